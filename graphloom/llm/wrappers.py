"""HTML main-text extraction by union-free regular-expression inference over the pages of a host.

1. Each page becomes a token stream (tags, with class, id and role for containers, and text slots), nested by its containers.
2. The streams of a host are aligned one after the other into its wrapper, level by level of containers. Tokens of one key and place
   match; what some pages lack becomes optional, what occurs in differing numbers becomes a repeated group, and a slot whose text
   differs is a text slot proper, while one that stays the same is template. A level holds each key once (or each of a fixed number of
   siblings), so the expression stays as small as the host's markup, and aligning is associative: map tasks align their own pages,
   partial wrappers are then aligned in the same way, and the order never matters. No task sees a host's pages together.
3. The wrapper's parts are labelled: article, other main containers, the rest; and side matter: containers that their tag or words
   mark, that hold little but links, or whose text stays the same over pages while the page's varies.
4. Every page is read through its host's wrapper: its tokens are aligned with the expression, and a text counts by the part that
   it falls in. Of the kinds of main part the page takes the best that it has text in. What no wrapper knows gives no text.

A null or empty html gives an empty text, a null url belongs to the host of the empty name. A very long page costs in proportion to its
length, and its markup alone stays in the wrapper. Rows that repeat are each answered; ties between parts can't occur, as all of the best
kind count. An empty table gives no rows. Extra columns pass through :func:`extract`, whatever their names, but for ``text``, which gives way.
White space is what ``str.split`` takes as such.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, stored

#: Bytes of wrapper labels that are broadcast at most; beyond, pages are joined with them by host.
BROADCAST_LIMIT = 16 << 20
#: Parts of wrappers that a map task holds before it hands them on, and shares in which a host's partial wrappers are aligned first.
HELD_PARTS, SHARES = 200_000, 16
#: Pages that must show the same text before it is template; share of link text that makes a menu within main text, and outside.
TEMPLATE_PAGES, MENU, LINKS = 3, 0.8, 0.5
#: Kinds of main part, best first.
ARTICLE, MAIN_TAG, NAMED_MAIN, REST = 1, 2, 4, 8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>|<[!?][^>]*>|[^<]+|<", re.S)
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Tags by what they do to text, and words of class, id or role that mark side matter.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select"}
CONTAINERS = set("html head body article main section div nav header footer aside form ul ol dl table figure dialog details".split())
INLINE = set("a abbr b bdi bdo big cite code em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr del time label".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SIDE_TAGS = {"head", "nav", "footer", "aside", "form", "dialog"}
SIDE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"cookies?|consent|notices?|alerts?|popup|modal|comments?|replies|respond|disqus|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|pagination|widgets?|toolbar|contentinfo|navigation|complementary)(?:$|[-_ ])",
    re.I,
)
MAIN = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|entry|story)(?:$|[-_ ])", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kinds are open, close, text; comments, declarations and raw elements are left out."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        s = m[0]
        if s[0] != "<" or s == "<":
            yield "text", "", s
            continue
        name = TAG.match(s)
        if not name:
            continue
        tag = name[1].lower()
        if s[1] == "/":
            yield "close", tag, ""
        elif tag in RAW and not s.endswith("/>"):
            close = re.compile(f"</{tag}", re.I).search(page, at)
            if close:
                stop = page.find(">", close.end())
                at = stop + 1 if stop >= 0 else end
            elif tag in ("script", "style"):
                at = end
        else:
            yield "open", tag, s


def signature(tag: str, source: str) -> str:
    """A container's name with its class, id and role, digits left out."""
    words = sorted({w for m in NAMED.finditer(source) for w in re.sub(r"\d+", "", m[2] or m[3] or m[4] or "").split()})
    return tag + "".join(f".{w}" for w in words) if words else tag


class Box:
    """A container of a page: its key and, in order, its boxes, its texts as (slot, text, in a link), and None where a block ends."""

    __slots__ = ("key", "items")

    def __init__(self, key: str) -> None:
        self.key, self.items = key, []


def outline(page: str) -> Box:
    """The page's stream nested by its containers, closed as browsers would. A text's slot is named by the block that it stands in."""
    stack = [Box("")]
    link, slot = 0, "#"
    for kind, tag, rest in tokens(page):
        if kind == "text":
            stack[-1].items.append((slot, rest, link > 0))
            continue
        opens = kind == "open"
        if tag == "a":
            link = link + 1 if opens else max(0, link - 1)
        if tag in INLINE:
            continue
        if tag not in CONTAINERS:
            stack[-1].items.append(None)
            if tag not in VOID:
                slot = f"#{tag}" if opens else "#"
            continue
        slot = "#"
        if opens:
            box = Box(signature(tag, rest))
            stack[-1].items.append(box)
            if not rest.endswith("/>"):
                stack.append(box)
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].key.split(".", 1)[0] == tag:
                    del stack[i:]
                    break
    return stack[0]


# A part of a wrapper is a list: occurrences, characters, those in links, hash of its text (None once it differed), and its level,
# key -> [occurrences of the parent that have it, place, repeated group or not, parts]. A fixed number of equal siblings are parts
# of their own, a repeated group is one part.


def shape(box: Box) -> list:
    """A page's container as the part of a wrapper that takes it alone."""
    level: dict[str, list] = {}
    slots: dict[str, list] = {}
    chars = links = 0
    whole = blake2b(digest_size=8)
    fresh = True
    for at, item in enumerate(box.items):
        if item is None:
            fresh = True
        elif isinstance(item, Box):
            part = shape(item)
            level.setdefault(item.key, [1, at, 0, []])[3].append(part)
            chars, links, fresh = chars + part[1], links + part[2], True
            whole.update(part[3].encode())
        elif text := "".join(item[1].split()).encode("utf-8", "replace"):
            own = slots.setdefault(item[0], [at, 0, 0, 0, blake2b(digest_size=8)])
            in_links = len(text) * item[2]
            for k, n in ((1, int(fresh or not own[1])), (2, len(text)), (3, in_links)):
                own[k] += n
            own[4].update(text)
            whole.update(text)
            chars, links, fresh = chars + len(text), links + in_links, False
    for slot, (at, runs, n, in_links, digest) in slots.items():
        level[slot] = [1, at, int(runs > 1), [[1, n, in_links, digest.hexdigest(), {}]]]
    return [1, chars, links, whole.hexdigest(), level]


def parts_of(part: list) -> int:
    return 1 + sum(parts_of(p) for entry in part[4].values() for p in entry[3])


def align(a: list, b: list) -> list:
    """The wrapper part that takes what either takes; ``a`` is changed."""
    for i in range(3):
        a[i] += b[i]
    if a[3] != b[3]:
        a[3] = None
    for key, other in b[4].items():
        own = a[4].get(key)
        if own is None:
            a[4][key] = other  # optional: not all occurrences of the parent have it
            continue
        own[0] += other[0]
        own[1] = min(own[1], other[1])
        if own[2] or other[2] or len(own[3]) != len(other[3]):  # a repeated group
            first, *rest = own[3]
            for part in (*rest, *other[3]):
                align(first, part)
            own[2], own[3] = 1, [first]
        else:
            for x, y in zip(own[3], other[3], strict=True):
                align(x, y)
    return a


def expression(part: list) -> str:
    """A part's level as a union-free regular expression over tokens."""
    out = []
    for key, (have, at, repeated, parts) in part[4].items():
        for i, p in enumerate(parts):
            if key[0] == "#":
                tag = key[1:]
                text = "#text" if p[3] is None else "#same"
                own = f"<{tag}> {text} </{tag}>" if tag else text
            else:
                own = " ".join(x for x in (f"<{key}>", expression(p), f"</{key.split('.', 1)[0]}>") if x)
            mark = ("*" if repeated else "?") if have < part[0] else "+" if repeated else ""
            out.append((at, key, i, f"( {own} ){mark}" if mark else own))
    return " ".join(x[3] for x in sorted(out))


def side(key: str, in_article: bool) -> bool:
    """Whether a container's tag or words mark menus, notices, adverts, forms, comments and the like."""
    tag, _, names = key.partition(".")
    if tag in SIDE_TAGS or tag == "header" and not in_article:
        return True
    return bool(names) and tag != "body" and any(SIDE.search(n) and not MAIN.search(n) for n in names.split("."))


def main_kind(key: str) -> int:
    tag, _, names = key.partition(".")
    if tag == "article":
        return ARTICLE
    if tag == "main":
        return MAIN_TAG
    return NAMED_MAIN if names and any(MAIN.search(n) for n in names.split(".")) else 0


def label(part: list, in_main: int = REST, varies: bool | None = None) -> dict:
    """What the wrapper says of each part: ``m`` kinds of main part that it is in, ``d`` side matter, ``s`` slots of template text, ``k`` its level."""
    if varies is None:
        varies = part[3] is None
    same = lambda p: varies and p[3] is not None and p[0] >= TEMPLATE_PAGES
    out: dict = {"m": in_main}
    level: dict[str, list] = {}
    slots = []
    for key, (_, _, _, parts) in part[4].items():
        if key[0] == "#":
            if in_main == REST and any(same(p) and p[1] for p in parts):
                slots.append(key)
            continue
        kind = in_main | main_kind(key)
        own = []
        for p in parts:
            if side(key, bool(kind & (ARTICLE | MAIN_TAG))):
                own.append({"d": 1})
                continue
            # a part that is main text itself is never a menu or a template
            begins = kind != in_main or key.split(".", 1)[0] in ("html", "body")
            menu = p[2] > p[1] * (LINKS if kind == REST else MENU)
            if not begins and (menu or same(p) and p[1]):
                own.append({"d": 1})
            else:
                own.append(label(p, kind, p[3] is None if begins else varies))
        level[key] = own
    if level:
        out["k"] = level
    if slots:
        out["s"] = slots
    return out


def read(page: str, labels: dict) -> str:
    """The main text of a page through its host's wrapper."""
    pieces: list[tuple[int, str]] = []

    def collect(box: Box, own: dict) -> None:
        kinds, known, template = own.get("m", 0), own.get("k", {}), own.get("s", ())
        seen: dict[str, int] = {}
        for item in box.items:
            if item is None:
                pieces.append((0, " "))
            elif isinstance(item, Box):
                place = seen[item.key] = seen.get(item.key, -1) + 1
                parts = known.get(item.key)
                pieces.append((0, " "))
                if parts:
                    part = parts[min(place, len(parts) - 1)]
                    if not part.get("d"):
                        collect(item, part)
                pieces.append((0, " "))
            elif item[0] not in template:
                pieces.append((kinds, item[1]))

    collect(outline(page), labels)
    for kind in (ARTICLE, MAIN_TAG, NAMED_MAIN, REST):
        if any(k & kind and not t.isspace() for k, t in pieces):
            return " ".join("".join(_html.unescape(t) if k else t for k, t in pieces if not k or k & kind).split())
    return ""


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_column(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """``url, html`` -> one row a host: ``host, pages, wrapper`` (expression) and ``labels`` (JSON of :func:`label`)."""

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0
        dump = lambda: pd.DataFrame([(h, json.dumps(p)) for h, p in held.items()], columns=["host", "partial"])
        for batch in batches:
            for url, page in zip(batch["url"], batch["html"], strict=True):
                part, host = shape(outline(page or "")), host_of(url)
                size += parts_of(part)
                held[host] = align(held[host], part) if host in held else part
                if size > HELD_PARTS:
                    size = sum(map(parts_of, held.values()))
                    if size > HELD_PARTS // 2:
                        yield dump()
                        held.clear()
                        size = 0
        yield dump()

    def aligned(batches: Iterator[pd.DataFrame]) -> dict[str, list]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, text in zip(batch["host"], batch["partial"], strict=True):
                part = json.loads(text)
                held[host] = align(held[host], part) if host in held else part
        return held

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(h, json.dumps(p)) for h, p in aligned(batches).items()], columns=["host", "partial"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [(h, p[0], expression(p), json.dumps(label(p))) for h, p in aligned(batches).items()]
        yield pd.DataFrame(out, columns=["host", "pages", "wrapper", "labels"])

    found = pages.select("url", "html").mapInPandas(partials, "host string, partial string")
    found = found.repartition("host", F.spark_partition_id() % SHARES).mapInPandas(shares, "host string, partial string")
    return found.repartition("host").mapInPandas(whole, "host string, pages long, wrapper string, labels string")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``pages`` with the column ``text``; an input column of that name gives way."""
    spark = pages.sparkSession
    pages = pages.drop("text")
    names = pages.columns
    size = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("labels")), F.lit(0)).alias("n")).first()["n"]
    known = None
    rows = pages
    if size <= BROADCAST_LIMIT:
        known = spark.sparkContext.broadcast({r["host"]: json.loads(r["labels"]) for r in wrappers.select("host", "labels").collect()})
    else:
        own = wrappers.select(F.col("host").alias("__host"), F.col("labels").alias("__labels"))
        rows = pages.withColumn("__own", host_column(F.col("url"))).join(own, F.col("__own") == F.col("__host"), "left").drop("__own", "__host")
    url, page = names.index("url"), names.index("html")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages_ = batch.column(url).to_pylist(), batch.column(page).to_pylist()
            if known is not None:
                labels = [known.value.get(host_of(u), {}) for u in urls]
            else:
                labels = [json.loads(x or "{}") for x in batch.column(batch.num_columns - 1).to_pylist()]
            out = pa.array([read(p or "", d) for p, d in zip(pages_, labels, strict=True)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], out], [*names, "text"])

    return rows.mapInArrow(texts, f"{pages.schema.simpleString()[7:-1]}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages, stored(infer(pages), "wrappers"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The query's SQL: tags are dropped in this order; within ``<article>`` the side elements go whole (none is nested in one of its name).
_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "middot": "·", "copy": "©", "nbsp": " ", "amp": "&"}
_TEXT = "coalesce(regexp_extract(html, '<article[^>]*>(.*)</article>', 1, 's'), '')"
for _tag in ("script", "style", "nav", "aside", "form", "footer"):
    _TEXT = f"regexp_replace({_TEXT}, '<{_tag}[ >].*?</{_tag}>', ' ', 'gs')"
for _word in ("ad", "comments", "sidebar", "notice"):
    _TEXT = f"""regexp_replace({_TEXT}, '<div class="{_word}">.*?</div>', ' ', 'gs')"""
_TEXT = rf"regexp_replace({_TEXT}, '</?(b|i|a|em|strong|span)( [^>]*)?>', '', 'g')"
_TEXT = f"regexp_replace({_TEXT}, '<[^>]*>', ' ', 'g')"
for _name, _char in _ENTITIES.items():
    _TEXT = "replace(" + _TEXT + f", '&{_name};', " + ("chr(39)" if _char == "'" else f"'{_char}'") + ")"
SQL = rf"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace({_TEXT}, '\s+', ' ', 'g')) AS text FROM pages)
"""
