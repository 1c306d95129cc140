"""Secret scans with multipart credential linking (native DataFrame functions alone).

Base kinds (``assign``, ``access``, ``hex``) always count. Weak kinds are reported only where complementary
parts lie within ``SCOPE`` code points of each other in one text: an access identifier (``ident``, or a base
``access``) next to a secret (``token``, or a base ``assign`` or ``hex``), and an ``endpoint`` next to both.

Spans are found by marking matches with control characters and summing the lengths of the pieces, in code
points. Where a text holds those control characters itself they are replaced, one for one, by a character that
no pattern takes, so offsets and matches stay. Null texts count as empty; empty texts and empty tables give no spans and no rows. A very
long text costs in proportion to its length and its spans. Spans that tie on their start sort by kind. Rows need no key, rows that repeat
are each answered, nothing shuffles. Extra columns, whatever their names, pass through :func:`scan`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns as (kind, head, value, least code points of the whole match, of the value).
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)""", "([A-Za-z0-9+/_.=-]+)", 0, 6),
    # the least length is part of these two: a shorter run holds no match, and a longer one is taken whole either way
    ("access", "(AKIA)", "([A-Z0-9]{16,})", 20, 0),
    ("hex", "()", "([0-9a-f]{24,})", 24, 0),
)
WEAK = (
    ("ident", r"""((?i:client_?id|user_?name|login|account_?id|key_?id)["']?\x20*[:=]\x20*["']?)""", "([A-Za-z0-9@._-]+)", 0, 3),
    ("endpoint", "(https?://)", r"([A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?)", 0, 4),
    ("token", "()", "([A-Za-z0-9+/_-]{20,})", 20, 0),
)
KINDS = [k[0] for k in (*BASE, *WEAK)]
SCOPE = 200
#: Pieces of text that are handled as one block, and bits of the largest number of spans in a text.
BLOCK, LONGEST_BITS = 256, 28
OPEN, MID, CLOSE, STAND_IN = "\x01", "\x03", "\x02", "�"
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def safe_text(text: Column) -> Column:
    """Free of the marks that :func:`find` sets, with the same length in code points."""
    text = F.coalesce(text, F.lit(""))
    marked = text.contains(OPEN) | text.contains(MID) | text.contains(CLOSE)
    return F.when(marked, F.translate(text, OPEN + MID + CLOSE, STAND_IN * 3)).otherwise(text)


def find(text: Column, kind: str, head: str, value: str, least: int, least_value: int) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,kind,end>>``; those too short are dropped."""
    pieces = F.split(F.regexp_replace(text, head + value, f"{OPEN}$1{MID}$2{CLOSE}"), OPEN, -1)
    mixed = kind == "token"  # a word of letters alone, or a number, is no token

    def step(done: Column, piece: Column) -> Column:
        first, second = F.split_part(piece, F.lit(MID), F.lit(1)), F.split_part(piece, F.lit(MID), F.lit(2))
        second = F.split_part(second, F.lit(CLOSE), F.lit(1))
        size = F.length(first) + F.length(second)
        end = done["at"] + size
        good = (size >= least) & (F.length(second) >= least_value)
        if mixed:
            good = good & second.rlike("[0-9]") & second.rlike("[A-Z]") & second.rlike("[a-z]")
        span = F.struct(done["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(
            (done["at"] + F.length(piece) - 2).alias("at"),
            F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    def spans(pieces: Column) -> Column:
        def block(done: Column, i: Column) -> Column:
            # spans are gathered by blocks of pieces: appending to one long array would copy it for every span
            start = F.struct(done["at"].alias("at"), nothing().alias("spans"))
            own = F.aggregate(F.slice(pieces, i * BLOCK + 2, F.lit(BLOCK)), start, step)
            return bind(own, lambda x: F.struct(x["at"].alias("at"), F.concat(done["blocks"], F.array(x["spans"])).alias("blocks")))

        start = F.struct(F.length(pieces[0]).cast("long").alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("blocks"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, start, block, lambda d: F.flatten(d["blocks"]))

    return bind(pieces, spans)


def nothing() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def meets(w: Column, spans: Column, reach: int) -> Column:
    """Whether a span of ``spans``, which are in order and apart, comes within ``reach`` of ``w``: only the last that starts
    no later than ``w`` and the next one can, and a binary search finds them."""
    n = F.size(spans)

    def halve(low: Column, bit: Column) -> Column:
        # ``low`` spans start no later; tries that many more
        more = low + bit
        return F.when((more <= n) & (F.get(spans, more - 1)["start"] <= w["start"]), more).otherwise(low)

    before = F.aggregate(F.array(*[F.lit(1 << b) for b in range(LONGEST_BITS - 1, -1, -1)]), F.lit(0), halve)

    def hit(k: Column) -> Column:
        left = (k > 0) & (F.get(spans, k - 1)["end"] + reach > w["start"])
        right = (k < n) & (F.get(spans, k)["start"] < w["end"] + reach)
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    return F.when(n == 0, False).otherwise(bind(before, hit))


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``base_spans`` and ``linked_spans``, sorted by start and kind. A span is start, kind (index in KINDS), end.

    Weak kinds are looked for only where a text holds complements for them. Spans of a kind are in order and apart, so each join of
    one kind to another within the scope is a search for neighbours, not a comparison of all pairs.
    """
    kinds = {k[0]: k for k in (*BASE, *WEAK)}
    col = lambda k: F.col(f"__{k}")
    has = lambda k: F.size(col(k)) > 0
    at = lambda k, test: F.when(test, find(F.col("__safe"), *kinds[k])).otherwise(nothing())
    out = docs.withColumn("__safe", safe_text(F.col("text")))
    heads = out["__safe"].rlike("|".join(kinds[k][1] for k in ("assign", "ident")))
    out = out.withColumn("__heads", heads)
    out = out.withColumns({
        "__assign": at("assign", F.col("__heads")), "__ident": at("ident", F.col("__heads")),
        "__access": at("access", F.col("__safe").contains("AKIA")), "__hex": at("hex", F.col("__safe").rlike(kinds["hex"][2])),
    })

    # a weak span that covers part of a base one says nothing new
    def fresh(weak: str) -> Column:
        base = [col(k[0]) for k in BASE]
        return F.filter(col(weak), lambda w: ~(meets(w, base[0], 0) | meets(w, base[1], 0) | meets(w, base[2], 0)))

    out = out.withColumn("__ident", F.when(has("ident"), fresh("ident")).otherwise(nothing()))
    out = out.withColumn("__token", at("token", has("access") | has("ident")))
    out = out.withColumn("__token", F.when(has("token"), fresh("token")).otherwise(nothing()))
    both = (has("access") | has("ident")) & (has("assign") | has("hex") | has("token"))
    out = out.withColumn("__endpoint", at("endpoint", both & F.col("__safe").contains("://")))
    out = out.withColumn("__endpoint", F.when(has("endpoint"), fresh("endpoint")).otherwise(nothing()))

    by_id = lambda w: meets(w, col("access"), SCOPE) | meets(w, col("ident"), SCOPE)
    by_key = lambda w: meets(w, col("assign"), SCOPE) | meets(w, col("hex"), SCOPE) | meets(w, col("token"), SCOPE)
    linked = F.array_sort(F.concat(
        F.filter(col("ident"), by_key), F.filter(col("token"), by_id), F.filter(col("endpoint"), lambda w: by_id(w) & by_key(w))
    ))
    base = F.concat(*[col(k[0]) for k in BASE])
    weak = has("ident") | has("token") | has("endpoint")
    out = out.withColumn("base_spans", F.when(F.size(base) > 1, F.array_sort(base)).otherwise(base)).withColumn("linked_spans", F.when(weak, linked).otherwise(nothing()))
    return out.drop("__safe", "__heads", *[f"__{k}" for k in KINDS])


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs)
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE)],
        F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base_spans", "linked_spans"))).alias("spans"),
    )


def _sql() -> str:
    finds = []
    for i, (kind, head, value, least, least_value) in enumerate((*BASE, *WEAK)):
        pattern = (head + value).replace("'", "''")
        mixed = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')" if kind == "token" else ""
        finds.append(f"""
  SELECT row, {i} AS kind, s AS start, s + length(h) + length(v) AS stop FROM (
    SELECT row, split_part(p, chr(3), 1) AS h, split_part(split_part(p, chr(3), 2), chr(2), 1) AS v, n,
      (sum(length(p) - 2 * (n > 1)::INT) OVER (PARTITION BY row ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS s FROM (
      SELECT row, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (
        SELECT row, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\1' || chr(3) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM d)))
  WHERE n > 1 AND length(h) + length(v) >= {least} AND length(v) >= {least_value}{mixed}""")
    near = f"a.row = w.row AND w.start < a.stop + {SCOPE} AND a.start < w.stop + {SCOPE}"
    names = "['" + "','".join(KINDS) + "'][kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), repeat(chr(65533), 3)) AS text FROM documents),
f AS ({' UNION ALL '.join(finds)}),
b AS (SELECT * FROM f WHERE kind < 3),
w AS (SELECT * FROM f w WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM b a WHERE a.row = w.row AND w.start < a.stop AND a.start < w.stop)),
i AS (SELECT * FROM b WHERE kind = 1 UNION ALL SELECT * FROM w WHERE kind = 3),
k AS (SELECT * FROM b WHERE kind <> 1 UNION ALL SELECT * FROM w WHERE kind = 5),
s AS (SELECT * FROM b UNION ALL SELECT * FROM w WHERE
  (kind = 3 OR EXISTS (SELECT 1 FROM i a WHERE {near})) AND (kind = 5 OR EXISTS (SELECT 1 FROM k a WHERE {near}))),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg({names}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg({names}, ',' ORDER BY start, kind) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
"""


SQL = _sql()
