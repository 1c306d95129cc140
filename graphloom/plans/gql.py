"""A GQL front end: query text is parsed to patterns and clauses and compiled to DataFrame joins.

A node variable is a struct column of its properties with ``id`` and ``_label``, an edge variable one with ``src, dst, rel``; expressions
are then Spark SQL over these columns, and Catalyst prunes what no expression reads. Properties of mixed JSON are variants: MIN, MAX and ORDER BY take
them by the total order of ``functions/order.py``, SUM and AVG by their exact numbers. What has no mapping raises :class:`GqlError`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import order
from ..graph import GraphCatalogue, GraphError
from ..operators import paths
from ..storage import stored


class GqlError(GraphError):
    """A statement that can't be parsed or has no mapping."""


def unsupported(what: str) -> GqlError:
    return GqlError(f"GQL feature not supported: {what}")


TOKEN = re.compile(r"\s*(?:(--[^>\-\[(][^\n]*|//[^\n]*)|('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(\d+\.\d+|\d+)|([A-Za-z_]\w*)|(<>|<=|>=|\|\||<-|->|.))", re.S)
CLAUSES = "MATCH OPTIONAL WHERE FILTER FOR RETURN SELECT FROM GROUP HAVING ORDER OFFSET SKIP LIMIT INSERT SET REMOVE DETACH DELETE LET NEXT UNION EXCEPT INTERSECT OTHERWISE YIELD MERGE CALL".split()
#: Comparisons of JSON texts in the total order of mixed values.
JSON_ORDER = {"_GQL_LT": "<", "_GQL_LE": "<=", "_GQL_GT": ">", "_GQL_GE": ">=", "_GQL_EQ": "=", "_GQL_NE": "<>"}
AGGREGATE = re.compile(r"\b(count|sum|avg|min|max|min_by|max_by|collect_list|percentile_cont|percentile_disc)\s*\(", re.I)
#: Branches and width of a repeated group, as documented limits; what exceeds them is refused.
GROUP_BRANCHES, GROUP_WIDTH = 8, 4


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip().rstrip(";").strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise GqlError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        if not m[1]:
            out.append(next(g for g in m.groups()[1:] if g))
    return out


@dataclass
class Node:
    var: str
    label: Callable[[str], bool] | None = None
    props: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    named: bool = False


@dataclass
class Edge:
    var: str
    label: Callable[[str], bool] | None = None
    props: dict[str, str] = field(default_factory=dict)
    where: str | None = None
    way: str = ">"
    low: int | None = None
    high: int | None = 1  # None: no upper bound
    named: bool = False


@dataclass
class Group:
    items: list
    low: int
    high: int


@dataclass
class Path:
    var: str | None
    mode: str
    shortest: str | None
    items: list


class Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i, self.hidden = tokens(text), 0, 0

    def peek(self, n: int = 0) -> str:
        return self.t[self.i + n] if self.i + n < len(self.t) else ""

    def is_(self, *words: str) -> bool:
        return all(self.peek(n).upper() == w for n, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise GqlError(f"expected {word} before {self.peek()!r}")

    def next(self) -> str:
        if self.i >= len(self.t):
            raise GqlError("the statement ends too early")
        self.i += 1
        return self.t[self.i - 1]

    def name(self) -> str:
        t = self.next()
        if t[0] in "`\"":
            return t[1:-1]
        if not re.match(r"[A-Za-z_]", t):
            raise GqlError(f"expected a name, found {t!r}")
        return t

    def fresh(self) -> str:
        self.hidden += 1
        return f"__v{self.hidden}"

    def until(self, stop: set[str], commas: bool = False) -> list[str]:
        """Tokens of an expression, up to a clause word or a closing bracket of what is around it."""
        out, depth = [], 0
        while self.i < len(self.t):
            t = self.peek()
            if not depth and (t.upper() in stop or t in ")]}" or commas and t == ","):
                break
            depth += (t in "([{") - (t in ")]}")
            out.append(self.next())
        if not out:
            raise GqlError(f"expected an expression before {self.peek()!r}")
        return out

    # patterns
    def label(self) -> Callable[[str], bool]:
        def atom() -> Callable[[str], bool]:
            if self.take("!"):
                f = atom()
                return lambda x: not f(x)
            if self.take("("):
                f = either()
                self.need(")")
                return f
            if self.take("%"):
                return lambda x: True
            n = self.name()
            f = lambda x: x == n
            f.only = n
            return f

        def both() -> Callable[[str], bool]:
            f = [atom()]
            while self.take("&"):
                f.append(atom())
            return f[0] if len(f) == 1 else lambda x: all(g(x) for g in f)

        def either() -> Callable[[str], bool]:
            f = [both()]
            while self.take("|"):
                f.append(both())
            return f[0] if len(f) == 1 else lambda x: any(g(x) for g in f)

        return either()

    def filler(self, end: str):
        var, named, label, props, where = "", False, None, {}, None
        if re.match(r"[A-Za-z_`]", self.peek() or " ") and not self.is_("IS") and not self.is_("WHERE"):
            var, named = self.name(), True
        if self.take(":") or self.take("IS"):
            label = self.label()
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                props[key] = expression(self.until(set(), commas=True))
                self.take(",")
        if self.take("WHERE"):
            where = expression(self.until(set()))
        self.need(end)
        return var or self.fresh(), label, props, where, named

    def node(self) -> Node:
        self.need("(")
        var, label, props, where, named = self.filler(")")
        return Node(var, label, props, where, named)

    def quantifier(self) -> tuple[int, int | None] | None:
        if self.take("*"):
            return 0, None
        if self.take("+"):
            return 1, None
        if self.take("?"):
            return 0, 1
        if self.is_("{") and (self.peek(1).isdigit() or self.peek(1) == ","):
            self.need("{")
            low = int(self.next()) if self.peek().isdigit() else 0
            high = low
            if self.take(","):
                high = int(self.next()) if self.peek().isdigit() else None
            self.need("}")
            if high is not None and high < low:
                raise GqlError("a quantifier's upper bound is below its lower bound")
            return low, high
        return None

    def edge(self) -> Edge:
        left = self.take("<-") or (self.is_("<") and self.take("<", "-"))
        if not left and not (self.take("-") or self.take("~")):
            if self.take("->"):
                return self._quantified(Edge(self.fresh(), way=">"))
            raise GqlError(f"expected an edge before {self.peek()!r}")
        e = Edge(self.fresh())
        if self.take("["):
            var, label, props, where, named = self.filler("]")
            e = Edge(var, label, props, where, named=named)
            right = self.take("->")
            if not right and not self.take("-") and not self.take("~"):
                raise GqlError("an edge is not closed")
        else:
            right = self.take("->") or not left and self.is_(">") and self.take(">")
            if not right:
                self.take("-")
        e.way = "<" if left and not right else ">" if right and not left else "-"
        return self._quantified(e)

    def _quantified(self, e: Edge) -> Edge:
        q = self.quantifier()
        return e if q is None else replace(e, low=q[0], high=q[1])

    def items(self) -> list:
        out = []
        while True:
            if self.is_("(") and (self.peek(1) == "(" or self.peek(1) == "["):
                self.need("(")
                inner = self.items()
                self.need(")")
                q = self.quantifier()
                if q is None:
                    out += inner
                elif q[1] is None or q[1] - q[0] > GROUP_WIDTH or q[1] - q[0] + 1 > GROUP_BRANCHES:
                    raise unsupported("a repeated group of so wide a range")
                else:
                    out.append(Group(inner, *q))
            elif self.is_("("):
                out.append(self.node())
            elif self.peek() in ("-", "<-", "->", "~") or self.is_("<", "-"):
                out.append(self.edge())
            else:
                break
        if not out:
            raise GqlError(f"expected a pattern before {self.peek()!r}")
        return out

    def path(self) -> Path:
        var, shortest, mode = None, None, "WALK"
        if self.peek(1) == "=":
            var = self.name()
            self.need("=")
        for word in ("ALL", "ANY"):
            if self.take(word, "SHORTEST"):
                shortest = word
            elif self.is_(word) and self.peek(1) != "":
                raise unsupported(f"{word} PATHS")
        if self.is_("SHORTEST"):
            raise unsupported("SHORTEST k")
        for word in ("WALK", "TRAIL", "ACYCLIC", "SIMPLE"):
            if self.take(word):
                mode = word
        self.take("PATH") or self.take("PATHS")
        return Path(var, mode, shortest, self.items())


def expression(parts: list[str]) -> str:
    """GQL tokens as Spark SQL text."""
    out, i = [], 0
    while i < len(parts):
        t, up = parts[i], parts[i].upper()
        if up in ("STDDEV_POP", "STDDEV_SAMP", "TIME"):
            raise unsupported(up)
        if up in ("PERCENTILE_CONT", "PERCENTILE_DISC") and parts[i + 1 : i + 2] == ["("]:
            end = _close(parts, i + 1)
            args = _split(parts[i + 2 : end])
            inner = [expression(a) for a in args]
            out.append(f"{up}({inner[1]}) WITHIN GROUP (ORDER BY {inner[0]})")
            i = end + 1
            continue
        if up in JSON_ORDER and parts[i + 1 : i + 2] == ["("]:
            end = _close(parts, i + 1)
            args = [expression(a) for a in _split(parts[i + 2 : end])]
            if len(args) != 2:
                raise GqlError(f"{up} takes two values")
            out.append(f"(_gql_sortkey({args[0]}) {JSON_ORDER[up]} _gql_sortkey({args[1]}))")
            i = end + 1
            continue
        if up in ("_GQL_SORTKEY", "_GQL_LIST_CHECKED"):
            t = t.lower()
        if up == "PROPERTY_EXISTS" and parts[i + 1 : i + 2] == ["("]:
            end = _close(parts, i + 1)
            a, b = _split(parts[i + 2 : end])
            out.append(f"({expression(a)}.{b[0].strip(chr(34) + chr(39) + '`')} IS NOT NULL)")
            i = end + 1
            continue
        if up in ("ELEMENT_ID", "PATH_LENGTH", "LABELS", "LABEL") and parts[i + 1 : i + 2] == ["("]:
            end = _close(parts, i + 1)
            inner = expression(parts[i + 2 : end])
            out.append({"ELEMENT_ID": f"{inner}.id", "PATH_LENGTH": f"size({inner}.rels)", "LABELS": f"array({inner}._label)", "LABEL": f"{inner}._label"}[up])
            i = end + 1
            continue
        if up == "IS" and "LABELED" in [p.upper() for p in parts[i + 1 : i + 3]]:
            negated = parts[i + 1].upper() == "NOT"
            i += 3 if negated else 2
            out.append(f"._label {'<>' if negated else '='} '{parts[i].strip(chr(34) + '`')}'")
            i += 1
            continue
        if t == "[":
            end = _close(parts, i, "[", "]")
            before = out[-1] if out else ""
            inner = parts[i + 1 : end]
            if before.upper() == "IN":
                if not inner:
                    raise unsupported("IN with an empty list")
                out.append("(" + ", ".join(expression(x) for x in _split(inner)) + ")")
            elif before and re.match(r"[\w)\]`]", before[-1]) and before.upper() not in ("IN", "AND", "OR", "NOT", "="):
                out.append(f"[{expression(inner)}]")
            else:
                kinds = {("s" if p[0][0] in "'\"" else "n") for p in _split(inner) if len(p) == 1 and (p[0][0] in "'\"" or p[0][0].isdigit())} if inner else set()
                if len(kinds) > 1:
                    raise GqlError("a list literal mixes types")
                out.append("array(" + ", ".join(expression(p) for p in _split(inner)) + ")" if inner else "array()")
            i = end + 1
            continue
        if t[0] == '"':
            t = "'" + t[1:-1].replace("'", "\\'") + "'"
        out.append({"CHAR_LENGTH": "char_length", "CHARACTER_LENGTH": "char_length", "SIZE": "size"}.get(up, t))
        i += 1
    text = ""
    for p in out:
        glue = not text or p in (".", ")", ",", "(", "[") or p.startswith(("._label", ".", "[")) or text[-1] in ".(["
        spaced = p == "(" and re.search(r"\b(IN|AND|OR|NOT|THEN|ELSE|WHEN)$", text, re.I) or p == "(" and text[-1:] in "+-*/=<>,"
        text += p if glue and not spaced else f" {p}"
    return text


def _close(parts: list[str], at: int, a: str = "(", b: str = ")") -> int:
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == a) - (parts[i] == b)
        if not depth:
            return i
    raise GqlError(f"{a} is not closed")


def _split(parts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for p in parts:
        depth += (p in "([{") - (p in ")]}")
        if p == "," and not depth:
            out.append([])
        else:
            out[-1].append(p)
    return out


class GqlSession:
    """Runs statements against a catalogue; results are DataFrames, changes make new versions of its tables."""

    def __init__(self, spark: SparkSession, catalogue: GraphCatalogue) -> None:
        self.spark, self.home = spark, catalogue
        self.graphs: dict[str, GraphCatalogue] = {"main": catalogue}
        self.catalogue, self.types = catalogue, {"main": "TYPED"}
        spark.udf.register("_gql_sortkey", order.sort_key_udf)
        spark.udf.register("_gql_list_checked", order.list_checked_udf)

    # tables
    def nodes(self, n: Node) -> DataFrame:
        parts = [
            df.select(F.struct(*df.columns, F.lit(label).alias("_label")).alias(n.var))
            for label, df in self.catalogue.node_tables.items()
            if n.label is None or n.label(label)
        ]
        if not parts:
            raise GqlError("no node table has such a label")
        return self._narrow(_union(parts, n.var), n)

    def edges(self, e: Edge) -> DataFrame:
        parts = []
        for label, pairs in self.catalogue.edge_tables.items():
            if e.label is None or e.label(label):
                for source, target, df in pairs:
                    if "rel" not in df.columns:
                        df = df.withColumn("rel", F.xxhash64(F.lit(label), *df.columns))
                    ends = [F.lit(source).alias("_from"), F.lit(target).alias("_to"), F.lit(label).alias("_label")]
                    parts.append(df.select(F.struct(*df.columns, *ends).alias(e.var)))
        if not parts:
            raise GqlError("no edge table has such a label")
        return self._narrow(_union(parts, e.var), e)

    @staticmethod
    def _narrow(df: DataFrame, item: Node | Edge) -> DataFrame:
        for key, value in item.props.items():
            df = df.where(F.expr(f"{item.var}.`{key}` = {value}"))
        return df.where(F.expr(item.where)) if item.where else df

    # patterns
    def match(self, path: Path) -> DataFrame:
        branches = expand(path.items)
        done = [self._flat(path, flat, lists) for flat, lists in branches]
        return reduce(lambda a, b: a.unionByName(b), done)

    def _flat(self, path: Path, flat: list, lists: dict[str, list[str]]) -> DataFrame:
        first = flat[0]
        df = self.nodes(first)
        walked: list[tuple[str, Column]] = []
        stops = [first.var]
        for e, n in zip(flat[1::2], flat[2::2], strict=True):
            prev = stops[-1]
            if e.low is None:
                df = self._hop(df, prev, e, n)
                walked.append(("one", F.col(f"`{e.var}`.rel")))
            else:
                df = self._span(df, prev, e, n, path)
                walked.append(("many", F.col(e.var)))
            stops.append(n.var)
        rels = F.concat(*[F.array(c.cast("long")) if kind == "one" else c for kind, c in walked]) if walked else F.expr("cast(array() as array<bigint>)")
        if path.var or path.mode != "WALK":
            inner = [F.array(F.col(f"`{s}`.id").cast("long")) if not i or walked[i - 1][0] == "one" else F.col(f"__nodes_{s}") for i, s in enumerate(stops)]
            df = df.withColumn("__p", F.struct(F.concat(*inner).alias("nodes"), rels.alias("rels")))
            size, some = F.size("__p.nodes"), F.size(F.array_distinct("__p.nodes"))
            if path.mode == "TRAIL":
                df = df.where(F.size("__p.rels") == F.size(F.array_distinct("__p.rels")))
            elif path.mode == "ACYCLIC":
                df = df.where(size == some)
            elif path.mode == "SIMPLE":
                closed = (F.col("__p.nodes")[0] == F.element_at("__p.nodes", -1)) & (size > 1)
                df = df.where((size == some) | closed & (size == some + 1))
        for name, parts in lists.items():
            df = df.withColumn(name, F.array(*[F.col(p) for p in parts]) if parts else F.array())
        keep = [F.col(v) for v in dict.fromkeys([x.var for x in flat if x.named] + list(lists))]
        return df.select(*keep, *([F.col("__p").alias(path.var)] if path.var else []), *([F.lit(1).alias("__one")] if not keep and not path.var else []))

    def _hop(self, df: DataFrame, prev: str, e: Edge, n: Node) -> DataFrame:
        edges = self.edges(e)
        ends = [("src", "_from"), ("dst", "_to")]
        ways = {">": [ends], "<": [ends[::-1]], "-": [ends, ends[::-1]]}[e.way]
        sides = []
        for i, ((a, la), (b, lb)) in enumerate(ways):
            own = edges.where(F.col(f"{e.var}.src") != F.col(f"{e.var}.dst")) if i else edges  # a loop has one direction
            sides.append(own.select(e.var, F.col(f"{e.var}.{a}").alias("__a"), F.col(f"{e.var}.{la}").alias("__la"), F.col(f"{e.var}.{b}").alias("__b"), F.col(f"{e.var}.{lb}").alias("__lb")))
        step = reduce(lambda x, y: x.unionByName(y), sides)
        df = df.join(step, (F.col(f"{prev}.id") == F.col("__a")) & (F.col(f"{prev}._label") == F.col("__la")))
        return self._arrive(df, n).drop("__a", "__la", "__b", "__lb")

    def _arrive(self, df: DataFrame, n: Node) -> DataFrame:
        same = (F.col(f"{n.var}.id") == F.col("__b")) & (F.col(f"{n.var}._label") == F.col("__lb"))
        if n.var in df.columns:
            return df.where(same)
        if not n.named and n.label is None and not n.props and not n.where:  # the edge says all that is asked of it
            return df.withColumn(n.var, F.struct(F.col("__b").alias("id"), F.col("__lb").alias("_label")))
        return df.join(self.nodes(n), same)

    def _span(self, df: DataFrame, prev: str, e: Edge, n: Node, path: Path) -> DataFrame:
        pairs = {(s, t) for label, own in self.catalogue.edge_tables.items() if e.label is None or e.label(label) for s, t, _ in own}
        if len({x for p in pairs for x in p}) != 1:
            raise unsupported("a quantified edge between several node tables")
        label = next(iter(pairs))[0]
        own = self.edges(e).select(f"{e.var}.src", f"{e.var}.dst", f"{e.var}.rel")
        turned = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel")
        own = {">": own, "<": turned, "-": own.union(turned.where("src <> dst"))}[e.way]
        start = df.select(F.col(f"{prev}.id").alias("id")).distinct()
        if e.high is None and path.mode == "WALK" and not path.shortest:
            raise unsupported("an open quantifier in a WALK, which may be endless: give a bound, a path mode or SHORTEST")
        if path.shortest:
            found = paths.shortest_paths(own, start, path.shortest, e.high, e.low).where(F.size("rels") >= e.low)
        else:
            found = paths.walks(own, e.low, e.high, path.mode, start)
        found = found.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.lit(label).alias("__lb"), F.col("rels").alias(e.var), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))).alias(f"__nodes_{n.var}"))
        df = df.join(found, F.col(f"{prev}.id") == F.col("__a"))
        return self._arrive(df, n).drop("__a", "__b", "__lb")

    @staticmethod
    def _join(a: DataFrame | None, b: DataFrame, optional: bool) -> DataFrame:
        if a is None:
            return b
        shared = [c for c in b.columns if c in a.columns and not c.startswith("__")]
        for c in shared:
            b = b.withColumnRenamed(c, f"__r_{c}")
        b = b.drop("__one")
        if not shared:
            if optional:
                return a.join(b, F.lit(True), "left")
            return a.crossJoin(b)  # patterns that share no variable are a product by the language's rules
        on = []
        for c in shared:  # nodes are the same by id and label, edges by their ends too; lists and paths as they are
            kind = a.schema[c].dataType
            names = set(kind.names) if isinstance(kind, T.StructType) else set()
            keys = ("id", "_label") if "id" in names and "src" not in names else ("rel", "_label", "src", "dst", "_from", "_to") if "rel" in names else ()
            own = [F.col(f"{c}.{k}").eqNullSafe(F.col(f"__r_{c}.{k}")) for k in keys if k in names] or [F.col(c) == F.col(f"__r_{c}")]
            on += own
        return a.join(b, reduce(lambda x, y: x & y, on), "left" if optional else "inner").drop(*[f"__r_{c}" for c in shared])

    # statements
    def run(self, text: str) -> DataFrame | None:
        """A query's rows; None for statements that only change something. EXPLAIN gives the plan (``plan``) of a query that changes nothing."""
        p = Parser(text)
        if not p.t:
            raise GqlError("the statement is empty")
        if p.take("EXPLAIN"):
            if {t.upper() for t in p.t} & {"INSERT", "SET", "REMOVE", "DELETE", "CREATE", "DROP", "SESSION"}:
                raise unsupported("EXPLAIN of a change")
            plan = self._query(p)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(plan,)], "plan string")
        if p.peek().upper() in ("CREATE", "DROP", "SESSION"):
            return self._catalogue(p)
        return self._query(p)

    def _catalogue(self, p: Parser) -> None:
        verb = p.next().upper()
        if verb == "SESSION":
            p.need("SET")
            p.take("PROPERTY")
            p.need("GRAPH")
            name = p.name()
            if name not in self.graphs:
                raise GqlError(f"[42000] graph {name} does not exist")
            self.catalogue = self.graphs[name]
            return None
        if p.is_("OR", "REPLACE"):
            raise unsupported(f"{verb} OR REPLACE")
        p.take("PROPERTY")
        kind = p.next().upper()
        maybe = p.take("IF", "NOT", "EXISTS") or p.take("IF", "EXISTS")
        if kind == "GRAPH":
            name = p.name()
            if verb == "CREATE":
                if name in self.graphs and not maybe:
                    raise GqlError(f"[42000] graph {name} already exists")
                self.graphs.setdefault(name, GraphCatalogue())
                self.types.setdefault(name, "ANY" if p.take("ANY") else "TYPED")
            elif name not in self.graphs and not maybe:
                raise GqlError(f"[42000] graph {name} does not exist")
            else:
                self.graphs.pop(name, None)
            return None
        if kind == "SCHEMA":
            name = "".join(p.t[p.i :])
            if verb == "CREATE":
                if name in self.home.schemas and not maybe:
                    raise GqlError(f"[42000] schema {name} already exists")
                self.home.schemas.add(name)
            elif name not in self.home.schemas and not maybe:
                raise GqlError(f"[42000] schema {name} does not exist")
            else:
                self.home.schemas.discard(name)
            return None
        raise unsupported(f"{verb} {kind}")

    def schemas(self) -> list[str]:
        return sorted(self.home.schemas)

    def _counted_pairs(self, p: Parser) -> DataFrame | None:
        """``MATCH (a)-[]-(n)-[]-(b) WHERE ... RETURN keys of n, count(*)`` without its pairs, or None (and nothing read) for any other statement.

        The two sides may be tied by one comparison of order. Each side is counted by node and value, and a pair count is a
        product of these counts with running sums, so the work grows with the sides and not with their product.
        """
        at = p.i
        found = self._pairs_plan(p) if p.take("MATCH") else None
        if found is None:
            p.i = at
        return found

    def _pairs_plan(self, p: Parser) -> DataFrame | None:
        stop = set(CLAUSES)
        path = p.path()
        flat = path.items
        if path.var or path.mode != "WALK" or path.shortest or [type(x) for x in flat] != [Node, Edge, Node, Edge, Node]:
            return None
        a, e, n, f, b = flat
        if not (a.named and n.named and b.named) or len({a.var, n.var, b.var}) < 3 or any(x.named or x.low is not None for x in (e, f)):
            return None
        asked = p.until(stop) if p.take("WHERE") else []
        if not p.take("RETURN") or p.take("DISTINCT"):
            return None
        returned = p.until(stop)
        if p.i < len(p.t) or {t.upper() for t in asked} & {"OR", "XOR", "NOT", "BETWEEN", "CASE", "EXISTS"}:
            return None
        of = lambda parts: {x for i, x in enumerate(parts) if x in (a.var, n.var, b.var) and (not i or parts[i - 1] != ".")}
        keys, counts = [], []
        for one in _split(returned):
            alias = None
            if len(one) > 2 and one[-2].upper() == "AS":
                alias, one = one[-1].strip('`"'), one[:-2]
            text = expression(one)
            if "".join(one).lower() == "count(*)":
                counts.append((text, alias or text))
            elif of(one) == {n.var} and not AGGREGATE.search(text):
                keys.append((text, alias or text))
            else:
                return None
        if not keys or not counts:
            return None
        own: dict[str, list[str]] = {a.var: [], b.var: []}
        order: tuple[str, str, str] | None = None
        conditions, depth = [[]] if asked else [], 0
        for t in asked:
            depth += (t in "([{") - (t in ")]}")
            if t.upper() == "AND" and not depth:
                conditions.append([])
            else:
                conditions[-1].append(t)
        for one in conditions:
            names = of(one)
            if len(names - {n.var}) < 2 and not {n.var, a.var} <= names and not {n.var, b.var} <= names:
                own[b.var if names == {b.var} else a.var].append(expression(one))
            elif len(one) == 7 and one[1] == one[5] == "." and one[3] in ("<", "<=", ">", ">=") and names == {one[0], one[4]} == {a.var, b.var} and not order:
                order = (expression(one[:3]), one[3], expression(one[4:])) if one[0] == a.var else (expression(one[4:]), one[3].translate(str.maketrans("<>", "><")), expression(one[:3]))
            else:
                return None
        sides = []
        for var, items, value in ((a.var, [a, e, n], order and order[0]), (b.var, [b, replace(f, way={">": "<", "<": ">"}.get(f.way, f.way)), n], order and order[2])):
            df = self.match(Path(None, "WALK", None, items))
            for text in own[var]:
                df = df.where(F.expr(text))
            node = [F.col(f"{n.var}.id").alias("__id"), F.col(f"{n.var}._label").alias("__label")]
            sides.append(df.select(*[F.expr(t).alias(f"__k{i}") for i, (t, _) in enumerate(keys)], *node, (F.expr(value) if value else F.lit(0)).alias("__v")))
        if sides[0].schema["__v"].dataType != sides[1].schema["__v"].dataType:
            return None
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        both = sides[0].withColumn("__l", one).withColumn("__r", none).unionByName(sides[1].withColumn("__l", none).withColumn("__r", one)).where("__v IS NOT NULL")
        names = [f"__k{i}" for i in range(len(keys))] + ["__id", "__label"]
        both = both.groupBy(*names, "__v").agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
        if order is None:
            pairs = both.withColumn("__n", F.col("__l") * F.col("__r"))
        else:
            # ranges of values are summed apart, each from where the ranges before it end
            cut = stored(both.repartitionByRange("__id", "__label", "__v").withColumn("__piece", F.spark_partition_id()), "values")
            before = W.Window.partitionBy("__id", "__label").orderBy("__piece" if order[1][0] == "<" else F.col("__piece").desc()).rowsBetween(W.Window.unboundedPreceding, -1)
            starts = cut.groupBy("__id", "__label", "__piece").agg(F.sum("__l").alias("__l")).select("__id", "__label", "__piece", F.coalesce(F.sum("__l").over(before), none).alias("__start"))
            last = 0 if order[1].endswith("=") else -1
            upto = W.Window.partitionBy("__id", "__label", "__piece").orderBy("__v" if order[1][0] == "<" else F.col("__v").desc()).rowsBetween(W.Window.unboundedPreceding, last)
            pairs = cut.withColumn("__upto", F.coalesce(F.sum("__l").over(upto), none)).join(starts, ["__id", "__label", "__piece"])
            pairs = pairs.withColumn("__n", F.col("__r") * (F.col("__start") + F.col("__upto")))
        made = pairs.groupBy(*[F.col(f"__k{i}") for i in range(len(keys))]).agg(F.sum("__n").alias("__n")).where("__n > 0")
        given = {alias: F.col(f"__k{i}") for i, (_, alias) in enumerate(keys)} | {alias: F.col("__n") for _, alias in counts}
        aliases = []
        for one in _split(returned):
            named = len(one) > 2 and one[-2].upper() == "AS"
            aliases.append(one[-1].strip('`"') if named else expression(one))
        return made.select(*[given[x].alias(x) for x in aliases])

    def _query(self, p: Parser) -> DataFrame | None:
        counted = self._counted_pairs(p)
        if counted is not None:
            return counted
        df: DataFrame | None = None
        select: list[str] | None = None
        distinct = False
        stop = set(CLAUSES)
        while p.i < len(p.t):
            word = p.peek().upper()
            if word in ("UNION", "EXCEPT", "INTERSECT", "OTHERWISE", "LET", "NEXT", "MERGE", "YIELD"):
                raise unsupported(word)
            if word in ("MATCH", "OPTIONAL"):
                optional = p.take("OPTIONAL")
                p.need("MATCH")
                own = None
                while True:
                    path = p.path()
                    own = self._join(own, self.match(path), False)
                    if not p.take(","):
                        break
                if optional and p.take("WHERE"):
                    own = own.where(F.expr(expression(p.until(stop))))
                df = self._join(df, own, optional)
            elif p.take("WHERE"):
                df = df.where(F.expr(expression(p.until(stop))))
            elif p.take("FILTER"):
                p.take("WHERE")
                df = df.where(F.expr(expression(p.until(stop))))
            elif p.take("FOR"):
                name = p.name()
                p.need("IN")
                listed = F.expr(expression(p.until(stop | {"WITH"})))
                if p.is_("WITH"):
                    raise unsupported("ordinality on FOR")
                base = df if df is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
                df = base.withColumn(name, F.explode(listed))
            elif p.take("SELECT"):
                distinct = p.take("DISTINCT")
                select = p.until({"FROM", "MATCH", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"})
                if p.take("FROM"):
                    name = p.name()
                    if name not in self.graphs:
                        raise GqlError(f"[42000] graph {name} does not exist")
                    self.catalogue = self.graphs[name]
            elif p.take("RETURN"):
                distinct = p.take("DISTINCT")
                return self._project(p, df, p.until(stop), distinct, False)
            elif word in ("INSERT", "SET", "REMOVE", "DETACH", "DELETE"):
                df = self._change(p, df)
                if p.i >= len(p.t):
                    return None
            elif select is not None:
                return self._project(p, df, select, distinct, True)
            else:
                raise GqlError(f"cannot read {p.peek()!r}")
        if select is not None:
            return self._project(p, df, select, distinct, True)
        raise GqlError("the query returns nothing")

    def _project(self, p: Parser, df: DataFrame | None, parts: list[str], distinct: bool, select: bool) -> DataFrame:
        if df is None:
            df = self.spark.range(1).select(F.lit(1).alias("__one"))
        stop = set(CLAUSES)
        items: list[tuple[str, str]] = []
        for one in _split(parts):
            if one == ["*"]:
                items += [(f"`{c}`", c) for c in df.columns if not c.startswith("__")]
                continue
            alias = None
            ups = [x.upper() for x in one]
            if len(one) > 2 and ups[-2] == "AS":
                alias, one = one[-1].strip('`"'), one[:-2]
            text = expression(one)
            items.append((text, alias or text))
        group = having = None
        if p.take("GROUP"):
            p.need("BY")
            if p.is_("("):
                raise unsupported("GROUP BY ()")
            group = [expression(x) for x in _split(p.until(stop))]
        if p.take("HAVING"):
            having = expression(p.until(stop))
        order: list[tuple[str, str]] = []
        if p.take("ORDER"):
            p.need("BY")
            for one in _split(p.until(stop)):
                way = ""
                ups = [x.upper() for x in one]
                for n, w in ((2, "NULLS"),):
                    if len(one) > n and ups[-2] == w:
                        way, one, ups = f" NULLS {ups[-1]}", one[:-2], ups[:-2]
                if ups[-1] in ("ASC", "DESC", "ASCENDING", "DESCENDING"):
                    way, one = (" DESC" if ups[-1].startswith("DESC") else " ASC") + way, one[:-1]
                order.append((expression(one), way))
        skip = limit = None
        while p.peek().upper() in ("OFFSET", "SKIP", "LIMIT"):
            word = p.next().upper()
            n = int(p.next())
            skip, limit = (n, limit) if word != "LIMIT" else (skip, n)
        if p.i < len(p.t):
            if p.peek().upper() in ("UNION", "EXCEPT", "INTERSECT", "NEXT", "OTHERWISE"):
                raise unsupported(p.peek().upper())
            raise GqlError(f"cannot read {p.peek()!r}")
        having = _by_total_order(df, having)
        items = [(_by_total_order(df, t), a) for t, a in items]
        order = [(_by_total_order(df, t), way) for t, way in order]
        grouped = group is not None or having is not None or any(AGGREGATE.search(t) for t, _ in items)
        if grouped and distinct and select:
            raise unsupported("SELECT DISTINCT with aggregation")
        if grouped:
            keys = [(t, a) for t, a in items if not AGGREGATE.search(t)]
            for g in group or ():
                if g not in [t for t, _ in keys] and g not in [a for _, a in keys]:
                    keys.append((g, f"__g_{len(keys)}"))
            asked = [(t, a) for t, a in items if AGGREGATE.search(t)]
            extra = []
            for t in [having, *[t for t, _ in order]]:
                if t and AGGREGATE.search(t) and t not in [x for x, _ in asked]:
                    extra.append((t, f"__x_{len(extra)}"))
            made = df.groupBy(*[F.expr(t).alias(a) for t, a in keys]).agg(*[F.expr(t).alias(a) for t, a in [*asked, *extra]] or [F.count(F.lit(1)).alias("__n")])
            names = {t: a for t, a in [*keys, *asked, *extra]}
            if having:
                made = made.where(f"`{names[having]}`") if having in names else made.where(F.expr(having))
        else:
            hidden = [(t, f"__o_{i}") for i, (t, _) in enumerate(order) if t not in [a for _, a in items] and t not in [x for x, _ in items]]
            names = {t: a for t, a in [*items, *hidden]}
            made = df.select(*[F.expr(t).alias(a) for t, a in [*items, *([] if distinct else hidden)]])
        out = made.select(*[f"`{a}`" for _, a in items]).distinct() if distinct else made
        if order:
            out = out.orderBy(*[_ordered(_sortable(out, names.get(t, t)), way) for t, way in order])
        if skip:
            out = out.offset(skip)
        if limit is not None:
            out = out.limit(limit)
        return out.select(*[f"`{a}`" for _, a in items])

    # changes
    def _change(self, p: Parser, df: DataFrame | None) -> DataFrame | None:
        stop = set(CLAUSES)
        if p.take("INSERT"):
            while True:
                self._insert(p.items(), df)
                if not p.take(","):
                    return df
        if p.take("SET"):
            changes: dict[tuple[str, str], str] = {}
            for one in _split(p.until(stop)):
                if one[1:2] != ["."]:
                    raise unsupported("SET of labels")
                changes[one[0], one[2]] = expression(one[4:])
            self._update(df, changes)
            return df
        if p.take("REMOVE"):
            for one in _split(p.until(stop)):
                if one[1:2] != ["."]:
                    raise unsupported("REMOVE of labels")
                self._update(df, {(one[0], one[2]): "NULL"})
            return df
        detach = p.take("DETACH")
        p.need("DELETE")
        for one in _split(p.until(stop)):
            self._delete(df, one[0], detach)
        return df

    def _insert(self, items: list, df: DataFrame | None) -> None:
        base = df if df is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
        known: dict[str, tuple[str, str]] = {}
        for x in items:
            if isinstance(x, Node) and not (df is not None and x.var in df.columns):
                label = next((n for n in self.catalogue.node_tables if x.label and x.label(n)), None)
                if self._open() and getattr(x.label, "only", None):
                    known[x.var] = self._insert_open(x, base)
                    continue
                if label is None:
                    raise GqlError("no node table has such a label")
                own = self.catalogue.node_tables[label]
                values = {k: F.expr(v) for k, v in x.props.items()}
                row = base.select(*[(values[c] if c in values else F.lit(None)).cast(own.schema[c].dataType).alias(c) for c in own.columns])
                if "id" in x.props and not own.join(row.select("id"), "id", "left_semi").isEmpty():
                    raise GqlError(f"a node of {label} with this id exists already")
                self.catalogue.node_tables[label] = stored(own.unionByName(row), "nodes")
                known[x.var] = (label, x.props.get("id", "NULL"))
        for a, e, b in zip(items[0::2], items[1::2], items[2::2], strict=False):
            ends = []
            for n in (a, b) if e.way != "<" else (b, a):
                ends.append((F.expr(known[n.var][1]), known[n.var][0]) if n.var in known else (F.col(f"{n.var}.id"), None))
            only = getattr(e.label, "only", None)
            if self._open() and only and only not in self.catalogue.edge_tables:
                labels = [label or base.select(f"{n.var}._label").first()[0] for (_, label), n in zip(ends, (a, b) if e.way != "<" else (b, a), strict=True)]
                row = base.select(ends[0][0].cast("long").alias("src"), ends[1][0].cast("long").alias("dst"), *[F.expr(v).alias(k) for k, v in e.props.items()])
                self.catalogue.edge_tables[only] = [(*labels, stored(row, "edges"))]
                continue
            for label, pairs in self.catalogue.edge_tables.items():
                if e.label and e.label(label):
                    for i, (s, t, own) in enumerate(pairs):
                        if ends[0][1] in (None, s) and ends[1][1] in (None, t):
                            values = {"src": ends[0][0], "dst": ends[1][0]} | {k: F.expr(v) for k, v in e.props.items()}
                            row = base.select(*[(values[c] if c in values else F.lit(None)).cast(own.schema[c].dataType).alias(c) for c in own.columns])
                            pairs[i] = (s, t, stored(own.unionByName(row), "edges"))
                            break

    def _open(self) -> bool:
        """Whether the graph in use takes any label and property."""
        return next((self.types.get(n) for n, g in self.graphs.items() if g is self.catalogue), None) == "ANY"

    def _insert_open(self, x: Node, base: DataFrame) -> tuple[str, str]:
        """A node of an open graph: its table and columns come into being with it; without an id it gets the next one."""
        label, own = x.label.only, self.catalogue.node_tables.get(x.label.only)
        key = x.props.get("id")
        if key is None:
            last = own.agg(F.max("id").alias("id")).first()["id"] if own is not None else None
            key = f"{(last or 0) + 1}L"
        row = base.limit(1).select(F.expr(key).cast("long").alias("id"), *[F.expr(v).alias(k) for k, v in x.props.items() if k != "id"])
        if own is not None:
            for c in set(row.columns) & set(own.columns):
                if row.schema[c].dataType != own.schema[c].dataType:  # values of several types are kept as text
                    row, own = row.withColumn(c, F.col(c).cast("string")), own.withColumn(c, F.col(c).cast("string"))
            row = own.unionByName(row, allowMissingColumns=True)
        self.catalogue.node_tables[label] = stored(row, "nodes")
        return label, key

    def _update(self, df: DataFrame, changes: dict[tuple[str, str], str]) -> None:
        """All right-hand sides are read before any change, so the order of items says nothing."""
        for var in {v for v, _ in changes}:
            own = {prop: value for (v, prop), value in changes.items() if v == var}
            new = df.select(F.col(f"{var}.id").alias("__id"), F.col(f"{var}._label").alias("__label"), *[F.expr(v).alias(f"__new_{k}") for k, v in own.items()])
            new = stored(new.dropDuplicates(["__id", "__label"]), "changes")
            for label, table in list(self.catalogue.node_tables.items()):
                hit = new.where(F.col("__label") == label).drop("__label").withColumn("__hit", F.lit(True))
                joined = table.join(hit, table["id"] == hit["__id"], "left")
                for k in own:
                    if k in table.columns:
                        joined = joined.withColumn(k, F.when(F.col("__hit"), F.col(f"__new_{k}").cast(table.schema[k].dataType)).otherwise(F.col(k)))
                self.catalogue.node_tables[label] = stored(joined.select(*table.columns), "nodes")

    def _delete(self, df: DataFrame, var: str, detach: bool) -> None:
        if "src" in df.schema[var].dataType.names:
            gone = stored(df.select(F.col(f"{var}.rel").alias("rel"), F.col(f"{var}._label").alias("__label")).distinct(), "gone")
            for label, pairs in self.catalogue.edge_tables.items():
                for i, (s, t, own) in enumerate(pairs):
                    keyed = own if "rel" in own.columns else own.withColumn("rel", F.xxhash64(F.lit(label), *own.columns))
                    left = keyed.join(gone.where(F.col("__label") == label).select("rel"), "rel", "left_anti")
                    pairs[i] = (s, t, stored(left.select(*own.columns), "edges"))
            return
        gone = stored(df.select(F.col(f"{var}.id").alias("id"), F.col(f"{var}._label").alias("__label")).distinct(), "gone")
        for label, pairs in self.catalogue.edge_tables.items():
            for i, (s, t, own) in enumerate(pairs):
                left = own
                for end, table in (("src", s), ("dst", t)):
                    left = left.join(gone.where(F.col("__label") == table).select(F.col("id").alias(end)), end, "left_anti")
                left = left.select(*own.columns)
                if not detach and left.count() < own.count():
                    raise GqlError("a node with edges needs DETACH DELETE")
                pairs[i] = (s, t, stored(left, "edges"))
        for label, table in list(self.catalogue.node_tables.items()):
            self.catalogue.node_tables[label] = stored(table.join(gone.where(F.col("__label") == label).select("id"), "id", "left_anti").select(*table.columns), "nodes")


def _ordered(c: Column, way: str) -> Column:
    """A sort key; nulls come first unless said otherwise."""
    last = "NULLS LAST" in way
    if "DESC" in way:
        return c.desc_nulls_last() if last else c.desc_nulls_first()
    return c.asc_nulls_last() if last else c.asc_nulls_first()


MIXED_AGGREGATE = re.compile(r"\b(min|max|sum|avg)\s*\((?!\s*\*)", re.I)


def _by_total_order(df: DataFrame, text: str | None) -> str | None:
    """MIN and MAX of variants by the total order, SUM and AVG of their exact numbers; JSON nulls are skipped. Other text stays."""
    if not text or T.VariantType() not in _kinds(df.schema) or not MIXED_AGGREGATE.search(text):
        return text
    out, at = "", 0
    while m := MIXED_AGGREGATE.search(text, at):
        end = _closing(text, m.end())
        inner = text[m.end() : end]
        out += text[at : m.start()]
        if not re.match(r"\s*distinct\b", inner, re.I) and isinstance(df.select(F.expr(inner)).schema[0].dataType, T.VariantType):
            if m[1].lower() in ("min", "max"):
                out += f"{m[1].lower()}_by({inner}, CASE WHEN NOT is_variant_null({inner}) THEN _gql_sortkey(to_json({inner})) END)"
            else:
                out += f"{m[1].lower()}(CASE WHEN NOT is_variant_null({inner}) THEN CAST({inner} AS DECIMAL(38,10)) END)"
        else:
            out += text[m.start() : end + 1]
        at = end + 1
    return out + text[at:]


def _closing(text: str, at: int) -> int:
    """Where the parenthesis that is open at ``at`` closes; those within quotes don't count."""
    depth, quote = 1, ""
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if not depth:
                return at
        at += 1
    raise GqlError("( is not closed")


def _kinds(kind: T.DataType) -> set[T.DataType]:
    """The types of columns and of their fields."""
    if not isinstance(kind, T.StructType):
        return {kind}
    return set().union(*[_kinds(f.dataType) for f in kind.fields])


def _sortable(df: DataFrame, name: str) -> Column:
    """The column itself, or for variants their key in the total order."""
    c = F.col(f"`{name}`")
    return order.sort_key(F.to_json(c)) if isinstance(df.schema[name].dataType, T.VariantType) else c


def _union(parts: list[DataFrame], var: str) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    names = list(dict.fromkeys(n for p in parts for n in p.schema[var].dataType.names))
    kinds = {f.name: f.dataType for p in parts for f in p.schema[var].dataType.fields}
    even = []
    for p in parts:
        has = p.schema[var].dataType.names
        even.append(p.select(F.struct(*[(F.col(f"`{var}`.`{n}`") if n in has else F.lit(None).cast(kinds[n])).alias(n) for n in names]).alias(var)))
    return reduce(lambda a, b: a.unionByName(b), even)


def expand(items: list) -> list[tuple[list, dict[str, list[str]]]]:
    """Flat alternations of nodes and edges, one for each count of the repeated groups; their variables become lists."""
    branches: list[tuple[list, dict[str, list[str]]]] = [([], {})]
    for item in items:
        if not isinstance(item, Group):
            branches = [([*flat, item], lists) for flat, lists in branches]
            continue
        grown = []
        for flat, lists in branches:
            for n in range(item.low, item.high + 1):
                body, own = [], {x.var: [] for x in item.items if x.named}
                for r in range(n):
                    for x in item.items:
                        name = f"__{x.var}_{len(flat)}_{r}"
                        body.append(replace(x, var=name, named=False))
                        if x.named:
                            own[x.var].append(name)
                grown.append(([*flat, *body], lists | own))
        branches = grown
    return [(_merge(flat), lists) for flat, lists in branches]


def _merge(flat: list) -> list:
    """Two nodes side by side are one node; a missing one is any node."""
    out: list = []
    for x in flat:
        if isinstance(x, Edge):
            if not out or isinstance(out[-1], Edge):
                out.append(Node(f"__n{len(out)}_{x.var}"))
            out.append(x)
        elif out and isinstance(out[-1], Node):
            a = out.pop()
            named = a if a.named else x
            labels = [f for f in (a.label, x.label) if f]
            both = (lambda fs: lambda v: all(f(v) for f in fs))(labels) if labels else None
            keep = Node(named.var, both, a.props | x.props, None, named.named)
            where = [re.sub(rf"\b{re.escape(n.var)}\.", f"{named.var}.", n.where) for n in (a, x) if n.where]
            out.append(replace(keep, where=" AND ".join(f"({w})" for w in where) or None))
        else:
            out.append(x)
    if isinstance(out[-1], Edge):
        out.append(Node(f"__n_end_{out[-1].var}"))
    return out
