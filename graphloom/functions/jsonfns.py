"""JSON scalar functions over text columns.

Text order and number spelling are kept, which VARIANT would not do, so functions that return JSON text parse in Arrow UDFs;
what only counts or tests uses built-ins. A null argument gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Number(str):
    """A number as it was spelt."""


def parse(text: str):
    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_no_constant)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def dump(v) -> str:
    """Compact text in source order."""
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dump, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def merge_patch(target, patch):
    """RFC 7396; keys that the patch has come last, in its order."""
    if not isinstance(patch, dict):
        return patch
    own = target if isinstance(target, dict) else {}
    out = {k: v for k, v in own.items() if k not in patch}
    for k, v in patch.items():
        if v is not None:
            out[k] = merge_patch(own.get(k), v)
    return out


STEP = re.compile(r"\.\"([^\"]*)\"|\[\"?([^\]\"]*)\"?\]|[./]?([^./\[]+)")
MISSING = object()


def steps(path: str) -> list[str]:
    path = path[1:] if path.startswith("$") else path
    return [next(g for g in m.groups() if g is not None) for m in STEP.finditer(path)]


def extract(v, path: str):
    """The value at a path that may mix dots, slashes and brackets, else MISSING."""
    for s in steps(path):
        if isinstance(v, dict) and s in v:
            v = v[s]
        elif isinstance(v, list) and re.fullmatch(r"\d+", s) and int(s) < len(v):
            v = v[int(s)]
        else:
            return MISSING
    return v


def _equal(a, b) -> bool:
    if isinstance(a, Number) and isinstance(b, Number):
        return a == b or float(a) == float(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    return type(a) is type(b) and a == b


def _covers(a, b) -> bool:
    """Whether ``a`` itself holds ``b``: arrays in any order, objects by a part of their keys."""
    if isinstance(a, list) and isinstance(b, list):
        return all(any(_covers(x, y) for x in a) for y in b)
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _covers(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return any(_covers(x, b) for x in a)
    return _equal(a, b)


def contains(hay, needle) -> bool:
    if _covers(hay, needle):
        return True
    inner = hay.values() if isinstance(hay, dict) else hay if isinstance(hay, list) else ()
    return any(contains(x, needle) for x in inner)


#: Unsigned and signed integer types by their bits.
UNSIGNED, SIGNED = {8: "UINT8", 16: "UINT16", 32: "UINT32", 64: "UINT64"}, {8: "INT8", 16: "INT16", 32: "INT32", 64: "INT64", 128: "INT128"}


def structure(v):
    """The smallest type that holds a value: a name, ``{key: type}`` for a struct or ``[type]`` for a list."""
    if v is None:
        return "ANY"
    if isinstance(v, bool):
        return "BOOL"
    if isinstance(v, Number):
        if not re.fullmatch(r"-?\d+", v):
            return "DOUBLE"
        n = int(v)
        sizes, low = (UNSIGNED, 0) if n >= 0 else (SIGNED, 1)
        return next((name for bits, name in sizes.items() if (n if n >= 0 else ~n) < 1 << (bits - low)), "DOUBLE")
    if isinstance(v, str):
        return "STRING"
    if isinstance(v, list):
        inner = "ANY"
        for x in v:
            inner = unify(inner, structure(x))
        return [inner]
    return {k: structure(x) for k, x in v.items()}


def unify(a, b):
    """The smallest type that holds both."""
    if a == b or b == "ANY":
        return a
    if a == "ANY":
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: unify(a.get(k, "ANY"), b.get(k, "ANY")) for k in dict.fromkeys((*a, *b))}
    if isinstance(a, list) and isinstance(b, list):
        return [unify(a[0], b[0])]
    bits = [next(((n, t is SIGNED) for t in (UNSIGNED, SIGNED) for n, name in t.items() if name == x), None) if isinstance(x, str) else None for x in (a, b)]
    if all(bits):
        if bits[0][1] == bits[1][1]:
            return a if bits[0][0] >= bits[1][0] else b
        (plain, _), (signed, _) = sorted(bits, key=lambda x: x[1])
        return SIGNED[max(plain * 2, signed)]
    if {a, b} <= {"DOUBLE", *UNSIGNED.values(), *SIGNED.values()} if isinstance(a, str) and isinstance(b, str) else False:
        return "DOUBLE"
    return "STRING"


def type_text(t) -> str:
    if isinstance(t, list):
        return type_text(t[0]) + "[]"
    if isinstance(t, dict):
        return "STRUCT(" + ", ".join(f"{k} {type_text(x)}" for k, x in t.items()) + ")"
    return t


def _udf(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    """An Arrow UDF of texts; null in, null out."""

    def batch(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*cols, strict=True)], dtype=object)

    made = F.pandas_udf(batch, kind)
    return lambda *cols: made(*[F.lit(c) if isinstance(c, str) and c.startswith("\0") else c for c in cols])


def _text(v) -> str:
    return "" if v is MISSING else dump(v)


json_merge_patch = _udf(lambda a, b: dump(merge_patch(parse(a), parse(b))), T.StringType())
json_contains = _udf(lambda a, b: contains(parse(a), parse(b)), T.BooleanType())
json_structure = _udf(lambda a: type_text(structure(parse(a))), T.StringType())
json_minify = _udf(lambda a: dump(parse(a)), T.StringType())
_extract = _udf(lambda a, p: _text(extract(parse(a), p)), T.StringType())


def json_extract(text: Column, path: str | int | Column | list[str]) -> Column:
    """The JSON text at a path; an empty string where nothing is there; a list of paths gives an array."""
    if isinstance(path, list):
        return F.when(text.isNotNull(), F.array(*[_extract(text, F.lit(p)) for p in path]))
    return _extract(text, path if isinstance(path, Column) else F.lit(str(path)))


def json_valid(text: Column) -> Column:
    """Whether the text parses."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


def json_array_length(text: Column) -> Column:
    """Elements of an array, 0 for anything else."""
    return F.when(text.isNotNull(), F.coalesce(F.json_array_length(text), F.lit(0)))


def json_keys(text: Column) -> Column:
    """An object's keys in source order, none for anything else."""
    return F.when(text.isNotNull(), F.coalesce(F.json_object_keys(text), F.expr("cast(array() as array<string>)")))


def to_json(value: Column, kind: T.DataType) -> Column:
    """Any value as JSON text; null stays null."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    # a scalar goes through a list of one
    inner = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))


#: Other names of the same function.
json_quote = array_to_json = row_to_json = to_json


def json_array(*parts: Column) -> Column:
    """An array of JSON texts; null becomes the JSON null."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(p, F.lit("null")) for p in parts]), F.lit("]"))


def json_object(*parts: Column) -> Column:
    """Keys (strings) and JSON texts in turn; a null key is left out with its value."""
    if len(parts) % 2:
        raise ValueError("json_object needs an even number of arguments")
    pairs = [
        F.when(k.isNotNull(), F.concat(to_json(k.cast("string"), T.StringType()), F.lit(":"), F.coalesce(v, F.lit("null"))))
        for k, v in zip(parts[::2], parts[1::2], strict=True)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def cast_to_json(text: Column) -> Column:
    """The text itself if it parses, else an error."""
    said = F.concat(F.lit("Cannot convert "), text, F.lit(" to JSON."))
    return F.when(text.isNull() | json_valid(text), text).otherwise(F.raise_error(said))
