"""Embeddings and extraction through pluggable providers.

A provider is a function of a list of texts, called once an Arrow batch. ``offline`` needs no network and gives the same vector for the same
text always; others are registered with a function that calls their service.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDERS: dict[str, Callable[[list[str], str, int], list[list[float]]]] = {}
EXTRACTORS: dict[str, Callable[[list[str], str, str], list[str]]] = {}


def _offline(texts: list[str], model: str, dimensions: int) -> list[list[float]]:
    out = []
    for t in texts:
        v = np.zeros(dimensions)
        for w in t.lower().split() or [""]:
            h = int.from_bytes(hashlib.blake2b(f"{model}\0{w}".encode(), digest_size=8).digest(), "little")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


EMBEDDERS["offline"] = _offline


def create_embedding(text: Column, provider: str, model: str, dimensions: int = 256) -> Column:
    """A list of floats a text; null stays null."""
    if provider not in EMBEDDERS:
        raise ValueError(f"Provider not found: {provider}; registered: {', '.join(sorted(EMBEDDERS))}")
    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    call = EMBEDDERS[provider]

    def batch(texts: pd.Series) -> pd.Series:
        known = texts[texts.notna()]
        made = dict(zip(known.index, call(known.tolist(), model, dimensions), strict=True)) if len(known) else {}
        return pd.Series([made.get(i) for i in texts.index], index=texts.index, dtype=object)

    return F.pandas_udf(batch, T.ArrayType(T.FloatType()))(text)


def ai_extract(text: Column, instruction: str, provider: str, model: str = "") -> Column:
    """What the provider answers to an instruction about each text."""
    if provider not in EXTRACTORS:
        raise ValueError(f"Provider not found: {provider}; registered: {', '.join(sorted(EXTRACTORS))}")
    call = EXTRACTORS[provider]

    def batch(texts: pd.Series) -> pd.Series:
        known = texts[texts.notna()]
        made = dict(zip(known.index, call(known.tolist(), instruction, model), strict=True)) if len(known) else {}
        return pd.Series([made.get(i) for i in texts.index], index=texts.index, dtype=object)

    return F.pandas_udf(batch, T.StringType())(text)


SIMPLE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def record_type(schema: str | dict) -> T.DataType:
    """The Spark type of a JSON schema."""
    s = json.loads(schema) if isinstance(schema, str) else schema
    kind = s.get("type")
    if kind == "object":
        return T.StructType([T.StructField(k, record_type(v)) for k, v in s.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(record_type(s.get("items", {"type": "string"})))
    if kind not in SIMPLE:
        raise ValueError(f"Unsupported JSON schema type: {kind}")
    return SIMPLE[kind]


def coerce(v, kind: T.DataType):
    """A value of the wanted type; one of another type is null."""
    if isinstance(kind, T.StructType):
        return {f.name: coerce(v.get(f.name), f.dataType) for f in kind.fields} if isinstance(v, dict) else None
    if isinstance(kind, T.ArrayType):
        return [coerce(x, kind.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    if isinstance(kind, T.LongType):
        return v if isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63 else None
    if isinstance(kind, T.DoubleType):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    return v if isinstance(v, str) else None


def record_from_text(answer: Column, schema: str) -> Column:
    """Answers (JSON text, maybe within a code fence) as structs of the schema; what can't be read is null."""
    kind = record_type(schema)
    if not isinstance(kind, T.StructType):
        raise ValueError("the schema of a record must be an object")

    def batch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                body = (t or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```")
                v = json.loads(body)
            except ValueError:
                v = None
            rows.append(coerce(v, kind) or dict.fromkeys(kind.names))
        return pd.DataFrame(rows, columns=kind.names).astype(object)

    return F.pandas_udf(batch, kind)(answer)


def ai_extract_record(text: Column, schema: str, provider: str, model: str = "") -> Column:
    """A struct of the JSON schema, read from the provider's answer about each text."""
    return record_from_text(ai_extract(text, schema, provider, model), schema)
