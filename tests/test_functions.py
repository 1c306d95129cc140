from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import ai, jsonfns as J
from graphloom.functions.stem import porter, porter2
from graphloom.operators import fts, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


#: A record of a shop, as the cases below read it.
ORDER = '{"no": 17, "lines": [{"part": "bolt", "n": 3}, {"part": "nut", "n": null}], "to": {"city": "Ulm", "zip": ["89073", 0]}}'


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.no", "17"), ("$.lines[0].part", '"bolt"'), ("lines/1/n", "null"), ("$.to.zip[1]", "0"), ("$.to.street", ""), ("$.no.more", ""),
        ("to/city", '"Ulm"'), ("$.lines[1]", '{"part":"nut","n":null}'), ("$.lines/5", ""),
    ],
)
def test_json_extract(spark, path, want):
    assert one(spark, J.json_extract(F.lit(ORDER), path)) == want


def test_json_extract_positions_lists_and_nulls(spark):
    assert one(spark, J.json_extract(F.lit('["p", "q"]'), 1)) == '"q"'
    assert one(spark, J.json_extract(F.lit(ORDER), ["$.to.city", "$.nowhere", "$.no"])) == ['"Ulm"', "", "17"]
    assert one(spark, J.json_extract(F.lit(None).cast("string"), "$.no")) is None


def merged(a, b):
    """RFC 7396, plainly; a key that is patched goes to the end."""
    if not isinstance(b, dict):
        return b
    a = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        old = a.pop(k, None)
        if v is not None:
            a[k] = merged(old, v)
    return a


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ({"on": True, "level": {"low": 2}}, {"level": {"high": 9}}), ({"x": [1]}, {"x": [2, 3], "y": "new"}), (7, {"from": "scalar"}), ({"x": 1}, "text"),
        ({"gone": 1, "kept": {"gone": 2, "stays": 3}}, {"gone": None, "kept": {"gone": None}}), (["l"], ["m", "n"]), ({}, {"never": None}),
    ],
)
def test_json_merge_patch(spark, a, b):
    got = one(spark, J.json_merge_patch(F.lit(json.dumps(a)), F.lit(json.dumps(b))))
    assert json.loads(got) == merged(a, b)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("200", "UINT8"), ("-3.25", "DOUBLE"), ("false", "BOOL"), ('"ink"', "STRING"), ("null", "ANY"), ("[7, 70]", "UINT8[]"),
        (ORDER, "STRUCT(no UINT8, lines STRUCT(part STRING, n UINT8)[], to STRUCT(city STRING, zip STRING[]))"),
    ],
)
def test_json_structure(spark, text, want):
    assert one(spark, J.json_structure(F.lit(text))) == want


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ('{"no": 17}', True), ('{"no": 18}', False), ('{"city": "Ulm"}', True), ('{"part": "nut", "n": null}', True), ('[{"n": 3}]', True),
        ("17", True), ("71", False), ('["89073"]', True), ('{"lines": [{"part": "screw"}]}', False), ('[0, "89073"]', True), ("[0, 1]", False),
    ],
)
def test_json_contains(spark, part, want):
    assert one(spark, J.json_contains(F.lit(ORDER), F.lit(part))) is want


def test_json_others(spark):
    assert [one(spark, J.json_array_length(F.lit(x))) for x in (ORDER, "[[], 5, null]")] == [0, 3]
    assert [one(spark, J.json_keys(F.lit(x))) for x in ('"no"', ORDER)] == [[], ["no", "lines", "to"]]
    assert [one(spark, J.json_valid(F.lit(x))) for x in (ORDER, ORDER[:-1], " ", "-0.5")] == [True, False, False, True]
    assert one(spark, J.json_minify(F.lit('{ "z" : 2.50, "y": { } }'))) == '{"z":2.50,"y":{}}'
    assert one(spark, J.json_object(F.lit("kept"), F.lit("3"), F.lit(None).cast("string"), F.lit("4"))) == '{"kept":3}'
    assert one(spark, J.to_json(F.lit('say "hi"'), T.StringType())) == '"say \\"hi\\""'
    with pytest.raises(ValueError):
        J.json_object(F.lit("key without a value"))
    with pytest.raises(Exception, match="Cannot convert"):
        one(spark, J.cast_to_json(F.lit(ORDER[5:])))


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("gas", "gas"), ("feed", "feed"), ("agreed", "agre"), ("hopping", "hop"),
        ("hoping", "hope"), ("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("skies", "sky"), ("national", "nation"),
        ("happiness", "happi"), ("running", "run"), ("dying", "die"), ("cry", "cri"), ("by", "by"), ("controlling", "control"), ("adjustable", "adjust"),
    ],
)
def test_porter2(word, stem):
    assert porter2(word) == stem


def test_porter():
    # where the two published rule sets part
    words = ["generously", "skies", "dying", "fairly", "news", "hopefulness", "vietnamization", "motoring", "falling", "rate", "sky", "ow"]
    assert [porter(w) for w in words] == ["gener", "ski", "dy", "fairli", "new", "hope", "vietnam", "motor", "fall", "rate", "sky", "ow"]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([(0, "the quick brown fox"), (1, "quick quick foxes run"), (2, "the"), (3, None), (4, "lazy dogs")], "id long, body string")


def test_bm25_counts_only_documents_with_tokens(spark):
    docs = spark.createDataFrame([(0, "alice"), (1, "the")], "id long, body string")
    got = fts.query(fts.build(docs, ["body"]), "alice").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(0, 0.124939)]


def test_fts_terms(books):
    index = fts.build(books, ["body"])
    ids = lambda *a, **k: sorted(r["id"] for r in fts.query(index, *a, **k).collect())
    assert ids("fox") == [0, 1] and ids("the quick dog", conjunctive=True) == [] and ids("brown the fox", conjunctive=True) == [0]
    assert ids("qu*k") == [0, 1] and ids("do?") == [4] and ids("fox", top=1) == [0] and ids("") == []
    with pytest.raises(ValueError):
        fts.query(index, "fox", b=2.0)


def test_fts_updates(spark, books):
    index = fts.build(books, ["body"]).without(spark.createDataFrame([(0,)], "id long"))
    assert [r["id"] for r in fts.query(index, "fox").collect()] == [1]
    index = index.with_rows(spark.createDataFrame([(1, "cat"), (9, "fox")], "id long, body string"), ["body"])
    assert [r["id"] for r in fts.query(index, "fox").collect()] == [9]


@pytest.fixture(scope="module")
def four(spark):
    rows = [(0, [0.0, 1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0, 0.0]), (3, [-1.0, 0.0, 0.0, 0.0]), (4, None)]
    return spark.createDataFrame(rows, "id long, vec array<float>")


def test_quantised_search(four):
    q = [1.0, 0.0, 0.0, 0.0]
    for kind in ("sq8", "sq16"):
        for rerank in (False, True):
            assert [r["id"] for r in vectors.quantized(four, "vec", "l2", kind, rerank).search(q, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        vectors.quantized(four, "vec", "ip")


def test_knn(four):
    q = [1.0, 0.0, 0.0, 0.0]
    assert [r["id"] for r in vectors.knn(four, "vec", q, 9).collect()] == [1, 2, 0, 3]
    assert vectors.knn(four, "vec", q, 1, "ip").first()["id"] == 3  # the raw product sorts ascending
    assert vectors.knn(four, "vec", q, 1, "l2", F.col("id") != 1).first()["id"] == 2
    assert math.isclose(vectors.knn(four, "vec", q, 1, "l2sq", F.col("id") == 3).first()["distance"], 4.0)
    for bad in ({"k": 0}, {"k": 1, "search_type": "odd"}, {"k": 1, "blind_search_up_sel": 0.9}):
        with pytest.raises(ValueError):
            vectors.knn(four, "vec", q, **bad)


def test_records(spark):
    schema = '{"type":"object","properties":{"n":{"type":"integer"},"s":{"type":"string"},"l":{"type":"array","items":{"type":"number"}}}}'
    df = spark.createDataFrame([('{"n": 1, "s": "x", "l": [1, 2.5]}',), ('```json\n{"n": "1", "s": 2}\n```',), ("nonsense",), (None,)], "t string")
    got = [tuple(r["r"]) for r in df.select(ai.record_from_text(F.col("t"), schema).alias("r")).collect()]
    assert got == [(1, "x", [1.0, 2.5]), (None, None, None), (None, None, None), (None, None, None)]
    with pytest.raises(ValueError):
        ai.create_embedding(F.lit("x"), "nobody", "m")
