from __future__ import annotations

import json
import sqlite3
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from graphloom.sources import attach, jsonio, lake
from graphloom.streaming import cdc


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE node_person(id INTEGER PRIMARY KEY, name TEXT, born DATE)")
        c.execute("CREATE TABLE rel_knows(src_id INT, dst_id INT, w REAL)")
        c.executemany("INSERT INTO node_person VALUES (?, ?, ?)", [(i, f"p{i}", "2020-01-02") for i in range(1, 21)])
        c.executemany("INSERT INTO rel_knows VALUES (?, ?, ?)", [(i, i + 1, 0.5) for i in range(1, 20)])
    return path


def test_sqlite_scan_filter_and_graph(spark, db):
    a = attach.attach_sqlite(spark, db)
    assert a.table_names() == ["node_person", "rel_knows"]
    df = a.table("node_person").where("id > 15 AND name <> 'p17'")
    assert sorted(r["id"] for r in df.collect()) == [16, 18, 19, 20] and str(df.first()["born"]) == "2020-01-02"
    graph, skipped = a.graph()
    assert list(graph.edge_tables) == ["knows"] and not skipped
    with pytest.raises(ValueError):
        a.table("nothing")
    with pytest.raises(ValueError):
        a.sql_query("DELETE FROM node_person")


def test_sqlite_mismatch_and_text(spark, db):
    with sqlite3.connect(db) as c:
        c.execute("INSERT INTO rel_knows VALUES ('x', 1, 1.0)")
    with pytest.raises(Exception, match="Mismatch Type Error"):
        attach.attach_sqlite(spark, db).table("rel_knows").collect()
    assert attach.attach_sqlite(spark, db, all_varchar=True).table("rel_knows").where("src_id = 'x'").count() == 1


def test_sqlite_sync(spark, db, tmp_path):
    sync = cdc.SqliteSync(spark, db, f"file://{tmp_path}/snap")
    first = sync.sync()
    assert (first.tables_synced, first.rows_upserted, first.rows_deleted) == (2, 39, 0)
    with sqlite3.connect(db) as c:
        c.execute("UPDATE node_person SET name = 'new' WHERE id = 3")
        c.execute("DELETE FROM node_person WHERE id = 4")
        c.execute("INSERT INTO node_person VALUES (99, 'z', NULL)")
    second = sync.sync()
    assert (second.rows_upserted, second.rows_deleted) == (2, 1)
    assert {r["id"]: r["name"] for r in sync.table("node_person").where("id IN (3, 4, 99)").collect()} == {3: "new", 99: "z"}
    assert sync.sync().rows_upserted == 0


def test_stream_equals_batch(spark, tmp_path):
    schema = "id long, v long, seq long, op string"
    feed = [(i % 7, i, i, "delete" if i % 5 == 0 else "upsert") for i in range(40)]
    snapshot = cdc.Snapshot(spark, f"file://{tmp_path}/s", "id long, v long")
    for n in range(4):
        spark.createDataFrame(feed[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/feed")
        cdc.sync_stream(stream, snapshot, ["id"], f"{tmp_path}/check").awaitTermination()
    whole = cdc.apply_changes(spark.createDataFrame([], "id long, v long"), spark.createDataFrame(feed, schema), ["id"])
    assert sorted(map(tuple, snapshot.read().collect())) == sorted(map(tuple, whole.collect()))
    assert snapshot.cursor()["batch"] == 3


def test_a_batch_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    snapshot = cdc.Snapshot(spark, f"file://{tmp_path}/s", "id long, v string", buckets=8)
    feed = lambda rows: spark.createDataFrame(rows, "id long, v string, seq long, op string")
    snapshot.change(feed([(i, "a", i, "upsert") for i in range(100)]), ["id"], 0)
    assert set(snapshot.cursor()["held"].values()) == {1} and len(snapshot.cursor()["held"]) == 8
    snapshot.change(feed([(5, "b", 0, "upsert"), (5, "c", 1, "upsert"), (200, None, 2, "upsert")]), ["id"], 1)
    held = list(snapshot.cursor()["held"].values())
    assert held.count(1) >= 6 and 1 <= held.count(2) <= 2
    assert {r["id"]: r["v"] for r in snapshot.read().collect()} == {**dict.fromkeys(range(100), "a"), 5: "c", 200: None}
    for n in range(2, 4):
        snapshot.change(feed([(i, None, 9, "delete") for i in range(300)]), ["id"], n)
    assert snapshot.read().count() == 0 and snapshot.cursor() == {"version": 4, "batch": 3, "buckets": 8, "keys": ["id"], "held": {}}
    left = {p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")}
    assert left == {"cursor-3.json", "cursor-4.json", "v4"}
    with pytest.raises(ValueError, match="dealt by"):
        snapshot.change(feed([(1, "a", 0, "upsert")]), ["v"], 4)


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, 'q"', 2.5)], "z long, b string, a double")
    jsonio.export_array(df, f"{tmp_path}/out")
    assert jsonio.detect(spark, f"{tmp_path}/out") == "array"
    assert sorted(r["z"] for r in jsonio.scan(spark, f"{tmp_path}/out").collect()) == [1, 2]
    (tmp_path / "lines.json").write_text('{"z":1,"b":"x"}\n{"z":2,"a":3}\n')
    assert jsonio.scan(spark, str(tmp_path / "lines.json")).columns == ["z", "b", "a"] or jsonio.scan(spark, str(tmp_path / "lines.json")).columns == ["z", "a", "b"]
    (tmp_path / "loose.json").write_text('{"a":\n 1}')
    assert jsonio.scan(spark, str(tmp_path / "loose.json")).first()["a"] == 1
    with pytest.raises(ValueError):
        jsonio.scan(spark, str(tmp_path / "loose.json"), format="newline_delimited")


def test_delta_log(spark, tmp_path):
    root, log = tmp_path / "t", tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    for n in (0, 1):
        spark.createDataFrame([(n, f"x{n}")], "id long, name string").coalesce(1).write.parquet(str(root / f"p{n}"))
    files = [next((root / f"p{n}").glob("*.parquet")).relative_to(root).as_posix() for n in (0, 1)]
    schema = json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}, {"name": "name", "type": "string", "nullable": True, "metadata": {}}]})
    (log / f"{0:020}.json").write_text("\n".join(json.dumps(x) for x in [{"metaData": {"schemaString": schema, "partitionColumns": []}}, {"add": {"path": files[0], "partitionValues": {}}}]))
    (log / f"{1:020}.json").write_text("\n".join(json.dumps(x) for x in [{"add": {"path": files[1], "partitionValues": {}}}, {"remove": {"path": files[0]}}]))
    assert [r["id"] for r in lake.delta_scan(spark, str(root)).collect()] == [1]
    assert [r["id"] for r in lake.delta_scan(spark, str(root), 0).collect()] == [0]


def test_delta_partitions_and_checkpoints(spark, tmp_path):
    root, log = tmp_path / "t d", tmp_path / "t d" / "_delta_log"
    log.mkdir(parents=True)
    kinds = ["a b", "50%", "ü=x", None, ""]
    adds = []
    for n, kind in enumerate(kinds):
        folder = root / f"kind={kind or 'none'}{n}"
        spark.createDataFrame([(n,), (n + 10,)], "id long").coalesce(1).write.parquet(str(folder))
        file = next(folder.glob("*.parquet")).relative_to(root).as_posix()
        adds.append({"path": quote(file), "partitionValues": {"kind": kind, "day": f"2024-01-0{n + 1}"}})
    fields = [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("kind", "string"), ("id", "long"), ("day", "date"))]
    meta = {"schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": ["kind", "day"], "configuration": {}}

    def commit(n, *actions):
        (log / f"{n:020}.json").write_text("\n".join(json.dumps(x) for x in actions))

    def rows(*args, **named):
        return {r["id"]: (r["kind"], str(r["day"])) for r in lake.delta_scan(spark, str(root), *args, **named).collect()}

    commit(0, {"metaData": meta}, *({"add": a} for a in adds))
    every = {n + m: (kind or None, f"2024-01-0{n + 1}") for n, kind in enumerate(kinds) for m in (0, 10)}
    assert rows() == every and lake.delta_scan(spark, str(root)).columns == ["kind", "id", "day"]
    assert set(rows(partitions=F.col("day") < "2024-01-02")) == {0, 10}
    # version 1 removes a file; its checkpoint has two parts, and what came before is cleaned away
    commit(1, {"remove": {"path": adds[1]["path"]}})
    live = [(adds[n]["path"], adds[n]["partitionValues"]) for n in (0, 2, 3, 4)]
    own = "add struct<path:string,partitionValues:map<string,string>>, metaData struct<schemaString:string,partitionColumns:array<string>>"
    head = (None, (meta["schemaString"], meta["partitionColumns"]))
    for part, actions in enumerate(([head, *[(x, None) for x in live[:2]]], [(x, None) for x in live[2:]]), 1):
        spark.createDataFrame(actions, own).coalesce(1).write.parquet(str(tmp_path / f"c{part}"))
        next((tmp_path / f"c{part}").glob("*.parquet")).rename(log / f"{1:020}.checkpoint.{part:010}.{2:010}.parquet")
    (log / f"{0:020}.json").unlink()
    commit(2, {"remove": {"path": adds[0]["path"]}})
    assert set(rows()) == {2, 12, 3, 13, 4, 14} and set(rows(1)) == {0, 10, 2, 12, 3, 13, 4, 14}
    with pytest.raises(ValueError, match="lacks version"):
        rows(0)
    commit(3, {"add": {**adds[0], "deletionVector": {"storageType": "u"}}})
    with pytest.raises(ValueError, match="deletion vectors"):
        rows()
    commit(4, {"metaData": {**meta, "configuration": {"delta.columnMapping.mode": "name"}}})
    with pytest.raises(ValueError, match="other names"):
        rows()
    (log / f"{3:020}.json").unlink()
    with pytest.raises(ValueError, match="lacks version 3"):
        rows()


def test_iceberg_snapshots(spark, tmp_path):
    meta = {"snapshots": [{"sequence-number": n, "snapshot-id": 10 + n, "timestamp-ms": 100 * n, "manifest-list": "m"} for n in (1, 2)]}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    path = str(tmp_path / "m.json")
    assert lake.snapshot_at(spark, path) == 12 and lake.snapshot_at(spark, path, timestamp_ms=150) == 11
    with pytest.raises(ValueError):
        lake.snapshot_at(spark, path, 11, 100)


def test_json_depth_and_broken_first_line(spark, tmp_path):
    (tmp_path / "deep.json").write_text('{"a": {"b": {"c": 1}}, "l": [[1, 2]], "n": 7}\n')
    got = jsonio.scan(spark, f"file://{tmp_path}/deep.json", maximum_depth=2).first()
    assert (got["a"]["b"], got["l"], got["n"]) == ('{"c": 1}', ["[1, 2]"], 7)  # text as it was written
    (tmp_path / "bad.json").write_text('{"a": \n{"a": 1}\n{"a": 2}\n[3]\n')
    path = f"file://{tmp_path}/bad.json"
    assert sorted(r["a"] for r in jsonio.scan(spark, path, ignore_errors=True).where("a IS NOT NULL").collect()) == [1, 2]
    assert sorted(r["record"] for r in jsonio.rejected(spark, path).collect()) == ['[3]', '{"a": ']
