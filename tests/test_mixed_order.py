from __future__ import annotations

import duckdb

from graphloom.plans import catalogue


def test_equal_numbers_are_ordered_by_name_as_in_the_sql(spark, tmp_path):
    """More rows of one number than the limit takes, names against the order of keys."""
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame([(4 * i, f"C{200 - i:03d}", 7.25) for i in range(90)], "c_custkey long, c_name string, c_acctbal double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    want = [tuple(r) for r in con.sql(catalogue.SQL["gql_mixed_order"]).fetchall()]
    got = [tuple(r) for r in catalogue.QUERIES["gql_mixed_order"](spark, str(tmp_path)).select("id", "text").collect()]
    assert got == want and len(got) == 60
