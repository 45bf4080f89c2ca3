from __future__ import annotations

import duckdb

from pagewright.plans import packages


def test_files_are_made_by_whole_number_division_of_keys_that_no_double_holds(spark, tmp_path):
    at = f"{tmp_path}/customer.parquet"
    rows = [(10**16 + k, f"Customer#{k}", k / 4, "BUILDING") for k in (0, 49, 50, 99, 100)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(at)
    run, sql = packages.QUERIES["xlsx_cells"]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW customer AS SELECT * FROM '{at}/*.parquet'")
    made = run(spark, str(tmp_path)).select("doc_id", "row", "col", "text").collect()
    assert sorted(map(tuple, made)) == sorted(db.sql(f"SELECT doc_id, row, col, text FROM ({sql})").fetchall())
