"""Queries over whole tables against SQL, and the pipeline over a small table."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from pagewright.llm import near_dedup, queries
from tests.test_catalogue import plain

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    made = queries.queries()[name](spark, small)
    rows = made.collect()
    assert rows
    if name in SQL:
        db = duckdb.connect()
        for table in os.listdir(small):
            db.sql(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{small}/{table}'")
        found = db.sql(SQL[name])
        columns = sorted(found.columns)
        assert plain(rows, columns) == plain([dict(zip(found.columns, r)) for r in found.fetchall()], columns)


def test_near_query_is_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_near_dedup(spark, small).collect())
    assert got == sorted(near_dedup.brute_force([r.doc_id for r in docs], [r.text for r in docs]))


def test_pipeline_keeps_columns_and_drops_copies(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wanted, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, small)
        assert docs.columns == wanted
        seen[name] = docs.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    assert len({r.text for r in seen["exact_dedup"]}) == len(seen["exact_dedup"])
    assert len(seen["toxicity"]) > len(seen["exact_dedup"]) >= len(seen["near_dedup"]) > 0
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["near_dedup"]}
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in packed} <= {r.doc_id for r in seen["near_dedup"]}
