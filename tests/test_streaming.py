from __future__ import annotations

import datetime as dt

from pagewright.streaming.pages import counts_by_window, page_batch, page_stream

ROWS = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 2, "c"), (1, 0, 3, "late"), (1, 2, 4, None), (2, 5, 0, "x"), (2, 5, 1, "y")]


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "doc_id long, page int, order long, content string, t timestamp"
    held = spark.createDataFrame([(*r, start + dt.timedelta(seconds=r[2])) for r in ROWS], schema)
    held.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    # A later document moves the watermark, so that the others end.
    spark.createDataFrame([(9, 0, 0, "z", start + dt.timedelta(hours=1))], schema).write.parquet(str(tmp_path / "in/b"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = (
        page_stream(source, "t", "1 minute").writeStream.format("memory").queryName("pages").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).start()
    )
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.table("pages").collect() if r.doc_id != 9}
    finally:
        query.stop()
    wanted = {tuple(r) for r in page_batch(held.select("doc_id", "page", "order", "content")).collect()}
    assert got == wanted and (1, 1, 2, "c late", 1, False) in wanted


def test_counts_by_window(spark):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(start + dt.timedelta(minutes=m), "k") for m in (0, 1, 6)], "t timestamp, kind string")
    assert sorted(r.n for r in counts_by_window(rows, "t", "kind", "5 minutes", "1 minute").collect()) == [1, 2]
