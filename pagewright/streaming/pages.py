"""Pages out of a stream of primitives, each as soon as the next one of its document begins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "doc_id long, page int, n int, text string, late int, truncated boolean"
_STATE = "page int, orders string, texts string, late int"

#: Primitives of a page from which on it is reported as truncated; they are kept all the same.
MANY = 50_000
_MARK = "\x1e"


def page_batch(primitives: DataFrame) -> DataFrame:
    """doc_id, page, n, text, late, truncated of a table (doc_id, page, order, content): the same rows as the stream's.

    A primitive of an earlier page than one seen before is late: it stays in the page that is open, as a running maximum of
    the page numbers says.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    held = primitives.withColumn("open", F.max("page").over(w))
    texts = F.array_sort(F.collect_list(F.struct("order", "content")))
    return held.groupBy("doc_id", F.col("open").alias("page")).agg(
        F.count("*").cast("int").alias("n"),
        F.array_join(F.transform(texts, lambda t: F.coalesce(t["content"], F.lit(""))), " ").alias("text"),
        F.count_if(F.col("page") < F.col("open")).cast("int").alias("late"),
        (F.count("*") >= MANY).alias("truncated"),
    )


def _flush(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits the pages that are complete; the open one waits in the state, and ends when the document times out."""
    rows = []
    page, orders, texts, late = state.get if state.exists else (None, "", "", 0)
    held = list(zip(map(int, orders.split(_MARK)), texts.split(_MARK))) if orders else []

    def done() -> None:
        held.sort(key=lambda x: x[0])
        rows.append((key[0], page, len(held), " ".join(t for _, t in held), late, len(held) >= MANY))

    if state.hasTimedOut:
        if held:
            done()
        state.remove()
    else:
        new = pd.concat(list(batches)).sort_values("order") if batches is not None else pd.DataFrame()
        for r in new.itertuples():
            if page is None:
                page = int(r.page)
            if r.page > page:
                done()
                page, held, late = int(r.page), [], 0
            late += int(r.page < page)
            held.append((int(r.order), (r.content or "").replace(_MARK, " ")))
        state.update((page, _MARK.join(str(o) for o, _ in held), _MARK.join(t for _, t in held), late))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 1)
    yield pd.DataFrame(rows, columns=["doc_id", "page", "n", "text", "late", "truncated"])


def page_stream(primitives: DataFrame, time: str, wait: str) -> DataFrame:
    """The stream of pages of a stream (doc_id, page, order, content, time); a document ends `wait` behind the watermark."""
    return (
        primitives.withWatermark(time, wait)
        .groupBy("doc_id")
        .applyInPandasWithState(_flush, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def counts_by_window(events: DataFrame, time: str, kind: str, length: str, late: str) -> DataFrame:
    """Rows of each kind in windows of event time, for streams and for tables."""
    w = F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), kind, "n"
    )
