"""Exact top-k search by exhaustive term-at-a-time accumulation, in blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.staging import stage

#: Queries and rows of a block. A pair of blocks needs QUERY_ROWS * BLOCK_ROWS scores of eight bytes.
QUERY_ROWS, BLOCK_ROWS = 128, 4096

K, SCALE = 10, 1024.0

#: Sums of products stay below this, or are made with Python's integers.
EXACT = float(1 << 62)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def to_weights(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component, saturated to a long; null for a vector that is null, or holds a null or a
    number that is not finite."""
    sound = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False))
    )
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """<kind>_ids, <kind>_terms, <kind>_at, <kind>_weights: rows packed into blocks of postings sorted by term.

    A row is (id, w array<long>); a posting is the place of a row in its block and its weight for the term; zero weights
    have none. Rows of different lengths may meet: a term that one lacks weighs 0.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids: list, vectors: list) -> pa.RecordBatch:
            lengths = np.array([len(v) for v in vectors])
            flat = np.concatenate([np.zeros(0, np.int64), *vectors]).astype(np.int64)
            at = np.repeat(np.arange(len(vectors)), lengths)
            term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            use = np.flatnonzero(flat)
            use = use[np.argsort(term[use], kind="stable")]
            packed = [np.array(ids, np.int64), term[use].astype(np.int32), at[use].astype(np.int32), flat[use]]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names)

        ids: list = []
        vectors: list = []
        for batch in batches:
            values = batch.column(1)
            flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for i, key in enumerate(batch.column(0).to_pylist()):
                ids.append(key)
                vectors.append(flat[ends[i] : ends[i + 1]])
                if len(ids) == size:
                    yield emit(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield emit(ids, vectors)

    names = [f"{kind}_{x}" for x in ("ids", "terms", "at", "weights")]
    return rows.mapInArrow(pack, ", ".join(f"{x} binary" for x in names))


def _postings(block: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("ids", np.int64), ("terms", np.int32), ("at", np.int32), ("weights", np.int64))
    return tuple(np.frombuffer(block[f"{kind}_{x}"], t) for x, t in kinds)


def accumulate(query: tuple, rows: tuple) -> np.ndarray:
    """Scores of all queries of a block against all rows of another, one term after another.

    For each term that a query has, its weight times the term's posting weights is scattered into the query's score
    array. Sums that may leave 64 bits are made exactly and saturate.
    """
    q_ids, q_terms, q_at, q_weights = query
    r_ids, r_terms, r_at, r_weights = rows
    most = np.abs(q_weights.astype(float)).max(initial=0) * np.abs(r_weights.astype(float)).max(initial=0)
    wide = most * max(len(np.unique(r_terms)), 1) >= EXACT
    scores = np.zeros((len(q_ids), len(r_ids)), object if wide else np.int64)
    for term in np.intersect1d(q_terms, r_terms):
        a, b = np.searchsorted(q_terms, [term, term + 1])
        c, d = np.searchsorted(r_terms, [term, term + 1])
        weights = r_weights[c:d].astype(scores.dtype)
        every = d - c == len(r_ids)  # then the postings are in row order and scatter to all places
        for q, w in zip(q_at[a:b].tolist(), q_weights[a:b].tolist()):
            if every:
                scores[q] += w * weights
            else:
                scores[q, r_at[c:d]] += w * weights
    return np.clip(scores, _LEAST, _MOST).astype(np.int64) if wide else scores


def best_of_ids(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scores and ids with one column for each id: rows that repeat an id count once, with their best score."""
    each = np.unique(ids)
    if len(each) == len(ids):
        return scores, ids
    order = np.argsort(ids, kind="stable")
    return np.maximum.reduceat(scores[:, order], np.searchsorted(ids[order], each), axis=1), each


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, of ids that differ: partition at the k-th score, then order by score and id; `own` takes
    no part."""
    use = np.flatnonzero(ids != own)
    if len(use) > k:
        least = np.partition(scores[use], len(use) - k)[len(use) - k]
        use = use[scores[use] >= least]
    best = use[np.lexsort((ids[use], ~scores[use]))][:k]
    return best, scores[best]


def top_k(rows: DataFrame, queries: Column, id_col: str, vector: str, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, id, score: for each row that meets `queries`, its k highest integer inner products.

    All other rows are candidates; ties go to the smaller id. Query blocks meet candidate blocks as pairs of packed
    rows: as many rows as pairs of blocks, each some hundred thousand products, and nothing is broadcast beyond the size
    that Spark itself checks. A task keeps the best k of each query over all pairs that it sees, and these few are merged.
    Vectors that are null or hold a null or a number that is not finite take no part. A row that repeats an id is the
    same candidate, or query, with its best score. Null ids take no part. An empty table gives no rows.
    """
    weighed = rows.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), queries.alias("asks"), to_weights(F.col(vector), scale).alias("w")
    ).filter("w is not null")
    asking = weighed.filter("asks").select("id", "w").dropDuplicates(["id", "w"])
    asking = asking.repartition(-(-asking.count() // (8 * QUERY_ROWS)) or 1)  # so that blocks are full
    asked = stage(blocks(asking, QUERY_ROWS, "q"), "queries")
    searched = stage(blocks(weighed.select("id", "w"), BLOCK_ROWS, "r"), "rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for pair in range(batch.num_rows):
                block = {name: batch.column(i)[pair].as_py() for i, name in enumerate(batch.schema.names)}
                query, rows_ = _postings(block, "q"), _postings(block, "r")
                scores, ids = best_of_ids(accumulate(query, rows_), rows_[0])
                for q, own in enumerate(query[0].tolist()):
                    at, found = select(scores[q], ids, own, k)
                    held: dict[int, int] = {}
                    for score, key in [*best.get(own, ()), *zip(found.tolist(), ids[at].tolist())]:
                        held[key] = max(score, held.get(key, score))
                    best[own] = sorted(((s, i) for i, s in held.items()), key=lambda x: (-x[0], x[1]))[:k]
                if len(best) * k > 1 << 18:
                    yield from _flush(best)
        yield from _flush(best)

    def _flush(best: dict) -> Iterator[pa.RecordBatch]:
        flat = [(q, i, s) for q, found in best.items() for s, i in found]
        best.clear()
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat)], ["query_id", "id", "score"])

    found = asked.crossJoin(searched).mapInArrow(search, "query_id long, id long, score long")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
