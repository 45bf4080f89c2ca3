"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.staging import ROW, stage_rows

SHARDS, SEED = 16, 42

#: Rows of a cell: a run of slots of one shard that one task puts in order.
CELL_ROWS = 16_384

#: numpy draws hypergeometric numbers from populations below this size.
NUMPY_LIMIT = 10**9


def _rejection_draw(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """A hypergeometric number for any population, by the ratio of uniforms."""
    total, mean = good + bad, drawn * good / (good + bad)
    spread = math.sqrt(max((total - drawn) / max(total - 1, 1) * mean * bad / total, 0.0) + 0.5)
    least, most = max(0, drawn - bad), min(good, drawn)
    mode = math.floor((drawn + 1) * (good + 1) / (total + 2))
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)

    def log_weight(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, drawn - k, bad - drawn + k))

    top = log_weight(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if least <= k <= most and 2 * math.log(u) <= log_weight(k) - top:
            return k


def draw_counts(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of `drawn` elements, taken without return from groups of `sizes`, come from each group."""
    if int(sizes.sum()) < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    out, rest = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for i, n in enumerate(sizes.tolist()):
        rest -= n
        if drawn and n:
            out[i] = _rejection_draw(rng, n, rest, drawn) if rest else drawn
            drawn -= int(out[i])
    return out


def matrix_row(part: int, ends: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix: how many rows of this partition go to each cell.

    ends: prefix sums of the partitions' sizes, from 0. The population is halved by partitions again and again, and each
    half's share of every cell is drawn with a generator seeded by the half's bounds; so any task finds its own row in
    log2(partitions) draws and all tasks agree, with no matrix on the driver.
    """
    low, high, counts = 0, len(ends) - 1, cells
    while high - low > 1:
        middle = (low + high) // 2
        left = draw_counts(np.random.default_rng([seed, low, high]), counts, int(ends[middle] - ends[low]))
        counts, low, high = (left, low, middle) if part < middle else (counts - left, middle, high)
    return counts


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs with `shard` (counts at most one apart) and `slot` (gapless from 0 in each shard), a uniform shuffle.

    Each written partition permutes its own rows over the cells that its matrix row names, the cells are exchanged, and
    each cell permutes again. The driver holds one count for each partition. Columns named shard or slot are replaced.
    All values may be null and rows may repeat: places go by row, not by value. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stage_rows(docs.select(*[F.col(f"`{c}`") for c in kept]), "documents")
    part = F.shiftright(ROW, 33)
    sizes = {r[0]: r[1] for r in rows.groupBy(part.alias("part")).count().collect()}
    order = sorted(sizes)
    ends = np.cumsum([0, *[sizes[p] for p in order]])
    place = {p: i for i, p in enumerate(order)}
    total = int(ends[-1])
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = [max(1, -(-n // cell_rows)) for n in wanted]
    cells = np.array([n // k + (i < n % k) for n, k in zip(wanted, cuts) for i in range(k)], np.int64)
    cell_shard = np.repeat(np.arange(shards), cuts)
    first = np.cumsum(cells) - cells
    starts = first - first[np.searchsorted(cell_shard, cell_shard)]

    @F.pandas_udf("struct<cell:int,shard:int,start:long>")
    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        dealt: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.to_numpy(np.int64)
            parts, at = ids >> 33, ids & ((1 << 33) - 1)
            cell = np.zeros(len(ids), np.int32)
            for p in np.unique(parts).tolist():
                if p not in dealt:
                    if len(dealt) > 3:
                        dealt.clear()
                    goes = np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(place[p], ends, cells, seed))
                    dealt[p] = np.random.default_rng([seed, 1, p]).permutation(goes)
                here = parts == p
                cell[here] = dealt[p][at[here]]
            yield pd.DataFrame({"cell": cell, "shard": cell_shard[cell].astype(np.int32), "start": starts[cell]})

    within = Window.partitionBy("_pw_to.cell").orderBy(F.xxhash64(F.lit(seed), ROW), ROW)
    return rows.withColumn("_pw_to", deal(ROW)).select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_pw_to.shard").alias("shard"),
        (F.col("_pw_to.start") + F.row_number().over(within) - 1).alias("slot"),
    )
