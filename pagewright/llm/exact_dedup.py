"""Exact deduplication by mergeable counting quotient filters, with byte verification of what they report."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.staging import ROW, power_of_two, stage, stage_rows

#: Fingerprints that one filter holds before it is emitted, and fingerprints that one merged block is planned for.
FILTER_ROWS, BLOCK_ROWS, LEAST_BLOCKS = 1 << 19, 1 << 19, 32


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints: run lengths per quotient, sorted remainders, and a count for each remainder.

    The quotient is the top `qbits` bits of a fingerprint and the remainder is the rest, so nothing is lost: a filter
    gives back exactly the fingerprints and counts put into it, filters of any sizes merge by their sorted remainders,
    and a count never reads too low. The quotient size follows the number of entries.
    """

    def __init__(self, qbits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.qbits, self.runs, self.remainders, self.counts = qbits, runs, remainders, counts

    @classmethod
    def _of_sorted(cls, keys: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        qbits = max(1, min(24, int(len(keys)).bit_length()))
        shift = np.uint64(64 - qbits)
        runs = np.bincount((keys >> shift).astype(np.int64), minlength=1 << qbits).astype(np.uint32)
        return cls(qbits, runs, keys & np.uint64((1 << (64 - qbits)) - 1), counts.astype(np.uint64))

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        keys, counts = np.unique(fingerprints.view(np.uint64), return_counts=True)
        return cls._of_sorted(keys, counts)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        keys = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")  # a merge of sorted runs
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return cls._of_sorted(keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (quotients << np.uint64(64 - self.qbits)) | self.remainders

    def repeated(self) -> np.ndarray:
        return self.fingerprints()[self.counts > 1]

    def to_bytes(self) -> bytes:
        head = struct.pack("<BI", self.qbits, len(self.remainders))
        return head + self.runs.tobytes() + self.remainders.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        qbits, n = struct.unpack_from("<BI", data)
        at = 5
        runs = np.frombuffer(data, np.uint32, 1 << qbits, at)
        at += 4 << qbits
        return cls(qbits, runs, np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.uint64, n, at + 8 * n))


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """The values of the one long column `fp` that occur more than once.

    Every task builds filters over its own rows and cuts them by the leading bits of the fingerprint; the filters of
    one cut meet in one task and merge. A value that a third of all rows share is one entry with a count in each filter.
    """
    bits = power_of_two(max(LEAST_BLOCKS, rows / BLOCK_ROWS)).bit_length() - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.concatenate(held).view(np.uint64)
            blocks = (keys >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(blocks, kind="stable")
            cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1))
            parts = np.split(keys[order], cuts[1:])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks[order][cuts], pa.int64()),
                    pa.array([CountingQuotientFilter.build(p).to_bytes() for p in parts], pa.binary()),
                ],
                ["block", "cqf"],
            )

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
                n += batch.num_rows
            if n >= FILTER_ROWS:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    def merge(table: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge(
            [CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("cqf")]
        )
        return pa.table({"fp": pa.array(merged.repeated().view(np.int64))})

    return (
        fingerprints.select("fp")
        .mapInArrow(build, "block long, cqf binary")
        .groupBy("block")
        .applyInArrow(merge, "fp long")
    )


def exact_groups(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of a table from stage_rows(): keep_id, group_size, kept and text_sha256.

    Rows whose fingerprint no filter counts twice are alone in their group and their texts go no further. The texts of
    the others are grouped by all their bytes; the group is led by its largest key, ties by the smallest row number.
    Nulls count as empty texts; a null key is less than any other, and leads only where all are null; rows that repeat are
    copies of each other; very long texts count whole. Returns ROW, key, keep_id, group_size, kept, text_sha256; empty for
    an empty table. Only key and text are read, whatever other columns are called.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = stage(
        rows.select(ROW, F.col(key).alias("_pw_key"), F.xxhash64(whole).alias("fp"), F.sha2(whole, 256).alias("sha")),
        "fingerprints",
    )
    repeats = stage(repeated_fingerprints(narrow, narrow.count()), "repeated")
    suspects = rows.select(
        F.struct(F.col(key).alias("id"), (-F.col(ROW)).alias("row")).alias("lead"),
        whole.alias("bytes"),
        F.xxhash64(whole).alias("fp"),
    ).join(repeats, "fp", "left_semi")
    # Equal bytes meet after a map-side count, so a hot text crosses the network once per task.
    verified = (
        suspects.groupBy("fp", "bytes")
        .agg(F.max("lead").alias("lead"), F.count("*").alias("n"))
        .select("fp", F.sha2("bytes", 256).alias("sha"), "lead", "n")
    )
    groups = verified.groupBy("fp", "sha").agg(
        F.count("*").alias("texts"), F.max("lead").alias("lead"), F.sum("n").alias("n")
    )
    sound = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    # Written, so that both sides of the join are plain exchanges and a hot text is a skewed side that can be split.
    groups = stage(groups.select("fp", "sha", "lead", F.coalesce(sound, "n").alias("n")).filter("n > 1"), "groups")
    found = F.col("n").isNotNull()
    return (
        narrow.join(groups, ["fp", "sha"], "left")
        .select(
            ROW,
            F.col("_pw_key").alias(key),
            F.when(found, F.col("lead.id")).otherwise(F.col("_pw_key")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
            (~found | (F.col("lead.row") == -F.col(ROW))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest key; all columns as they came.

    Nulls count as empty texts; rows that are equal in every column count as copies too; an empty table stays empty.
    """
    rows = stage_rows(docs, "documents")
    dropped = stage(exact_groups(rows, text, key).filter(~F.col("kept")).select(ROW), "dropped")
    return rows.join(dropped, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
