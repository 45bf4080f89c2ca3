"""Bounded samples of labelled documents, and the split that keeps some documents out of learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.staging import stage


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: tuple[int, int], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, label, text of at most most[c] documents of each class c, written once.

    learn: a condition on the labels' rows. The documents with the smallest hashes of their keys are taken; labels other
    than 0 and 1 and null keys teach nothing, of repeated labels one counts, of texts that share a key the least.
    """
    one = labels.filter(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("label"))
    order = [F.xxhash64(F.col(key), F.lit(label)), F.col(key)]
    picks = [one.filter(F.col("label") == c).orderBy(*order).limit(most[c]) for c in (0, 1)]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # sum(most) rows at most
    held = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, key)
    return stage(held.groupBy(key).agg(F.max("label").alias("label"), F.min("text").alias("text")), "labelled")
