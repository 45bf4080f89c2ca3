"""The queries of this subpackage: op<N>_<name>, thin over the operators, and the SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.exact_dedup import exact_groups
from pagewright.llm.labelled import remainder
from pagewright.llm.mixing import MOST_REPEATS, line_order, mix, word_count
from pagewright.llm.near_dedup import near_groups
from pagewright.llm.packing import pack
from pagewright.llm.preference import format_preferences
from pagewright.llm.quality import fit_quality, score_quality
from pagewright.llm.sharding import shuffle_to_shards
from pagewright.llm.staging import stage, stage_rows
from pagewright.llm.substring_dedup import remove_repeats
from pagewright.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from pagewright.llm.topk import top_k

#: The tokenizer file lies outside the repository.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, "vec_id", "embedding")
    return found.withColumnRenamed("id", "vec_id")


def _scored(scores: DataFrame, held_out, least: float) -> DataFrame:
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    return _scored(score_quality(docs, fit_quality(docs, labels, ~held_out)), held_out, 0.5)


def judged_pairs(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with side: each conversation as chosen, and as rejected the same conversation up to
    its last answer, with that of the next conversation in its place.

    The tables hold no judged pairs. Conversations without an answer give no pair; without a next one the rejected answer
    is empty.
    """
    turns = turns.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    last = turns.filter("role = 'assistant' and turn is not null").groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.max_by(F.coalesce("text", F.lit("")), F.struct("turn", "text")).alias("answer")
    )
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("other"))
    ends = last.select("conv_id", "last").join(other, "conv_id", "left")
    chosen = turns.join(last.select("conv_id", "last"), "conv_id")
    before = F.coalesce(F.col("turn") < F.col("last"), F.lit(True))
    sides = F.explode(F.when(before, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    answers = ends.select(
        "conv_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"), F.lit(False).alias("side")
    )
    return chosen.select("conv_id", "turn", "role", "text", sides.alias("side")).unionByName(answers)


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = judged_pairs(table(spark, sf_dir, "conversations"))
    pairs = format_preferences(turns, F.col("conv_id"), F.col("side"))
    runs = lambda c: F.array_join(
        F.transform(c, lambda r: F.concat(F.when(r["train"], "+").otherwise("-"), r["n_chars"].cast("string"))), " "
    )
    return pairs.withColumns({c: runs(c) for c in ("chosen_mask", "rejected_mask")})


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents range-sorted by the training time of their first copy, those that the mix leaves out last."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), line_order("doc_id", "text").alias("place"))
    mixed = mix(stage(sized, "sizes"), size=F.col("words"), order=F.col("place"))
    times = [F.round(F.try_element_at("positions", F.lit(k)), 9).alias(f"position_{k}") for k in range(1, MOST_REPEATS + 1)]
    # The hash spreads documents without a place, which may be many, over the last ranges.
    first = [F.try_element_at("positions", F.lit(1)).asc_nulls_last(), F.xxhash64("doc_id", "size")]
    return mixed.orderBy(*first).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", *times
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return _scored(score_toxicity(docs, fit_toxicity(docs, labels, ~held_out)), held_out, THRESHOLD)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shuffle_to_shards(docs).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "documents")
    return exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "documents")
    return near_groups(rows).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_preference": op3_preference,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s QUALIFY rank <= 10
    """,
    "op3_preference": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, 'none') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), e AS (
            SELECT conv_id, turn AS last, text AS answer FROM c WHERE role = 'assistant' AND turn IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1
        ), r AS (
            SELECT conv_id, turn, role, c.text, true AS side FROM c JOIN e USING (conv_id)
            UNION ALL SELECT conv_id, turn, role, c.text, false FROM c JOIN e USING (conv_id) WHERE coalesce(turn < last, true)
            UNION ALL SELECT e.conv_id, e.last, 'assistant', coalesce(o.answer, ''), false FROM e LEFT JOIN e o ON o.conv_id = e.conv_id + 1
        ), s AS (
            SELECT conv_id AS pair_id,
                   list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (side) AS a0,
                   list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (NOT side) AS b0
            FROM r GROUP BY conv_id
        ), p AS (
            SELECT pair_id, coalesce(a0, []) AS a, coalesce(b0, []) AS b,
                   coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 1),
                       lambda i: coalesce(a[i] = b[i], false)), false) - 1, len(a)) AS n
            FROM s
        ), q AS (
            SELECT *, a[1:n] AS head, a[n + 1:] AS ar, b[n + 1:] AS br FROM p
        )
        SELECT pair_id, CAST(n AS INTEGER) AS n_prompt_turns,
               coalesce(list_aggregate(list_transform(head, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), 'string_agg', ''), '') AS prompt,
               coalesce(list_aggregate(list_transform(ar, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), 'string_agg', ''), '') AS chosen,
               coalesce(list_aggregate(list_transform(ar, lambda t: '-' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ' +' ELSE ' -' END || (length(t.text) + 1)), 'string_agg', ' '), '') AS chosen_mask,
               coalesce(list_aggregate(list_transform(br, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), 'string_agg', ''), '') AS rejected,
               coalesce(list_aggregate(list_transform(br, lambda t: '-' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ' +' ELSE ' -' END || (length(t.text) + 1)), 'string_agg', ' '), '') AS rejected_mask,
               len(list_filter(ar, lambda t: t.role = 'assistant')) > 0 AND len(list_filter(br, lambda t: t.role = 'assistant')) > 0
                   AND ar <> br AS usable
        FROM q
    """,
    "op4_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS h
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
            FROM d GROUP BY source
        ), l AS (
            SELECT source, n, w, CAST(3 * n AS DOUBLE) AS cap,
                   (sum(n) OVER () - coalesce(sum(CAST(3 * n AS DOUBLE)) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
            FROM s WINDOW before AS (ORDER BY CAST(3 * n AS DOUBLE) / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT source, n, w, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level * w <= cap) * w, cap)) AS target FROM l
        ), line AS (
            SELECT doc_id, size, n, w, target,
                   sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS begin
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), copied AS (
            SELECT *, CASE WHEN size > 0 THEN CAST(greatest(0, least(3, ceil((target - begin - size / 2) / greatest(n, 1)))) AS BIGINT) ELSE 0 END AS copies,
                   CASE w WHEN 2 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS w0, CASE w WHEN 1 THEN -1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 3.0::DOUBLE END AS slope
            FROM line
        ), timed AS (
            SELECT *, list_transform(list_transform(range(0, copies), lambda e: least((begin + e * n) / target, 1) * w), lambda need: round(
                       least(greatest(2 * need / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * need, 1e-18::DOUBLE))), 0), 1), 9)) AS p
            FROM copied
        )
        SELECT doc_id, size, n AS source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken,
               p[1] AS position_1, p[2] AS position_2, p[3] AS position_3
        FROM timed
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
        ), k AS (
            SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i : i + 34], ' ')) AS n FROM s
        ), gone AS (
            SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k WHERE n > 1
        ), g AS (
            SELECT r, list(j) AS js FROM gone GROUP BY r
        ), one AS (
            SELECT r, w[j] AS x, j FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)
        ), kept AS (
            SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM one ANTI JOIN gone USING (r, j) GROUP BY r
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.js), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
    """,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
