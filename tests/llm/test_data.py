from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import sharding
from pagewright.llm.mixing import mix, training_order
from pagewright.llm.packing import UnitTokenizer, assemble, pack
from pagewright.llm.preference import format_preferences
from pagewright.llm.quality import fit_quality, score_quality
from pagewright.llm.queries import TOKENIZER
from pagewright.llm.topk import top_k
from pagewright.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity

ODD = ["a", "b", "!", " ", "  ", "\n", "\t", "\x1c", "\x85", "1", "'s", "é", "<|endoftext|>", "\r", "_", "　", "日", "²", "don'tx"]


def test_units_have_the_ids_of_whole_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(3000)]
    plain, units = Tokenizer.from_file(TOKENIZER), UnitTokenizer(TOKENIZER)
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(x, units.dtype).tolist() for x in units.encode(texts)]
        assert got == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_a_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "x", *[" ".join(rng.choices(["the", "qed", "Ünï", "12"], k=rng.randint(0, 900))) for _ in range(40)], "word " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = pack(docs, TOKENIZER)
    rows = made.collect()
    plain = Tokenizer.from_file(TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids
        assert {r.doc_tokens for r in pieces} == {len(ids)} and not pieces[0].continued and not pieces[-1].continues
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = {s: sum(r.length for r in p) for s, p in by_sequence.items()}
    assert all(n == 2048 for s, n in sizes.items() if s < len(sizes) - 1)
    whole = {r.sequence_id: r for r in assemble(made, pad_id=7).collect()}
    for s, p in by_sequence.items():
        p.sort(key=lambda r: r.offset)
        assert [r.offset for r in p] == np.cumsum([0, *[r.length for r in p[:-1]]]).tolist()
        assert np.frombuffer(whole[s].ids, "<u4").tolist()[: sizes[s]] == np.frombuffer(b"".join(r.ids for r in p), "<u4").tolist()
        assert len(whole[s].ids) == 4 * 2048
    assert pack(docs.limit(0), TOKENIZER).count() == 0


def test_sequences_follow_the_mix_over_several_files(spark, small, tmp_path):
    rows = [(i, "abc"[i % 3], " ".join([f"w{i}"] * (i % 40 + 1))) for i in range(3000)]
    mixed = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    path, times = f"{tmp_path}/mixing", defaultdict(list)
    for r in mixed.collect():
        times[r.doc_id] += r.positions
    # A file for each range of time, the later ones with more rows, as Spark reads long files first.
    at = mixed.withColumn("_at", F.explode("positions")).withColumn("_file", F.floor(5 * F.col("_at") ** 0.5).cast("int"))
    for f in range(6):
        some = at.filter(F.col("_file") == f).orderBy("_at").select("doc_id", "source", "text").coalesce(1)
        some.write.parquet(f"{path}-{f}")
        (part,) = (tmp_path / f"mixing-{f}").glob("part-*.parquet")
        (tmp_path / "mixing").mkdir(exist_ok=True)
        part.rename(tmp_path / f"mixing/part-{f:05d}-x.parquet")
    pieces = corpus_pipeline.packing(spark, spark.read.parquet(path), small).filter("start = 0").collect()
    pieces.sort(key=lambda r: (r.sequence_id, r.offset))
    assert len(pieces) == sum(map(len, times.values())) and pieces[-1].sequence_id > 10
    left = {i: sorted(x, reverse=True) for i, x in times.items()}
    found = [left[r.doc_id].pop() for r in pieces]
    assert found == sorted(found)


@pytest.mark.parametrize("cell_rows", [3, 16_384])
def test_shards_have_exact_sizes_and_keep_all_rows(spark, cell_rows):
    rows = [(i % 70 if i % 9 else None, "t" * (i % 5), i, i) for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, _x int").repartition(5)
    got = sharding.shuffle_to_shards(docs, 7, cell_rows=cell_rows).collect()
    assert Counter((r.doc_id, r.text, r._x) for r in got) == Counter((r[0], r[1], r[3]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [29] * 7 and all(sorted(s) == list(range(29)) for s in slots.values())
    assert sharding.shuffle_to_shards(docs.limit(0), 7).count() == 0
    assert sharding.shuffle_to_shards(docs.limit(3), 7).count() == 3


def test_matrix_rows_add_up_and_spread():
    sizes, cells = np.array([5, 0, 900, 37, 58]), np.array([250, 250, 251, 249])
    ends = np.cumsum([0, *sizes])
    rows = np.array([sharding.matrix_row(p, ends, cells, 1) for p in range(5)])
    assert rows.sum(axis=1).tolist() == sizes.tolist() and rows.sum(axis=0).tolist() == cells.tolist() and rows.min() >= 0
    many = np.array([sharding.matrix_row(2, ends, cells, s)[0] for s in range(300)])
    mean, spread = 900 * 0.25, (900 * 0.25 * 0.75 * 100 / 999) ** 0.5
    assert abs(many.mean() - mean) < 4 * spread / 300**0.5 and 0.8 < many.std() / spread < 1.2


def test_draws_from_large_populations():
    rng = np.random.default_rng(3)
    found = [sharding._rejection_draw(rng, 3 * 10**9, 10**9, 1000) for _ in range(2000)]
    assert abs(np.mean(found) - 750) < 1.5 and abs(np.std(found) - (1000 * 0.75 * 0.25) ** 0.5) < 1
    assert sharding.draw_counts(rng, np.array([2 * 10**9, 10**9]), 50).sum() == 50


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "c", None, ""]), " ".join(["w"] * rng.randint(0, 30))) for i in range(3000)]
    rows += [(None, "a", "x y"), (5000, "d", None), (5001, "d", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("kept out"))
    got = mix(docs).collect()
    assert len(got) == len(rows)
    totals = Counter()
    for _, s, t in rows:
        totals[s] += len((t or "").split())
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped: set = set()
    while True:  # share out, stop what is above, share again
        rest = sum(totals.values()) - sum(3 * totals[s] for s in capped)
        free = [s for s in totals if s not in capped]
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * totals[s]}
        if not over:
            break
        capped |= over
    wanted = {s: 3 * totals[s] if s in capped else weight[s] * level for s in totals}
    taken = Counter()
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - wanted[r.source]) < 1e-6 * max(wanted[r.source], 1)
        assert r.taken <= 3 * r.size and len(r.positions) * r.size == r.taken and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 15 for s in totals)
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.taken, r.positions)
    assert sorted(map(key, got)) == sorted(map(key, again))
    ordered = training_order(mix(docs))
    assert ordered.columns == ["doc_id", "source", "text"] and ordered.count() == sum(len(r.positions) for r in got)
    assert mix(docs.limit(0)).count() == 0


def test_a_fading_source_comes_early(spark):
    rows = [(i, "abc"[i % 3], "w w w w") for i in range(900)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    half = {s: np.mean([p < 0.5 for r in got if r.source == s for p in r.positions]) for s in "abc"}
    assert abs(half["a"] - 0.625) < 0.02 and abs(half["b"] - 0.5) < 0.02 and abs(half["c"] - 0.375) < 0.02


def brute_top_k(rows, k):
    vectors = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in vectors if i % 10 == 0}:
        best: dict = {}
        for a in (v for i, v in vectors if i == q):
            for i, b in vectors:
                if i != q:
                    s = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b))))
                    best[i] = max(s, best.get(i, s))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_top_k_is_that_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("pagewright.llm.topk.BLOCK_ROWS", block)
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.0, 1.5, -0.7, 0.001, 2.0]) for _ in range(6)]) for i in range(60)]
    rows += [(70, None), (80, [1.0, None]), (90, [float("nan")] * 6), (91, [float("inf")] * 6), (None, [1.0] * 6), (20, [3.0] * 6), (33, rows[33][1]), (100, []), (110, [1e17] * 6), (111, [1e17] * 3)]
    docs = spark.createDataFrame(rows, "vec_id long, e array<double>").repartition(3)
    got = {(r.query_id, r["rank"], r.id, r.score) for r in top_k(docs, F.col("vec_id") % 10 == 0, "vec_id", "e", 5).collect()}
    assert got == brute_top_k(rows, 5)
    assert top_k(docs.limit(0), F.col("vec_id") % 10 == 0, "vec_id", "e").count() == 0


def test_top_k_of_ids_that_many_rows_repeat(spark):
    rows = [(0, [1.0])] + [(1, [9.0])] * 10 + [(1, [3.0])] + [(2, [5.0])] * 4 + [(3, [4.0]), (4, [2.0]), (5, [4.0])]
    docs = spark.createDataFrame(rows, "vec_id long, e array<double>").coalesce(1)
    got = {(r.query_id, r["rank"], r.id, r.score) for r in top_k(docs, F.col("vec_id") % 10 == 0, "vec_id", "e", 3).collect()}
    assert len(got) == 3 and got == brute_top_k(rows, 3)


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "?"),
        (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 1, None, None), (6, 0, "user", "a"), (7, 0, "system", "a"), (None, 0, "user", "z"),
    ]
    held = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("chosen", F.lit(9))
    got = {r.pair_id: r for r in format_preferences(held, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == ("<|user|>\nhi\n", "<|assistant|>\ngood\n", "<|assistant|>\nbad\n<|user|>\n?\n")
    assert [tuple(r) for r in got[0].rejected_mask] == [(14, False), (4, True), (9, False), (2, False)] and got[0].usable
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].usable) == (1, "", False)
    assert got[2].chosen == "<|none|>\n\n" and got[2].rejected == "" and got[3].n_prompt_turns == 0


def labelled(spark, n, make):
    rng = random.Random(8)
    rows = [(i, *make(rng, i)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, None), (n + 1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (n, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def good_text(rng, n):
    return " ".join("".join(rng.choices(["the", "er", "tion", "an", "st", "ou"], k=rng.randint(1, 3))) for _ in range(n))


def test_quality_is_learned(spark):
    def make(rng, i):
        text = good_text(rng, rng.randint(5, 120))
        return (text, 1) if i % 3 else ("!! ".join(text.upper().split()), 0)

    docs, labels, truth = labelled(spark, 300, make)
    got = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels, F.col("doc_id") % 2 == 0)).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values()) and got[300] == got[301]
    assert np.mean([(got[i] >= 0.5) == y for i, y in truth.items() if i % 2]) > 0.95


def test_quality_is_learned_behind_a_common_beginning(spark, monkeypatch):
    monkeypatch.setattr("pagewright.llm.quality.PIECES", 60)

    def make(rng, i):
        text = good_text(rng, 120)
        return "same words to begin with " * 11 + (text if i % 3 else "!! ".join(text.upper().split())), int(i % 3 > 0)

    docs, labels, truth = labelled(spark, 400, make)
    model = fit_quality(docs, labels, F.col("doc_id") % 2 == 0)
    assert b"THE" in model.bad and b"THE" not in model.good and b"the" in model.good
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in truth.items() if i % 2]) > 0.95


def test_quality_without_labels_of_both_kinds(spark):
    docs, labels, _ = labelled(spark, 20, lambda rng, i: (good_text(rng, 20), 1))
    for given in (labels.filter("quality = 1"), labels.limit(0)):
        assert all(0 <= r.score <= 1 for r in score_quality(docs, fit_quality(docs, given, F.lit(True))).collect())


def test_toxicity_is_learned_and_misspellings_share(spark):
    def make(rng, i):
        held = good_text(rng, rng.randint(20, 150)).split()
        if i % 4 == 0:
            for _ in range(1 + len(held) // 15):
                held[rng.randrange(len(held))] = rng.choice(["idiotic", "worthless", "scummy"])
        return " ".join(held), int(i % 4 == 0)

    docs, labels, truth = labelled(spark, 400, make)
    model = fit_toxicity(docs, labels, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    assert np.mean([(got[i] >= 0.3) == y for i, y in truth.items() if i % 2]) > 0.93
    plain = good_text(random.Random(1), 40)
    clean, unseen = model.scores([plain.encode(), (plain + " idiotics worthles scumy").encode()])
    assert unseen > clean
    kept = drop_toxic(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    empty = fit_toxicity(docs, labels.limit(0), F.lit(True))
    assert drop_toxic(docs.limit(0), empty).count() == 0


def test_crc_of_ids_is_that_of_the_query(spark, small):
    from pagewright.llm.queries import op7_packing

    r = op7_packing(spark, small).orderBy("doc_id", "start").first()
    text = spark.read.parquet(f"{small}/documents.parquet").filter(F.col("doc_id") == r.doc_id).first().text
    ids = [*Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids, 1]
    assert zlib.crc32(np.array(ids[: r.length], "<u4").tobytes()) == r.ids_crc32
