"""Queries without SQL against plain Python on small tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewright.llm import quality, queries, toxicity

WORDS = ["the", "of", "and", "tion", "er", "harm", "less", "ß", "é", "日本"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels with nulls, empty and long texts, repeated rows and labels out of range."""
    rng = random.Random(3)
    text = lambda n, bad: " ".join(rng.choice(["scum", "idiot"]) if bad and i % 9 == 4 else rng.choice(WORDS) for i in range(n))
    rows = [(i, text(rng.randint(5, 90), i % 5 == 0), "en", "ab"[i % 2], 1) for i in range(160)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, text(40_000, False), "en", "a", 1), (7, "other text", "en", "b", 1), rows[8], (None, "x y", "en", "a", 3)]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(120)] + [(0, 0, 1), (None, 1, 1), (121, None, None), (122, 2, 7)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def held_out(key, modulus):
    return zlib.crc32(("" if key is None else str(key)).encode()) % modulus


def plain_score(model, text):
    """A toxicity score, n-gram by n-gram."""
    folded = bytes(toxicity._FOLD[np.frombuffer(b" " + toxicity.fold(text) + b" ", np.uint8)])
    total, n = 0.0, 0
    for length in toxicity.LENGTHS:
        for i in range(len(folded) - length + 1):
            gram = folded[i : i + length]
            if b" " in gram[1:-1]:
                continue
            code = 0
            for k, b in enumerate(gram):
                code = (b if not k else code * 16777619 ^ b) & 0xFFFFFFFF
            mixed = ((code ^ (code >> 15)) * 2654435761 + length) & 0xFFFFFFFF
            total += float(model.weights[(mixed * 2246822519 & 0xFFFFFFFF) >> (32 - toxicity.BUCKETS.bit_length() + 1)])
            n += 1
    return 1 / (1 + np.exp(-np.clip(total / max(n, 1) + model.offset, -40, 40)))


def test_toxicity_query(spark, tables, monkeypatch):
    folder, rows = tables
    models = []
    monkeypatch.setattr(queries, "fit_toxicity", lambda *a, **k: models.append(toxicity.fit_toxicity(*a, **k)) or models[-1])
    got = queries.op5_toxicity(spark, folder).collect()
    assert len(got) == len(rows)
    wanted = defaultdict(list)
    for key, text, *_ in rows:
        wanted[key].append(plain_score(models[0], text))
    for r in got:
        assert min(abs(r.score - x) for x in wanted[r.doc_id]) < 1e-5
        assert r.held_out == (held_out(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 160]) > 0.9


def test_a_long_text_scores_as_its_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(WORDS) for _ in range(3000)).encode()
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32), 0.2)
    whole, bag = model.scores([text, b"", text[:50]]), toxicity.bag(text)
    monkeypatch.setattr(toxicity.cut, "__defaults__", (64,))
    assert np.allclose(model.scores([text, b"", text[:50]]), whole, atol=1e-6)
    assert all((a == b).all() for a, b in zip(toxicity.bag(text), bag))
    assert b"".join(toxicity.cut(b"x" * 200, 64)) == b"x" * 200


def test_quality_query(spark, tables, monkeypatch):
    folder, rows = tables
    models = []
    monkeypatch.setattr(queries, "fit_quality", lambda *a, **k: models.append(quality.fit_quality(*a, **k)) or models[-1])
    got = queries.op2_quality(spark, folder).collect()
    assert len(got) == len(rows)
    wanted = defaultdict(list)
    for key, text, *_ in rows:
        wanted[key].append(models[0].score(text))
    for r in got:
        assert min(abs(r.score - x) for x in wanted[r.doc_id]) < 1e-9
        assert r.held_out == (held_out(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5)
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert quality.score_quality(empty, models[0]).count() == 0


def test_sharding_query(spark, tables):
    folder, rows = tables
    got = queries.op6_sharding(spark, folder).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, size(t), zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_preference_query_shares_turns(spark, small):
    got = queries.op3_preference(spark, small).collect()
    assert np.mean([r.n_prompt_turns > 0 for r in got]) > 0.5 and np.mean([r.usable for r in got]) > 0.5


def test_mixing_positions_are_sorted(spark, small):
    got = [r.position_1 for r in queries.op4_mixing(spark, small).collect()]
    placed = [p for p in got if p is not None]
    assert placed == sorted(placed) and got[: len(placed)] == placed
