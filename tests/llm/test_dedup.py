from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import components as graph
from pagewright.llm import near_dedup, sketches, substring_dedup
from pagewright.llm.components import components
from pagewright.llm.exact_dedup import CountingQuotientFilter, drop_exact_copies, exact_groups
from pagewright.llm.staging import stage_rows

DOCS = "doc_id long, text string, fp string, n long, _row string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n)]


def thue_morse(n: int) -> tuple[str, str]:
    """Two different words that polynomial hashes modulo a power of two take for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_filter_is_lossless_and_mergeable():
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    parts = [rng.choice(values, n) for n in (0, 1, 7, 2000)] + [np.array([-1, 0, -1, 1])]
    filters = [CountingQuotientFilter.from_bytes(CountingQuotientFilter.build(p).to_bytes()) for p in parts]
    merged = CountingQuotientFilter.merge(filters)
    wanted = Counter(int(x) for p in parts for x in p)
    assert dict(zip(merged.fingerprints().view(np.int64).tolist(), merged.counts.tolist())) == wanted
    assert set(merged.repeated().view(np.int64).tolist()) == {k for k, n in wanted.items() if n > 1}


def test_exact_groups_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a", "x", 1, "r"), (5, "a", None, 2, None), (3, None, "y", 3, "r"), (4, "", "y", 4, "r"), (4, "", "y", 4, "r"), (None, "a", "z", None, "r"), (9, "A", "z", 1, "r")]
    docs = spark.createDataFrame(rows, DOCS)
    got = exact_groups(stage_rows(docs, "documents")).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size) for r in got) == [(-1, 5, 3), (1, 5, 3), (3, 4, 3), (4, 4, 3), (4, 4, 3), (5, 5, 3), (9, 9, 1)]
    assert sorted(r.doc_id for r in got if r.kept) == [4, 5, 9]
    assert {r.text_sha256 for r in got if r.doc_id == 9} == {hashlib.sha256(b"A").hexdigest()}
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 9]
    assert drop_exact_copies(docs.limit(0)).count() == 0


def substring_cases() -> list[str | None]:
    rng = random.Random(3)
    shared, loop = words(rng, 60), words(rng, 2)
    out: list[str | None] = [" ".join(words(rng, rng.randint(0, 120))) for _ in range(30)]
    out += [" ".join(words(rng, 20) + shared[a:b] + words(rng, 20)) for a, b in [(0, 60), (5, 40), (20, 60), (0, 34), (10, 45)]]
    out += ["same " * 80, "same " * 36, " ".join(loop * 40), " ".join(loop * 20 + ["end"]), " ".join((words(rng, 3) * 30)[:70])]
    out += [None, "", "  \t\n", "x" * 5000, out[3], out[3], "\n".join(shared), "\xa0".join(shared[:40]), "ä " + " ".join(shared)]
    return out


@pytest.mark.parametrize("rounds", ["RPRPPPP", "P", "RRPPPPPPPP"])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(substring_dedup.Grammar.__init__, "__defaults__", (rounds,))
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    texts = substring_cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == substring_dedup.brute_force(texts)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_windows_with_words_of_equal_polynomial_hashes_differ(spark):
    a, b = thue_morse(12)
    rest = [f"w{i}" for i in range(36)]
    texts = [" ".join([*rest[:18], x, *rest[18:]]) for x in (a, b)] + [" ".join(rest[:34]), "v " * 80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == substring_dedup.brute_force(texts) and got[0][1] == 0


def test_symbols_of_equal_windows_agree_wherever_they_stand():
    rng = random.Random(5)
    window = words(rng, 35)
    found = set()
    for _ in range(20):
        before = words(rng, rng.randint(0, 30))
        w = substring_dedup.Words([" ".join(before + window + words(rng, 10)).encode()])
        g = substring_dedup.Grammar(w)
        found.add(g.names[g.left[len(before)] : g.right[len(before) + 35]].tobytes())
    assert len(found) == 1 and found != {b""}


def near_cases() -> list[tuple]:
    rng = random.Random(7)
    out: list[tuple] = []
    for g in range(12):
        base = words(rng, rng.choice([6, 40, 120, 300]))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice("pqrst")
            out.append(" ".join(copy))
    hot = words(rng, 100)
    for _ in range(160):  # a group of which many pairs lie just under the threshold
        copy = list(hot)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = "".join(rng.choices("uvwxyz", k=5))
        out.append(" ".join(copy))
    out += [None, "", " \n", "one", "ONE", "one two three four", "One two three FOUR", "É a b c d", "é a b c d", "a b c d e f", "A  b\tc d E\nf"]
    rng.shuffle(out)
    return [(i * 3 + 1, t, "x", i, None) for i, t in enumerate(out)]


@pytest.mark.parametrize("percent, block", [(85, 128), (80, 128), (85, 16), (70, 5)])
def test_near_groups_are_those_of_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_cases()
    docs = spark.createDataFrame(rows, DOCS)
    got = near_dedup.near_groups(stage_rows(docs, "documents"), percent=percent).collect()
    wanted = near_dedup.brute_force([r[0] for r in rows], [r[1] for r in rows], percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(wanted)
    assert sorted(r.doc_id for r in got if r.leads) == sorted({c for _, _, c in wanted})


def test_words_of_equal_polynomial_hashes_are_different_words(spark):
    a, b = thue_morse(12)
    rows = [(1, a), (2, b), (3, f"x {a} y z u v"), (4, f"x {b} y z u v"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(stage_rows(docs, "documents")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(near_dedup.brute_force([r[0] for r in rows], [r[1] for r in rows]))
    assert {r.component_id for r in got} == {1, 2, 3, 4}


def test_percent_below_what_bands_find_is_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        near_dedup.near_groups(stage_rows(docs, "documents"), percent=60)


@pytest.mark.parametrize("percent", [85, 80, 70])
def test_pairs_at_the_threshold_are_candidates(spark, percent):
    rng, rows = random.Random(percent), []
    for k in range(300):  # pairs of 105 shingles a side, of which so many are shared that the pair just reaches the threshold
        base = words(rng, 109)
        share = -(-2 * 105 * percent // (100 + percent))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: share + 4] + words(rng, 105 - share)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(stage_rows(docs, "documents"), percent=percent).collect()}
    assert np.mean([got[2 * k + 1] == 2 * k for k in range(300)]) >= 0.99


def test_near_copies_drop_but_one(spark):
    rows = [(2, "a b c d e f", "x", 1, None), (1, "A b c d e f", None, None, None), (1, "A b c d e f", None, None, None), (None, "a B c d e f", "y", 1, None), (7, None, "z", 2, None), (8, "", "z", 2, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 7, 8]
    assert near_dedup.drop_near_copies(docs.limit(0)).count() == 0


def test_registers_merge_as_sets_do():
    sets = sketches.shingle_sets([[w.encode() for w in words(random.Random(k), 80)] for k in (1, 2)])
    h, s = sets.hashes, sets.bounds
    union = np.unique(h)
    both = sketches.registers(h, s)
    assert (sketches.registers(union, np.array([0, len(union)]))[0] == both.max(axis=0)).all()


def test_estimates_are_near_the_truth():
    rng = random.Random(11)
    base, pairs = words(rng, 400), []
    for k in (0, 5, 10, 20, 40, 80):
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(400)] = "zz"
        pairs.append([w.encode() for w in copy])
    sets = sketches.shingle_sets([[w.encode() for w in base], *pairs])
    r, n = sketches.registers(sets.hashes, sets.bounds), np.diff(sets.bounds)
    a, b = np.zeros(len(pairs), int), np.arange(1, len(pairs) + 1)
    common = sketches.intersections(sets, a, b)
    truth = common / (n[a] + n[b] - common)
    assert np.abs(sketches.estimate(r[a], r[b], n[a], n[b]) - truth).max() < 0.15


@pytest.mark.parametrize("share", [1 << 19, 50, 7])
def test_components_of_paths_stars_and_rings(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "FOREST_ROWS", share)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, x) for x in range(101, 140)]
    ring = [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + ring, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words", [near_dedup.MARK_WORDS, 1])
def test_texts_that_are_no_candidates_are_not_moved(spark, monkeypatch, words):
    moved, links = [], near_dedup.group_links
    monkeypatch.setattr(near_dedup, "MARK_WORDS", words)
    monkeypatch.setattr(near_dedup, "group_links", lambda m, payload, *more: moved.append(payload.count()) or links(m, payload, *more))
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[7] + " more"])), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(stage_rows(docs, "documents")).collect()}
    assert got == {i: i for i in range(300)} | {300: 7}
    assert moved[0] == 301 and (moved[1] == 2 or words == 1 and 2 <= moved[1] < 30)
