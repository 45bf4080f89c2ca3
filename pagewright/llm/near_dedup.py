"""Near-duplicate groups: SetSketch registers in bands find candidates, a joint likelihood thins them, full sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import sketches
from pagewright.llm.arrow import slices, text_parts, tidy
from pagewright.llm.components import FOREST_ROWS, Forest, components
from pagewright.llm.staging import ROW, free, stage, stage_rows

#: Links need 100 * intersection >= PERCENT * union. Below LEAST_PERCENT the bands would miss pairs.
PERCENT, LEAST_PERCENT = 85, 70

#: A pair whose likeliest similarity is this much below the threshold is no candidate: over four standard deviations of
#: the estimate from 128 registers. Registers agree about as often as the sets do, so a pair in which they agree less
#: often by SLACK more is not even estimated.
MARGIN, SLACK = 0.175, 0.125

#: Most members, and most shingles, of a block. A larger group is cut into blocks; PIVOTS of its members are in each.
BLOCK, BLOCK_SHINGLES, PIVOTS = 128, 1 << 20, 4

#: Rows and pairs that a task holds at once; bytes of text.
HELD_ROWS, HELD_PAIRS, HELD_BYTES = 16_384, 1 << 15, 1 << 20

#: Most words of 64 bits that say which rows of a table a join will need.
MARK_WORDS = 1 << 20

ALL = 2


def sketch_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """ROW, key, n, same, sketch: size of each row's set, a SHA-256 digest of its words in order, and its registers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, texts in text_parts(batch.column(2), HELD_BYTES):
                words = [sketches.words_of(t) for t in texts]
                sets = sketches.shingle_sets(words)
                found = sketches.registers(sets.hashes, sets.bounds)
                part = batch.slice(cut.start, cut.stop - cut.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(sets.bounds)),
                        pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()),
                        pa.array([x.tobytes() for x in found], pa.binary()),
                    ],
                    [ROW, "key", "n", "same", "sketch"],
                )

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(ROW, F.col(key).alias("key"), F.col(text).cast("string").alias("_pw_text")).mapInArrow(
        run, f"{ROW} long, key {kind}, n long, same binary, sketch binary"
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of some thousand rows that hold whole groups, from batches that are sorted by `columns`."""
    rest: list[pa.RecordBatch] = []

    def last_start(table: pa.Table) -> int:
        last = table.num_rows - 1
        same = np.ones(table.num_rows, bool)
        for c in columns:
            x = table.column(c).to_numpy()
            same &= x == x[last]
        return int(np.flatnonzero(same)[0])

    for batch in batches:
        rest.append(batch)
        if sum(b.num_rows for b in rest) >= HELD_ROWS or sum(b.nbytes for b in rest) >= 32 * HELD_BYTES:
            table = pa.Table.from_batches(rest).combine_chunks()
            cut = last_start(table)
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).to_batches()
    if rest and sum(b.num_rows for b in rest):
        yield pa.Table.from_batches(rest).combine_chunks()


def _bounds_of(table: pa.Table, columns: list[str]) -> np.ndarray:
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for c in columns:
        x = table.column(c).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(fresh), table.num_rows)


def _may_be_in(payload: DataFrame, members: DataFrame) -> DataFrame:
    """payload without most of the rows whose member is not among members, which are to be a staged table.

    A join moves all rows of both sides, so sketches and texts that it would drop are left out before. Marks of the members
    are broadcast: one bit for each, in MARK_WORDS words at most; where several members share a bit, more rows stay.
    """
    word = F.pmod(F.xxhash64(F.shiftright("member", 6)), F.lit(MARK_WORDS))
    bit = F.expr("shiftleft(1L, cast(member & 63 as int))")
    marks = members.select(word.alias("_pw_word"), bit.alias("_pw_bit")).groupBy("_pw_word").agg(F.bit_or("_pw_bit").alias("_pw_bits"))
    marked = payload.withColumns({"_pw_word": word, "_pw_bit": bit}).join(F.broadcast(marks), "_pw_word")
    return marked.filter(F.col("_pw_bits").bitwiseAND(F.col("_pw_bit")) != 0).select(*payload.columns)


Match = Callable[[pa.Table, np.ndarray, Callable], Iterator[tuple[np.ndarray, np.ndarray]]]


def group_links(members: DataFrame, payload: DataFrame, match: Match, name: str) -> DataFrame:
    """a, b: edges that connect what the true links within each group connect.

    members has grp, member and n (its shingles), payload has member and what match() compares. A group that fits into a
    block is compared pair by pair in one task. A larger one goes through two passes. First its members are dealt into
    blocks and a few pivots are added to each, so nearly all of a group of copies is linked with the first pivot by as
    many comparisons as it has members times a block. Then only the members that the links so far do not connect with that
    pivot meet all others of the group, in blocks against blocks, as far as they are in another component. No pair that
    could add to the components is left out; the second pass grows with the square of a group only as far as its
    members are no copies of each other.
    """
    size = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sizes = members.groupBy("grp").agg(F.count("*").alias("members"), F.ceil(size).cast("int").alias("blocks")).filter("members > 1")
    sizes = stage(sizes.select("grp", "blocks"), f"{name}-sizes")
    own = lambda blocks: F.pmod(F.xxhash64("member"), F.col(blocks)).cast("int")
    dealt = members.select("grp", "member").join(sizes, "grp")
    large = stage(dealt.filter("blocks > 1"), f"{name}-large")
    first = dealt.select("grp", own("blocks").alias("i"), F.lit(0).alias("j"), "member")
    ordered = [F.min(F.struct(F.xxhash64("member", F.lit(k)).alias("h"), "member")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = stage(large.groupBy("grp").agg(F.max("blocks").alias("blocks"), *ordered), f"{name}-pivots")
    spread = pivots.select("grp", "blocks", F.explode(F.array_distinct(F.array(*[f"p{k}.member" for k in range(PIVOTS)]))).alias("member"))
    spread = spread.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), "member", own("blocks").alias("at"))
    first = first.unionByName(spread.filter("i <> at").drop("at"))
    links = _matched(first.withColumns({"side": F.lit(ALL), "part": F.col("member")}), payload, match, f"{name}-first")
    if large.isEmpty():
        return links
    links = stage(links, f"{name}-links")
    parts = components(links).select(F.col("node").alias("member"), "root")
    held = large.join(parts, "member", "left").select("grp", "blocks", "member", F.coalesce("root", "member").alias("part"))
    chief = pivots.select("grp", F.col("p0.member").alias("member")).join(parts, "member", "left")
    held = held.join(stage(chief.select("grp", F.coalesce("root", "member").alias("chief")), f"{name}-chiefs"), "grp")
    held = stage(held, f"{name}-parts")
    apart = held.filter("part <> chief")
    counts = apart.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rest"))
    counts = stage(counts, f"{name}-rest")
    if counts.isEmpty():
        return links
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    payload = _may_be_in(payload, held.join(counts, "grp"))
    left = apart.join(counts, "grp").select("grp", own("rest").alias("i"), every("blocks").alias("j"), "member", F.lit(0).alias("side"), "part")
    right = held.join(counts, "grp").select("grp", every("rest").alias("i"), own("blocks").alias("j"), "member", F.lit(1).alias("side"), "part")
    return links.unionByName(_matched(left.unionByName(right), payload, match, f"{name}-second"))


def _matched(placed: DataFrame, payload: DataFrame, match: Match, name: str) -> DataFrame:
    """Stars of what the links that match() finds within each (grp, i, j) of placed members connect.

    All members of a block of the side ALL meet; of other blocks the two sides do, if they are of different parts.
    """
    group = ["grp", "i", "j"]
    grouped = placed.join(payload, "member").repartition(*group).sortWithinPartitions(*group, "side")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in _whole_groups(batches, group):
            ids, side, part = (table.column(c).to_numpy() for c in ("member", "side", "part"))

            def due(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (side[a] == ALL) | (side[a] != side[b]) & (part[a] != part[b])

            for a, b in match(table, _bounds_of(table, group), due):
                forest.link(ids[a], ids[b])
            if len(forest.parent) > FOREST_ROWS:
                yield forest.batch()
                forest = Forest()
        yield forest.batch()

    return grouped.mapInArrow(run, "a long, b long")


def _pairs(bounds: np.ndarray, due: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each group that are due, some ten thousand at a time."""
    held_a, held_b, n = [], [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a == 2:
            x, y = np.array([a]), np.array([a + 1])
        else:
            x, y = (a + z for z in np.triu_indices(b - a, 1))
        use = due(x, y)
        held_a.append(x[use])
        held_b.append(y[use])
        n += len(held_a[-1])
        if n >= HELD_PAIRS:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, n = [], [], 0
    if n:
        yield np.concatenate(held_a), np.concatenate(held_b)


def candidate_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: edges that connect all sets that share a band and may be similar enough.

    sets has set_id, n and sketch. The key of a band is counted first; of keys that one set alone has nothing more is
    moved. See group_links() for keys that many sets share.
    """
    least = percent / 100 - MARGIN
    agree = int(sketches.REGISTERS * (least - SLACK))

    @tidy
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column(1).to_pylist())
            keys = sketches.band_keys(np.frombuffer(data, np.uint16).reshape(-1, sketches.REGISTERS)).view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["grp", "member"])

    def likely(table: pa.Table, bounds: np.ndarray, due: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = table.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, sketches.REGISTERS)
        for a, b in _pairs(bounds, due):
            near = (sketch[a] == sketch[b]).sum(axis=1) >= agree
            a, b = a[near], b[near]
            use = sketches.estimate(sketch[a], sketch[b], n[a], n[b]) >= least
            yield a[use], b[use]

    bands = sets.select("set_id", "sketch").mapInArrow(keyed, "grp long, member long").withColumn("n", F.lit(0))
    return group_links(bands, sets.select(F.col("set_id").alias("member"), "n", "sketch"), likely, "bands")


def verified_links(groups: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: edges that connect what all true links of each candidate component connect, and nothing more.

    groups, a staged table, has node, root and n; texts has ROW and text. Texts of candidates alone are moved, once to the
    component's block, and again only as group_links() says; there the full set is made and pairs are counted by the
    shingles that they share.
    """

    def linked(table: pa.Table, bounds: np.ndarray, due: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts_ = table.column("text").cast(pa.binary()).to_pylist()
        weights = np.add.reduceat(np.array([len(t or b"") for t in texts_], np.int64), bounds[:-1])
        for some in slices(weights, HELD_BYTES):
            ends = bounds[some.start : some.stop + 1]
            first = int(ends[0])
            sets = sketches.shingle_sets([sketches.words_of(t or b"") for t in texts_[first : ends[-1]]])
            for a, b in zip((ends[:-1] - first).tolist(), (ends[1:] - first).tolist()):
                x, y = _similar(sets, a, b, percent)
                x, y = x + first, y + first
                use = due(x, y)
                yield x[use], y[use]

    members = groups.select(F.col("root").alias("grp"), F.col("node").alias("member"), "n")
    held = _may_be_in(texts.select(F.col(ROW).alias("member"), "text"), members.select("member"))
    return group_links(members, held, linked, "likely")


def _similar(sets: sketches.Sets, a: int, b: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the sets a to b - 1 with 100 * intersection >= percent * union, the smaller place first."""
    if b - a < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = sets.ids[sets.bounds[a] : sets.bounds[b]]
    size = np.diff(sets.bounds)[a:b]
    row = np.repeat(np.arange(b - a), size)
    order = np.argsort(part, kind="stable")
    part, row = part[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    times = np.diff(starts, append=len(part))
    column = np.repeat(np.cumsum(times > 1) - 1, times)
    use = np.repeat(times > 1, times)  # a shingle of one set alone is in no intersection
    row, column = row[use], column[use]
    common = np.zeros((b - a, b - a), np.int64)
    step = max(1, (8 << 20) // (4 * (b - a)))  # columns at once: below 2 ** 24, so sums of floats are exact
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        x, y = np.searchsorted(column, [c, c + step])
        matrix = np.zeros((b - a, min(step, int(column[-1]) + 1 - c)), np.float32)
        matrix[row[x:y], column[x:y] - c] = 1
        common += (matrix @ matrix.T).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    x, y = np.nonzero(np.triu((100 * common >= percent * union) & (union > 0), 1))
    return a + x, a + y


def near_groups(rows: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """ROW, key, n_shingles, component_id, leads for each row of a table from stage_rows().

    Rows with the same words in the same order are one set from the start, led by the least key; a hot group of copies is
    one set. Sets that share a band of registers and are likely to be similar make candidate components, and within these
    links are verified on full sets, shingle by shingle; hashes decide no link and no size. component_id is the least key
    reachable; leads marks the one row that stands for the component, of equal keys the first row.
    percent: 70 to 100, else ValueError, as 32 bands of four registers miss pairs of lower similarity; at 85 they miss one
    in 10 ** 10, at 70 one in 6,000. Null and empty texts have no set and are linked with nothing; texts of fewer than
    five words are one shingle; null keys come after all others; rows that repeat are copies; very long texts count
    whole; an empty table gives no rows. Only key and text are read, whatever other columns are called.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {LEAST_PERCENT} and 100, not {percent}")
    sketched = stage(sketch_rows(rows, key, text), "sketches")
    lead = F.min(F.struct(F.col("key").isNull().alias("none"), "key", ROW)).alias("lead")
    sets = sketched.filter("n > 0").groupBy("same").agg(lead, F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    sets = stage(sets.withColumn("set_id", F.col(f"lead.{ROW}")), "sets")
    fuzzy = components(candidate_links(sets, percent))
    fuzzy = stage(fuzzy.join(sets.select(F.col("set_id").alias("node"), "n"), "node"), "candidates")
    links = verified_links(fuzzy, rows.select(ROW, F.col(text).cast("string").alias("text")), percent)
    linked = stage(components(links).select(F.col("node").alias("set_id"), "root"), "linked")
    rooted = sets.select("same", "set_id", "lead").join(linked, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    # Both sides of each join below are plain exchanges, so that a hot root or text is a skewed side that can be split.
    rooted = stage(rooted, "rooted")
    heads = stage(rooted.groupBy("root").agg(F.min("lead").alias("head")), "heads")
    heads = stage(rooted.join(heads, "root").select("same", "head"), "led")
    full = sketched.filter("n > 0").select(ROW, "key", "n", "same").join(heads, "same", "left")
    free(rooted, linked, sets)
    shown = lambda table, component, leads: table.select(
        ROW, F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), leads.alias("leads")
    )
    return shown(full, F.col("head.key"), F.col(f"head.{ROW}") == F.col(ROW)).unionByName(
        shown(sketched.filter("n = 0"), F.col("key"), F.lit(True))
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the least key; all columns as they came.

    Nulls, repeats and other cases are as in near_groups(): null and empty texts all stay, of equal rows one does.
    """
    rows = stage_rows(docs, "documents")
    dropped = stage(near_groups(rows, key, text, percent).filter(~F.col("leads")).select(ROW), "dropped")
    return rows.join(dropped, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def brute_force(ids: list, texts: list[str | None], percent: int = PERCENT) -> list[tuple]:
    """(id, n_shingles, component_id) by comparing all pairs, for tests."""
    import re

    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\\x20\\x09-\\x0d]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    forest = Forest()
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                forest.link(np.array([i]), np.array([j]))
    least: dict[int, int] = {}
    for i, x in enumerate(ids):
        r = forest.root(i)
        least[r] = min(x, least.get(r, x))
    return [(x, len(s), least[forest.root(i)]) for i, (x, s) in enumerate(zip(ids, sets))]
