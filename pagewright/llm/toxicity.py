"""Toxicity by subword-bag embeddings: the mean of character n-gram vectors under a linear softmax."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import give_back, text_parts, tidy
from pagewright.llm.labelled import labelled_sample

#: Lengths in bytes of the n-grams, word edges included; buckets that their hashes fall in; length of a vector.
LENGTHS, BUCKETS, WIDTH = (3, 4, 5), 1 << 17, 8
#: Most labelled documents of classes 0 and 1 to learn from; each teaches with its whole text.
MOST_ROWS = (10_000, 3_000)
#: An n-gram of fewer of these documents has no vector. One of the share p of all n-grams counts RARE / (RARE + p) in a mean.
MIN_DOCS, RARE = 5, 1e-5
#: Passes over the training rows, rows in a step, and size of the first step; steps shrink to 0.
EPOCHS, BATCH, STEP = 20, 64, 8.0
#: Bytes of text that are worked on at once; a longer text is cut at white space, a word that is longer at this length.
HELD_BYTES = 1 << 20

THRESHOLD = 0.3

#: ASCII bytes that are no letter or digit become word edges; other bytes stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def subwords(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the start positions of the n-grams within words, and their buckets.

    texts lie one behind another, each between two edges; text k begins at the sum of the lengths before it plus 2k.
    """
    data = _FOLD[np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)]
    edge = data == 32
    wide = data.astype(np.uint32)
    code, inner = wide.copy(), np.ones(len(data), bool)
    for n in range(2, max(LENGTHS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        code = code[:m] * np.uint32(16777619) ^ wide[n - 1 :]
        if n > 2:
            inner = inner[:m] & ~edge[n - 2 : n - 2 + m]
        if n in LENGTHS:
            at = np.flatnonzero(inner[:m])
            mixed = (code[at] ^ (code[at] >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n)
            yield at, (mixed * np.uint32(2246822519) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode()


def cut(text: bytes, most: int = HELD_BYTES) -> Iterator[bytes]:
    """text in pieces of at most `most` bytes that end before a space, so that no n-gram of a shorter word is lost."""
    while len(text) > most:
        at = text.rfind(b" ", 1, most + 1)
        at = at if at > 0 else most
        yield text[:at]
        text = text[at:]
    yield text


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams in order, and how often each comes."""
    total = np.zeros(BUCKETS, np.int64)
    found = [b for piece in cut(text) for _, b in subwords([piece])]
    if sum(map(len, found)) < BUCKETS:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    for b in found:
        total += np.bincount(b, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs of vectors and softmax: as the mean is linear, one number for each bucket, and an offset."""

    weights: np.ndarray
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        pieces = [(k, p) for k, t in enumerate(texts) for p in cut(t)]
        owner = np.array([k for k, _ in pieces], np.int64)
        ends = np.cumsum([0, *[len(p) + 2 for _, p in pieces]])
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for at, bucket in subwords([p for _, p in pieces]):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
            cuts = np.searchsorted(at, ends)
            np.add.at(total, owner, sums[cuts[1:]] - sums[cuts[:-1]])
            np.add.at(count, owner, np.diff(cuts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.offset, -40, 40)))


@dataclasses.dataclass
class Bags:
    """The n-grams of all training rows, row after row: bucket and times of each, and where rows begin."""

    buckets: np.ndarray
    times: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Bags:
        held = [bag(t) for t in texts]
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.uint32) for x in zip(*held)] if held else [np.zeros(0, np.uint32)] * 2
        return cls(*flat, np.cumsum([0, *[len(b) for b, _ in held]]))

    def runs(self, rows: int = 256) -> Iterator[tuple[np.ndarray, slice]]:
        """Some rows at a time: the row of each of their n-grams, and where these lie."""
        for k in range(0, len(self.starts) - 1, rows):
            ends = self.starts[k : k + rows + 1]
            yield k + np.repeat(np.arange(len(ends) - 1), np.diff(ends)), slice(ends[0], ends[-1])


def train(bags: Bags, toxic: np.ndarray, weight: np.ndarray, ranks: np.ndarray | None = None, seed: int = 7) -> ToxicityModel:
    """Vectors of all buckets and the softmax over two classes, trained together by plain gradient steps.

    A row's input is the mean of its n-grams' vectors, rare n-grams counting more. Plain steps move a vector by how many
    rows ask for it, so what many toxic rows share is learned before what one of them has. weight: how much each row
    counts in the loss; ranks: the rows in the order that the seed permutes. With two classes all that a bucket gives a
    row's logits is its vector times the difference of the softmax's columns, so a step needs one number for each n-gram
    and none of its width. The bags are used up.
    """
    n = len(toxic)
    rng = np.random.default_rng(seed)
    ranks = np.arange(n) if ranks is None else ranks
    seen, met = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
    for _, cut_ in bags.runs():
        seen += np.bincount(bags.buckets[cut_], bags.times[cut_], BUCKETS)
        met += np.bincount(bags.buckets[cut_], minlength=BUCKETS)
    factor = np.where(met >= MIN_DOCS, RARE / (RARE + seen / max(seen.sum(), 1)), 0.0)
    known = np.flatnonzero(factor)
    places = np.full(BUCKETS, len(known), np.uint32)  # the last place stands for all that is not known, and counts nothing
    places[known] = np.arange(len(known))
    counts = np.append(factor[known], 0.0)
    total, norms = np.zeros(n), np.zeros(n)
    for row, cut_ in bags.runs():
        place = bags.buckets[cut_] = places[bags.buckets[cut_]]  # in place: from here on, buckets are places
        total += np.bincount(row, bags.times[cut_], n)
        norms += np.bincount(row, (counts[place] * bags.times[cut_]) ** 2, n)
    total = np.maximum(total, 1)
    norms = np.sqrt(norms) / total
    scale = 1 / float(np.median(norms[norms > 0])) if (norms > 0).any() else 1.0
    counts, starts = (counts * scale).astype(np.float32), bags.starts
    vectors = np.zeros((len(counts), WIDTH), np.float32)  # so that an n-gram that tells nothing says nothing
    softmax, offset = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2)
    worth = weight / max(weight.mean(), 1e-9) if n else weight
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        order = ranks[rng.permutation(n)]
        for k in range(0, n, BATCH):
            group = order[k : k + BATCH]
            spans = [slice(starts[i], starts[i + 1]) for i in group]
            at, times = (np.concatenate([x[s] for s in spans]) for x in (bags.buckets, bags.times))
            row = np.repeat(np.arange(len(group)), starts[group + 1] - starts[group])
            shares = counts[at] * times / total[group][row]
            slant = softmax[:, 1] - softmax[:, 0]
            logit = np.bincount(row, shares * (vectors @ slant)[at], len(group)) + offset[1] - offset[0]
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - toxic[group]) * worth[group] / len(group)
            pull = np.bincount(at, shares * error[row], len(counts)).astype(np.float32)
            toward = pull @ vectors
            vectors -= np.float32(step) * pull[:, None] * slant
            softmax -= np.float32(step * 0.1) * np.stack([-toward, toward], axis=1)
            offset -= step * 0.1 * error.sum() * np.array([-1.0, 1.0])
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = (vectors @ (softmax[:, 1] - softmax[:, 0]) * counts)[:-1]
    return ToxicityModel(weights, float(offset[1] - offset[0]))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "toxic",
    most: tuple[int, int] = MOST_ROWS,
    key: str = "doc_id",
    text: str = "text",
) -> ToxicityModel:
    """A model from the whole texts of a bounded sample: most[c] labelled documents of each class c.

    Executors count the n-grams of the texts; the driver holds six bytes for each different n-gram of a document, of which
    there are BUCKETS at most however long it is. Labels other than 0 and 1 and null keys teach nothing, a label that is
    repeated counts once, of texts that share a key the least is taken; null and empty texts teach their label without
    n-grams. Without labels all scores are 0.5, with those of one class all tend to it. Other columns are not read.
    """
    sample = labelled_sample(docs, labels, label, learn, most, key, text)
    shares = {r["label"]: r["n"] for r in labels.filter(learn).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).collect()}

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut_, texts in text_parts(batch.column(2), HELD_BYTES):
                some = batch.slice(cut_.start, cut_.stop - cut_.start)
                held = [bag(fold(t.decode())) for t in texts]
                packer = zstandard.ZstdCompressor(level=3)
                packed = [
                    packer.compress(np.diff(b, prepend=0).astype(np.uint32).tobytes() + np.minimum(t, 65535).astype(np.uint16).tobytes())
                    for b, t in held
                ]
                sizes = pa.array([len(b) for b, _ in held], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), sizes, pa.array(packed, pa.binary())], ["place", "label", "n", "held"])

    placed = sample.select(F.xxhash64(F.col(key)).alias("place"), F.col("label").cast("int"), F.col("text"))
    counted = placed.mapInArrow(count, "place long, label int, n long, held binary").toArrow()
    ranks = np.argsort(counted.column("place").to_numpy(), kind="stable")
    toxic = counted.column("label").to_numpy().astype(float)
    starts = np.concatenate([[0], np.cumsum(counted.column("n").to_numpy(), dtype=np.int64)])
    bags = Bags(np.empty(starts[-1], np.uint32), np.empty(starts[-1], np.uint16), starts)
    packer = zstandard.ZstdDecompressor()
    for begin, end, x in zip(starts[:-1], starts[1:], counted.column("held")):
        data, n = packer.decompress(x.as_py()), end - begin
        bags.buckets[begin:end] = np.cumsum(np.frombuffer(data, np.uint32, n))
        bags.times[begin:end] = np.frombuffer(data, np.uint16, n, 4 * n)
    del counted
    give_back()
    held = {c: float((toxic == c).sum()) for c in (0, 1)}
    # A class of which the sample holds a part only counts with the weight of the whole.
    weight = np.array([shares.get(int(c), 0) / max(held[int(c)], 1) for c in toxic], float)
    model = train(bags, toxic, weight, ranks)
    del bags
    give_back()
    return model


def _scores(model: ToxicityModel, texts: pa.Array) -> pa.Array:
    parts = [model.scores([fold(t.decode()) for t in part]) for _, part in text_parts(texts, HELD_BYTES)]
    return pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every document, 0 to 1, over its whole text.

    Null and empty texts, and those without n-grams, get the score of the offset. Rows that repeat are scored each, alike;
    a null key stays null; a very long text is worked through a piece at a time; an empty table gives no rows. Only key
    and text are read, so no name of another column clashes.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(model, batch.column(1))], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_pw_text")).mapInArrow(run, f"`{key}` {kind}, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose whole text scores at the threshold or above; all columns as they came.

    Only the text column goes to Python. Null and empty texts get the score of the offset alone; rows that repeat stay or
    go together; an empty table stays empty.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        made = _scores(model, texts)
        give_back()
        return made

    return docs.filter(score(F.col(text).cast("string")) < threshold)
