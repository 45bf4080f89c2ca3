"""Substring deduplication by recompression: repeated word windows are found through shared grammar symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import slices, tidy
from pagewright.llm.sketches import MASK, mix
from pagewright.llm.staging import power_of_two, stage

WINDOW = 35

#: Rounds of the recompression: R names the runs of equal symbols, P the pairs. Each costs a window a symbol or half of one
#: at either end, as what stands outside may join there; five rounds of pairs leave symbols of four to five words.
ROUNDS = "RPRPPPP"

#: Bytes of text in a chunk, and bytes of text for which one task counts the keys.
CHUNK_BYTES, SHARE_BYTES, LEAST_SHARES = 2 << 20, 32 << 20, 32

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def word_names(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: eight bytes after eight, each scrambled into what came before."""
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = end - begin
    names = mix(size.astype(np.uint64), 3)
    todo, k = np.arange(len(begin)), 0
    while len(todo):
        rest = np.minimum(size[todo] - 8 * k, 8).astype(np.uint64)
        held = eights[begin[todo] + 8 * k] & (np.uint64(MASK) >> (np.uint64(64) - np.uint64(8) * rest))
        names[todo] = mix(names[todo] ^ held, 5)
        k += 1
        todo = todo[size[todo] > 8 * k]
    return names


class Words:
    """The words of some texts: byte ranges in one buffer, names, and which words belong to which text."""

    def __init__(self, texts: list[bytes]):
        whole = b"".join(t + b" " for t in texts)
        self.data = np.frombuffer(whole, np.uint8)
        space = _SPACE[self.data]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        self.begin, self.end = edges[::2], edges[1::2]
        ends = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.bounds = np.searchsorted(self.begin, ends)  # of the texts, in words
        self.names = word_names(self.data, self.begin, self.end)
        self.first = np.zeros(len(self.begin) + 1, bool)
        self.first[self.bounds] = True

    def windows(self, length: int) -> np.ndarray:
        """Starts of all windows that lie within one text."""
        starts = np.arange(max(len(self.begin) - length + 1, 0))
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))  # of each word's text
        return starts[starts + length <= last[: len(starts)]]


class Grammar:
    """Symbols after all rounds: `names`, and for a window of words the symbols that depend on its words alone.

    A symbol's name is a hash of what it stands for - a run of a symbol so many times, or a pair of symbols - so equal
    words get equal symbols in every text of the corpus, with no exchange between rounds. In a round of pairs a hash of
    the name puts each symbol left or right, and a left one joins a right one behind it. left[p] and right[q] say which
    symbols lie in words p to q whatever stands before p and behind q.
    """

    def __init__(self, words: Words, rounds: str = ROUNDS):
        names, first = words.names, words.first[:-1]
        n = len(names)
        left, right = np.arange(n + 1), np.arange(n + 1)
        for k, kind in enumerate(rounds):
            if not len(names):
                break
            if kind == "R":
                fresh = first | np.concatenate([[True], names[1:] != names[:-1]])
                place = np.cumsum(fresh) - 1
                starts = np.flatnonzero(fresh)
                times = np.diff(starts, append=len(names)).astype(np.uint64)
                held = names[starts]
                new = np.where(times > 1, mix(held * np.uint64(_ODD[0]) + times, 5), held)
                # A run at the edge may go on outside.
                after, before = np.append(place + 1, len(starts)), np.append(0, place)
            else:
                goes_left = (mix(names, 11 + k) >> np.uint64(63)).astype(bool)
                second = np.zeros(len(names), bool)
                second[1:] = goes_left[:-1] & ~goes_left[1:] & ~first[1:]
                starts = np.flatnonzero(~second)
                place = np.cumsum(~second) - 1
                held = names[starts]
                pair = np.append(second, False)[starts + 1]
                other = names[np.minimum(starts + 1, len(names) - 1)]
                new = np.where(pair, mix(mix(held, 17) * np.uint64(_ODD[1]) + other, 19), held)
                after = np.append(place + ~goes_left, len(starts))
                before = np.append(0, place + ~goes_left)
            left, right = after[left], before[right]
            names, first = new, first[starts]
        self.names, self.left, self.right = names, left, right


def candidates(words: Words, grammar: Grammar, repeated: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows all of whose own symbols are repeated in the corpus, or that have none."""
    starts = words.windows(length)
    alone = np.concatenate([[0], np.cumsum(~repeated)])
    a, b = grammar.left[starts], grammar.right[starts + length]
    return starts[(a >= b) | (alone[np.maximum(b, a)] == alone[a])]


def window_keys(words: Words, starts: np.ndarray, length: int) -> np.ndarray:
    """A 128-bit BLAKE2b digest of each window's words joined by spaces, as an array of two columns.

    The names of symbols only leave windows out; which windows are equal is read from the words themselves.
    """
    buffer = words.data.copy()
    buffer[words.end] = 32
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[words.begin] += 1
    inside[words.end + 1] -= 1  # each word with one space behind it
    flat = buffer[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)].tobytes()
    at = np.concatenate([[0], np.cumsum(words.end - words.begin + 1)])
    digest = hashlib.blake2b
    spans = zip(at[starts].tolist(), at[starts + length].tolist())
    found = b"".join([digest(flat[a:b], digest_size=16).digest() for a, b in spans])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows, the place of each row among them, and which occur more than once."""
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    group = np.cumsum(fresh) - 1
    place = np.empty(len(keys), np.int64)
    place[order] = group
    return ordered[fresh], place, np.bincount(group, minlength=int(fresh.sum())) > 1


def _requests(chunk: int, keys: np.ndarray, shift: int) -> pa.RecordBatch:
    found, _, many = _unique(keys)
    share = (found[:, 0] >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(share, prepend=-1))
    ends = np.append(cuts[1:], len(share))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(share[cuts]),
            pa.array(np.full(len(cuts), chunk)),
            pa.array([found[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        ],
        ["share", "chunk", "keys", "many"],
    )


def _repeats(requests: DataFrame, columns: int) -> DataFrame:
    """chunk, answers: for each chunk a bit for each of its keys, whether it occurs twice or more in the corpus.

    The keys of one share of all hashes meet in one task, each once from a chunk however often it occurs there.
    """

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, columns) for x in table.column("keys")]
        many = np.concatenate(
            [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(table.column("many"), parts)]
        ).astype(bool)
        _, place, twice = _unique(np.concatenate(parts))
        twice[place[many]] = True
        bits = np.split(twice[place], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "share": table.column("share"),
                "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
            }
        )

    found = requests.groupBy("share").applyInArrow(merge, "chunk long, share long, bits binary")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("share", "bits")).alias("answers"))


def _answered(keys: np.ndarray, answers: list[dict] | None, shift: int) -> np.ndarray:
    """The bits of _repeats() for each of a chunk's keys, in their own order."""
    found, place, _ = _unique(keys)
    share = (found[:, 0] >> np.uint64(shift)).astype(np.int64)
    out = np.zeros(len(found), bool)
    for x in answers or ():
        a, b = np.searchsorted(share, [x["share"], x["share"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
    return out[place]


def _chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """chunk, bytes, held: consecutive documents as compressed Arrow streams of (key, text)."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            for cut in slices(sizes, CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(cut.start, cut.stop - cut.start))
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [number], "bytes": [int(sizes[cut].sum())], "held": [sink.getvalue().to_pybytes()]}
                )
                number += 1

    return docs.select(key, F.col(text).cast("string").alias("_pw_text")).mapInArrow(
        pack, "chunk long, bytes long, held binary"
    )


def _open(held: bytes) -> tuple[pa.Array, list[bytes]]:
    table = pa.ipc.open_stream(held).read_all().combine_chunks()
    texts = table.column(1).cast(pa.binary()).to_pylist()
    keys = table.column(0)
    return keys.chunk(0) if keys.num_chunks else pa.array([], keys.type), [x or b"" for x in texts]


def _each(columns: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(*(c[i].as_py() for c in batch.columns))

    return columns.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed, kept: each document without the words that repeated windows cover.

    A window is `length` consecutive words of one document; it is repeated if its words also start anywhere else, the
    same document included. All windows are judged on the input.
    First exchange: the symbols of every chunk of documents are counted over the corpus, and each chunk learns which of
    its symbols occur twice. Only windows whose own symbols are all repeated can be repeated themselves. Second
    exchange: these windows are counted by a 128-bit cryptographic digest of their words, so no weakness of a symbol's name
    can make two windows equal. Keys go to a task by a share of the hash and bits come back to the chunk.
    kept joins the kept words with one space. Null and empty texts have no words; documents of fewer than `length` words
    keep all; repeated rows count as other documents; a null key stays null; very long texts are chunks of their own; an
    empty table gives no rows. Only key and text are read, whatever other columns are called; a key may not be named
    n_words, n_removed or kept.
    """
    chunks = stage(_chunks(docs, key, text), "chunks")
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    shift = 64 - (power_of_two(max(LEAST_SHARES, size / SHARE_BYTES)).bit_length() - 1)
    wire = "share long, chunk long, keys binary, many binary"

    def parse(held: bytes) -> tuple[pa.Array, Words, Grammar]:
        keys, texts = _open(held)
        words = Words(texts)
        return keys, words, Grammar(words)

    def names(chunk: int, held: bytes) -> Iterator[pa.RecordBatch]:
        _, _, grammar = parse(held)
        if len(grammar.names):
            yield _requests(chunk, grammar.names[:, None], shift)

    symbols = _repeats(_each(chunks.select("chunk", "held"), names, wire), 1)

    def ask(chunk: int, held: bytes, answers: list) -> Iterator[pa.RecordBatch]:
        _, words, grammar = parse(held)
        starts = candidates(words, grammar, _answered(grammar.names[:, None], answers, shift), length)
        if len(starts):
            yield _requests(chunk, window_keys(words, starts, length), shift)

    seen = stage(symbols, "symbols")
    asked = chunks.select("chunk", "held").join(seen, "chunk")
    windows = stage(_repeats(_each(asked, ask, wire), 2).withColumnRenamed("answers", "windows"), "windows")

    def cut(chunk: int, held: bytes, answers: list, found: list) -> Iterator[pa.RecordBatch]:
        keys, words, grammar = parse(held)
        n = len(words.begin)
        gone = np.zeros(n + 1, np.int64)
        if found:
            starts = candidates(words, grammar, _answered(grammar.names[:, None], answers, shift), length)
            starts = starts[_answered(window_keys(words, starts, length), found, shift)]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + length, -1)
        kept = np.cumsum(gone[:-1]) == 0
        # The bytes of kept words, each with the one byte behind it as a space.
        buffer = words.data.copy()
        buffer[words.end] = 32
        edge = np.zeros(len(buffer) + 1, np.int8)
        edge[words.begin[kept]] += 1
        edge[words.end[kept] + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        flat = buffer[inside].tobytes()
        ends = np.concatenate([[0], np.cumsum((words.end - words.begin + 1) * kept)])[words.bounds]
        total = np.diff(words.bounds)
        left = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.bounds])
        texts = [flat[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(total), pa.array(total - left), pa.array(texts, pa.binary()).cast(pa.string())],
            [key, "n_words", "n_removed", "kept"],
        )

    kind = docs.schema[key].dataType.simpleString()
    joined = chunks.select("chunk", "held").join(seen, "chunk", "left").join(windows, "chunk", "left")
    return _each(joined, cut, f"`{key}` {kind}, n_words long, n_removed long, kept string")


def brute_force(texts: list[str | None], length: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the SHA-256 of the kept words, for tests."""
    import re
    from collections import Counter

    words = [re.findall("[^\\x20\\x09-\\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
