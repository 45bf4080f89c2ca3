"""Shingle sets of texts, and SetSketch registers over them."""

from __future__ import annotations

import dataclasses

import numpy as np
import xxhash

SHINGLE = 5

#: Registers of a sketch, registers of a band, and the base of their scale: so near 1 that registers are equal about as
#: often as the sets' similarity, and that four of them tell sets apart as 49 bits do.
REGISTERS, BAND, BASE = 128, 4, 1.001

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MASK = (1 << 64) - 1
_MIXERS = np.random.default_rng(10).integers(1, 1 << 32, (REGISTERS, 2), np.uint32, endpoint=False) | np.uint32(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A to Z in lower case; bytes.split() cuts at 0x20 and 0x09 to 0x0D."""
    return text.translate(_LOWER).split()


@dataclasses.dataclass(frozen=True)
class Sets:
    """The sets of some texts one behind another: set k lies from bounds[k] to bounds[k + 1].

    ids: numbers of shingles, equal exactly where the shingles' words are; they hold within one call. hashes: 64-bit
    hashes of the same shingles, which hold everywhere, for sketches only.
    """

    ids: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def shingle_sets(texts: list[list[bytes]], size: int = SHINGLE) -> Sets:
    """The shingle sets of texts, each given as its words.

    A shingle is `size` consecutive words; fewer words are one shingle; no words are none.
    """
    flat = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}  # 0 fills up short shingles
    word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    word_hash = np.zeros(len(number) + 1, np.uint64)
    word_hash[1:] = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    count = np.array([len(t) for t in texts], np.int64)
    each = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(texts)), each)
    first = np.cumsum(count) - count
    begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    end = np.minimum(begin + size, (first + count)[owner])
    word = np.append(word, 0)
    # Numbers of longer and longer beginnings of the shingles, word by word; dense again before they outgrow 63 bits.
    ids, span = np.zeros(len(begin), np.int64), 1
    hashes = np.zeros(len(begin), np.uint64)

    def room(ids: np.ndarray, span: int, times: int) -> tuple[np.ndarray, int]:
        if span * times < 1 << 62:
            return ids, span
        ids = np.unique(ids, return_inverse=True)[1]
        return ids, int(ids.max(initial=0)) + 1

    for k in range(size):
        next_ = word[np.where(begin + k < end, begin + k, len(flat))]
        hashes = mix(hashes ^ word_hash[next_], 29 + k)
        ids, span = room(ids, span, len(number) + 1)
        ids, span = ids * (len(number) + 1) + next_, span * (len(number) + 1)
    ids, span = room(ids, span, len(texts) + 1)
    _, once = np.unique(owner * span + ids, return_index=True)
    return Sets(ids[once], hashes[once], np.searchsorted(owner[once], np.arange(len(texts) + 1)))


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set that is not empty.

    Register i is floor(1 - log_BASE(m)), m the least over the set of an exponential number that element and i determine:
    the minimum truncated to a scale of steps by BASE. The larger of two registers is that of the union.
    """
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    starts = bounds[full]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    high = hashes.astype(np.uint32)
    least = np.empty((len(full), REGISTERS), np.float64)
    for i in range(REGISTERS):
        x = (low ^ _MIXERS[i, 0]) * _MIXERS[i, 1]
        x ^= x >> np.uint32(15)
        x += high
        x *= _MIXERS[i, 0]
        x ^= x >> np.uint32(16)
        least[:, i] = np.minimum.reduceat(x, starts)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32)
    out[full] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 4096, 0, 65535).astype(np.uint16)
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers: the band's four registers, scrambled with its number."""
    packed = np.ascontiguousarray(sketch).view(np.uint64)
    return np.stack([mix(packed[:, b], 41 + b) for b in range(packed.shape[1])], axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity by maximum likelihood, jointly from how many registers of a are larger, smaller and equal.

    Sizes are known, so the share of registers that differ either way depends on the similarity alone.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    best, found = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0, 1, 129):
        j = share * most
        up, down = chance(u - (1 - u) * j), chance(1 - u - u * j)
        value = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = value > best
        best[better], found[better] = value[better], j[better]
    return found


def intersections(sets: Sets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[k] and b[k]."""
    own = lambda i: sets.ids[sets.bounds[i] : sets.bounds[i + 1]]
    return np.array([np.intersect1d(own(i), own(j), assume_unique=True).size for i, j in zip(a.tolist(), b.tolist())], np.int64)
