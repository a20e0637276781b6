"""Words of a text as hashes, for the operators that run in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that a worker remembers with their hash; the table starts anew when full.
REMEMBERED = 50_000
#: Bytes of texts that are split at a time, one text at least.
SPLIT_BYTES = 1 << 20
#: Words hashed at a time.
HASHED = 1 << 17


class WordHashes(dict):
    """Word (lower-cased bytes) to its 64-bit hash as an unsigned integer, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at runs of space and the control characters 09-0D (what bytes.split takes as white space)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def text_runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Number of the first and the texts of each run of SPLIT_BYTES, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has: split_words of whole columns."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, ends = found.flatten(), np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    full = pc.not_equal(pc.binary_length(words), 0)
    so_far = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words if so_far[-1] == len(words) else words.filter(full), np.diff(so_far[ends], prepend=0)


def word_hashes(words: pa.Array) -> np.ndarray:
    """What WordHashes has for each word, worked out for all of them at once; only words of 32 bytes or more go one by one."""
    if len(words) > HASHED:
        return np.concatenate([word_hashes(words.slice(k, HASHED)) for k in range(0, len(words), HASHED)])
    if not len(words):
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]), np.zeros(8, np.uint8)])
    load = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).__getitem__
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    at, size = offsets[:-1].astype(np.int64) - offsets[0], np.diff(offsets)
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) + p5
        for k in range(3):
            some = np.flatnonzero(size >= 8 * k + 8)
            h[some] = turn(h[some] ^ turn(load(at[some] + 8 * k) * p2, 31) * p1, 27) * p1 + p4
        rest = load(at + (size & ~7))
        some = np.flatnonzero(size & 4)
        x = rest[some]
        h[some] = turn(h[some] ^ (x & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
        rest[some] = x >> np.uint64(32)
        for k in range(3):
            some = np.flatnonzero((size & 3) > k)
            h[some] = turn(h[some] ^ (rest[some] >> np.uint64(8 * k) & np.uint64(0xFF)) * p5, 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size >= 32):
        h[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + size[k]])
    return h


class HashPlaces:
    """Where hashes are in a sorted array: as they are spread evenly, their first bits tell the place but for a few."""

    def __init__(self, hashes: np.ndarray):
        bits = max(1, len(hashes).bit_length() - 2)
        self.hashes, self.shift = hashes, np.uint64(64 - bits)
        self.starts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.uint32 if len(hashes) < 1 << 32 else np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        last = len(self.hashes) - 1
        at = np.minimum(self.starts.take((hashes >> self.shift).astype(np.int64)).astype(np.int64), last)
        there = self.hashes.take(at)
        behind = np.flatnonzero((there < hashes) & (at < last))
        while len(behind):
            place = at[behind] + 1
            at[behind], there[behind] = place, self.hashes[place]
            behind = behind[(there[behind] < hashes[behind]) & (place < last)]
        return at, there == hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes, in text order; none if there are fewer."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = mixed(words[:k])
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + k])
    return out
