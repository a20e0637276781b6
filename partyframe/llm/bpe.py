"""Byte-level BPE by forced-boundary splitting.

A byte pair that lies inside no vocabulary token can be spanned by no token, so the encoding certainly has a cut
there. Long texts are cut at such pairs that also end a pre-token, pre-tokens are cut at every such pair, the
fragments are encoded independently (and remembered), and their ids are concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fragments that a worker remembers, the longest of them in characters, characters of a text cut at a time, ids in an Arrow batch.
REMEMBERED, LONGEST, WINDOW, BATCH_IDS = 100_000, 48, 1 << 16, 1 << 19
#: Characters of texts whose unknown fragments are encoded together; a rank above all others.
TOGETHER, NONE = 1 << 19, 1 << 40
#: Vocabulary files above this size are refused: their bytes are broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
SPACE = r"\t-\r \x85\xa0  -     　"
# Fixed pattern of the pre-tokenizer (byte-level BPE with regex splitting).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# The same for texts of ASCII and Latin letters only, where explicit classes serve and matching is faster.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
NOT_PLAIN = rf"[^\x00-\x7f{LATIN}]"


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which vocabulary files write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PairTable:
    """(left, right) to (rank, merged id) for arrays of ids: open addressing, a few vector steps a lookup."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        bits = max(4, (4 * len(merges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks, self.ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64), np.full(1 << bits, -1, np.int32)
        pairs = np.array([a << 32 | b for a, b in merges], np.int64)
        self.probes = 1
        for key, at, (rank, new) in zip(pairs.tolist(), self.slots(pairs).tolist(), merges.values(), strict=True):
            probes = 1
            while self.keys[at] >= 0:
                at, probes = (at + 1) & self.mask, probes + 1
            self.keys[at], self.ranks[at], self.ids[at] = key, rank, new
            self.probes = max(self.probes, probes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 if it is no merge."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slots(keys)
        there = self.keys[at]
        found = np.where(there == keys, at, -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (there >= 0)]
        return found


class ByteBPE:
    """A tokenizer from the bytes of a tokenizers JSON file with a BPE model over bytes and no normalizer."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a byte-level BPE file without normalizer and prefix space")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.id_of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.inside = np.zeros(65536, bool)
        for token in self.bytes_of.values():
            for a, b in zip(token, token[1:], strict=False):
                self.inside[a << 8 | b] = True
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces, self.plain_pieces, self.not_plain = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall, re.compile(NOT_PLAIN).search
        self.forced_space = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        if any(self.inside[a << 8 | 32] for a in range(256) if not chr(a).isspace() and a < 128):
            self.forced_space = re.compile(r"(?!)")  # such a vocabulary joins words: no cut before its pre-tokens are known
        self.pairs = PairTable(self.merges)
        self.byte_ids = np.array(self.id_of_byte, np.int32)
        self.remembered: dict[str, bytes] = {}
        size = max(self.bytes_of) + 1
        self.token_len = np.zeros(size, np.int64)
        for i, token in self.bytes_of.items():
            self.token_len[i] = len(token)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    def fragments(self, data: bytes) -> Iterator[bytes]:
        """data cut wherever two neighbouring bytes lie inside no token."""
        if len(data) < 2:
            yield data
            return
        raw = np.frombuffer(data, np.uint8).astype(np.int32)
        start = 0
        for cut in (np.flatnonzero(~self.inside[raw[:-1] << 8 | raw[1:]]) + 1).tolist():
            yield data[start:cut]
            start = cut
        yield data[start:]

    def merged(self, data: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank first, the leftmost of equals."""
        ids, get = [self.id_of_byte[b] for b in data], self.merges.get
        if len(ids) > 40:
            return self.merged_long(ids)
        while len(ids) > 1:
            best = min((m[0], k, m[1]) if (m := get((ids[k], ids[k + 1]))) else (1 << 30, k, -1) for k in range(len(ids) - 1))
            if best[2] < 0:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """As merged(), in n log n steps: a heap of pairs over a linked list."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            nxt = after[k]
            if nxt < 0 or ids[k] != left or ids[nxt] != right:
                continue
            ids[k], ids[nxt] = new, -1
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (m := get((ids[a], ids[after[a]]))):
                    heapq.heappush(heap, (m[0], a, ids[a], ids[after[a]], m[1]))
        return [i for i in ids if i >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        return [i for fragment in self.fragments(piece.encode()) for i in self.merged(fragment)]

    def windows(self, text: str) -> Iterator[str]:
        """A long text cut at spaces between words: no token spans one, and what stands before changes no later pre-token."""
        start = 0
        while len(text) - start > WINDOW and (cut := self.forced_space.search(text, start + WINDOW)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def merged_together(self, pieces: list[str]) -> list[bytes]:
        """The ids of short pieces as int32 bytes, all at once: in each round every fragment merges its best pair."""
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        ends = np.cumsum([len(r) for r in raw])
        cut = np.zeros(len(data), np.int64)
        cut[1:] = ~self.inside[data[:-1] << 8 | data[1:]]
        cut[ends[:-1]] = 1
        fragment, ids = np.cumsum(cut), self.byte_ids[data]
        done_ids, done_fragments = [], []
        while len(ids):
            slot = self.pairs(ids[:-1], ids[1:])
            rank = np.full(len(ids), NONE, np.int64)
            rank[:-1] = np.where((slot >= 0) & (fragment[:-1] == fragment[1:]), self.pairs.ranks[slot], NONE)
            first = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = best == NONE
            if over.any():
                done_ids.append(ids[over])
                done_fragments.append(fragment[over])
            chosen = np.flatnonzero((rank == best) & ~over)
            if len(chosen):  # of a run such as aaaa every other pair, from the left
                starts = np.concatenate(([True], np.diff(chosen) > 1))
                chosen = chosen[(chosen - np.repeat(chosen[starts], np.diff(np.append(np.flatnonzero(starts), len(chosen))))) % 2 == 0]
                ids[chosen] = self.pairs.ids[slot[chosen]]
            keep = ~over
            keep[chosen + 1] = False
            ids, fragment = ids[keep], fragment[keep]
        fragments = np.concatenate(done_fragments)
        order = np.argsort(fragments, kind="stable")
        flat, fragments = np.concatenate(done_ids)[order], fragments[order]
        piece_ends = np.searchsorted(fragments, np.cumsum(cut)[ends - 1], side="right") * 4
        flat, start, out = flat.tobytes(), 0, []
        for end in piece_ends.tolist():
            out.append(flat[start:end])
            start = end
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not remembered; start anew when the memory would be full."""
        new = pieces.difference(self.remembered)
        if len(self.remembered) + len(new) > REMEMBERED:
            self.remembered.clear()
            new = pieces
        short = [p for p in new if len(p) <= LONGEST]
        if short:
            self.remembered.update(zip(short, self.merged_together(short), strict=True))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text as int32; the strings of special tokens become those tokens."""
        parts: list[list] = []  # of each text: lists of pieces, and ids of special tokens
        for text in texts:
            own: list = []
            for k, part in enumerate(self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]):
                if k % 2:
                    own.append(np.array([self.special[part]], np.int32).tobytes())
                else:
                    own += [(self.pieces if self.not_plain(w) else self.plain_pieces)(w) for w in self.windows(part)]
            parts.append(own)
        self.learn(set().union(*(x for own in parts for x in own if type(x) is list)))
        get, out = self.remembered.get, []
        for own in parts:
            ids = []
            for x in own:
                if type(x) is list:
                    try:
                        ids.append(b"".join(map(get, x)))
                    except TypeError:  # some are too long to be remembered
                        ids += [get(p) or np.array(self.encode_piece(p), np.int32).tobytes() for p in x]
                else:
                    ids.append(x)
            out.append(np.frombuffer(b"".join(ids), np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that form no UTF-8 become U+FFFD. Unknown ids are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.token_len))]
        length = self.token_len[ids]
        ends = np.cumsum(length)
        if not len(ids) or not ends[-1]:
            return ""
        at = np.repeat(self.token_start[ids] - (ends - length), length) + np.arange(ends[-1])
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


_made: dict[int, ByteBPE] = {}


def tokenizer(file) -> ByteBPE:
    """The worker's tokenizer for a broadcast file, built once."""
    data = file.value
    key = hash(data)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(data)
    return _made[key]


def broadcast_file(spark, path: str):
    """The bytes of a vocabulary file on the driver, broadcast: executors need no such file of their own."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every document, by the tokenizers JSON file at `vocabulary`; no shuffle.

    Null and empty texts give an empty array; null ids, repeated rows and an empty table pass as they are; other
    columns are ignored. A text is held whole, its pre-tokens a window at a time; long unbroken runs take n log n.
    """
    file = broadcast_file(docs.sparkSession, vocabulary)

    def encode(batches):
        bpe = tokenizer(file)
        for batch in batches:
            keys, texts, start = batch.column(0), batch.column(1), 0
            flat: list[np.ndarray] = []
            group: list[str] = []
            chars = held = 0
            for k in range(len(texts)):
                group.append(texts[k].as_py() or "")
                chars += len(group[-1])
                if chars >= TOGETHER or k + 1 == len(texts):
                    ids = bpe.encode_batch(group)
                    flat += ids
                    held += sum(map(len, ids))
                    group, chars = [], 0
                if (held > BATCH_IDS and not group) or k + 1 == len(texts):
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat), pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), lists], ["id", "ids"])
                    flat, held, start = [], 0, k + 1

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, text) for every row; null or empty ids give an empty text; other columns are ignored."""
    file = broadcast_file(encoded.sparkSession, vocabulary)

    def decode(batches):
        bpe = tokenizer(file)
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            start, texts = 0, []
            for end in ends.tolist():
                texts.append(bpe.decode(flat[start:end]))
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["id", "ids", "text"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    return source.mapInArrow(decode, schema).withColumnsRenamed({"id": id_col, "ids": ids_col})
