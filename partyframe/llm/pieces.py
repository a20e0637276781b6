"""SentencePiece (BPE models) that keeps the source bytes of every piece.

The compiled character map, a double-array trie, is matched from left to right by longest prefix, and each normalised
byte records the source bytes that it stands for. Words are merged as the model's scores say, each word once and then
remembered; the byte lengths of the pieces then project each of them to its span of the source.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import NONE, PairTable, broadcast_file

#: Words that a worker remembers, the longest of them, characters of a text normalised at a time and encoded together, ids in a batch.
REMEMBERED, LONGEST, WINDOW, TOGETHER, BATCH_IDS = 100_000, 48, 1 << 16, 1 << 19, 1 << 18
# Fixed values of the format: kinds of pieces, the model type of BPE, the mark of a space.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE_MODEL, MARK = 1, 2, 3, 6, 2, "▁"
#: Symbols of characters that no piece is: minus the code point, minus this.
BELOW = 2


def one_by_one(error: UnicodeError):
    """Each byte that is no UTF-8 becomes one U+FFFD."""
    return "�", error.start + 1


codecs.register_error("partyframe-each-byte", one_by_one)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message; fixed-width values as their bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a trie over UTF-8 bytes in a double array, whose leaves point to replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], np.uint32).astype(np.int64)
        self.texts = compiled[4 + size :] if compiled else b""
        labels = self.units & 0x800000FF
        self.child_of = (self.units >> 10) << ((self.units & 0x200) >> 6)  # relative to the node's own place
        self.leaf = (self.units >> 8 & 1).astype(bool)
        self.plain_units, self.plain_children, self.plain_leaf, self.labels = self.units.tolist(), self.child_of.tolist(), self.leaf.tolist(), labels.tolist()
        self.keys = [k.decode("utf-8", "replace") for k in self.all_keys(labels)] if size else []
        single = {k for k in self.keys if len(k) == 1}
        second = {k[1] for k in self.keys if len(k) > 1}
        either = [f"[{''.join(map(re.escape, sorted(single)))}]"] * bool(single) + [rf"[\s\S](?=[{''.join(map(re.escape, sorted(second)))}])"] * bool(second)
        #: Finds where a key may begin: a character that is a key, or one before the second character of a key.
        self.candidate = re.compile("|".join(either) or r"(?!)")

    def all_keys(self, labels: np.ndarray) -> Iterator[bytes]:
        bytes_ = np.arange(1, 256)
        todo = [(int(self.child_of[0]), b"")]
        while todo:
            base, prefix = todo.pop()
            places = base ^ bytes_
            inside = places < len(self.units)
            for byte in bytes_[inside][labels[places[inside]] == bytes_[inside]].tolist():
                at = base ^ byte
                key = prefix + bytes([byte])
                if self.plain_leaf[at]:
                    yield key
                todo.append((at ^ self.plain_children[at], key))

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(end, replacement) of the longest key that data holds at start."""
        found, at = None, self.plain_children[0]
        for k in range(start, len(data)):
            at ^= data[k]
            if at >= len(self.labels) or self.labels[at] != data[k]:
                break
            leaf = self.plain_leaf[at]
            at ^= self.plain_children[at]
            if leaf:
                found = k + 1, self.plain_units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def utf8_lengths(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Pieces:
    """A SentencePiece model of kind BPE, from the bytes of its file. Models with pieces of the user are refused."""

    def __init__(self, file: bytes):
        pieces, trainer, rules = [], {}, {}
        for number, value in fields(file):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                rules |= dict(fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != BPE_MODEL or trainer.get(24, 0) or not rules.get(5, 1) or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("not a BPE model that escapes spaces before words and has no pieces of the user")
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.map = CharacterMap(rules.get(2, b""))
        self.size = len(pieces)
        self.fallback = bool(trainer.get(35, 0))
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.byte_id = np.full(256, self.unknown, np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(text[3:5], 16)] = i
        self.make_merges(pieces)
        self.make_words(pieces)
        self.make_decoder(pieces, trainer.get(44, " ⁇ ".encode()).decode())
        self.remembered: dict[str, bytes] = {}

    def make_merges(self, pieces: list[tuple[str, float, int]]) -> None:
        """Two neighbouring symbols merge if what they spell is a piece, that of the highest score first."""
        symbols = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        order = {s: k for k, s in enumerate(sorted({pieces[i][1] for i in symbols.values()}, reverse=True))}
        for char in sorted({c for text in symbols for c in text} - symbols.keys()):
            symbols[char] = self.size + len(symbols)  # a symbol within pieces that is none itself
        self.merges = {}
        for i, (text, score, kind) in enumerate(pieces):
            for k in range(1, len(text)) if kind == NORMAL else ():
                left, right = symbols.get(text[:k]), symbols.get(text[k:])
                if left is not None and right is not None:
                    self.merges[left, right] = (order[score], i)
        self.pairs = PairTable(self.merges)
        self.symbol_of = (-np.arange(0x110000) - BELOW).astype(np.int32)
        self.spelled = {s: ord(text) for text, s in symbols.items() if s >= self.size}
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = symbol

    def make_words(self, pieces: list[tuple[str, float, int]]) -> None:
        """Where a text can be cut: before a mark that follows another character, and around ASCII characters that no longer
        piece holds. No merge spans such a place."""
        longer = [text for text, _, kind in pieces if kind == NORMAL and len(text) > 1]
        held = {c for text in longer for c in text}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held)
        joins = any(a != MARK and b == MARK for text in longer for a, b in zip(text, text[1:], strict=False))
        self.words = (lambda text: [text] * bool(text)) if joins else re.compile(rf"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|[{alone}]" * bool(alone)).findall
        spaced = joins or any(" " in k and len(k) > 1 for k in self.map.keys)
        self.gap = re.compile("(?!)" if spaced else "(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

    def make_decoder(self, pieces: list[tuple[str, float, int]], unknown_text: str) -> None:
        shown = []
        for text, _, kind in pieces:
            raw = bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else unknown_text.encode() if kind == UNKNOWN else text.replace(MARK, " ").encode()
            shown.append(raw)
        self.lengths = np.array([1 if k == BYTE else len(t.encode()) for t, _, k in pieces], np.int64)
        self.shown_length = np.array([len(s) for s in shown], np.int64)
        self.shown_start = np.concatenate(([0], np.cumsum(self.shown_length)[:-1]))
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.control = np.array([k == CONTROL for _, _, k in pieces])
        self.marked = np.array([k == NORMAL and t.startswith(MARK) for t, _, k in pieces])

    # ---- normalisation

    def windows(self, text: str) -> Iterator[str]:
        """A long text, cut before single spaces between ASCII letters or digits."""
        start = 0
        while len(text) - start > WINDOW and (cut := self.gap.search(text, start + WINDOW)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def normalised(self, text: str, first: bool = True, last: bool = True) -> tuple[str, np.ndarray, np.ndarray]:
        """(normalised text, begin, end): begin and end hold, for each of its bytes, the source bytes that it stands for.
        first and last tell whether the text is the beginning and the end of a longer one."""
        if not self.squeeze and not self.map.candidate.search(text):
            raw = np.frombuffer(text.encode(), np.uint8)
            begin = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 32, 3, 1))
            head = 3 * (self.prefix and first and bool(text))
            return MARK * (head // 3) + text.replace(" ", MARK), np.concatenate((np.zeros(head, np.int32), begin)), np.concatenate((np.zeros(head, np.int32), begin + 1))
        codes, begin, end, own = self.mapped(text)
        if self.squeeze:
            space = codes == 32
            keep = ~(space & np.concatenate(([first], space[:-1])))
            run_ends = np.append(np.flatnonzero(keep)[1:], len(codes)) - 1  # the space that stays stands for the whole run
            codes, begin, end, own = codes[keep], begin[keep], end[run_ends], own[keep]
            size = len(codes)
            while last and size and codes[size - 1] in (32, ord(MARK)):
                size -= 1
            codes, begin, end, own = codes[:size], begin[:size], end[:size], own[:size]
        if self.prefix and first and len(codes):
            codes, begin, end, own = np.insert(codes, 0, 32), np.insert(begin, 0, begin[0]), np.insert(end, 0, begin[0]), np.insert(own, 0, False)
        own &= codes != 32
        codes[codes == 32] = ord(MARK)
        sizes = utf8_lengths(codes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place of a byte in its character
        begin, end, own = np.repeat(begin, sizes), np.repeat(end, sizes), np.repeat(own, sizes)
        begin = np.where(own, begin + inside, begin)
        end = np.where(own, begin + 1, end)
        return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), begin.astype(np.int32), end.astype(np.int32)

    def mapped(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, begin, end, own) of each character after the character map: its source bytes, and whether it is the source's
        own character."""
        data, codes = text.encode(), code_points(text)
        byte_at = np.concatenate(([0], np.cumsum(utf8_lengths(codes)))).tolist()
        char_at = {b: k for k, b in enumerate(byte_at)}
        parts, done, at = [], 0, 0

        def keep(upto: int) -> None:
            starts = np.array(byte_at[done : upto + 1], np.int64)
            parts.append((codes[done:upto], starts[:-1], starts[1:], np.ones(upto - done, bool)))

        while found := self.map.candidate.search(text, at):
            k = found.start()
            hit = self.map.longest(data, byte_at[k])
            if hit is None or hit[0] not in char_at:
                at = k + 1
                continue
            keep(k)
            new = code_points(hit[1].decode("utf-8", "replace"))
            parts.append((new, np.full(len(new), byte_at[k]), np.full(len(new), hit[0]), np.zeros(len(new), bool)))
            done = at = char_at[hit[0]]
        keep(len(codes))
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

    # ---- merging

    def merged(self, word: str) -> np.ndarray:
        """The symbols of one word: the merge of the highest score first, of equals the leftmost; n log n steps."""
        ids = self.symbol_of[code_points(word)].tolist()
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, k, left, right, new = heapq.heappop(heap)
            nxt = after[k]
            if gone[k] or nxt < 0 or ids[k] != left or ids[nxt] != right:
                continue
            ids[k], gone[nxt] = new, True
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0 and (m := get((ids[a], ids[after[a]]))):
                    heapq.heappush(heap, (m[0], a, ids[a], ids[after[a]], m[1]))
        return np.array([i for i, g in zip(ids, gone, strict=True) if not g], np.int32)

    def merged_together(self, words: list[str]) -> list[bytes]:
        """The symbols of words as int32 bytes, all words at once: each round merges the best pair of a word wherever it
        stands. Where one such merge brings up a pair as good or better, be it with what the next merge takes, the order would
        matter: those words go one by one."""
        ids = self.symbol_of[code_points("".join(words))]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        best_before, many_before, apart = np.full(len(words), -1), np.zeros(len(words), bool), np.zeros(len(words), bool)
        done_ids, done_words = [], []
        while len(ids):
            slot = self.pairs(ids[:-1], ids[1:])
            rank = np.full(len(ids), NONE, np.int64)
            rank[:-1] = np.where((slot >= 0) & (word[:-1] == word[1:]), self.pairs.ranks[slot], NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best_each = np.minimum.reduceat(rank, first)
            here = word[first]
            apart[here] |= many_before[here] & (best_each <= best_before[here])
            best = np.repeat(best_each, np.diff(np.append(first, len(ids))))
            over = best == NONE
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
            chosen = np.flatnonzero((rank == best) & ~over)
            if len(chosen):  # of a run of overlapping pairs every other one, from the left
                starts = np.concatenate(([True], np.diff(chosen) > 1))
                chosen = chosen[(chosen - np.repeat(chosen[starts], np.diff(np.append(np.flatnonzero(starts), len(chosen))))) % 2 == 0]
                next_too = chosen[:-1][np.diff(chosen) == 2]
                new = self.pairs(self.pairs.ids[slot[next_too]], ids[next_too + 2])
                apart[word[next_too[(new >= 0) & (self.pairs.ranks[new] <= best[next_too]) & (word[next_too] == word[np.minimum(next_too + 2, len(ids) - 1)])]]] = True
                ids[chosen] = self.pairs.ids[slot[chosen]]
            best_before[here] = best_each
            many_before = np.bincount(word[chosen], minlength=len(words)) > 1
            keep = ~over
            keep[chosen + 1] = False
            ids, word = ids[keep], word[keep]
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        flat = np.concatenate(done_ids)[order].tobytes()
        ends = np.searchsorted(all_words[order], np.arange(len(words)), side="right") * 4
        out = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for k in np.flatnonzero(apart).tolist():
            out[k] = self.merged(words[k]).tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered; start anew when the memory would be full."""
        new = words.difference(self.remembered)
        if len(self.remembered) + len(new) > REMEMBERED:
            self.remembered.clear()
            new = words
        short = [w for w in new if len(w) <= LONGEST]
        if short:
            self.remembered.update(zip(short, self.merged_together(short), strict=True))

    def finished(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths in normalised bytes): symbols that are no piece fall back to their bytes, or are unknown, neighbours
        together."""
        odd = (symbols < 0) | (symbols >= self.size)
        if not odd.any():
            return symbols, self.lengths[symbols]
        at = np.flatnonzero(odd)
        code = np.array([-s - BELOW if s < 0 else self.spelled[s] for s in symbols[at].tolist()], np.int64)
        if self.fallback:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()]
            repeats = np.ones(len(symbols), np.int64)
            repeats[at] = [len(r) for r in raw]
            ids = np.repeat(symbols, repeats)
            ids[np.repeat(odd, repeats)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            return ids, np.where(np.repeat(odd, repeats), 1, self.lengths[np.where(np.repeat(odd, repeats), 0, ids)])
        lengths = self.lengths[np.where(odd, 0, symbols)]
        lengths[at] = utf8_lengths(code)
        starts = np.flatnonzero(~(odd & np.concatenate(([False], odd[:-1]))))
        return np.where(odd, self.unknown, symbols)[starts].astype(np.int32), np.add.reduceat(lengths, starts)

    # ---- whole texts

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begin, end) of each text: the pieces and the bytes of the text that each stands for."""
        parts: list[list] = []
        for text in texts:
            cut = list(self.windows(text)) if text else []
            own = []
            for k, window in enumerate(cut):
                norm, begin, end = self.normalised(window, k == 0, k + 1 == len(cut))
                own.append((self.words(norm), begin, end, len(window.encode())))
            parts.append(own)
        self.learn({w for own in parts for words, *_ in own for w in words})
        return [self.assembled(own) for own in parts]

    def assembled(self, windows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        get, shift = self.remembered.get, 0
        columns: tuple[list, list, list] = ([], [], [])
        for words, begin, end, size in windows:
            try:
                raw = b"".join(map(get, words))
            except TypeError:  # some are too long to be remembered
                raw = b"".join(get(w) or self.merged(w).tobytes() for w in words)
            ids, lengths = self.finished(np.frombuffer(raw, np.int32))
            upto = np.cumsum(lengths)
            if len(ids):
                for column, x in zip(columns, (ids, begin[upto - lengths] + shift, end[upto - 1] + shift), strict=True):
                    column.append(x.astype(np.int32))
            shift += size
        return tuple(np.concatenate(c) if c else np.empty(0, np.int32) for c in columns)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces show nothing, the mark before the first word goes, each byte of byte pieces that
        is no UTF-8 becomes U+FFFD. Ids outside the model are left out."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        ids = ids[~self.control[ids]]
        if not len(ids):
            return ""
        start, length = self.shown_start[ids], self.shown_length[ids]
        if self.prefix or self.squeeze:
            for k in range(len(ids)):
                if not self.marked[ids[k]]:
                    break
                start[k], length[k] = start[k] + 1, length[k] - 1
                if length[k] or not self.squeeze:
                    break
        ends = np.cumsum(length)
        return self.shown[np.repeat(start - (ends - length), length) + np.arange(ends[-1])].tobytes().decode("utf-8", "partyframe-each-byte")


_made: dict[int, Pieces] = {}


def pieces_of(file) -> Pieces:
    """The worker's model for a broadcast file, built once."""
    key = hash(file.value)
    if key not in _made:
        _made.clear()
        _made[key] = Pieces(file.value)
    return _made[key]


def piece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, starts, ends) of every document, by the SentencePiece file at `model`; no shuffle. Piece k stands for
    the UTF-8 bytes starts[k] to ends[k] (not included) of the text: several pieces of one replaced character have its whole
    span, byte pieces a byte each, the mark put before a text an empty span.

    Null and empty texts give empty arrays; null ids, repeated rows and an empty table pass as they are; other columns are
    ignored. Long texts are normalised a window at a time; long words without a space take n log n.
    """
    file = broadcast_file(docs.sparkSession, model)

    def encode(batches):
        made = pieces_of(file)
        for batch in batches:
            keys, texts, first = batch.column(0), batch.column(1), 0
            found: list[tuple] = []
            group: list[str] = []
            chars = held = 0
            for k in range(len(texts)):
                group.append(texts[k].as_py() or "")
                chars += len(group[-1])
                last = k + 1 == len(texts)
                if chars >= TOGETHER or last:
                    new = made.encode_batch(group)
                    found += new
                    held += sum(len(x[0]) for x in new)
                    group, chars = [], 0
                if (held > BATCH_IDS and not group) or last:
                    rows = pa.array(np.concatenate(([0], np.cumsum([len(x[0]) for x in found]))).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(rows, pa.array(np.concatenate(c), pa.int32())) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(first, k + 1 - first), *lists], ["id", "ids", "starts", "ends"])
                    found, held, first = [], 0, k + 1

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends"))])
    return source.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def piece_decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, ids_col, text, and the columns of keep) for every row; null or empty ids give an empty text."""
    file = broadcast_file(encoded.sparkSession, model)

    def decode(batches):
        made = pieces_of(file)
        for batch in batches:
            lists = batch.column(1)
            flat, upto = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum().tolist()
            texts = [made.decode(flat[a:b]) for a, b in zip([0, *upto[:-1]], upto, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string()), *batch.columns[2:]], ["id", "ids", "text", *keep])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"), *keep)
    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType()), *(source.schema[c] for c in keep)])
    return source.mapInArrow(decode, schema).withColumnsRenamed({"id": id_col, "ids": ids_col})
