"""Masked pseudo-likelihood: a network over the words on both sides predicts every token of a text.

Tokens are words, p(word | sides) = p(class | sides) p(word | class). The network predicts the class; how a class divides
among its words is counted. Classes, windows and words that are kept all grow with the corpus.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, written
from .words import HashPlaces, WordHashes, mixed, split_texts, text_runs, word_hashes

#: Classes at least; there are as many as the cube root of the running words, so there can be as many windows as words.
LEAST_CLASSES = 128
#: Words that occur so often are kept one by one. All others occur once, so one number for each class is exact for them.
KEPT_COUNT = 2
#: Width of the network, its learning rate, rounds over all windows, and steps of a task in a round.
WIDTH, RATE, ROUNDS, STEPS = 32, 0.03, 6, 12
#: Parts that a task divides its contexts into, unless they are few; a step takes one part.
PARTS, FEW_CONTEXTS = 4, 1024
#: Words counted, or windows held, before a task sends what it has.
HELD = 2_000_000
#: Windows in a block at most, which is a row of the shuffle and of the written counts, and rows of an Arrow batch with blocks.
BLOCK, BLOCK_ROWS = 4096, 128
#: Networks of all tasks are summed by so many tasks before they reach the driver.
MERGED = 8
#: Words scored at a time.
SCORED = 16_384
PARAMS = ("left", "right", "bias", "class_out", "class_bias")


class WordClasses:
    """Class 0 is the edge of a text, then come the known words with a class each, then classes that share all other words by hash."""

    def __init__(self, known: dict[bytes, int]):
        self.known, self.first, self.hashed = known, len(known) + 1, max(1, (len(known) + 1) // 3)
        self.count = self.first + self.hashed
        own = WordHashes().of(list(known))
        order = np.argsort(own)
        self.own, self.own_class = HashPlaces(own[order]), np.fromiter(known.values(), np.int64, len(known))[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shared = self.first + (hashes % np.uint64(self.hashed)).astype(np.int64)
        if not self.known:
            return shared
        at, own = self.own.find(hashes)
        return np.where(own, self.own_class.take(at), shared)


@dataclass(frozen=True)
class Vocabulary:
    """How classes divide among words: hashes (sorted) and log p(word | class) of the words kept, and by class how many
    words occur once and log p of each of them. A class of many words has one such word more, for any not in the corpus."""

    words: WordClasses
    hashes: np.ndarray
    log_p: np.ndarray
    single: np.ndarray
    single_log_p: np.ndarray

    @cached_property
    def places(self) -> HashPlaces:
        return HashPlaces(self.hashes)

    def within(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log p(word | class) of words; a class of one word is that word."""
        out = np.zeros(len(hashes), np.float32)
        many = np.flatnonzero(classes >= self.words.first)
        at, kept = self.places.find(hashes[many])
        out[many] = np.where(kept, self.log_p.take(at) if len(self.log_p) else 0, self.single_log_p.take(classes[many]))
        return out

    @cached_property
    def token_class(self) -> np.ndarray:
        """Class of every token: the edge, the words kept, then the words that occur once by class."""
        return np.concatenate([[0], self.words.of(self.hashes), np.repeat(np.arange(self.words.count), self.single)])

    @cached_property
    def token_log_p(self) -> np.ndarray:
        return np.concatenate([[0.0], self.log_p, np.repeat(self.single_log_p, self.single)])

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word's token; words that occur once in a class have equal columns and go by the first of them."""
        at, kept = self.places.find(hashes)
        firsts = 1 + len(self.hashes) + np.cumsum(self.single) - self.single
        return np.where(kept, at + 1, firsts[self.words.of(hashes)])


@dataclass(frozen=True)
class WindowNetwork:
    """log p(class | left, right) = log softmax(tanh(left[l] + right[r] + bias) @ class_out + class_bias).

    With log p(word | class) added to the bias, it is one softmax over all words: left_in, right_in, out and out_bias are
    those weights by token. Scoring never builds them.
    """

    vocabulary: Vocabulary
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray

    def classes(self, words: list[bytes]) -> np.ndarray:
        """Token of each word, an edge (0) before and after."""
        return np.concatenate([[0], self.vocabulary.tokens(WordHashes().of(words)), [0]])

    @cached_property
    def left_in(self) -> np.ndarray:
        return self.left[self.vocabulary.token_class]

    @cached_property
    def right_in(self) -> np.ndarray:
        return self.right[self.vocabulary.token_class]

    @cached_property
    def out(self) -> np.ndarray:
        return self.class_out[:, self.vocabulary.token_class]

    @cached_property
    def out_bias(self) -> np.ndarray:
        return self.class_bias[self.vocabulary.token_class] + self.vocabulary.token_log_p

    def log_table(self) -> np.ndarray:
        """log p(class | left, right) for every pair of classes; for small corpora, as it has the cube of the classes."""
        pairs = np.arange(len(self.left) ** 2)
        hidden = self.hidden(pairs // len(self.left), pairs % len(self.left))
        return hidden @ self.class_out + self.class_bias - self.log_norm(hidden)[:, None]

    def hidden(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(self.left.take(left, axis=0) + self.right.take(right, axis=0) + self.bias)

    def log_norm(self, hidden: np.ndarray) -> np.ndarray:
        logits = hidden @ self.class_out + self.class_bias
        most = logits.max(axis=1)
        return most + np.log(np.exp(logits - most[:, None]).sum(axis=1))


def class_number(running: int) -> int:
    """Cube root of the running words, rounded up to a multiple of four; LEAST_CLASSES at least."""
    return max(LEAST_CLASSES, 4 * int(np.ceil(np.cbrt(running) / 4)))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): every word of all texts."""
    def count(batches):
        held: list[pa.Array] = []
        size = 0

        def sent():
            words, n = pc.value_counts(pa.chunked_array(held, pa.string())).flatten()
            held.clear()
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), n], ["word", "n"])

        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                words, _ = split_texts(texts)
                held.append(words)
                size += len(words) + words.nbytes // 16
                if size > HELD:
                    yield sent()
                    size = 0
        yield sent()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, n: int) -> list[bytes]:
    return [bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()]


def frequent_words(docs: DataFrame, n: int) -> list[bytes]:
    """The n most frequent words of all texts, of equals the first in byte order."""
    return most_frequent(count_words(docs), n)


def vocabulary_of(counted: DataFrame, known: dict[bytes, int]) -> Vocabulary:
    """16 bytes reach the driver and 12 the executors for every word kept (names are 64-bit hashes of words)."""

    def named(batches):
        words = WordClasses(known)
        single = np.zeros(words.count, np.int64)
        for batch in batches:
            name, n = word_hashes(batch.column(0)), batch.column(1).to_numpy()
            single += np.bincount(words.of(name[n < KEPT_COUNT]), minlength=words.count)
            kept = n >= KEPT_COUNT
            yield pa.RecordBatch.from_arrays([pa.array(name[kept].view(np.int64)), pa.nulls(int(kept.sum()), pa.int32()), pa.array(n[kept])], ["hash", "single", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(words.count, pa.int64()), pa.array(np.arange(words.count, dtype=np.int32)), pa.array(single)], ["hash", "single", "n"])

    found = written(counted.select("word", "n").mapInArrow(named, "hash long, single int, n long"), "lm-words")
    words = WordClasses(known)
    table = found.where("hash IS NOT NULL").select("hash", "n").toArrow()
    hashes, n = table["hash"].to_numpy().view(np.uint64), table["n"].to_numpy()
    del table
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    single = np.zeros(words.count, np.int64)
    for r in found.where("hash IS NULL").groupBy("single").agg(F.sum("n").alias("n")).collect():
        single[r.single] = r.n
    classes = words.of(hashes)
    total = np.bincount(classes, n, words.count) + single
    single[words.first :] += 1
    total[words.first :] += 1
    log_total = np.log(np.maximum(total, 1))
    return Vocabulary(words, hashes, (np.log(n) - log_total[classes]).astype(np.float32), single, (-log_total).astype(np.float32) * (np.arange(words.count) >= words.first))


@dataclass(frozen=True)
class WindowCounts:
    """(keys, counts, n): blocks of windows as 64-bit integers, key (left * classes + right) * classes + token and how often, and the
    sum of the counts. Every window of all texts is there; a context (left, right) is in one part."""

    frame: DataFrame

    def sum(self) -> int:
        return self.frame.agg(F.sum("n")).first()[0] or 0


def summed(key: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each."""
    key, n = np.concatenate(key), np.concatenate(n)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(n, at) if len(at) else n


def blocks(key: np.ndarray, n: np.ndarray, part: np.ndarray):
    """Batches of BLOCK_ROWS rows (part, keys, counts, n) of BLOCK windows at most."""
    order = np.argsort(part, kind="stable")
    names, sizes = np.unique(part, return_counts=True)
    ends = np.cumsum(sizes)
    cuts = [(name, order[k : min(k + BLOCK, end)]) for name, end, size in zip(names.tolist(), ends.tolist(), sizes.tolist(), strict=True) for k in range(end - size, end, BLOCK)]
    for k in range(0, len(cuts), BLOCK_ROWS):
        some = cuts[k : k + BLOCK_ROWS]
        columns = [name for name, _ in some], [key[at].tobytes() for _, at in some], [n[at].tobytes() for _, at in some], [int(n[at].sum()) for _, at in some]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["part", "keys", "counts", "n"])


def held(batches):
    """Key and n of windows, HELD at a time, each key once in what is held; the first columns are those of WindowCounts."""
    key, n, size = [], [], 0
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
            key.append(np.frombuffer(keys.as_buffer(), np.int64))
            n.append(np.frombuffer(counts.as_buffer(), np.int64))
            size += len(key[-1])
            if size > HELD:
                yield summed(key, n)
                key, n, size = [], [], 0
    if size:
        yield summed(key, n)


def neighbours(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and after each token of texts of so many, 0 at the edges of a text."""
    left, right = np.roll(token, 1), np.roll(token, -1)
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    left[ends - sizes], right[ends - 1] = 0, 0
    return left, right


def window_counts(docs: DataFrame, known: dict[bytes, int], parts: int = 1) -> WindowCounts:
    """How often each (left, right, token) class occurs in all texts: only those that occur, in so many parts by context."""
    count = WordClasses(known).count

    def windows(batches):
        words = WordClasses(known)
        keys: list[np.ndarray] = []
        size = 0

        def sent():
            key = np.concatenate([*keys, np.empty(0, np.int64)])
            keys.clear()
            key, n = np.unique(key, return_counts=True)
            return blocks(key, n, (mixed((key // count).view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64))

        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                found, sizes = split_texts(texts)
                token = words.of(word_hashes(found))
                left, right = neighbours(token, sizes)
                keys.append((left * count + right) * count + token)
                size += len(token)
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    def merged(batches):
        for key, n in held(batches):
            yield from (x.select(["keys", "counts", "n"]) for x in blocks(key, n, np.zeros(len(key), np.uint16)))

    sent = docs.select("text").mapInArrow(windows, "part int, keys binary, counts binary, n long")
    dealt = sent.repartitionById(parts, F.col("part")).select("keys", "counts", "n")
    with arrow_rows(docs.sparkSession, BLOCK_ROWS):
        return WindowCounts(written(dealt.mapInArrow(merged, "keys binary, counts binary, n long"), "lm-windows"))


def descend(params: dict[str, np.ndarray], key: np.ndarray, n: np.ndarray, rate: float, seed: int) -> dict[str, np.ndarray]:
    """STEPS steps of Adam or one pass, whichever is more, over windows whose keys are in order."""
    count = len(params["left"])
    context, token = key // count, key % count
    starts = np.flatnonzero(np.diff(context, prepend=-1))
    ends = np.append(starts[1:], len(key))
    pairs = context[starts]
    parts = min(PARTS, -(-len(pairs) // FEW_CONTEXTS)) if len(pairs) < PARTS * FEW_CONTEXTS else max(PARTS, len(pairs) // (16 * FEW_CONTEXTS))
    share = n * (parts / n.sum())
    draw = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step = 0
    while step < STEPS:
        for part in np.array_split(draw.permutation(len(pairs)), parts):
            step += 1
            part = np.sort(part)
            left, right = pairs[part] // count, pairs[part] % count
            sizes = ends[part] - starts[part]
            rows = np.repeat(starts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            firsts = np.cumsum(sizes) - sizes
            hidden = np.tanh(params["left"].take(left, axis=0) + params["right"].take(right, axis=0) + params["bias"])
            back, class_out, class_bias = np.empty_like(hidden), np.zeros_like(params["class_out"]), np.zeros_like(params["class_bias"])
            for at in range(0, len(part), FEW_CONTEXTS):
                some = slice(at, at + FEW_CONTEXTS)
                of = slice(firsts[at], firsts[at] + sizes[some].sum())
                d_logits = hidden[some] @ params["class_out"]
                d_logits += params["class_bias"]
                d_logits -= d_logits.max(axis=1, keepdims=True)
                np.exp(d_logits, out=d_logits)
                d_logits *= (np.add.reduceat(share[rows[of]], firsts[some] - firsts[at]).astype(np.float32) / d_logits.sum(axis=1))[:, None]
                d_logits[np.repeat(np.arange(len(d_logits)), sizes[some]), token[rows[of]]] -= share[rows[of]]
                back[some] = d_logits @ params["class_out"].T
                class_out += hidden[some].T @ d_logits
                class_bias += d_logits.sum(axis=0)
            d_hidden = back * (1 - hidden * hidden)
            by = lambda side: np.stack([np.bincount(side, d_hidden[:, w], count) for w in range(d_hidden.shape[1])], axis=1)  # noqa: E731, B023
            grads = {"left": by(left), "right": by(right), "bias": d_hidden.sum(axis=0), "class_out": class_out, "class_bias": class_bias}
            for k in PARAMS:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                params[k] = (params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return params


def train(network: WindowNetwork, windows: WindowCounts) -> WindowNetwork:
    """Minimise the cross entropy of all counted windows: in each round every task descends over its contexts, and the
    networks of all tasks are averaged by how many windows they saw."""
    params = {k: getattr(network, k) for k in PARAMS}
    shapes = {k: v.shape for k, v in params.items()}
    flat = lambda p: np.concatenate([p[k].ravel() for k in PARAMS]).astype(np.float64)
    row = lambda seen, sums: pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([sums.tobytes()], pa.binary())], ["seen", "sums"])

    def merged(batches):
        seen, sums = 0.0, 0.0
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, sums = seen + n, sums + np.frombuffer(x, np.float64)
        if seen:
            yield row(seen, sums)

    for k in range(ROUNDS):
        rate, start = RATE * (1 - k / (ROUNDS + 1)), params

        def task(batches, rate=rate, start=start, seed=k):
            params, seen = dict(start), 0
            for key, n in held(batches):
                params = descend(params, key, n, rate, seed)
                seen += n.sum()
            if seen:
                yield row(seen, seen * flat(params))

        with arrow_rows(windows.frame.sparkSession, BLOCK_ROWS):
            found = windows.frame.mapInArrow(task, "seen double, sums binary").repartition(MERGED).mapInArrow(merged, "seen double, sums binary").collect()
        if not found:
            return network
        mean = sum(np.frombuffer(r.sums, np.float64) for r in found) / sum(r.seen for r in found)
        cuts = np.split(mean.astype(np.float32), np.cumsum([int(np.prod(shapes[x])) for x in PARAMS])[:-1])
        params = {x: part.reshape(shapes[x]) for x, part in zip(PARAMS, cuts, strict=True)}
    return replace(network, **params)


def fit_window_network(docs: DataFrame, text_col: str = "text", seed: int = 0) -> WindowNetwork:
    """Vocabulary and windows come from all texts. The driver holds the words that occur twice or more, 16 bytes each,
    and the network; windows stay with the executors."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = written(count_words(texts), "lm-counts")
    running = counted.agg(F.sum("n")).first()[0] or 0
    known = {w: k for k, w in enumerate(most_frequent(counted, class_number(running) * 3 // 4 - 1), 1)}
    vocabulary = vocabulary_of(counted, known)
    count = vocabulary.words.count
    draw = np.random.default_rng(seed)
    start = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
    network = WindowNetwork(vocabulary, start(count, WIDTH), start(count, WIDTH), np.zeros(WIDTH, np.float32), start(WIDTH, count), np.zeros(count, np.float32))
    return train(network, window_counts(texts, known, 1 + running // HELD))


class Scorer:
    """Sums of log p for words of whole texts. The norm of a context is worked out once: 4 bytes for each pair of classes."""

    def __init__(self, network: WindowNetwork):
        self.network = network
        self.count = len(network.left)
        self.norm = np.full(self.count**2, np.nan, np.float32)
        self.columns = np.ascontiguousarray(network.class_out.T)

    def sums(self, words: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """log-likelihood of each text; sizes says how many of the words are its own."""
        net, names = self.network, word_hashes(words)
        token = net.vocabulary.words.of(names)
        left, right = neighbours(token, sizes)
        log_p = net.vocabulary.within(names, token).astype(np.float64)
        for k in range(0, len(token), SCORED):
            l, r, t = left[k : k + SCORED], right[k : k + SCORED], token[k : k + SCORED]
            pair = l * self.count + r
            new = np.unique(pair[np.isnan(self.norm.take(pair))])
            for at in range(0, len(new), 4096):
                x = new[at : at + 4096]
                self.norm[x] = net.log_norm(net.hidden(x // self.count, x % self.count))
            log_p[k : k + SCORED] += np.einsum("ij,ij->i", net.hidden(l, r), self.columns.take(t, axis=0)) + net.class_bias.take(t) - self.norm.take(pair)
        out = np.zeros(len(sizes))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(log_p, (np.cumsum(sizes) - sizes)[full])
        return out


_scorers: dict[str, Scorer] = {}


def scorer_of(name: str, sent) -> Scorer:
    """The worker's scorer for a broadcast network, which keeps the norms of all tasks that the worker runs."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(sent.value)
    return _scorers[name]


def lm_score(docs: DataFrame, network: WindowNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, log_likelihood, mean_log_likelihood) for every row; no shuffle.

    Each word of the whole text is masked in turn and predicted from its neighbours; log_likelihood is the sum of
    their conditional log-probabilities as words, not as classes. Texts that are null or have no word: 0 tokens, sum 0, mean null. Other
    columns are ignored; repeated rows are scored each; texts count whole, some words at a time, however long they are;
    an empty table gives no rows.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(network), uuid.uuid4().hex

    def score(batches):
        scorer = scorer_of(name, sent)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, texts in text_runs(batch.column(1)):
                words, sizes = split_texts(texts)
                n[at : at + len(sizes)], total[at : at + len(sizes)] = sizes, scorer.sums(words, sizes)
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), mean], ["id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())])
    return source.mapInArrow(score, schema).withColumnRenamed("id", id_col)
