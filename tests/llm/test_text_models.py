"""op2, op6 and op7: models trained in numpy."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from shapes import empty, frame

from partyframe.llm import lm_scoring, queries
from partyframe.llm.language_id import UNKNOWN, identify_languages, ngram_buckets
from partyframe.llm.quality import fit_importance, importance_resample, importance_weights, kth_largest
from partyframe.llm.words import split_words


def test_language_on_the_held_out_fold(spark, small):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op6_language_id(spark, small).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    told = [(r.lang_pred, langs[r.doc_id]) for r in rows if r.held_out and r.lang_pred != UNKNOWN and langs[r.doc_id]]
    assert sum(a == b for a, b in told) >= 0.9 * len(told)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*langs.values(), UNKNOWN} for r in rows)


def gram_buckets(text: str) -> list[int]:
    """The buckets of all 1-, 2- and 3-grams in plain integers."""
    low, out = 0xFFFFFFFF, []
    code = [ord(c) for c in f" {text.lower()} "]
    one = [c * 2654435761 & low for c in code]
    two = [((a ^ a >> 15) * 2246822519 + c * 3266489917) & low for a, c in zip(one, code[1:], strict=False)]
    three = [((a ^ a >> 13) * 668265263 + c * 374761393) & low for a, c in zip(two, code[2:], strict=False)]
    for h in [*one, *two, *three]:
        out.append(((h ^ h >> 16) * 2246822519 & low) >> 16)
    return out


def test_posteriors_by_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(4)
    letters = {"aa": "etaoin shrdlu", "bb": "enisrat dhulc", "cc": "aeionl rstcd"}
    rows = [(k, "".join(draw.choice(list(letters[lang]), 30 + k)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 12)] + [(90, "Ünd ß İ", "aa"), (91, None, "bb"), (92, "no tongue", None)]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    learned = [(t, lang) for k, t, lang in rows if t is not None and lang is not None and not held(k)]
    counts = {lang: Counter(b for t, x in learned if x == lang for b in gram_buckets(t)) for lang in letters}
    total = {lang: sum(c.values()) + 0.5 * 65536 for lang, c in counts.items()}
    monkeypatch.setattr("partyframe.llm.language_id.WINDOW", 16)  # several windows a text
    for text in ("", "x", "fourteen signs", "fifteen  signs!", "a text of more than sixteen signs, and of more than twice as many"):
        assert Counter(np.concatenate(list(ngram_buckets(text))).tolist()) == Counter(gram_buckets(text))
    for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        text = rows[[k for k, _, _ in rows].index(r.doc_id)][1]
        if text is None:
            assert (r.lang_pred, r.score) == (UNKNOWN, 0.0)
            continue
        log = {lang: math.log(sum(x == lang for _, x in learned) / len(learned)) + sum(math.log((counts[lang][b] + 0.5) / total[lang]) for b in gram_buckets(text)) for lang in letters}
        best = max(log, key=log.get)
        assert r.lang_pred == best and math.isclose(r.score, 1 / sum(math.exp(v - log[best]) for v in log.values()), rel_tol=1e-3)


def test_a_text_of_megabytes_takes_bounded_memory():
    import tracemalloc

    from partyframe.llm.language_id import LanguageModel

    model = LanguageModel(("a", "b"), np.log([0.5, 0.5]), np.zeros((65536, 2), np.float32))
    tracemalloc.start()
    assert np.allclose(model.posteriors(["word and word " * 200_000]), 0.5)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_language_of_awkward_texts(spark):
    rows = identify_languages(frame(spark)).collect()
    assert len(rows) == 11
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [found[k].lang_pred for k in (3, 4, 6, 7)] == [UNKNOWN] * 4
    assert found[1].lang_pred in ("en", "la", "de") and found[5].lang_pred == "la"
    assert identify_languages(empty(spark)).count() == 0
    unlearned = identify_languages(frame(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlearned} == {UNKNOWN} and {r.score for r in unlearned} == {0.0}


def test_prediction_ignores_language_and_source(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    hidden = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")), "source": F.lit(None).cast("string")})
    assert sorted(identify_languages(docs).collect()) == sorted(identify_languages(hidden).collect())


def test_scores_are_sums_of_conditional_log_probabilities(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    network = lm_scoring.fit_window_network(docs)
    table = network.log_table()
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-4)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in lm_scoring.lm_score(docs, network).limit(40).collect():
        c = network.classes(split_words(texts[r.doc_id]))
        total = 0.0
        for k in range(1, len(c) - 1):  # one position at a time, from the weights
            hidden = np.tanh(network.left_in[c[k - 1]] + network.right_in[c[k + 1]] + network.bias)
            logits = (hidden @ network.out + network.out_bias).astype(float)
            total += logits[c[k]] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        assert r.n_tokens == len(c) - 2
        assert math.isclose(r.log_likelihood, total, rel_tol=1e-3, abs_tol=1e-2)


def test_counts_cover_the_whole_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    words = Counter(w for r in docs.collect() for w in split_words(r.text))
    assert lm_scoring.frequent_words(docs, 20) == [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:20]]
    known = {w: k for k, w in enumerate(lm_scoring.frequent_words(docs, 95), 1)}
    assert lm_scoring.window_counts(docs, known).sum() == sum(words.values())


def test_training_tells_order_from_disorder(spark):
    good, bad = "a b c d e f g h " * 30, "h c a g d b f e " * 30
    docs = spark.createDataFrame([(k, good) for k in range(40)] + [(100, bad)], "doc_id long, text string")
    scores = {r.doc_id: r.mean_log_likelihood for r in lm_scoring.lm_score(docs, lm_scoring.fit_window_network(docs.where("doc_id < 100"))).collect()}
    assert scores[0] > scores[100] + 1


def test_lm_scores_of_awkward_texts(spark):
    df = frame(spark)
    rows = lm_scoring.lm_score(df, lm_scoring.fit_window_network(df)).collect()
    assert len(rows) == 11 and all((r.n_tokens == 0) == (r.mean_log_likelihood is None) for r in rows)
    assert lm_scoring.lm_score(empty(spark), lm_scoring.fit_window_network(empty(spark))).count() == 0


def test_rare_words_are_scored_as_words(spark):
    """Two words that share a class differ by how often each occurs; all words of the corpus sum up to one."""
    rare = [f"rare{k}" for k in range(400)]
    texts = [" ".join([*(f"usual{k % 130}" for k in range(j, j + 130)), *(w for w in rare[j::20] for _ in range(1 + 2 * (rare.index(w) % 3)))]) for j in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    network = lm_scoring.fit_window_network(docs)
    alone = spark.createDataFrame(list(enumerate([*rare, *(f"usual{k}" for k in range(130))])), "doc_id long, text string")
    p = {r.doc_id: r.log_likelihood for r in lm_scoring.lm_score(alone, network).collect()}
    words = network.vocabulary.words
    of = lambda k: int(words.of(lm_scoring.WordHashes().of([rare[k].encode()]))[0])
    a, b = next((a, b) for a in range(0, 400, 3) for b in range(2, 400, 3) if of(a) == of(b))
    assert math.isclose(p[b] - p[a], math.log(5), rel_tol=1e-4)
    edge_and_unseen = np.exp(network.log_table()[0]) * (np.arange(words.count) == 0) + np.exp(network.log_table()[0] + network.vocabulary.single_log_p) * (np.arange(words.count) >= words.first)
    assert math.isclose(sum(map(math.exp, p.values())) + edge_and_unseen.sum(), 1, rel_tol=1e-3)


def test_classes_and_words_kept_grow_with_the_corpus(spark, small):
    assert lm_scoring.class_number(10**6) == 128 and lm_scoring.class_number(10**9) == 1000 and lm_scoring.class_number(10**12) == 10_000
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    counts = Counter(w for r in docs.collect() for w in split_words(r.text))
    kept = lm_scoring.fit_window_network(docs).vocabulary
    assert len(kept.hashes) == sum(n > 1 for n in counts.values()) and kept.single.sum() - kept.words.hashed == sum(n == 1 for n in counts.values())


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0), (None, 1), (8, None)], "doc_id long, quality int")


def test_importance_weights_by_brute_force(spark, small):
    docs, marks = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    target = (F.col("quality") == 1) & (F.col("toxic") == 0)
    model = fit_importance(docs, marks, target)
    good = {r.doc_id for r in marks.where(target).collect()}
    from partyframe.llm.quality import BUCKETS, SMOOTHING, ngram_buckets
    from partyframe.llm.words import WordHashes

    hashes, counts = WordHashes(), np.full((2, BUCKETS), SMOOTHING)
    grams = {r.doc_id: ngram_buckets(r.text, hashes) for r in docs.select("doc_id", "text").collect()}
    for k, g in grams.items():
        counts[0] += np.bincount(g, minlength=BUCKETS)
        counts[1] += np.bincount(g, minlength=BUCKETS) * (k in good)
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    for r in importance_weights(docs, model).collect():
        assert math.isclose(r.log_weight, (log_p[1] - log_p[0])[grams[r.doc_id]].sum(), rel_tol=1e-9, abs_tol=1e-6)


def test_resampling_takes_the_largest_keys(spark):
    df = frame(spark)
    model = fit_importance(df, labels(spark), F.coalesce(F.col("quality") == 1, F.lit(False)))
    for k in (0, 1, 4, 11, 99):
        rows = importance_resample(df, model, k).collect()
        keys = sorted((r.gumbel_key for r in rows), reverse=True)
        assert sum(r.kept for r in rows) == (0 if k == 0 else sum(x >= keys[min(k, 11) - 1] for x in keys))
    assert importance_resample(empty(spark), model, 3).count() == 0


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=500).round(2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 77, 499, 500):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_draws_follow_the_weights(spark):
    """Documents that look like the target are drawn more often than chance."""
    rows = [(k, "good clean prose " * 5 if k % 4 == 0 else "buy cheap now " * 5) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0, 400, 5)], "doc_id long, quality int")
    drawn = importance_resample(docs, fit_importance(docs, marks, F.col("quality") == 1), 80).where("kept").collect()
    share = defaultdict(int)
    for r in drawn:
        share[r.doc_id % 4 == 0] += 1
    assert share[True] >= 0.9 * len(drawn)


def test_words_of_columns_are_those_of_texts():
    """Splitting and hashing whole columns gives what words one by one give."""
    import pyarrow as pa
    from shapes import ROWS

    from partyframe.llm import words

    draw = np.random.default_rng(5)
    texts = [t for _, t, *_ in ROWS] + [" ".join("xYÄ€\U0001f600\x00z"[k % 7] * int(k) for k in draw.integers(1, 70, 200)), "\x0b\x0ca\x1cb\x85c D \r\n", "e" * 100_000, "Ab c " * 100_000]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    plain, at = words.WordHashes(), 0
    for first, run in words.text_runs(column):
        assert first == at and (len(run) == 1 or sum(len((t or "").encode()) for t in run.to_pylist()) <= words.SPLIT_BYTES)
        found, sizes = words.split_texts(run)
        wanted = [split_words(t) for t in run.to_pylist()]
        assert sizes.tolist() == [len(w) for w in wanted] and [w.encode() for w in found.to_pylist()] == [x for w in wanted for x in w]
        assert np.array_equal(words.word_hashes(found), plain.of([x for w in wanted for x in w]))
        at += len(run)
    assert at == len(texts)
    for n in (0, 1, 2, 3, 1000, 5000):
        own = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        asked = np.concatenate([own, own + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        place, there = words.HashPlaces(own).find(asked)
        assert np.array_equal(there, np.isin(asked, own)) and np.array_equal(own[place[there]], asked[there])


def test_windows_travel_and_rest_in_blocks(spark, small):
    """Tasks send blocks of windows, not a row for each; each context is in one part."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    known = {w: k for k, w in enumerate(lm_scoring.frequent_words(docs, 95), 1)}
    classes, wanted = lm_scoring.WordClasses(known), Counter()
    for r in docs.collect():
        c = [0, *classes.of(lm_scoring.WordHashes().of(split_words(r.text))).tolist(), 0]
        wanted.update(zip(c, c[2:], c[1:], strict=False))
    rows = lm_scoring.window_counts(docs, known, 5).frame.withColumn("file", F.input_file_name()).collect()
    found, files = Counter(), defaultdict(set)
    for r in rows:
        key, n = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)
        assert len(key) == len(n) <= lm_scoring.BLOCK and n.sum() == r["n"]
        for k, m in zip(key.tolist(), n.tolist(), strict=True):
            context = divmod(k // classes.count, classes.count)
            found[*context, k % classes.count] += m
            files[context].add(r["file"])
    assert found == wanted and len(rows) <= 5 + len(wanted) // lm_scoring.BLOCK
    assert all(len(x) == 1 for x in files.values()) and len({x for y in files.values() for x in y}) == 5
