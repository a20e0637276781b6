"""op12: target resampling against a plain version and its SQL."""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F
from shapes import ROWS, empty, frame

from partyframe.llm import bucket_resampling as b
from partyframe.llm import queries


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def plain(docs, target, least=20, share=5):
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x[1] for x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for key, text in docs:
        n, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs)
        h = None if key is None else int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(fs), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((-r[4], r[0]) for r in out if r[0] is not None and r[1] >= least)[: share * sum(r[0] is not None and r[1] >= least for r in out) // 100]
    return able, out


def test_equals_the_sql(spark, small, duck):
    assert table(queries.op12_target_resampling(spark, small)) == table(duck.sql(queries.OP12_SQL))


@pytest.mark.parametrize("window", [b.WINDOW, 7])
def test_features_of_windows(window, monkeypatch):
    monkeypatch.setattr(b, "WINDOW", window)
    for text in (None, "", " ", "one", "One two", "A b  c", "é ß–x 12 zz, Q.q\n\tend " * 9, "x" * 50 + " y", "-- !! --"):
        counts = np.zeros(b.BUCKETS, np.int64)
        words, n = b.feature_counts(text, counts)
        want_words, want = features(text)
        expected = np.bincount([crc32(f.encode()) % b.BUCKETS for f in want], minlength=b.BUCKETS)
        assert (words, n) == (want_words, len(want)) and (counts == expected).all(), text


def test_awkward_rows_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(b, "BLOCK_ROWS", 3)
    docs = frame(spark)
    target = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, None)], "item_id long, text string")
    got = b.target_resample(docs, target, least_words=3, share=40).collect()
    drawn, want = plain([(r[0], r[1]) for r in ROWS], ["the quick brown fox jumps", None], 3, 40)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((list(r[:5]) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r.rank, -r.score, r.doc_id) for r in got if r.rank is not None)
    assert [x[1:] for x in ranked] == drawn and [x[0] for x in ranked] == list(range(1, len(drawn) + 1))
    assert b.target_resample(empty(spark), target).collect() == []
    assert all(r.rank is None for r in b.target_resample(docs, target.limit(0), share=0).collect())


def test_ranks_of_one_hot_score_over_many_ranges(spark):
    """A third of all rows share one score, and one id and score fill whole ranges: places still run from 1 on."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 100).alias("score"))
        got = b.draw_order(rows, "score", "doc_id").orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["rank"] for r in got] == list(range(1, 9001))
    order = [(-r.score, r.doc_id) for r in got]
    assert order == sorted(order)


def test_blocks_hold_the_whole_matrix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    blocks = b.count_blocks(docs).collect()
    assert sum(len(x.ids) for x in blocks) == docs.count()
    total = b.column_sums(b.count_blocks(docs))
    assert total.sum() == sum(sum(x.features) for x in blocks) == sum(len(features(r.text)[1]) for r in docs.collect())
    assert all(x.row_start[-1] == len(x.buckets) == len(x.counts) for x in blocks)
