"""op11: hard negatives against brute force and SQL."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from partyframe.llm import hard_negatives as h
from partyframe.llm import queries
from partyframe.llm.shared import written

SCHEMA = "id long, label int, v array<long>"


def plain(rows, positives=5, negatives=3, anchor=lambda k: k % 10 == 0):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for key, label, v in rows:
        if not anchor(key):
            continue
        near = sorted((-dot(v, w), k) for k, l, w in rows if k != key and l == label)[:positives]
        others = sorted((-dot(v, w), k) for k, l, w in rows if k != key and l != label)
        for p, k in near:
            kept = [(s, n) for s, n in others if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(key, k, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(kept)]
    return sorted(out)


def mined(spark, rows):
    return sorted(map(tuple, h.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0).collect()))


def clustered(n, length, seed, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-100, 100, (6, length))
    v = middle[rng.integers(0, 6, n)] + rng.integers(-30, 30, (n, length))
    return [(k, int(rng.integers(0, labels)), v[k].tolist()) for k in range(n)]


def test_equals_the_sql(spark, small, duck):
    assert table(queries.op11_hard_negatives(spark, small)) == table(duck.sql(queries.OP11_SQL))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force_in_many_rounds(spark, monkeypatch, seed):
    """Few clusters a round, small blocks, lists in many parts."""
    for name, value in (("FIRST", 1), ("TIMES", 2), ("BLOCK_ROWS", 4), ("BLOCKS_TOGETHER", 1), ("REQUEST_ANCHORS", 3), ("JOINED_ROWS", 2)):
        monkeypatch.setattr(h, name, value)
    rows = clustered(230, 5, seed)
    assert mined(spark, rows) == plain(rows)


def test_lists_out_of_reach_are_left_out(spark, monkeypatch):
    """Well separated groups: bounds leave out most lists, and the answer stays that of brute force."""
    rows = [(k, k % 3, [(1000 if k % 12 == g else 0) + (k * 7 + g) % 5 for g in range(12)]) for k in range(600)]
    asked = []
    real = h.requests_of
    monkeypatch.setattr(h, "requests_of", lambda a, i, b, e: asked.append(written(real(a, i, b, e), "asked")) or asked[-1])
    monkeypatch.setattr(h, "FIRST", 2)
    assert mined(spark, rows) == plain(rows)
    clusters = round(600**0.5)
    visits = sum(len(r.ids) for frame in asked for r in frame.collect()) if asked else 0
    assert 0 < visits < 0.5 * 2 * 60 * clusters


def test_repeated_vectors_ties_and_awkward_rows(spark):
    rows = [(k, k % 2, [3, 4, 5]) for k in range(60)]  # one hot vector: all scores tie, no negative is below 95 percent
    rows += [(100 + k, k % 2, [3 - k % 3, 4, 2]) for k in range(30)]
    rows += [(None, 1, [1, 1, 1]), (200, None, [1, 2, 3]), (201, 1, None), (202, 0, [1, None, 1]), (203, 1, [9]), (204, 0, []), (210, 7, [5, 5, 5]), (220, 1, [-3, -4, -5]), (230, 0, [0, 0, 0])]
    assert mined(spark, rows) == plain(rows)


def test_repeated_ids_stay_once(spark):
    rows = clustered(80, 4, 3)
    assert mined(spark, rows + rows[:40]) == plain(rows)


def test_empty_and_one_row(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1, 2])]) == []


def test_large_numbers(spark):
    big = 1 << 26
    rows = [(k, k % 2, [big + k * 1001, big - k * k, k]) for k in range(40)]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="56 bits"):
        mined(spark, [(0, 1, [1 << 40, 1])])


def test_every_row_is_in_a_list(spark):
    rows = spark.createDataFrame(clustered(500, 6, 9), SCHEMA).select("id", F.col("label").cast("long").alias("label"), "v")
    index = h.build_index(rows)
    lists = index.lists.collect()
    assert sorted(k for r in lists for k in r.row_ids) == list(range(500))
    for r in lists:
        x = np.frombuffer(r.rows, index.kind).reshape(len(r.row_ids), -1)
        assert (np.linalg.norm(x - index.centroids[r.cluster], axis=1) <= index.radii[r.cluster] + 1e-9).all()
