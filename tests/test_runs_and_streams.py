"""Run bundles, categorical drift, running sums over ranges, replay windows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from partyframe.functions.session import shared_path
from partyframe.operators import privacy as pv
from partyframe.operators import studies as sd
from partyframe.operators.linkage import dense_order
from partyframe.operators.ranking import ordered_place, ordered_sums
from partyframe.sources import runs
from partyframe.streaming.replay_window import Accepted, judged


def write(spark, root, **other):
    documents = {"config": {"a": 1}, "dataset_provenance": {}, "linkage_manifest": {}, "metrics": {"roc_auc": 0.5}}
    tables = {name: spark.range(3).select("id", F.lit(name).alias("x")) for name in runs.TABLES}
    return runs.write_run(spark, root, 1, documents, tables, **other)


def test_run_records_code_packages_and_datasets(spark):
    data = {"people": spark.range(50).select("id", F.lit("x").alias("name")), "none": spark.range(0).toDF("id")}
    folder = write(spark, shared_path(spark, "runs"), datasets=data)
    manifest = runs.read_document(spark, f"{folder}/{runs.MANIFEST}.json")
    assert manifest["dataset_hashes"]["people"]["rows"] == 50 and manifest["dataset_hashes"]["none"]["rows"] == 0
    assert manifest["dependency_versions"]["pyspark"] and set(manifest["dependency_versions"]) == set(runs.PACKAGES)
    assert runs.read_run(spark, folder)[0]["environment"]["dependency_versions"] == manifest["dependency_versions"]
    assert runs.changed_datasets(spark, folder, data) == []
    assert runs.changed_datasets(spark, folder, {"people": data["people"].where("id > 0"), "new": data["none"]}) == ["new", "none", "people"]
    assert runs.changed_files(spark, folder).count() == 0
    assert runs.dependency_versions(("no such package",)) == {"no such package": None}


def test_code_version_from_a_repository_s_files(tmp_path):
    assert runs.code_version(str(tmp_path)) is None
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack\n" + "b" * 40 + " refs/heads/main\n")
    assert runs.code_version(str(tmp_path / "deep")) == "b" * 40
    (git / "refs/heads/main").write_text("a" * 40 + "\n")
    assert runs.code_version(str(tmp_path)) == "a" * 40
    (git / "HEAD").write_text("c" * 40 + "\n")
    assert runs.code_version(str(tmp_path)) == "c" * 40


def test_what_an_action_costs(spark):
    spark.sparkContext.setJobGroup("mine", "mine")
    try:
        out, cost = runs.measured(lambda: (bytearray(64 << 20), spark.range(100).repartition(3).count())[1], spark)
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out == 100 and cost["seconds"] > 0 and cost["jobs"] >= 1 and cost["stages"] >= 1 and cost["tasks"] >= 1 and cost["rss_samples"] >= 2
    _, small = runs.measured(lambda: None)
    assert cost["peak_rss_bytes"] > 1 << 20 and set(small) == {"seconds", "peak_rss_bytes", "rss_samples"}
    grid = runs.scaling_grid(spark, [5, 50], lambda n: spark.range(n), lambda df: df.count()).collect()
    assert [r.rows for r in grid] == [5, 50] and all(r.jobs >= 1 and r.tasks >= 1 for r in grid)


def uniform(key: int, seed: int = 42) -> float:
    return int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:15], 16) / (1 << 60)


@pytest.mark.parametrize("strength", [0.0, 0.3, 1.0])
def test_categorical_drift_of_many_categories(spark, strength):
    rows = [(k, None if k % 11 == 0 else f"c{k % 700:04d}" if k % 3 else "d most") for k in range(3000)]
    found = {r.id: r.c for r in sd.categorical_drift(spark.createDataFrame(rows, "id long, c string").repartition(5), "c", "id", strength).collect()}
    counts = sorted(Counter(c for _, c in rows if c is not None).items())
    total, upto, ends = sum(n for _, n in counts), 0, []
    for c, n in counts:
        upto += n
        ends.append(((1 - strength) * upto / total + (strength if c >= "d most" else 0.0), c))
    ends[-1] = (2.0, ends[-1][1])
    assert len(found) == len(rows)
    for k, c in rows:
        assert found[k] == (None if c is None else next(v for end, v in ends if uniform(k) < end))


def test_categorical_drift_edges(spark):
    numbers = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id long, c int")
    assert sorted((r.id, r.c) for r in sd.categorical_drift(numbers, "c", "id").collect()) == [(1, 5), (2, 5), (3, None)]
    assert sd.categorical_drift(numbers.where("c IS NULL"), "c", "id").collect()[0].c is None
    assert sd.categorical_drift(numbers.limit(0), "c", "id").count() == 0
    with pytest.raises(ValueError, match="strength"):
        sd.categorical_drift(numbers, "c", "id", 1.5)


def test_running_sums_over_ranges_with_one_hot_value(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("v"), (F.col("id") % 5).alias("w"), (F.col("id") / 4).alias("d"))
        summed = ordered_sums(rows, [F.desc("v"), F.asc("id")], {"upto": F.col("w"), "far": F.col("d")}).collect()
        placed = ordered_place(rows, [F.col("v"), F.col("id")], "place").collect()
        dense = {r.id: r.place for r in dense_order(rows.select("id", F.col("v").cast("double").alias("v")), "id", "v", "place").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    upto = far = 0
    for r in sorted(summed, key=lambda r: (-r.v, r.id)):
        upto, far = upto + r.w, far + r.d
        assert r.upto == upto and math.isclose(r.far, far)
    order = sorted(placed, key=lambda r: (r.v, r.id))
    assert [r.place for r in order] == list(range(2000)) and all(dense[r.id] == r.place for r in order)
    assert ordered_sums(rows.limit(0), [F.col("v")], {"upto": F.col("w")}).count() == 0 == ordered_place(rows.limit(0), [F.col("v")], "place").count()


def test_student_quantiles_agree_where_the_method_changes():
    series = [pv.t_critical(n) for n in (999, 1000)]
    grown = [sum(term / n**k for k, term in enumerate(pv.T_EXPANSION)) for n in (999, 1000)]
    assert all(math.isclose(a, b, rel_tol=1e-11) for a, b in zip(series, grown, strict=True))
    assert pv.t_critical(1000) > pv.t_critical(1001) > pv.t_critical(10**9) > pv.Z


def test_cache_of_accepted_messages():
    known = Accepted([], ttl=10, most=2)
    assert [known.verdict("a", "x", 0), known.verdict("a", "x", 5), known.verdict("a", "y", 6)] == ["accepted", "repeat", "conflict"]
    assert known.verdict("b", "x", 7) == "accepted" and known.verdict("a", "x", 8) == "repeat"
    assert known.verdict("c", "x", 9) == "accepted" and list(known.entries) == ["a", "c"]  # b was met longest ago
    assert known.verdict("a", "z", 10.5) == "accepted"  # ten seconds after it was accepted, though met since
    assert known.verdict("b", "x", 11) == "accepted"


def test_verdicts_over_two_micro_batches(spark):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    schema = "seq long, message_id string, sender string, sent_at timestamp, received_at timestamp, digest string"
    first = [(1, "m1", "p", at(0), at(1), "d"), (2, "m1", "p", at(0), at(2), "d"), (3, "m2", "p", at(0), at(900), "d"), (4, "m3", "q", at(3), at(3), "d"), (5, None, "q", at(3), at(3), "d")]
    second = [(6, "m1", "p", at(4), at(5), "other"), (7, "m2", "p", at(900), at(901), "e"), (8, "m1", "q", at(5), at(5), "d"), (9, "m3", "q", at(9), at(9), "d"), (10, "m1", "p", at(700), at(700), "new"), (11, "m4", "p", at(2000), at(1000), "d")]
    folder = shared_path(spark, "replay")
    results = {}
    for rows in (first, second):  # the second run continues from the first one's state
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/given")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/given")
        results = {r.seq: r.verdict for r in judged(stream, folder, skew_seconds=300, ttl_seconds=600, shards=2).collect()}
    assert results == {1: "accepted", 2: "repeat", 3: "expired", 4: "accepted", 5: "malformed", 6: "conflict", 7: "accepted", 8: "accepted", 9: "repeat", 10: "accepted", 11: "expired"}
