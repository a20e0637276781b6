"""Operators on small literal frames: facts that SQL cannot state, and bad input."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.operators import evaluate as ev
from partyframe.operators import features as fe
from partyframe.operators import gbdt, linkage, logistic, privacy, ranking, relational, studies
from partyframe.operators.audit import UnsafeLogFieldError, row_digest, safe_log_fields
from partyframe.operators.preprocess import LocalPreprocessor
from partyframe.sources import files, parties, registry, runs, synthetic
from partyframe.streaming import audit as stream


def learning(spark, n=250, seed=7):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 5))
    z = x @ np.array([0.7, -0.5, 0.4, 0.6, -0.8]) - 0.2
    y = (draw.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(k, *map(float, x[k]), int(y[k])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y int"), x, y


PARTIES = {"active": ["a", "b", "c"], "passive": ["d", "e"]}


def descend(x, y, rate, epochs, l2=0.0, l1=0.0, clip=None, weight=None):
    w, b, blocks = np.zeros(5), 0.0, [slice(0, 3), slice(3, 5)]
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(epochs):
        r = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight / weight.sum()
        g = x.T @ r + l2 * w
        for s in blocks:
            norm = np.linalg.norm(g[s])
            g[s] *= clip / norm if clip and norm > clip else 1
        w, b = w - rate * g, b - rate * r.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


@pytest.mark.parametrize("extra", [{}, {"l2": 0.01, "l1": 0.002, "clip": 0.05}])
def test_vertical_logistic_is_pooled_descent(spark, extra):
    df, x, y = learning(spark)
    m = logistic.fit_logistic(df, PARTIES, options=logistic.LogisticOptions(0.08, 25, **{"l2": 0.0, **extra}))
    w, b = descend(x, y, 0.08, 25, **extra)
    assert np.allclose(list(m.weights.values()), w, atol=1e-10) and math.isclose(m.intercept, b, abs_tol=1e-10)


def test_class_weights_and_early_stopping(spark):
    df, x, y = learning(spark)
    weight = np.where(y == 1, 4.25, 0.65)
    m = logistic.fit_logistic(df, PARTIES, options=logistic.LogisticOptions(0.05, 10, 0.0, class_weight={0: 0.65, 1: 4.25}))
    assert np.allclose(list(m.weights.values()), descend(x, y, 0.05, 10, weight=weight)[0], atol=1e-10)
    held = logistic.fit_logistic(df.where("id % 2 = 0"), PARTIES, options=logistic.LogisticOptions(30.0, 12, patience=2), validation=df.where("id % 2 = 1"))
    assert len(held.history) < 12
    still = logistic.fit_logistic(df, PARTIES, options=logistic.LogisticOptions(0.01, 50, tolerance=1.0))
    assert len(still.history) == 2


def test_logistic_policies(spark):
    df, _, _ = learning(spark, 40)
    m = logistic.fit_logistic(df, PARTIES, options=logistic.LogisticOptions(0.1, 2))
    with pytest.raises(logistic.MissingPartyError):
        logistic.score_logistic(df.drop("d", "e"), m)
    with pytest.raises(logistic.MissingPartyError):
        logistic.score_logistic(df.drop("a"), m, "zero_contribution")
    assert logistic.score_logistic(df.drop("d", "e"), m, "zero_contribution").count() == 40
    with pytest.raises(ValueError, match="missing features"):
        logistic.fit_logistic(df.withColumn("a", F.lit(None).cast("double")), PARTIES)
    for bad in ({"learning_rate": 0}, {"batches": 0}, {"schedule": "x"}, {"clip": -1.0}):
        with pytest.raises(ValueError, match="unusable"):
            logistic.LogisticOptions(**bad)


def test_message_volume():
    assert logistic.message_volume(100, 2, 3) == {"messages": 20, "scalars": 2000, "bytes": 16000}


def test_one_tree_by_hand(spark):
    """Base score ln(1/2), as two of six labels are 1. With p = 1/3 rows have g = -2/3 (label 1) or 1/3 and h = 2/9; the
    split below 3 has G = -4/3, H = 4/9 on its left and G = 4/3, H = 8/9 on its right."""
    df = spark.createDataFrame([(k, 7.0, v, y) for k, (v, y) in enumerate([(1.0, 1), (1.0, 1), (5.0, 0), (5.0, 0), (9.0, 0), (9.0, 0)])], "id long, own double, theirs double, y int")
    m = gbdt.fit_gbdt(df, {"active": ["own"], "passive": ["theirs"]}, options=gbdt.GBDTOptions(trees=1, depth=1, bins=3, min_leaf=1))
    root = m.trees[0][1]
    assert (root.party, root.feature, root.bin) == ("passive", "theirs", 0) and math.isclose(root.gain, 8 / 13 + 8 / 17)
    base = math.log(0.5)
    margins = [r.margin for r in gbdt.score_gbdt(df, m).orderBy("id").collect()]
    assert np.allclose(margins, [base + 0.1 * 12 / 13] * 2 + [base - 0.1 * 12 / 17] * 4)
    new = spark.createDataFrame([(1, 7.0, -30.0), (2, 7.0, 400.0), (3, 7.0, None)], "id long, own double, theirs double")
    assert [r.margin > base for r in gbdt.score_gbdt(new, m).orderBy("id").collect()] == [True, False, False]
    assert np.allclose([r.margin for r in gbdt.score_gbdt(df.drop("theirs"), m, "zero_contribution").collect()], base)


def test_trees_take_options(spark):
    df, _, _ = learning(spark)
    m = gbdt.fit_gbdt(df.where("id % 3 > 0"), PARTIES, options=gbdt.GBDTOptions(trees=7, depth=3, min_leaf=5, max_leaves=3, row_fraction=0.8, feature_fraction=0.6, patience=2, checkpoint_every=2), validation=df.where("id % 3 = 0"))
    assert all(sum(x.feature is None for x in t.values()) <= 3 for t in m.trees) and 1 <= len(m.trees) <= 7


def test_shapley_of_an_additive_game(spark):
    weights = [1.0, 2.0, 3.0, 4.0]
    rows = [(m, float(sum(w for k, w in enumerate(weights) if m >> k & 1))) for m in range(16)]
    found = {r.party: r.shapley for r in studies.shapley_values(spark.createDataFrame(rows, "mask int, value double"), list("abcd")).collect()}
    assert all(math.isclose(found[p], w) for p, w in zip("abcd", weights, strict=True))


def test_student_quantiles():
    for df, t in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (10, 2.2281), (30, 2.0423), (2000, 1.9612)):
        assert math.isclose(privacy.t_critical(df), t, abs_tol=2e-4)


def test_accountant_and_release(spark):
    a = privacy.ZCDPAccountant(2.0, 8)
    assert math.isclose(a.rho, 1.0) and math.isclose(a.epsilon(math.exp(-1)), 3.0)
    with pytest.raises(ValueError):
        privacy.ZCDPAccountant(0.0)
    df = spark.range(4000).select("id", F.lit(3.0).alias("x"))
    noisy, _ = privacy.gaussian_release(df, ["x"], "id", 1.0, 0.5, b"sixteen bytes or more")
    other, _ = privacy.gaussian_release(df, ["x"], "id", 1.0, 0.5, b"another secret of bytes")
    assert noisy.join(other, ["id", "x"]).count() == 0
    with pytest.raises(ValueError, match="16 bytes"):
        privacy.gaussian_release(df, ["x"], "id", 1.0, 0.5, b"short")
    mean, std = noisy.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean - 1) < 0.1 and abs(std - 1) < 0.1 and sorted(noisy.collect()) == sorted(noisy.repartition(7).collect())
    with pytest.raises(privacy.UnavailableBackendError):
        privacy.cryptographic_backend("paillier")
    with pytest.raises(ValueError, match="16 bytes"):
        privacy.pair_masks("r", b"short")


def test_attacks_by_hand(spark):
    """Confidences 0.9, 0.8, 0.7 of training rows against 0.6, 0.65, 0.85: 7 of 9 pairs are in order, and from 0.7 on all
    training rows and one other are told."""
    p = lambda xs: spark.createDataFrame([(x,) for x in xs], "p double")
    r = privacy.membership_inference(p([0.9, 0.2, 0.7]), p([0.6, 0.35, 0.85])).first()
    assert math.isclose(r.roc_auc, 7 / 9) and math.isclose(r.advantage, 2 / 3)
    r = privacy.routing_exposure(spark.createDataFrame([(k,) for k in (10, 10, 12, 14, 14, 14, 18, 19)], "entity int"), 20).first()
    assert (r.events, r.unique_entities, r.exposed_fraction) == (8, 5, 0.25)


def test_nearest_donor_by_brute_force(spark):
    draw = np.random.default_rng(3)
    a, d = draw.normal(size=60).round(2), draw.normal(size=40).round(1)
    found = linkage.nearest(spark.createDataFrame([(k, float(v)) for k, v in enumerate(a)], "anchor_id long, score double"), spark.createDataFrame([(k, float(v)) for k, v in enumerate(d)], "donor_id long, score double"))
    for r in found.collect():
        assert math.isclose(abs(d[r.donor_id] - a[r.anchor_id]), np.abs(d - a[r.anchor_id]).min(), abs_tol=1e-12)
    assert found.count() == 60


def test_copula_link_keeps_order_at_full_correlation(spark):
    a, d = spark.range(100).select("id", F.col("id").cast("double").alias("x")), spark.range(40).select("id", (F.col("id") * 3.0).alias("x"))
    rows = linkage.copula_link(a, d, "id", ["x"], ["x"], 1.0, 0.0).orderBy("anchor_id").collect()
    donors = [r.donor_id for r in rows]
    assert donors == sorted(donors) and len(donors) == 100 and 0 <= min(donors) <= max(donors) < 40
    linked = linkage.copula_link(a, d, "id", ["x"], ["x"])
    assert sorted(linked.collect()) == sorted(linkage.copula_link(a.repartition(5), d, "id", ["x"], ["x"]).collect())
    with pytest.raises(relational.TargetLeakError):
        relational.require_target_blind(["age", " Default_Payment"], "default_payment")


def test_temporal_parties(spark):
    """Ten ratings each, listed from the last to the first: eight early ones with mean 2.5, half of them of a drama, and
    two late ones with mean 4.5 for every fifth user, 2.5 for the others."""
    ids = [2000 + 3 * k for k in range(110)]
    late = lambda k: (4, 5) if k % 5 == 0 else (1, 4)
    users = spark.createDataFrame([(u, "F" if k % 3 else "M", 18 + k % 40, k % 7, f"Z{k}") for k, u in enumerate(ids)], "UserID int, Gender string, Age int, Occupation int, ZipCode string")
    movies = spark.createDataFrame([(10, "Horror|Drama"), (11, "War"), (12, "Western")], "MovieID int, Genres string")
    rated = [(u, 10 + at % 2, 1 + at % 4 if at < 8 else late(k)[at - 8], 500 + 60 * at) for k, u in enumerate(ids) for at in reversed(range(10))]
    rows = fe.temporal_parties(users, spark.createDataFrame(rated, "UserID int, MovieID int, Rating int, Timestamp long"), movies).collect()
    assert {r.UserID for r in rows if r.target} == set(ids[::5]) and len(rows) == 110
    assert {(r.mean_rating, r.genre_drama_fraction) for r in rows} == {(2.5, 0.5)}
    with pytest.raises(relational.AlignmentError):
        fe.temporal_parties(users.limit(60), spark.createDataFrame(rated, "UserID int, MovieID int, Rating int, Timestamp long"), movies)


def test_ratings_are_dealt_by_user_and_distinct_movies_found_in_order(spark, monkeypatch):
    """Movie 10 is rated early, early and late, movie 11 early, movie 12 and no movie late and early."""
    monkeypatch.setattr(fe, "USER_ROWS", 100)
    users = spark.range(200).selectExpr("id AS UserID", "'F' AS Gender", "20 AS Age", "1 AS Occupation", "'12345' AS ZipCode")
    movies = spark.createDataFrame([(10, "Horror|Drama"), (11, "War")], "MovieID int, Genres string")
    seen = [(10, 2, 1), (None, 3, 2), (10, 4, 3), (11, 5, 4), (12, 4, 5), (10, 4, 5)]
    rated = spark.createDataFrame([(u, *x) for u in range(200) for x in seen], "UserID long, MovieID int, Rating int, Timestamp long")
    linked = fe.temporal_parties(users, rated, movies)
    assert {(r.rating_count, r.unique_movies, r.mean_rating, r.genre_drama_fraction, r.target) for r in linked.collect()} == {(4, 2, 3.5, 0.5, 1)}
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [UserID" in plan and "], 12" in plan  # 1,200 ratings
    assert not any("Aggregate" in line and "MovieID" in line for line in plan.splitlines())


def test_small_features(spark):
    bank = spark.createDataFrame([(7, 300.0, 180.0, 60.0, 0.0, 1, 3, 1200.0), (8, 50.0, 90.0, 5.0, 15.0, -1, 0, 500.0)], "id int, BILL_AMT1 double, BILL_AMT2 double, PAY_AMT1 double, PAY_AMT2 double, PAY_0 int, PAY_2 int, LIMIT_BAL double")
    rows = {r.id: (r.mean_bill_amount, r.credit_utilization_proxy, r.bill_trend, r.repayment_delay_count) for r in fe.bank_features(bank, "id").collect()}
    assert rows == {7: (240, 0.25, 120, 2), 8: (70, 0.1, -40, 0)}
    retail = spark.createDataFrame([("A1", "p", 3, "2019-03-05", 2.5, 9), ("A1", "q", 2, "2019-03-05", 4.0, 9), ("A9", "p", 50, "2019-12-01", 9.0, 9), ("B2", "r", 7, "one day", 1.0, 9)], "InvoiceNo string, StockCode string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID int")
    r = fe.retail_features(retail, F.lit("2019-06-30").cast("timestamp")).first()
    assert (r.total_spend, r.purchase_count, r.invoice_count, r.unique_products, r.active_days) == (15.5, 2, 1, 2, 1)
    assert fe.bank_features(bank.limit(0), "id").count() == 0


def test_preprocessor_guards(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 5.0, None)], "id int, x double, c string")
    p = LocalPreprocessor(["x"], ["c"]).fit(df)
    assert p.transform(df, "id").columns == ["id", "x", "c_a", "c_b"] and len(p.feature_metadata()) == 3
    with pytest.raises(relational.MissingColumnsError):
        p.transform(df.drop("x"))
    with pytest.raises(ValueError, match="winsor"):
        LocalPreprocessor(["x"], winsor=0.7)


def test_quantiles_by_counting(spark):
    x = np.random.default_rng(9).normal(size=997) ** 3
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    qs = [0.0, 0.013, 0.25, 0.5, 0.999, 1.0]
    assert np.allclose(ranking.counted_quantiles(df, "v", qs), np.quantile(x, qs), rtol=1e-12)
    assert ranking.counted_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_quantiles_in_brackets(spark, monkeypatch):
    x, y = np.random.default_rng(4).normal(size=1499) ** 5, np.random.default_rng(5).integers(0, 3, 1499).astype(float)  # outliers; ties
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)] + [(None, 1.0, None)], "x double, y double, z double")
    qs = [0.0, 0.25, 0.5, 0.77, 1.0]
    expected = {"x": np.quantile(x, qs), "y": np.quantile(np.append(y, 1.0), qs)}

    def same():
        found = ranking.bracketed_quantiles(df, ["x", "y", "z"], qs)
        assert found["z"] == [None] * len(qs)
        assert all(np.allclose(found[c], expected[c], rtol=1e-12) for c in expected)

    same()
    monkeypatch.setattr(ranking, "SKETCH", 20)  # sketches that miss: brackets are wrong or wide, the result is not
    same()
    monkeypatch.setattr(ranking, "BRACKET_ROWS", 10)  # brackets that are too full
    same()
    assert all(v == [None] for v in ranking.bracketed_quantiles(df.limit(0), ["x", "y"], [0.5]).values())
    monkeypatch.setattr(ranking, "QUANTILE_ROWS", 0)
    assert ranking.quantile_frame(df, "x", 0.5, "m").first().m == pytest.approx(np.quantile(x, 0.5), rel=1e-12)
    assert ranking.quantiles(df, ["y"], [0.5]) == {"y": [1.0]}


def test_metrics_of_identical_scores(spark):
    df = spark.createDataFrame([(k, k % 2, 0.5) for k in range(100)], "id int, y int, p double").withColumn("p2", F.col("p"))
    r = ev.binary_metrics(df).first()
    assert (r.roc_auc, r.pr_auc, r.ece) == (0.5, 0.5, 0.0)
    assert all((r.lower, r.upper) == (0, 0) for r in ev.paired_differences(df, "id", "p", "p2", 10).collect())
    t = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "y int, p double")
    assert 0.4 < ev.select_threshold(t, 11).first().threshold <= 0.6


def test_poisson_resamples(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    p, p2 = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), np.clip(rng.normal(0.4 + 0.1 * y, 0.2), 0, 1)
    rows = [(k, int(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(y, p, p2))]
    df = spark.createDataFrame([*rows, (600, None, 0.3, 0.3), (601, 1, None, None)], "id int, y int, p double, p2 double")
    limits = ev.poisson_limits()
    assert limits[:2] == [int(math.exp(-1) * 2**32), int(2 * math.exp(-1) * 2**32)] and limits == sorted(limits)

    def times(k: int, replicate: int) -> int:
        h = hashlib.sha256(f"42:{k}:{replicate // ev.BLOCK}".encode()).hexdigest()
        u = int(h[8 * (replicate % ev.BLOCK) :][:8], 16)
        return sum(u >= limit for limit in limits)

    found = {(r.score, r.replicate): r for r in ev.poisson_metrics(df, "id", ["p", "p2"], 11, bins=2**20).collect()}
    assert set(found) == {(c, k) for c in ("p", "p2") for k in range(11)}
    for c, x in (("p", p), ("p2", p2)):
        w = np.array([times(k, 9) for k in range(600)])
        up, down = np.repeat(x[y == 1], w[y == 1]), np.repeat(x[y == 0], w[y == 0])
        auc = np.mean((up[:, None] > down) + 0.5 * (up[:, None] == down))
        tp, fp = (up >= 0.5).sum(), (down >= 0.5).sum()
        r = found[c, 9]
        assert np.allclose([r.roc_auc, r.brier, r.f1], [auc, np.average((x - y) ** 2, weights=w), 2 * tp / (2 * tp + fp + (up < 0.5).sum())], atol=1e-5)
    slack = ev.binning_slack(df, 64).first().slack
    coarse, fine = (ev.poisson_metrics(df, "id", ["p"], 1, bins=b).first().roc_auc for b in (64, 2**20))
    assert 0 < slack < 0.02 and abs(coarse - fine) < 2 * slack
    a, b = ({r.metric: r for r in f(df.where("y IS NOT NULL AND p IS NOT NULL"), "id", 200).collect()} for f in (ev.bootstrap_intervals, ev.poisson_intervals))
    assert all(abs(a[m].lower - b[m].lower) < 0.02 and abs(a[m].upper - b[m].upper) < 0.02 and a[m].estimate == b[m].estimate for m in a)  # two ways to resample agree
    assert all((r.lower, r.upper) == (0, 0) for r in ev.poisson_differences(df.withColumn("p2", F.col("p")), "id", "p", "p2", 10).collect())
    assert [r.valid_replicates for r in ev.poisson_differences(df.limit(0), "id", "p", "p2", 10).collect()] == []


def test_synthetic_parties_learn(spark):
    df, names = synthetic.vertical_parties(spark, 600)
    assert sorted(df.collect()) == sorted(synthetic.vertical_parties(spark, 600)[0].repartition(9).collect())
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    options = logistic.LogisticOptions(0.5, 15)
    auc = lambda parties: ev.binary_metrics(logistic.score_logistic(test, logistic.fit_logistic(train, parties, options=options))).first().roc_auc
    assert auc(names) > auc({"bank": names["bank"]}) > 0.5


def test_catalogue_fails_closed(spark):
    with pytest.raises(registry.LicenceError, match="insurance_freq, insurance_sev"):
        registry.require_licences(registry.datasets(spark))
    registry.require_licences(registry.datasets(spark, "bank"))


def test_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(12.0).reshape(4, 3))
    assert [tuple(r) for r in files.read_matrix(spark, f"file://{tmp_path}/x.npy").orderBy("row").collect()][3] == (3, 9.0, 10.0, 11.0)
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "id int, x double")
    assert [r.x for r in files.nan_to_null(df).orderBy("id").collect()] == [None, None, 1.0]
    manifest = files.file_manifest(spark, f"file://{tmp_path}")
    assert {(r.name, r.present) for r in files.missing_files(manifest, ["x.npy", "y.npy"]).collect()} == {("x.npy", True), ("y.npy", False)}


def test_digests(spark):
    df = spark.createDataFrame([(k, f"id{k}") for k in range(50)], "o long, id string")
    assert row_digest(df).first() == row_digest(df.repartition(7)).first() != row_digest(df.where("o > 0")).first()
    other = df.withColumn("o", 49 - F.col("o"))
    assert relational.order_digest(df, "id", "o").first() == relational.order_digest(df.repartition(5), "id", "o").first() != relational.order_digest(other, "id", "o").first()
    outlier = df.union(spark.createDataFrame([(10**15, "far"), (None, "none")], "o long, id string"))
    assert relational.order_digest(outlier, "id", "o").first() != relational.order_digest(df, "id", "o").first() != relational.order_digest(df.limit(0), "id", "o").first()
    with pytest.raises(UnsafeLogFieldError):
        safe_log_fields({"rows": [1, 2]})


def test_streams(spark, tmp_path):
    rows = [("m1", "a", "2024-01-01 00:00:01", "forward", "p", 8), ("m1", "a", "2024-01-01 00:00:02", "forward", "p", 8), ("m2", "a", "2024-01-01 00:00:30", "backward", "p", 16)]
    spark.createDataFrame(rows, "message_id string, sender string, ts string, direction string, party string, bytes long").write.json(f"{tmp_path}/in")
    given = spark.readStream.schema("message_id string, sender string, ts string, direction string, party string, bytes long").json(f"{tmp_path}/in")
    for name, df, mode in (("once", stream.delivered_once(given), "append"), ("rate", stream.rate_limit(given, "sender", 2), "complete"), ("traffic", stream.traffic(given), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("once").count() == 2
    assert spark.table("rate").agg(F.max("requests")).first()[0] == 3 and spark.table("rate").where("NOT allowed").count() > 0
    assert {(r.direction, r.bytes) for r in spark.table("traffic").collect()} == {("forward", 16), ("backward", 16)}


def test_intervals_of_more_than_ten_thousand_group_sizes(spark):
    x = spark.range(10_100).select("id", F.explode(F.sequence(F.lit(1), F.col("id") + 2)).alias("v"))
    rows = privacy.interval_summary(x, ["id"], "v").where("n > 1 AND ci95_low < mean AND mean < ci95_high")
    assert rows.count() == 10_100


def test_quantile_buckets_spread_despite_an_outlier(spark):
    df = spark.range(4000).select(F.col("id").cast("double").alias("v")).unionAll(spark.createDataFrame([(1e15,)], "v double"))
    marked = df.withColumn("b", ranking.value_bucket(df, "v"))
    rows = marked.orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) > 1000
    assert {r["rank"] for r in ranking.average_rank(df, "v").collect()} == {k + 1.0 for k in range(4001)}


def test_psi_refuses_bad_ids(spark):
    good, twice, null = (spark.createDataFrame(x, "id string") for x in ([("a",), ("b",)], [("a",), ("a",)], [("a",), (None,)]))
    assert [[r.id for r in f.collect()] for f in relational.psi_align([good, good.where("id = 'b'")], "id", "s")] == [["b"], ["b"]]
    for bad in (twice, null):
        with pytest.raises(relational.AlignmentError, match="unique"):
            relational.psi_align([good, bad], "id", "s")
    relational.require_bound({"a": None, "b": None})
    for digests in ({"a": "x", "b": None}, {"a": "x", "b": "y"}):
        with pytest.raises(relational.AlignmentError):
            relational.require_bound(digests)


def test_run_bundles_tell_what_changed(spark, tmp_path):
    tables = {name: spark.createDataFrame([(1, 0.5)], "id int, x double") for name in runs.TABLES}
    documents = {"config": {"a": 1}, "dataset_provenance": {}, "linkage_manifest": {}, "metrics": {"roc_auc": 0.75}}
    folder = runs.write_run(spark, f"file://{tmp_path}", 1, documents, tables)
    assert runs.changed_files(spark, folder).count() == 0 and runs.read_run(spark, folder)[0]["environment"]["seed"] == 1
    assert [tuple(r) for r in runs.main_results(spark, {"r": folder}).collect()] == [("r", 0.75, None, None)]
    with pytest.raises(ValueError, match="documents"):
        runs.write_run(spark, f"file://{tmp_path}", 1, {}, tables)
    part = next((tmp_path / folder.rpartition("/")[2] / "metrics.json").glob("part-*"))
    part.write_text("{}")
    (part.parent / f".{part.name}.crc").unlink()
    assert [r.problem for r in runs.changed_files(spark, folder).collect()] == ["changed"]
    with pytest.raises(FileNotFoundError):
        runs.read_run(spark, f"file://{tmp_path}/no-run")


def test_unknown_parties_and_cutoffs(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown party"):
        parties.read_party(spark, "nobody", "x")
    rows = [("A", "p", 1, f"2020-01-{d:02d}", 2.0, 1) for d in range(1, 11)] + [("B", "p", 1, None, 2.0, 1)]
    spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID int").write.parquet(f"{tmp_path}/retail")
    found = parties.read_party(spark, "retail", f"{tmp_path}/retail", cutoff="2020-01-04")
    assert (found.rows.count(), found.facts["later"], found.facts["undated"]) == (4, 6, 1)
    assert parties.read_party(spark, "retail", f"{tmp_path}/retail", q=0.5).rows.count() == 5


def test_checkpoints_keep_thresholds_with_their_owner(spark):
    df, _, _ = learning(spark, 120)
    m = gbdt.fit_gbdt(df, PARTIES, options=gbdt.GBDTOptions(trees=2, depth=2, bins=4, min_leaf=5))
    text, routing = files.gbdt_checkpoint(m)
    assert "edges" not in text and set(routing) == {"active", "passive"}
    again = files.read_gbdt_checkpoint(text, routing)
    scored = lambda model: sorted((r.id, r.margin) for r in gbdt.score_gbdt(df, model).collect())
    assert scored(again) == scored(m)


def test_drift_study_and_overlap(spark):
    df, _, _ = learning(spark, 300)
    named = {"bank": ["a"], "telecom": ["b"], "insurance": ["c"], "retail": ["d", "e"]}
    options = logistic.LogisticOptions(0.5, 3)
    model = logistic.fit_logistic(df, named, options=options)
    rows = {r.scenario: r for r in studies.drift_study(df, model, named, "id").collect()}
    assert set(rows) == set(studies.DRIFT) and rows["baseline"].roc_auc_delta == 0
    assert rows["telecom_mean_shift"].roc_auc_delta == pytest.approx(0, abs=1e-9)  # a constant moves no rank
    drop = {r.party: r.roc_auc_drop for r in studies.permutation_contribution(df, model, named, "id").collect()}
    assert set(drop) == set(named) and max(drop.values()) > 0
    found = {(r.method, r.overlap): r.rows if "rows" in r else None for r in studies.overlap_study(df, PARTIES, "id", F.col("id") % 2 == 0, options, shares=(1.0, 0.5)).collect()}
    assert len(found) == 4
