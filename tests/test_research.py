"""Models side by side, attacks over grids, replay of trees, message logs."""

from __future__ import annotations

import hashlib
import hmac
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyframe.functions.scalar import hmac_sha256, normal_quantile
from partyframe.operators import gbdt as gb
from partyframe.operators import many_models as mm
from partyframe.operators import privacy as pv
from partyframe.operators import privacy_research as pr
from partyframe.operators import replay
from partyframe.operators import studies as sd
from partyframe.operators.evaluate import binary_metrics, binary_metrics_by, ranking_metrics, score_table, score_table_by
from partyframe.operators.logistic import LogisticOptions, fit_logistic, message_volume, score_logistic
from partyframe.sources import files

PARTIES = {"own": ["a", "b"], "other": ["c"], "third": ["d"]}
COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = (x @ [1.0, -0.5, 0.8, 0.3] + rng.normal(size=400) > 0).astype(int)
    rows = [(k, *map(float, x[k]), int(y[k])) for k in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").repartition(3).persist()


def test_normal_quantile_and_hmac(spark):
    ps = [1e-300, 1e-20, 0.001, 0.0749, 0.0751, 0.5, 0.9, 1 - 1e-12, 0.0, 1.0, None]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("q")).collect()
    for r in rows:
        assert r.q is None if r.p is None or not 0 < r.p < 1 else math.isclose(r.q, NormalDist().inv_cdf(r.p), rel_tol=1e-14)
    for secret in (b"0123456789abcdef", b"x" * 100):
        rows = spark.range(20).select("id", hmac_sha256(F.concat(F.lit("m:"), F.col("id").cast("string")), secret).alias("h"), pv.pair_masks("m", secret)(F.col("id")).alias("n")).collect()
        for r in rows:
            digest = hmac.new(secret, f"m:{r.id}".encode(), hashlib.sha256).digest()
            assert r.h == digest.hex() and r.n == int.from_bytes(digest, "big") % pv.PRIME


def test_many_logistic_models_are_the_single_ones(people):
    half = F.col("id") % 2 == 0
    options = [LogisticOptions(0.5, 5, 0.01), LogisticOptions(0.3, 3, 0.01, 0.002, 1, "inverse_sqrt", 0.2, "balanced"), LogisticOptions(0.5, 2, 0.1, residual_clip=0.3, class_weight={1: 2.0})]
    cells = [mm.Cell(flag, parties, o) for o in options for flag in ("half", "all") for parties in (PARTIES, {"own": ["a", "b"]})]
    frame = mm.many_frame(people, COLUMNS, {"half": half, "all": F.lit(True)})
    for cell, model in zip(cells, mm.fit_many_logistic(frame, cells), strict=True):
        single = fit_logistic(people.where(half) if cell.learn == "half" else people, cell.parties, options=cell.options)
        assert model.weights.keys() == single.weights.keys()
        assert all(math.isclose(model.weights[c], w, abs_tol=1e-12) for c, w in single.weights.items()) and math.isclose(model.intercept, single.intercept, abs_tol=1e-12)
    frame.close()


def test_noise_moves_passive_parties_only_and_repeats(people):
    frame = mm.many_frame(people, COLUMNS, {"all": F.lit(True)})
    fit = lambda noise: mm.fit_many_logistic(frame, [mm.Cell("all", PARTIES, LogisticOptions(0.5, 1, 0.0, noise=noise))])[0]
    plain, noisy, again = fit(0.0), fit(3.0), fit(3.0)
    assert noisy.weights == pytest.approx(again.weights, abs=1e-12)
    assert all(math.isclose(noisy.weights[c], plain.weights[c], abs_tol=1e-12) for c in ("a", "b"))
    assert all(abs(noisy.weights[c] - plain.weights[c]) > 1e-4 for c in ("c", "d"))
    drawn = mm.hashed_normal(np.arange(20_000, dtype=np.int64), "s")
    assert abs(drawn.mean()) < 0.03 and abs(drawn.std() - 1) < 0.03


def test_many_boosted_models_are_the_single_ones(spark, people):
    gaps = people.withColumn("d", F.when(F.col("id") % 7 == 3, None).otherwise(F.col("d")))
    options = [gb.GBDTOptions(trees=3, depth=2, bins=8, min_leaf=5), gb.GBDTOptions(trees=2, depth=3, bins=5, min_leaf=20, reg_lambda=3.0, max_leaves=4)]
    frame = mm.many_frame(gaps, COLUMNS, {"even": F.col("id") % 2 == 0, "all": F.lit(True)}, complete=False)
    cells = [mm.Cell(flag, PARTIES, o) for flag in ("even", "all") for o in options]
    edges = {(frame.pattern(c.learn), c.options.bins): gb.fit_bins(gaps.where("id % 2 = 0") if c.learn == "even" else gaps, COLUMNS, c.options.bins) for c in cells}
    shape = lambda tree: {k: (n.feature, n.bin, n.n, n.party) for k, n in tree.items()}
    models = mm.fit_many_gbdt(frame, cells, edges)
    for cell, model in zip(cells, models, strict=True):
        single = gb.fit_gbdt(gaps.where("id % 2 = 0") if cell.learn == "even" else gaps, PARTIES, options=cell.options)
        assert [shape(t) for t in model.trees] == [shape(t) for t in single.trees]
    found = {r.id: r.p for r in mm.score_many(frame, models).collect()}
    for k, model in enumerate(models):
        assert all(math.isclose(found[r.id][k], r.p, abs_tol=1e-12) for r in gb.score_gbdt(gaps, model).select("id", "p").collect())
    frame.close()


def test_what_cells_refuse(people):
    for options in (LogisticOptions(batches=2), LogisticOptions(patience=3), LogisticOptions(tolerance=0.1), gb.GBDTOptions(row_fraction=0.5)):
        with pytest.raises(ValueError, match="side by side"):
            mm.Cell("all", PARTIES, options)
    with pytest.raises(ValueError, match="missing features"):
        mm.many_frame(people.withColumn("c", F.when(F.col("id") > 3, F.col("c"))), COLUMNS, {"all": F.lit(True)})
    frame = mm.many_frame(people, COLUMNS, {"none": F.lit(False)})
    with pytest.raises(ValueError, match="no rows"):
        mm.fit_many_gbdt(frame, [mm.Cell("none", PARTIES, gb.GBDTOptions(trees=1))])


@pytest.mark.parametrize("scores", ["id % 97 / 97.0", "0.5", "CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0.2 + id * 1e-9 END"])
def test_score_tables_of_groups(spark, scores):
    rows = spark.range(2000).selectExpr("id % 2 AS g", "cast((id * 7919 % 13) < 5 AS int) AS y", f"cast({scores} AS double) AS p")
    many = {(r.g, r.p): r for r in score_table_by(rows, ["g"]).collect()}
    metrics, aucs = {r.g: r for r in binary_metrics_by(rows, ["g"]).collect()}, {r.g: r for r in ranking_metrics(score_table_by(rows, ["g"]), "g").collect()}
    for g in (0, 1):
        own = rows.where(F.col("g") == g)
        for r in score_table(own).collect():
            assert (r.pos, r.neg, r.tp, r.fp) == tuple(many[g, r.p][c] for c in ("pos", "neg", "tp", "fp"))
        single = binary_metrics(own).first().asDict()
        assert all(math.isclose(metrics[g][c], v, abs_tol=1e-12) for c, v in single.items())
        assert math.isclose(aucs[g].roc_auc, single["roc_auc"])


@pytest.mark.parametrize("range_rows", [500_000, 40])
def test_curves_of_many_models_are_exact(spark, people, monkeypatch, range_rows):
    monkeypatch.setattr(mm, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(mm, "SORTED_SCORES", 1200)
    monkeypatch.setattr(mm, "ROWS", 70)
    frame = mm.many_frame(people, COLUMNS, {"even": F.col("id") % 2 == 0, "rest": F.col("id") % 4 == 1, "ones": F.col("y") == 1, "none": F.lit(False)})
    cells = [mm.Cell("even", PARTIES, LogisticOptions(0.5, 3)), mm.Cell("even", PARTIES, gb.GBDTOptions(2, 2, 0.1, 1.0, 8, 10)), mm.Cell("even", PARTIES, LogisticOptions(0.5, 0))]
    models = [*mm.fit_many_logistic(frame, cells[:1]), *mm.fit_many_gbdt(frame, cells[1:2]), *mm.fit_many_logistic(frame, cells[2:])]  # the last: one score for all
    curves = [c for k in range(3) for c in (mm.Curve(k, ("even", "rest"), "even", True), mm.Curve(k, ("even",)), mm.Curve(k, ("ones",)), mm.Curve(k, ("none",)))]
    if range_rows == 40:
        assert any(len(e) > 3 for e in mm.curve_edges(frame, models, curves))
    found = {r.curve: r for r in mm.curve_metrics(frame, models, curves).collect()}
    scored = mm.score_many(frame, models).collect()
    for at, c in enumerate(curves):
        rows = [(r.p[c.cell], int(r.y == 1 if c.label is None else r.flags[frame.pattern(c.label)])) for r in scored if any(r.flags[frame.pattern(x)] for x in c.rows)]
        if not rows:
            assert at not in found
            continue
        s, y = np.array(rows).T
        s = np.abs(s - 0.5) * 2.0 if c.sure else s
        ones, zeros = y.sum(), (1 - y).sum()
        if not zeros:
            assert found[at].roc_auc is None and found[at].pr_auc is None and found[at].gap is None
            continue
        curve = [((y * (s == v)).sum(), ((1 - y) * (s == v)).sum(), (y * (s >= v)).sum(), ((1 - y) * (s >= v)).sum()) for v in np.unique(s)]
        assert math.isclose(found[at].roc_auc, sum(neg * (tp - pos / 2) for pos, neg, tp, _ in curve) / (ones * zeros), abs_tol=1e-12)
        assert math.isclose(found[at].pr_auc, sum(pos * tp / (tp + fp) for pos, _, tp, fp in curve) / ones, abs_tol=1e-12)
        assert found[at].gap == max(tp / ones - fp / zeros for *_, tp, fp in curve)
    frame.close()


def test_rows_of_a_frame_are_dealt_to_tasks_and_scores_leave_them_counted(spark, monkeypatch):
    monkeypatch.setattr(mm, "TASK_ROWS", 5000)
    rows = spark.range(30_000).coalesce(1).selectExpr("id", "id % 7 / 7.0D AS a", "id % 5 / 5.0D AS b", "id % 3 / 3.0D AS c", "id % 2 / 2.0D AS d", "cast(id % 11 < 5 AS int) AS y")
    frame = mm.many_frame(rows, COLUMNS, {"all": F.lit(True)})
    held = [r["count"] for r in frame.rows.groupBy(F.spark_partition_id()).count().collect()]
    assert frame.size == sum(held) == 30_000 and len(held) == 6 and max(held) < 6000
    models = mm.fit_many_gbdt(frame, [mm.Cell("all", PARTIES, gb.GBDTOptions(2, 2, bins=8, min_leaf=5))])
    sent = mm.curve_runs(frame, models, [mm.Curve(0, ("all",))]).collect()
    assert sum(r["rows"] for r in sent) == sum(sum(r.n) for r in sent) == 30_000 and max(len(r.p) for r in sent) <= 16
    frame.close()


def jobs_of(spark, group: str, action) -> int:
    spark.sparkContext.setJobGroup(group, group)
    action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_grid_has_every_axis_and_jobs_do_not_grow_with_cells(spark, people):
    small = pr.Grid(sizes=(1.0,), party_counts=(2,), logistic_rounds=(2,), tree_rounds=(1,), regularization=(0.1,), noise=(0.0,))
    large = pr.Grid(sizes=(0.5, 1.0), party_counts=(2, 3), logistic_rounds=(1, 2), tree_rounds=(1,), regularization=(0.1, 1.0, 10.0), noise=(0.0, 0.5), seeds=(1, 2, 3))
    one = jobs_of(spark, "small grid", lambda: pr.privacy_research(people, PARTIES, small).collect())
    found = []
    two = jobs_of(spark, "large grid", lambda: found.extend(pr.privacy_research(people, PARTIES, large).collect()))
    assert two <= one + 3
    axes = {(r.experiment, r.model) for r in found}
    assert {e for e, _ in axes} == {"attack_vs_dataset_size", "attack_vs_party_count", "attack_vs_training_rounds", "attack_vs_regularization", "logistic_vs_gbdt", "mitigation_utility_tradeoff"}
    assert len(axes) == 12 and all(r.n == 3 for r in found) and {r.measure for r in found} == set(pr.MEASURES)
    assert all(r.ci95_low <= r.mean <= r.ci95_high for r in found)
    noisy = {r.strength: r.mean for r in found if r.condition == "passive_residual_gaussian_noise" and r.measure == "label_inference_accuracy"}
    assert noisy[0.0] == 1.0 and noisy[0.5] < 0.95  # the sign of a plain residual is the label
    with pytest.raises(ValueError, match="two seeds"):
        pr.Grid(seeds=(1, 1))


def test_a_grid_cell_is_what_the_single_measures_say(spark, people):
    grid = pr.Grid(sizes=(0.8,), party_counts=(3,), logistic_rounds=(3,), tree_rounds=(2,), seeds=(5, 6))
    frame = pr.grid_frame(people, COLUMNS, grid, "y", "id")
    learn, hold = pr.flags_of(0.8, 5)
    cells = [mm.Cell(learn, PARTIES, LogisticOptions(0.5, 3)), mm.Cell(learn, PARTIES, gb.GBDTOptions(2, 2, 0.1, 1.0, 8, 10))]
    models = [*mm.fit_many_logistic(frame, cells[:1]), *mm.fit_many_gbdt(frame, cells[1:])]
    found = {(r.cell, r.measure): r.value for r in pr.attack_measures(frame, cells, models, [hold] * 2, [0.0] * 2, [5] * 2).collect()}
    side = lambda k: people.join(frame.rows.where(F.col("flags")[k]).select("id"), "id")
    train, holdout = side(0), side(1)
    assert 0 < train.count() and train.count() + holdout.count() < 400
    for k, scored in enumerate(([score_logistic(d, models[0]) for d in (train, holdout)], [gb.score_gbdt(d, models[1]) for d in (train, holdout)])):
        member = pv.membership_inference(*scored).first()
        assert math.isclose(found[k, "membership_roc_auc"], member.roc_auc, abs_tol=1e-12) and math.isclose(found[k, "membership_advantage"], member.advantage, abs_tol=1e-12)
        assert math.isclose(found[k, "holdout_roc_auc"], binary_metrics(scored[1]).first().roc_auc, abs_tol=1e-12)
    events = replay.routing_events(train, *files.gbdt_checkpoint(models[1])).where("party <> 'own'")
    exposed = pv.routing_exposure(events, train.count()).first()
    assert math.isclose(found[1, "routing_exposure_fraction"], exposed.exposed_fraction) and math.isclose(found[1, "routing_events_per_entity"], exposed.events / train.count())
    assert (0, "routing_exposure_fraction") not in found and (1, "label_inference_accuracy") not in found


def test_reconstruction_equals_a_numpy_solve(spark, people):
    messages = people.withColumns({"m1": F.col("a") + 0.5 * F.col("c"), "m2": F.col("b") - F.col("d"), "m3": F.col("a") * F.col("b") + 1e4, "k": F.lit(3.0)})
    cal, ev = messages.where("id % 2 = 0"), messages.where("id % 2 = 1")
    get = lambda df, names: np.array([[r[c] for c in names] for r in df.orderBy("id").collect()])
    m, f = ["m1", "m2", "m3"], ["a", "c", "d", "k"]
    for alpha in (0.0, 1e-3, 5.0):
        x, t, x2, t2 = get(cal, m), get(cal, f), get(ev, m), get(ev, f)
        xc, tc = x - x.mean(0), t - t.mean(0)
        slopes = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ tc)
        guess = t.mean(0) + (x2 - x.mean(0)) @ slopes
        found = {r.feature: r for r in pv.reconstruct_features(cal, ev, m, f, alpha).collect()}
        for k, name in enumerate(f[:3]):
            r2 = 1 - ((t2[:, k] - guess[:, k]) ** 2).sum() / ((t2[:, k] - t2[:, k].mean()) ** 2).sum()
            assert math.isclose(found[name].r2, r2, abs_tol=1e-9) and math.isclose(found[name].mae, np.abs(t2[:, k] - guess[:, k]).mean(), abs_tol=1e-9)
        assert found["k"].r2 == 1.0 and found["k"].mae == 0.0
    total = pv.reconstruction_summary(cal, ev, m, f[:3]).first()
    assert (total.exposed_dimensions, total.reconstructed_features, total.calibration_count, total.evaluation_count) == (3, 3, 200, 200) and total.max_r2 >= total.mean_r2
    twice = pv.reconstruct_features(cal.withColumn("m4", F.col("m1")), ev.withColumn("m4", F.col("m1")), ["m1", "m4"], ["a"], 0.0).first()
    assert math.isclose(twice.r2, pv.reconstruct_features(cal, ev, ["m1"], ["a"], 0.0).first().r2, abs_tol=1e-9)  # a singular system


@pytest.mark.parametrize("spoil", ["alpha", "rows", "nan", "names"])
def test_reconstruction_refuses(people, spoil):
    cal = people.withColumn("a", F.when(F.col("id") == 0, float("nan")).otherwise(F.col("a"))) if spoil == "nan" else people.limit(1) if spoil == "rows" else people
    with pytest.raises(ValueError, match={"alpha": "negative", "rows": "two rows", "nan": "not finite: a", "names": "apart"}[spoil]):
        pv.reconstruct_features(cal, people, ["a"], ["a" if spoil == "names" else "c"], -1.0 if spoil == "alpha" else 1e-3)


def random_forest_model(trees: int, depth: int) -> gb.GBDTModel:
    rng = np.random.default_rng(trees)
    owner = {c: p for p, cs in PARTIES.items() for c in cs}
    edges = {c: sorted(rng.normal(size=7).tolist()) for c in COLUMNS}

    def tree():
        out = {}
        for k in range(1, 2**depth):
            if k == 1 or (k >> 1 in out and out[k >> 1].feature):
                c = COLUMNS[rng.integers(4)] if rng.random() < 0.9 else None
                out[k] = gb.Node(float(rng.normal()), 5.0, 10, owner.get(c), c, int(rng.integers(7)) if c else None, 1.0 if c else None)
        for k in list(out):
            for child in (2 * k, 2 * k + 1):
                if out[k].feature and child not in out:
                    out[child] = gb.Node(float(rng.normal()), 5.0, 5)
        return out

    return gb.GBDTModel(PARTIES, edges, 0.3, gb.GBDTOptions(trees=trees, depth=depth), [tree() for _ in range(trees)])


def test_replay_of_hundreds_of_trees(spark, people):
    gaps = people.withColumn("c", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("c")))
    few, many = random_forest_model(7, 3), random_forest_model(500, 4)
    text, routing = files.gbdt_checkpoint(few)
    got = {r.id: (r.margin, r.p) for r in replay.replay_scores(gaps, text, routing).collect()}
    for r in gb.score_gbdt(gaps, few).collect():
        assert math.isclose(got[r.id][0], r.margin, abs_tol=1e-12) and math.isclose(got[r.id][1], r.p, abs_tol=1e-12)
    rows = {r.id: [r[c] for c in COLUMNS] for r in gaps.collect()}
    text, routing = files.gbdt_checkpoint(many)
    scored = replay.replay_scores(gaps, text, routing)
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 40_000  # the plan does not hold the trees
    for r in scored.collect():
        margin = many.base
        for tree in many.trees:
            k = 1
            while tree[k].feature:
                v = rows[r.id][COLUMNS.index(tree[k].feature)]
                k = 2 * k + (0 if v is not None and v <= many.edges[tree[k].feature][tree[k].bin] else 1)
            margin += many.options.learning_rate * many.leaf(tree[k])
        assert math.isclose(r.margin, margin, abs_tol=1e-9)


def test_replay_without_a_party(people):
    model = random_forest_model(9, 3)
    text, routing = files.gbdt_checkpoint(model)
    with pytest.raises(replay.MissingRoutingError, match="other"):
        replay.replay_scores(people, text, {k: v for k, v in routing.items() if k != "other"})
    with pytest.raises(replay.MissingRoutingError):
        replay.replay_scores(people, text, {k: v for k, v in routing.items() if k != "own"}, missing_party="zero_contribution")
    got = {r.id: r.margin for r in replay.replay_scores(people.drop("c"), text, {k: v for k, v in routing.items() if k != "other"}, missing_party="zero_contribution").collect()}
    want = gb.score_gbdt(people.drop("c"), model, "zero_contribution").collect()
    assert all(math.isclose(got[r.id], r.margin, abs_tol=1e-12) for r in want)
    empty = gb.GBDTModel(PARTIES, model.edges, 0.7, gb.GBDTOptions(trees=1), [])
    assert {r.margin for r in replay.replay_scores(people, *files.gbdt_checkpoint(empty)).collect()} == {0.7}


@pytest.mark.parametrize(("epochs", "batches", "held", "stopped"), [(3, 1, 0, False), (4, 3, 17, True), (0, 1, 0, False), (1, 2, 5, False)])
def test_message_log_totals(spark, epochs, batches, held, stopped):
    log = replay.communication_frame(spark, 101, ["b", "c"], epochs, batches, held, stopped)
    total = log.agg(F.count("seq").alias("messages"), F.sum("scalars").alias("scalars"), F.sum("bytes").alias("bytes"), F.count_distinct("seq").alias("distinct")).first()
    want = message_volume(101, 2, epochs, batches, held, stopped)
    assert {k: total[k] for k in want} == want and total["distinct"] == total["messages"]
    back = log.where("direction = 'backward'").agg(F.count("seq").alias("n"), F.sum("scalars").alias("s")).first()
    assert back.n == 2 * epochs * batches and (back.s or 0) == 2 * epochs * 101


def test_missing_party_study_is_the_methods_one_by_one(people):
    marked = people.withColumns({"has_other": F.col("id") % 3 != 0, "has_third": F.when(F.col("id") % 10 != 0, True)})
    has, options = {"other": "has_other", "third": "has_third"}, LogisticOptions(0.5, 3, 0.01)
    found = {r["method"]: r for r in sd.missing_party_study(marked, PARTIES, "id", F.col("id") % 2 == 0, options, {"one": has}).collect()}
    assert set(found) == set(sd.METHODS)
    for method, row in found.items():
        kept, columns = sd.prepare_missing(marked, PARTIES, has, method)
        train, test = kept.where("id % 2 = 0"), kept.where("id % 2 = 1")
        single = binary_metrics(score_logistic(test, fit_logistic(train, columns, options=options))).first().asDict()
        assert (row.train_rows, row.test_rows) == (train.count(), test.count())
        assert all(math.isclose(row[c], v, abs_tol=1e-9) for c, v in single.items()), method
    with pytest.raises(ValueError, match="unknown"):
        sd.missing_party_study(marked, PARTIES, "id", F.col("id") % 2 == 0, options, {"one": has}, ("guess",))


def test_contributions_add_up(people):
    train, test, options = people.where("id % 2 = 0"), people.where("id % 2 = 1"), LogisticOptions(0.5, 3)
    scores = {r.subset: r.roc_auc for r in sd.party_subset_scores(train, test, PARTIES, options).collect()}
    shares = {r.party: r.shapley for r in sd.contribution_study(train, test, PARTIES, options).collect()}
    assert set(shares) == {"other", "third"} and math.isclose(sum(shares.values()), scores["own+other+third"] - scores["own"], abs_tol=1e-12)
    single = binary_metrics(score_logistic(test, fit_logistic(train, {"own": ["a", "b"], "third": ["d"]}, options=options))).first().roc_auc
    assert math.isclose(scores["own+third"], single, abs_tol=1e-12)
    dropped = {(r.scenario, r.phase): r.roc_auc for r in sd.dropout_study(train, test, PARTIES, options, {"none": (), "gone": ("other",)}).collect()}
    assert math.isclose(dropped["gone", "retrained"], single, abs_tol=1e-12) and math.isclose(dropped["none", "inference"], dropped["none", "retrained"])
    whole = fit_logistic(train, PARTIES, options=options)
    assert math.isclose(dropped["gone", "inference"], binary_metrics(score_logistic(test.drop("c"), whole, "zero_contribution")).first().roc_auc, abs_tol=1e-12)


def test_pooled_subsets_read_their_rows_once(spark):
    from partyframe.operators.studies import pooled_subsets

    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def met(x):
        read.add(1)
        return x

    rows = spark.range(120).select("id", met((F.col("id") % 7).cast("double")).alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    found = pooled_subsets(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), {"one": ["a"], "two": ["b"]}, "id", iterations=2).collect()
    assert {(r["subset"], r["model"]) for r in found} == {(s, m) for s in ("one", "one+two") for m in ("logistic", "boosting")}
    assert all(r.roc_auc == 1.0 for r in found if r["model"] == "boosting") and read.value == 120


def test_pooled_models_train_to_their_end(spark, small, monkeypatch):
    from pyspark.ml.base import Estimator

    from partyframe.plans import QUERIES

    models, given, one = [], Estimator.fit, sd.pooled_model
    monkeypatch.setattr(sd, "pooled_model", lambda *args: models.append(one(*args)) or models[-1])
    rows = spark.range(640).select("id", (F.col("id") % 64).cast("double").alias("a"), (F.crc32((F.col("id") % 64).cast("string")) % 2).cast("int").alias("y"))
    found = {r.model: r for r in sd.pooled_subsets(rows.where("id < 320"), rows.where("id >= 320"), {"one": ["a"]}, "id").collect()}
    assert found["boosting"].roc_auc == 1.0 and found["boosting"].log_loss < 0.1
    logistic, boosting = (model for _, model in models)
    assert boosting.getNumTrees == 100 and logistic.summary.totalIterations < logistic.getMaxIter() == 1000

    asked = []
    monkeypatch.setattr(Estimator, "fit", lambda kind, df: asked.append((type(kind).__name__, kind.getMaxIter())) or given(kind, df, {kind.maxIter: 1}))
    assert QUERIES["T7_pooled_subsets"](spark, small).count() == 8 and QUERIES["T7_pooled_baseline"](spark, small).count() > 0
    assert sorted(asked) == [("GBTClassifier", 100)] * 4 + [("LogisticRegression", 1000)] * 5
