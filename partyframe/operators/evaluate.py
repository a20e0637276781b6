"""Splits, metrics, curves and resampled intervals of scored rows (y in 0/1, p in [0, 1]).

Metrics that need an order work on distinct scores: rows are counted per score first, and running counts are made by
buckets (operators.ranking), so no task sees all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.scalar import clipped, hash_order
from partyframe.functions.session import checkpointed
from partyframe.operators.ranking import hash_rank, running, value_bucket

EPSILON = 2.0**-52
#: Ranges that the scores of a group fall into.
RANGES = 64


def stratified_split(df: DataFrame, key: str, y: str, train: float = 0.70, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """df with `split`: each class is ranked by a hash of seed and key; the first 70 % train, the next 15 % validate."""
    parts = []
    for label in (0, 1):
        rows = df.where(F.col(y) == label)
        n = rows.count()
        ranked = hash_rank(rows, hash_order(key, seed=seed), "_rank")
        name = F.when(F.col("_rank") <= int(train * n), "train").when(F.col("_rank") <= int((train + validation) * n), "validation").otherwise("test")
        parts.append(ranked.withColumn("split", name).drop("_rank"))
    return parts[0].unionByName(parts[1])


def score_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, pos, neg, tp, fp) for every distinct score: rows with it, and rows with it or a greater one."""
    counts = checkpointed(df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))
    return running(counts, "p", {"tp": F.col("pos"), "fp": F.col("neg")}, value_bucket(counts, "p"), descending=True)


def ranking_metrics(table: DataFrame, *by: str) -> DataFrame:
    """One row (for each group) with roc_auc, pr_auc and ks from a score table; AUCs are NULL for a single class."""
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    sums = table.groupBy(*by).agg(
        F.sum("pos").cast("double").alias("_p"),
        F.sum("neg").cast("double").alias("_n"),
        F.sum(neg * (tp - pos / 2)).alias("_u"),
        F.sum(pos * F.try_divide(tp, tp + fp)).alias("_ap"),
    )
    return sums.select(*by, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"), F.when(F.col("_n") > 0, F.try_divide(F.col("_ap"), F.col("_p"))).alias("pr_auc"))


def threshold_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {
        "precision": over(tp, tp + fp),
        "recall": over(tp, tp + fn),
        "f1": over(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (over(tp, tp + fn) + over(tn, tn + fp)) / 2,
    }


def confusion(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """One row: tp, fp, fn, tn where p >= threshold predicts 1."""
    hit, one = F.col(p) >= threshold, F.col(y) == 1
    return df.agg(*(F.count_if(c).alias(n) for n, c in (("tp", hit & one), ("fp", hit & ~one), ("fn", ~hit & one), ("tn", ~hit & ~one))))


def linspace(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced numbers, as numpy makes them."""
    step = (high - low) / (n - 1)
    return [*(low + k * step for k in range(n - 1)), high]


def bin_of(p: Column, bins: int) -> Column:
    """Which of `bins` equal bins [low, high) of [0, 1] a probability is in; the last one is closed."""
    edges = F.array(*(F.lit(e) for e in linspace(0.0, 1.0, bins + 1)[1:-1]))
    return F.size(F.filter(edges, lambda e: e <= p))


def calibration_curve(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(bin, n, mean_p, share) of the bins that have rows."""
    return df.groupBy(bin_of(F.col(p), bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def calibration_error(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    n = F.col("n").cast("double")
    return calibration_curve(df, bins, y, p).agg((F.sum(n * F.abs(F.col("share") - F.col("mean_p"))) / F.sum(n)).alias("ece"))


def proper_scores(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: log_loss (p clipped to the machine epsilon) and brier."""
    q, one = clipped(F.col(p), EPSILON, 1 - EPSILON), F.col(y).cast("double")
    loss = -(one * F.log(q) + (1 - one) * F.log(1 - q))
    return df.agg(F.avg(loss).alias("log_loss"), F.avg((F.col(p) - one) * (F.col(p) - one)).alias("brier"))


def binary_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """One row with the nine metrics."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    at = confusion(df, threshold, y, p).select(*(c.alias(n) for n, c in threshold_metrics(tp, fp, fn, tn).items()))
    return ranking_metrics(score_table(df, y, p)).crossJoin(at).crossJoin(proper_scores(df, y, p)).crossJoin(calibration_error(df, 10, y, p))


def score_table_by(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """score_table() within each group of `by`, for many groups at once. A group's distinct scores fall into ranges between its
    own quantiles, so neither a group nor a crowd of like scores is one task's; the counts are written, as they are read twice."""
    counts = checkpointed(df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")))
    edges = counts.groupBy(*by).agg(F.percentile_approx("p", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), F.lit(10 * RANGES)).alias("_edges"))
    placed = counts.join(edges, by).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("p")))).drop("_edges")
    totals = placed.groupBy(*by, "_range").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    above = W.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)  # RANGES rows of a group at most
    offsets = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in ("pos", "neg")))
    inside = W.partitionBy(*by, "_range").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    joined = placed.join(offsets, [*by, "_range"])
    return joined.select(*by, "p", "pos", "neg", (F.col("_pos") + F.sum("pos").over(inside)).alias("tp"), (F.col("_neg") + F.sum("neg").over(inside)).alias("fp"))


def binary_metrics_by(df: DataFrame, by: list[str], threshold: float = 0.5, bins: int = 10, y: str = "y", p: str = "p", ranked: DataFrame | None = None) -> DataFrame:
    """The nine metrics of binary_metrics() for each group of `by`, in one plan whatever the number of groups; the AUCs are those
    of `ranked` (by..., roc_auc, pr_auc) where they are known."""
    hit, one, q = F.col(p) >= threshold, F.col(y) == 1, clipped(F.col(p), EPSILON, 1 - EPSILON)
    label = F.col(y).cast("double")
    loss = -(label * F.log(q) + (1 - label) * F.log(1 - q))
    counts = df.groupBy(*by).agg(
        *(F.count_if(c).cast("double").alias(n) for n, c in (("tp", hit & one), ("fp", hit & ~one), ("fn", ~hit & one), ("tn", ~hit & ~one))),
        F.avg(loss).alias("log_loss"), F.avg((F.col(p) - label) * (F.col(p) - label)).alias("brier"),
    )
    at = counts.select(*by, *(c.alias(n) for n, c in threshold_metrics(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()), "log_loss", "brier")
    curve = df.groupBy(*by, bin_of(F.col(p), bins).alias("_bin")).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(p).alias("_mean"), F.avg(label).alias("_share"))
    ece = curve.groupBy(*by).agg((F.sum(F.col("_n") * F.abs(F.col("_share") - F.col("_mean"))) / F.sum("_n")).alias("ece"))
    aucs = ranking_metrics(score_table_by(df, by, y, p), *by) if ranked is None else ranked
    return aucs.join(at, by).join(ece, by)


def select_threshold(df: DataFrame, grid: int = 201, y: str = "y", p: str = "p") -> DataFrame:
    """One row (threshold, f1): the first of the evenly spaced thresholds with the largest F1. Rows are counted by the
    last threshold that they reach, so the grid is not joined with them."""
    points = linspace(0.0, 1.0, grid)
    reached = F.floor(F.col(p) * (grid - 1)).cast("int") + 1  # right up to rounding, which the two comparisons settle
    at = lambda k: F.element_at(F.array(*map(F.lit, points)), F.greatest(F.lit(1), F.least(F.lit(grid), k)))
    exact = F.when(F.col(p) < at(reached), reached - 1).when((reached < grid) & (F.col(p) >= at(reached + 1)), reached + 1).otherwise(reached)
    counts = df.where(F.col(p).isNotNull()).groupBy(exact.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    every = df.sparkSession.createDataFrame(list(enumerate(points, 1)), "k int, threshold double")
    upward = W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)  # over `grid` rows
    sums = every.join(counts, "k", "left").select("threshold", F.sum(F.coalesce("pos", F.lit(0))).over(upward).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(upward).alias("fp"))
    total = counts.agg(F.sum("pos").alias("total"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("total")), F.lit(0.0))
    return sums.crossJoin(F.broadcast(total)).select("threshold", f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def curve_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, tpr, fpr, precision, recall) at every distinct score: the ROC and the precision-recall curve."""
    table = score_table(df, y, p)
    total = df.agg(F.count_if(F.col(y) == 1).alias("_ones"), F.count_if(F.col(y) == 0).alias("_zeros"))
    tp, fp = F.col("tp"), F.col("fp")
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return table.crossJoin(F.broadcast(total)).select(F.col("p").alias("threshold"), rate(tp, F.col("_ones")).alias("tpr"), rate(fp, F.col("_zeros")).alias("fpr"), rate(tp, tp + fp).alias("precision"), rate(tp, F.col("_ones")).alias("recall"))


# ---- resampling


def resamples(df: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """df's rows, drawn n at a time with replacement for each replicate: draw j of replicate k takes the row whose rank
    (by a hash of the key) is a hash of (k, j) scaled to n. One row per drawn row and replicate, with how often `times`."""
    ranked = hash_rank(df, hash_order(key, seed=seed), "_rank")
    n = df.count()
    draws = df.sparkSession.range(0, n * replicates).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("replicate"), (F.col("id") % max(n, 1)).alias("j"))
    picked = draws.select("replicate", (hash_order("replicate", "j", seed=seed) % n + 1).alias("_rank")).groupBy("replicate", "_rank").agg(F.count(F.lit(1)).alias("times"))
    return picked.join(ranked, "_rank").drop("_rank")


def resampled_metrics(drawn: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """(replicate, roc_auc, pr_auc, brier, f1) from resamples()."""
    times, one, hit = F.col("times"), F.col(y) == 1, F.col(p) >= threshold
    count = lambda c: F.sum(F.when(c, times).otherwise(0))
    counts = drawn.groupBy("replicate", F.col(p).alias("p")).agg(count(one).alias("pos"), count(~one).alias("neg"))
    upward = W.partitionBy("replicate").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    ranked = ranking_metrics(counts.withColumns({"tp": F.sum("pos").over(upward), "fp": F.sum("neg").over(upward)}), "replicate")
    tp, fp, fn = (count(c).cast("double") for c in (hit & one, hit & ~one, ~hit & one))
    error = F.col(p) - F.col(y).cast("double")
    other = drawn.groupBy("replicate").agg((F.sum(times * error * error) / F.sum(times)).alias("brier"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
    return ranked.join(other, "replicate")


def intervals(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, lower, upper, valid_replicates): the 2.5 and 97.5 % points over replicates, NULLs left out."""
    long = metrics.unpivot("replicate", names, "metric", "value")
    return long.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"), F.count("value").alias("valid_replicates"))


def bootstrap_intervals(df: DataFrame, key: str, replicates: int = 1000, threshold: float = 0.5, seed: int = 42, y: str = "y", p: str = "p") -> DataFrame:
    """(metric, estimate, lower, upper, valid_replicates) for roc_auc, pr_auc, brier and f1."""
    names = ["roc_auc", "pr_auc", "brier", "f1"]
    whole = binary_metrics(df, threshold, y, p).select(F.lit(0).alias("replicate"), *names).unpivot("replicate", names, "metric", "estimate").select("metric", "estimate")
    return intervals(resampled_metrics(resamples(df.select(key, y, p), key, replicates, seed), threshold, y, p), names).join(whole, "metric")


def paired_differences(df: DataFrame, key: str, p: str, p2: str, replicates: int = 1000, seed: int = 42, y: str = "y") -> DataFrame:
    """(metric, lower, upper, valid_replicates) of p minus p2, both scored on the same resamples."""
    drawn = resamples(df.select(key, y, p, p2), key, replicates, seed)
    a, b = (resampled_metrics(drawn, y=y, p=c).select("replicate", F.col("roc_auc").alias(f"roc{k}"), F.col("pr_auc").alias(f"pr{k}")) for k, c in ((1, p), (2, p2)))
    both = a.join(b, "replicate").select("replicate", (F.col("roc1") - F.col("roc2")).alias("roc_auc"), (F.col("pr1") - F.col("pr2")).alias("pr_auc"))
    return intervals(both, ["roc_auc", "pr_auc"])


#: Replicates that a row draws its weights for from one SHA-256, 32 bits each.
BLOCK = 8


def poisson_limits() -> list[int]:
    """How many of 2**32 equally likely draws a Poisson variable of mean 1 answers with 0, with 1 or less, and so on."""
    out, term, total, k = [], math.exp(-1), 0.0, 0
    while term * 2**32 >= 0.5:
        total, k = total + term, k + 1
        out.append(int(total * 2**32))
        term /= k
    return out


def poisson_metrics(df: DataFrame, key: str, scores: list[str], replicates: int, threshold: float = 0.5, seed: int = 42, y: str = "y", bins: int = 4096) -> DataFrame:
    """(score, replicate, roc_auc, pr_auc, brier, f1) of each score column over Poisson resamples: every row has a weight of its
    own in each replicate, of mean 1, by a hash of seed, key and replicate, the same for all scores. Weights are summed in each
    task by `bins` equal ranges of scores, so nothing of the rows is drawn, shuffled or joined, and what meets are bins times
    replicates. The AUCs take a bin for a tie (binning_slack() bounds what that moves); brier and f1 are those of the rows. Scores
    are probabilities; rows without one, or with a label that is neither 0 nor 1, take no part in it."""
    limits, one, hit = poisson_limits(), F.col("_y") == 1, F.col("_p") >= threshold
    blocks = df.where(F.col(y).isin(0, 1)).select(F.col(key).alias("_key"), F.col(y).alias("_y"), *scores, F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // BLOCK) - 1))).alias("_block"))
    hashed = blocks.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_key").cast("string"), F.col("_block").cast("string")), 256))

    def weight(j: int) -> Column:
        u = F.conv(F.substring("_h", 8 * j + 1, 8), 16, 10).cast("bigint")
        out = F.when(u < limits[0], 0)
        for k, limit in enumerate(limits[1:], 1):
            out = out.when(u < limit, k)
        return out.otherwise(len(limits))

    weighed = hashed.select("_y", "_block", *scores, *(weight(j).alias(f"_w{j}") for j in range(BLOCK)))
    each = weighed.select("_y", "_block", *(f"_w{j}" for j in range(BLOCK)), F.inline(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("_p")) for c in scores))))
    error = F.col("_p") - F.col("_y").cast("double")
    parts = {"pos": one.cast("int"), "neg": (~one).cast("int"), "error": error * error, "hits": (hit & one).cast("int"), "alarms": (hit & ~one).cast("int")}
    binned = each.where("_p IS NOT NULL").groupBy("score", "_block", score_bin(F.col("_p"), bins).alias("bin"))
    sums = binned.agg(*(F.sum(F.col(f"_w{j}") * x).alias(f"_{n}{j}") for j in range(BLOCK) for n, x in parts.items()))
    rows = F.array(*(F.struct((F.col("_block") * BLOCK + j).alias("replicate"), *(F.col(f"_{n}{j}").alias(n) for n in parts)) for j in range(BLOCK)))
    long = sums.select("score", "bin", F.inline(rows)).where(F.col("replicate") < replicates)
    upward = W.partitionBy("score", "replicate").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)  # over `bins` rows at most
    ranked = ranking_metrics(long.withColumns({"tp": F.sum("pos").over(upward), "fp": F.sum("neg").over(upward)}), "score", "replicate")
    tp, fp, fn = F.sum("hits").cast("double"), F.sum("alarms").cast("double"), (F.sum("pos") - F.sum("hits")).cast("double")
    other = long.groupBy("score", "replicate").agg(F.try_divide(F.sum("error"), F.sum(F.col("pos") + F.col("neg"))).alias("brier"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
    return ranked.join(other, ["score", "replicate"])


def score_bin(p: Column, bins: int) -> Column:
    """Which of `bins` equal ranges of [0, 1] a score is in; scores outside are in the nearest."""
    return F.greatest(F.lit(0), F.least(F.floor(p * bins), F.lit(bins - 1))).cast("int")


def binning_slack(df: DataFrame, bins: int = 4096, y: str = "y", p: str = "p") -> DataFrame:
    """One row (slack): the most that taking bins for ties moves the ROC AUC of the whole, half the share of pairs within bins."""
    counts = df.where(F.col(p).isNotNull()).groupBy(score_bin(F.col(p), bins).alias("_b")).agg(F.count_if(F.col(y) == 1).cast("double").alias("_pos"), F.count_if(F.col(y) == 0).cast("double").alias("_neg"))
    return counts.agg(F.try_divide(F.sum(F.col("_pos") * F.col("_neg")) / 2, F.sum("_pos") * F.sum("_neg")).alias("slack"))


def poisson_intervals(df: DataFrame, key: str, replicates: int = 1000, threshold: float = 0.5, seed: int = 42, y: str = "y", p: str = "p", bins: int = 4096) -> DataFrame:
    """bootstrap_intervals() from Poisson resamples, for tables of any size; estimates are exact ones of the whole."""
    names = ["roc_auc", "pr_auc", "brier", "f1"]
    whole = binary_metrics(df, threshold, y, p).select(F.lit(0).alias("replicate"), *names).unpivot("replicate", names, "metric", "estimate").select("metric", "estimate")
    return intervals(poisson_metrics(df, key, [p], replicates, threshold, seed, y, bins), names).join(whole, "metric")


def poisson_differences(df: DataFrame, key: str, p: str, p2: str, replicates: int = 1000, seed: int = 42, y: str = "y", bins: int = 4096) -> DataFrame:
    """paired_differences() from Poisson resamples: a row has the same weights under both scores. Rows need both."""
    names = ["roc_auc", "pr_auc"]
    found = poisson_metrics(df.where(F.col(p).isNotNull() & F.col(p2).isNotNull()), key, [p, p2], replicates, 0.5, seed, y, bins)
    of = lambda c, n: F.max(F.when(F.col("score") == c, F.col(n)))
    return intervals(found.groupBy("replicate").agg(*((of(p, n) - of(p2, n)).alias(n) for n in names)), names)


def case_study(df: DataFrame, threshold: float, least_shift: float = 0.05, key: str = "id", p: str = "p", p2: str = "p2") -> DataFrame:
    """The row whose decision differs between two scores and whose score moved most, by least_shift or more."""
    shift = F.abs(F.col(p2) - F.col(p))
    flips = ((F.col(p) >= threshold) != (F.col(p2) >= threshold)) & (shift >= least_shift)
    return df.where(flips).select(key, p, p2, shift.alias("shift")).orderBy(F.desc("shift"), key).limit(1)
