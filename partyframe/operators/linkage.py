"""Donor matching without common keys, blind to the target: by a row factor's normal scores, or by ranks.

Nearest donors are found as-of style: both sides fall into ranges of the score, each range carries the last donor before
it and the first one after it, and windows run within a range. There is no theta join, no global sort in one task and no
collected donor table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.scalar import clipped, hash_order, hash_uniform, normal_quantile
from partyframe.functions.session import checkpointed
from partyframe.operators.ranking import average_rank, ordered_place, quantiles, value_bucket


def row_factor(df: DataFrame, key: str, features: list[str], name: str = "factor") -> DataFrame:
    """(key, factor): the mean of tanh((x - median) / MAD) over the features, medians in place of NULLs."""
    middle = {c: q[0] or 0.0 for c, q in quantiles(df, features, [0.5]).items()}
    filled = df.select(key, *(F.coalesce(F.col(c), F.lit(middle[c])).alias(c) for c in features))
    off = filled.select(key, *(F.abs(F.col(c) - middle[c]).alias(c) for c in features))
    spread = {c: q[0] if (q[0] or 0.0) >= 1e-12 else 1.0 for c, q in quantiles(off, features, [0.5]).items()}
    terms = [F.tanh((F.col(c) - middle[c]) / spread[c]) for c in features]
    return filled.select(key, (sum(terms[1:], terms[0]) / len(terms)).alias(name))


def normal_scores(df: DataFrame, col: str, name: str = "score") -> DataFrame:
    """df with the normal quantile of (average rank - 0.5) / n, kept within [1e-6, 1 - 1e-6]."""
    n = df.where(F.col(col).isNotNull()).count()
    ranked = average_rank(df, col, "_rank")
    return ranked.withColumn(name, normal_quantile(clipped((F.col("_rank") - 0.5) / max(n, 1), 1e-6, 1 - 1e-6))).drop("_rank")


def nearest(anchors: DataFrame, donors: DataFrame, by: str = "score") -> DataFrame:
    """(anchor_id, donor_id) of anchors (anchor_id, score) and donors (donor_id, score): the donor with the nearest
    score; of two at the same distance the one above, of equal scores the smallest id.

    Donors are reduced to one per score. Ranges of the score are as many as BUCKETS; what crosses a range is one donor
    below and one above, found over range totals only.
    """
    unique = donors.groupBy(by).agg(F.min("donor_id").alias("donor_id"))
    both = anchors.select(by, "anchor_id", F.lit(None).cast(donors.schema["donor_id"].dataType).alias("donor_id"), F.lit(1).alias("side")).unionByName(
        unique.select(by, F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id"), "donor_id", F.lit(0).alias("side"))
    )
    both = checkpointed(both)  # read twice
    marked = both.withColumn("b", value_bucket(both, by)).withColumn("d", F.when(F.col("side") == 0, F.struct(by, "donor_id")))
    ends = marked.groupBy("b").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    over = W.orderBy("b")  # BUCKETS rows at most
    outside = ends.select(
        "b",
        F.last("last", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("below"),
        F.first("first", ignorenulls=True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("above"),
    )
    inside = W.partitionBy("b").orderBy(by, "side")  # a donor at the anchor's own score stands before it
    upto = F.last("d", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("d", ignorenulls=True).over(inside.rowsBetween(1, W.unboundedFollowing))
    seen = marked.select("*", upto.alias("_in_below"), after.alias("_in_above")).where("side = 1").join(F.broadcast(outside), "b")
    low, high = F.coalesce("_in_below", "below"), F.coalesce("_in_above", "above")
    pick = F.when(high.isNull(), low).when(low.isNull(), high).when(F.abs(low[by] - F.col(by)) < F.abs(high[by] - F.col(by)), low).when(low[by] == F.col(by), low).otherwise(high)
    return seen.select("anchor_id", pick["donor_id"].alias("donor_id"))


def noise(key: str, seed: int) -> Column:
    """A standard normal number that depends on seed and key only."""
    return normal_quantile(clipped(hash_uniform(key, seed=seed), 1e-12, 1 - 1e-12))


def copula_link(anchors: DataFrame, donors: DataFrame, key: str, anchor_features: list[str], donor_features: list[str], rho: float = 0.25, stochasticity: float = 0.15, seed: int = 42) -> DataFrame:
    """(anchor_id, donor_id): each anchor wants the score rho a + sqrt(1 - rho^2) e (+ noise) and gets the nearest donor.
    With rho = 1 and no stochasticity the result is a function of the data alone; else also of the seed."""
    if not 0 <= rho <= 1 or stochasticity < 0:
        raise ValueError("rho must be within [0, 1], stochasticity not negative")
    a = normal_scores(row_factor(anchors, key, anchor_features), "factor").select(F.col(key).alias("anchor_id"), "score")
    d = normal_scores(row_factor(donors, key, donor_features), "factor").select(F.col(key).alias("donor_id"), "score")
    wanted = F.col("score") * rho
    if rho < 1:
        wanted = wanted + noise("anchor_id", seed) * ((1 - rho * rho) ** 0.5)
    if stochasticity:
        wanted = wanted + noise("anchor_id", seed + 1_000_003) * stochasticity
    return nearest(a.select("anchor_id", wanted.alias("score")), d)


def dense_order(df: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """df (key, score) with the 0-based place by score and key; a score that many rows share is no task's alone."""
    return ordered_place(df.select(key, score), [F.col(score), F.col(key)], name)


def rank_link(anchors: DataFrame, donors: DataFrame, key: str, anchor_features: list[str], donor_features: list[str], jitter: int = 1, seed: int = 42) -> DataFrame:
    """(anchor_id, donor_id): the donor whose place by mean feature is the anchor's, scaled (half to even), moved by up
    to `jitter` places. An equi-join on the place."""
    score = lambda df, cols: df.select(key, F.expr(f"aggregate(array_compact(array({', '.join(cols)})), 0D, (s, x) -> s + x) / greatest(1, size(array_compact(array({', '.join(cols)}))))").alias("score"))
    n, m = anchors.count(), donors.count()
    a, d = dense_order(score(anchors, anchor_features), key, "score", "place"), dense_order(score(donors, donor_features), key, "score", "at")
    move = (hash_order(key, seed=seed) % (2 * jitter + 1) - jitter) if jitter else F.lit(0)
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(m - 1), c))
    at = inside(inside(F.rint(F.col("place") / max(n - 1, 1) * (m - 1)).cast("long")) + move)
    return a.select(F.col(key).alias("anchor_id"), at.alias("at")).join(d.select(F.col(key).alias("donor_id"), "at"), "at").select("anchor_id", "donor_id")


def linkage_manifest(links: DataFrame, donors: DataFrame) -> DataFrame:
    """One row: anchors, donors, distinct donors used, how far they are used again, and whether any is."""
    sums = links.agg(F.count(F.lit(1)).alias("anchor_rows"), F.count_distinct("donor_id").alias("unique_donors"))
    return sums.crossJoin(donors.agg(F.count(F.lit(1)).alias("donor_rows"))).select(
        "anchor_rows", "donor_rows", "unique_donors", (1 - F.col("unique_donors") / F.greatest(F.col("anchor_rows"), F.lit(1))).alias("donor_reuse_fraction"), (F.col("unique_donors") < F.col("anchor_rows")).alias("with_replacement")
    )


