"""Synthetic parties by distribution: rows are functions of seed and entity, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.functions.scalar import clipped, hash_uniform
from partyframe.operators.linkage import normal_quantile
from partyframe.operators.ranking import quantiles

PARTIES = ("bank", "telecom", "insurance", "retail")


def normal(name: str, seed: int):
    return normal_quantile(clipped(hash_uniform("id", F.lit(name), seed=seed), 1e-12, 1 - 1e-12))


def vertical_parties(spark: SparkSession, rows: int = 2000, features: int = 4, seed: int = 42) -> tuple[DataFrame, dict[str, list[str]]]:
    """(id, a column per party and feature, y) and the columns by party. A party's features carry its latent factor with
    weights from 0.5 to 1.2; the label depends on all factors and two interactions."""
    base = spark.range(rows).withColumns({f"_l{k}": normal(f"latent{k}", seed) for k in range(4)})
    names = {p: [f"{p}_{j}" for j in range(features)] for p in PARTIES}
    weight = lambda j: 0.5 + 0.7 * j / max(features - 1, 1)
    cols = {c: F.col(f"_l{k}") * weight(j) + normal(c, seed) * 0.8 for k, (p, cs) in enumerate(names.items()) for j, c in enumerate(cs)}
    a, b, c, d = (F.col(f"_l{k}") for k in range(4))
    logit = 0.9 * a + 0.8 * b + 0.7 * c + 0.6 * d + 0.35 * a * b - 0.25 * c * d + normal("noise", seed) * 0.5
    y = (hash_uniform("id", F.lit("label"), seed=seed) < 1 / (1 + F.exp(-logit))).cast("int")
    return base.withColumns(cols).withColumn("y", y).select("id", *cols, "y"), names


def balanced_party(spark: SparkSession, rows: int, features: int, seed: int = 42) -> DataFrame:
    """(id, f0.., y): normal features, the label being whether their sum is above its median."""
    x = spark.range(rows).withColumns({f"f{k}": normal(f"f{k}", seed) for k in range(features)})
    x = x.withColumn("_s", sum((F.col(f"f{k}") for k in range(1, features)), F.col("f0")))
    return x.withColumn("y", (F.col("_s") > quantiles(x, ["_s"], [0.5])["_s"][0]).cast("int")).drop("_s")
