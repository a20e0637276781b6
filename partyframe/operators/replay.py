"""Replay of stored boosted trees over rows, and what a run sends: trees as a flat node table that rows are joined with.

A row meets one node of a tree at each level. Nodes are a broadcast table (tree, node, feature, cut, owner), so a level is one
join for all trees and the plan grows with the depth, not with the trees: hundreds of trees neither fail to compile nor
nest. Each node is decided by its owner's feature alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.functions.scalar import sigmoid

#: Node tables up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_NODES = 500_000


class MissingRoutingError(ValueError):
    """A party that owns nodes has given no thresholds."""


def node_table(spark: SparkSession, checkpoint: str, routing: dict[str, str], missing_party: str = "error") -> tuple[DataFrame, dict]:
    """((tree, node, feature, cut, party, value), facts) of a checkpoint (sources.files.gbdt_checkpoint) and the parties'
    thresholds. feature and cut are NULL for leaves. Nodes of a party without thresholds are an error, or leaves of value 0
    with zero_contribution; the active party must be there."""
    whole = json.loads(checkpoint)
    cuts = {p: json.loads(text) for p, text in routing.items()}
    active = next(iter(whole["parties"]))
    absent = [p for p in whole["parties"] if p not in cuts]
    if absent and (missing_party != "zero_contribution" or active in absent):
        raise MissingRoutingError(f"no thresholds of {', '.join(absent)}")
    rows = []
    for tree, nodes in enumerate(whole["trees"]):
        for name, (g, h, _, party, feature, cut, _) in nodes.items():
            if feature is None:
                rows.append((tree, int(name), None, None, None, -g / (h + whole["options"]["reg_lambda"])))
            elif party in absent:
                rows.append((tree, int(name), None, None, party, 0.0))
            else:
                rows.append((tree, int(name), feature, float(cuts[party][feature][cut]), party, None))
    table = spark.createDataFrame(rows, "tree int, node int, feature string, cut double, party string, value double")
    facts = {"base": whole["base"], "rate": whole["options"]["learning_rate"], "depth": whole["options"]["depth"], "trees": len(whole["trees"]), "active": active, "features": [c for p, cs in whole["parties"].items() if p in cuts for c in cs]}
    return table, facts | {"small": len(rows) <= BROADCAST_NODES}


def routed(df: DataFrame, nodes: DataFrame, facts: dict, key: str) -> DataFrame:
    """(key, tree, node): the node at which each row ends in each tree; missing values go right."""
    features = facts["features"]
    x = F.array(*(F.col(c).cast("double") for c in features)) if features else F.array(F.lit(0.0))
    now = df.select(F.col(key).alias("_key"), x.alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(facts["trees"] - 1))).alias("tree"), F.lit(1).alias("node")) if facts["trees"] else df.select(F.col(key).alias("_key"), x.alias("_x"), F.lit(0).alias("tree"), F.lit(1).alias("node")).limit(0)
    place = F.create_map(*(F.lit(v) for k, c in enumerate(features) for v in (c, k))) if features else None
    splits = nodes.where("feature IS NOT NULL").select("tree", "node", F.element_at(place, F.col("feature")).alias("_place") if features else F.lit(0).alias("_place"), "cut")
    splits = hinted(splits, facts)
    for _ in range(facts["depth"]):
        left = F.coalesce(F.get("_x", F.col("_place")) <= F.col("cut"), F.lit(False))
        step = F.when(F.col("_place").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        now = now.join(splits, ["tree", "node"], "left").select("_key", "_x", "tree", step.alias("node"))
    return now.select(F.col("_key").alias(key), "tree", "node")


def hinted(nodes: DataFrame, facts: dict) -> DataFrame:
    """Nodes of a checked number are broadcast."""
    return F.broadcast(nodes) if facts["small"] else nodes


def replay_scores(df: DataFrame, checkpoint: str, routing: dict[str, str], key: str = "id", missing_party: str = "error") -> DataFrame:
    """(key, margin, p) of every row, keys being unique: the leaves that it reaches, summed. A row's trees are summed in its
    task before anything is shuffled."""
    nodes, facts = node_table(df.sparkSession, checkpoint, routing, missing_party)
    leaves = nodes.where("value IS NOT NULL").select("tree", "node", "value")
    sums = routed(df, nodes, facts, key).join(hinted(leaves, facts), ["tree", "node"]).groupBy(key).agg(F.sum("value").alias("_sum"))
    scored = sums.select(key, (F.lit(facts["base"]) + F.lit(facts["rate"]) * F.col("_sum")).alias("margin"))
    if not facts["trees"]:
        scored = df.select(key, F.lit(facts["base"]).alias("margin"))
    return scored.withColumn("p", sigmoid("margin"))


def routing_events(df: DataFrame, checkpoint: str, routing: dict[str, str], key: str = "id") -> DataFrame:
    """(tree, node, party, entity): every row at every split that it meets. The nodes on a path are the halves of where it
    ends, so one walk gives all of them."""
    nodes, facts = node_table(df.sparkSession, checkpoint, routing)
    owners = nodes.where("feature IS NOT NULL").select("tree", "node", "party")
    met = F.filter(F.transform(F.sequence(F.lit(1), F.lit(facts["depth"])), lambda k: F.call_function("div", F.col("node"), F.pow(F.lit(2), k).cast("int")).cast("int")), lambda n: n >= 1)
    paths = routed(df, nodes, facts, key).select("tree", F.explode(met).alias("node"), F.col(key).alias("entity"))
    return paths.join(hinted(owners, facts), ["tree", "node"]).select("tree", "node", "party", "entity")


def communication_frame(spark: SparkSession, rows: int, passive: list[str], epochs: int, batches: int = 1, validation_rows: int = 0, stopped: bool = False) -> DataFrame:
    """(seq, epoch, party, direction, stage, step, scalars, bytes): every message of a training run, made from the run's shape
    without running it; 8 bytes a number. In an epoch a passive party sends its logits of all rows, then for each batch its
    logits, and gets residuals back; then those of the validation rows. The last logits follow the last epoch, once more
    before them where training stopped early. Totals equal logistic.message_volume()."""
    per_epoch = 1 + 2 * batches + (1 if validation_rows else 0)
    tail = 1 + int(stopped)
    steps = spark.range(epochs * per_epoch + tail).select(F.col("id").alias("at"))
    epoch, place = F.call_function("div", F.col("at"), F.lit(per_epoch)), F.col("at") % per_epoch
    ended = F.col("at") >= epochs * per_epoch
    batch = F.call_function("div", place - 1, F.lit(2))
    in_batch = (place >= 1) & (place <= 2 * batches)
    size = F.lit(rows // batches) + (batch < rows % batches).cast("long")
    backward = ~ended & in_batch & (place % 2 == 0)
    stage: Column = F.when(ended, "final_logits").when(place == 0, "epoch_logits").when(in_batch & (place % 2 == 1), "batch_logits").when(in_batch, "residuals").otherwise("validation_logits")
    scalars = F.when(ended, F.lit(rows)).when(in_batch, size).when(place > 2 * batches, F.lit(validation_rows)).otherwise(F.lit(rows)).cast("long")
    every = steps.select("at", F.when(ended, F.lit(epochs)).otherwise(epoch).cast("int").alias("epoch"), F.when(backward, "backward").otherwise("forward").alias("direction"), stage.alias("stage"), F.when(~ended & in_batch, batch).cast("int").alias("step"), scalars.alias("scalars"))
    named = every.select("*", F.posexplode(F.array(*map(F.lit, passive))).alias("_party", "party"))
    return named.select((F.col("at") * len(passive) + F.col("_party")).alias("seq"), "epoch", "party", "direction", "stage", "step", "scalars", (8 * F.col("scalars")).alias("bytes"))
