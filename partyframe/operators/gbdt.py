"""Vertical histogram gradient boosting: level-wise histograms of all parties in one aggregate per level.

Features are binned once. A level of a tree is one job: gradients are summed per (node, feature, bin), prefix sums give
both sides of every candidate, and one row per node comes back: its best split. Trees are flat tables with heap ids
(children of i: 2i and 2i + 1); scoring compiles them to expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.scalar import hash_uniform, sigmoid
from partyframe.functions.session import checkpointed
from partyframe.operators.preprocess import apply_bins, fit_bins


@dataclass(frozen=True)
class GBDTOptions:
    trees: int = 20
    depth: int = 3
    learning_rate: float = 0.1
    reg_lambda: float = 1.0
    bins: int = 16
    min_leaf: int = 20
    min_child_weight: float = 0.0
    max_leaves: int | None = None  # taken depth-first, left before right
    row_fraction: float = 1.0
    feature_fraction: float = 1.0
    patience: int | None = None
    checkpoint_every: int = 5
    seed: int = 42

    def __post_init__(self):
        good = self.trees > 0 and self.depth > 0 and self.learning_rate > 0 and self.reg_lambda >= 0 and self.bins > 1 and self.min_leaf > 0 and 0 < self.row_fraction <= 1 and 0 < self.feature_fraction <= 1
        if not good or (self.max_leaves is not None and self.max_leaves < 2) or (self.patience is not None and self.patience <= 0):
            raise ValueError("unusable options")


@dataclass
class Node:
    g: float
    h: float
    n: int
    party: str | None = None
    feature: str | None = None
    bin: int | None = None
    gain: float | None = None


@dataclass
class GBDTModel:
    parties: dict[str, list[str]]
    edges: dict[str, list[float]]
    base: float
    options: GBDTOptions
    trees: list[dict[int, Node]] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def leaf(self, node: Node) -> float:
        return -node.g / (node.h + self.options.reg_lambda)

    def tree_value(self, tree: dict[int, Node], codes: bool, present: set[str] | None = None, at: int = 1) -> Column:
        """The value of a tree as nested CASE WHEN, over bin codes or raw values; the subtree of an absent owner is 0."""
        node = tree[at]
        if node.feature is None:
            return F.lit(self.leaf(node))
        if present is not None and node.party not in present:
            return F.lit(0.0)
        go_left = F.col(node.feature) <= (node.bin if codes else self.edges[node.feature][node.bin])
        left, right = (self.tree_value(tree, codes, present, k) for k in (2 * at, 2 * at + 1))
        return F.when(go_left, left).otherwise(right)  # missing values go right, as they are binned


def split_gain(gl: Column, hl: Column, gr: Column, hr: Column, reg_lambda: float, min_child_weight: float = 0.0) -> Column:
    part = lambda g, h: g * g / (h + reg_lambda)
    gain = 0.5 * (part(gl, hl) + part(gr, hr) - part(gl + gr, hl + hr))
    return F.when((hl >= min_child_weight) & (hr >= min_child_weight), gain)


def histograms(rows: DataFrame, features: list[str]) -> DataFrame:
    """(node, f, bin, n, g, h) from rows (node, g, h, a code column per feature): summed in each task before the shuffle."""
    long = rows.select("node", "g", "h", F.posexplode(F.array(*features)).alias("f", "bin"))
    return long.groupBy("node", "f", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def candidates(hist: DataFrame, options: GBDTOptions) -> DataFrame:
    """(node, f, bin, n_left, g_left, h_left, n, g, h, gain) for every split with min_leaf rows on both sides."""
    upto = W.partitionBy("node", "f").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("node", "f")
    sums = hist.select("node", "f", "bin", *(F.sum(c).over(upto).alias(f"{c}_left") for c in "ngh"), *(F.sum(c).over(whole).alias(c) for c in "ngh"))
    gain = split_gain(F.col("g_left"), F.col("h_left"), F.col("g") - F.col("g_left"), F.col("h") - F.col("h_left"), options.reg_lambda, options.min_child_weight)
    both = (F.col("n_left") >= options.min_leaf) & (F.col("n") - F.col("n_left") >= options.min_leaf)
    return sums.where(both).withColumn("gain", F.round(gain, 12))


def best_splits(found: DataFrame) -> DataFrame:
    """The candidate of each node with the largest positive gain; of equals the first by feature (in party order) and bin."""
    return found.where("gain > 0").withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("gain"), "f", "bin"))).where("_r = 1").drop("_r")


def node_of(tree: dict[int, Node]) -> Column:
    """The deepest node of a row, over bin codes."""

    def at(k: int) -> Column:
        node = tree[k]
        return F.lit(k) if node.feature is None else F.when(F.col(node.feature) <= node.bin, at(2 * k)).otherwise(at(2 * k + 1))

    return at(1)


def grow_tree(rows: DataFrame, parties: dict[str, list[str]], features: list[str], options: GBDTOptions) -> dict[int, Node]:
    """One tree over rows (g, h, codes): a job per level."""
    owner = {c: p for p, cs in parties.items() for c in cs}
    g, h, n = rows.agg(F.sum("g"), F.sum("h"), F.count(F.lit(1))).first()
    tree, open_ = {1: Node(g or 0.0, h or 0.0, n)}, [1]
    for _ in range(options.depth):
        open_ = [k for k in open_ if tree[k].n >= 2 * options.min_leaf]
        if not open_:
            break
        level = rows.withColumn("node", node_of(tree)).where(F.col("node").isin(open_))
        for s in best_splits(candidates(histograms(level, features), options)).collect():
            node = tree[s.node]
            node.feature, node.bin, node.gain = features[s.f], s.bin, s.gain
            node.party = owner[node.feature]
            tree[2 * s.node] = Node(s.g_left, s.h_left, s.n_left)
            tree[2 * s.node + 1] = Node(s.g - s.g_left, s.h - s.h_left, s.n - s.n_left)
        open_ = [c for k in open_ if tree[k].feature for c in (2 * k, 2 * k + 1)]
    return limit_leaves(tree, options.max_leaves)


def limit_leaves(tree: dict[int, Node], most: int | None) -> dict[int, Node]:
    """Splits are taken depth-first, left before right, until there are `most` leaves."""
    if most is None:
        return tree
    left, stack, out = most - 1, [1], {}
    while stack:
        k = stack.pop()
        out[k] = tree[k]
        if tree[k].feature is not None and left > 0:
            left -= 1
            stack += [2 * k + 1, 2 * k]
        else:
            out[k].feature = None
    return out


def fit_gbdt(df: DataFrame, parties: dict[str, list[str]], y: str = "y", key: str = "id", options: GBDTOptions | None = None, validation: DataFrame | None = None) -> GBDTModel:
    """Boosting of the logistic loss from the log odds of the labels. Rows and features are subsampled by hashes. The
    margin is a column of the cached frame; its plan is cut by a checkpoint every few trees."""
    options = options or GBDTOptions()
    features = [c for cs in parties.values() for c in cs]
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    if mean is None:
        raise ValueError("no rows to learn from")
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    model = GBDTModel(parties, fit_bins(df, features, options.bins), math.log(mean / (1 - mean)), options)
    codes = apply_bins(model.edges)
    coded = lambda d: d.select(key, F.col(y).cast("double").alias("_y"), *(c.alias(n) for n, c in codes.items()), F.lit(model.base).alias("_m"))
    frame, held = coded(df).persist(), coded(validation).persist() if validation is not None else None
    cached, best = [x for x in (frame, held) if x is not None], None
    loss = lambda x: x.agg(F.avg(F.log(1 + F.exp(-F.abs("_m"))) + F.greatest(F.col("_m"), F.lit(0.0)) - F.col("_m") * F.col("_y"))).first()[0]
    try:
        for k in range(options.trees):
            p = sigmoid("_m")
            rows = frame.withColumns({"g": p - F.col("_y"), "h": F.greatest(p * (1 - p), F.lit(1e-8))})
            if options.row_fraction < 1:
                rows = rows.where(hash_uniform(key, seed=options.seed + k) < options.row_fraction)
            used = features if options.feature_fraction == 1 else drawn_features(features, options, k)
            tree = grow_tree(rows, parties, used, options)
            model.trees.append(tree)
            step = F.col("_m") + model.tree_value(tree, True) * options.learning_rate
            frame = frame.withColumn("_m", step)
            held = held.withColumn("_m", step) if held is not None else None
            if (k + 1) % options.checkpoint_every == 0 and k + 1 < options.trees:
                frame = checkpointed(frame)
                held = checkpointed(held) if held is not None else None
            seen = loss(held) if held is not None else None
            model.history.append({"epoch": k, "loss": None, "rate": options.learning_rate, "validation": seen})
            if seen is not None and options.patience:
                if best is None or seen < best[0]:
                    best = (seen, k)
                elif k - best[1] >= options.patience:
                    break
        if best is not None:
            del model.trees[best[1] + 1 :]
        return model
    finally:
        for x in cached:
            x.unpersist()


def drawn_features(features: list[str], options: GBDTOptions, tree: int) -> list[str]:
    import hashlib

    order = sorted(features, key=lambda c: hashlib.sha256(f"{options.seed}:{tree}:{c}".encode()).digest())
    chosen = set(order[: max(1, round(options.feature_fraction * len(features)))])
    return [c for c in features if c in chosen]


def score_gbdt(df: DataFrame, model: GBDTModel, missing_party: str = "error") -> DataFrame:
    """df with margin and p. Without a passive party's columns: an error, or 0 for every subtree that it owns."""
    present = {p for p, cs in model.parties.items() if all(c in df.columns for c in cs)}
    if len(present) < len(model.parties) and (missing_party != "zero_contribution" or next(iter(model.parties)) not in present):
        raise ValueError("a party's columns are missing")
    margin = F.lit(model.base)
    for tree in model.trees:
        margin = margin + model.tree_value(tree, False, present) * model.options.learning_rate
    return df.withColumn("margin", margin).withColumn("p", sigmoid("margin"))


def tree_table(df: DataFrame, model: GBDTModel) -> DataFrame:
    """(tree, node, depth, party, feature, bin, gain, n, value) of all nodes; value is that of leaves."""
    rows = [
        (k, i, i.bit_length() - 1, x.party if x.feature else None, x.feature, x.bin if x.feature else None, x.gain if x.feature else None, x.n, None if x.feature else model.leaf(x))
        for k, tree in enumerate(model.trees)
        for i, x in sorted(tree.items())
    ]
    return df.sparkSession.createDataFrame(rows, "tree int, node int, depth int, party string, feature string, bin int, gain double, n long, value double")


def split_importance(table: DataFrame) -> DataFrame:
    """(party, feature, split_count, gain_sum, gain_mean), largest gain first."""
    sums = table.where("feature IS NOT NULL").groupBy("party", "feature").agg(F.count(F.lit(1)).alias("split_count"), F.sum("gain").alias("gain_sum"), F.avg("gain").alias("gain_mean"))
    return sums.orderBy(F.desc("gain_sum"), "party", "feature")
