"""Attacks over a grid of models: size, parties, rounds, regularisation, model family and mitigation, each for several seeds.

All models of the grid are trained side by side (operators.many_models) and all attacks measured in one plan, so the number
of jobs follows the longest training, not the number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyframe.functions.scalar import clipped, hash_order, hash_uniform, normal_quantile
from partyframe.functions.session import checkpointed
from partyframe.operators.gbdt import GBDTOptions
from partyframe.operators.logistic import LogisticOptions
from partyframe.operators.many_models import Cell, Curve, ManyFrame, curve_metrics, fit_many_gbdt, fit_many_logistic, many_frame, scorer, summed
from partyframe.operators.privacy import interval_summary

MEASURES = ("membership_roc_auc", "membership_advantage", "label_inference_accuracy", "routing_exposure_fraction", "routing_events_per_entity", "holdout_roc_auc")


@dataclass(frozen=True)
class Grid:
    """The axes. Sizes are shares of the entities, drawn by hash; the baseline has the largest size, all parties and the middle
    rounds. Two seeds at least, as intervals run across them."""

    sizes: tuple[float, ...] = (0.25, 0.5, 1.0)
    party_counts: tuple[int, ...] = (2, 3, 4)
    logistic_rounds: tuple[int, ...] = (4, 8, 16)
    tree_rounds: tuple[int, ...] = (1, 2, 4)
    regularization: tuple[float, ...] = (0.001, 0.1, 1.0)
    noise: tuple[float, ...] = (0.0, 0.25, 1.0)
    seeds: tuple[int, ...] = (1, 2)
    learning_rate: float = 0.5
    bins: int = 12

    def __post_init__(self):
        if len(set(self.seeds)) < 2:
            raise ValueError("uncertainty needs two seeds")
        if not (self.sizes and self.party_counts and self.logistic_rounds and self.tree_rounds) or not all(0 < s <= 1 for s in self.sizes) or min(self.party_counts) < 2:
            raise ValueError("sizes are shares within (0, 1], and there are two parties at least")


@dataclass(frozen=True)
class Setting:
    """What tells one model of the grid from another; settings that several axes share are trained once."""

    model: str
    size: float
    parties: int
    rounds: int
    l2: float
    noise: float = 0.0
    depth: int = 2
    min_leaf: int = 0


def settings(grid: Grid, rows: int) -> list[tuple[str, str, float, Setting]]:
    """(experiment, condition, strength, setting) of every point of every axis."""
    size, parties = max(grid.sizes), max(grid.party_counts)
    middle = lambda xs: xs[len(xs) // 2]
    rounds = {"logistic": middle(grid.logistic_rounds), "gbdt": middle(grid.tree_rounds)}
    usual = {"logistic": 1e-3, "gbdt": 1.0}
    leaf = lambda share, part: max(8, int(rows * share) // 2 // part)

    def of(model, size=size, parties=parties, n=None, l2=None, noise=0.0, depth=2, min_leaf=None):
        least = (leaf(size, 40) if min_leaf is None else min_leaf) if model == "gbdt" else 0
        return Setting(model, size, parties, rounds[model] if n is None else n, usual[model] if l2 is None else l2, noise, depth, least)

    out = []
    for model in ("logistic", "gbdt"):
        out += [("attack_vs_dataset_size", str(s), float(s), of(model, size=s)) for s in grid.sizes]
        out += [("attack_vs_party_count", str(n), float(n), of(model, parties=n)) for n in grid.party_counts]
        out += [("attack_vs_training_rounds", str(n), float(n), of(model, n=n)) for n in (grid.logistic_rounds if model == "logistic" else grid.tree_rounds)]
        out += [("attack_vs_regularization", str(v), float(v), of(model, l2=v)) for v in grid.regularization]
        out.append(("logistic_vs_gbdt", "baseline", 0.0, of(model)))
    out += [("mitigation_utility_tradeoff", "passive_residual_gaussian_noise", float(v), of("logistic", noise=v)) for v in grid.noise]
    small, large = leaf(size, 40), max(16, leaf(size, 10))
    for name, depth, least, l2 in (("baseline", 2, small, 1.0), ("shallow_tree", 1, small, 1.0), ("large_leaf", 2, large, 1.0), ("high_leaf_regularization", 2, small, 10.0)):
        out.append(("mitigation_utility_tradeoff", name, float(least), of("gbdt", l2=l2, depth=depth, min_leaf=least)))
    return out


def flags_of(size: float, seed: int) -> tuple[str, str]:
    return f"learn:{size}:{seed}", f"hold:{size}:{seed}"


def grid_frame(df: DataFrame, columns: list[str], grid: Grid, y: str, key: str) -> ManyFrame:
    """The rows of every size and seed: a hash of seed and key draws them and deals them to training and holdout."""
    flags = {}
    for size in grid.sizes:
        for seed in grid.seeds:
            drawn, half = hash_uniform(key, seed=seed) < size, hash_order(key, seed=seed + 1) % 2
            learn, hold = flags_of(size, seed)
            flags |= {learn: drawn & (half == 0), hold: drawn & (half == 1)}
    return many_frame(df, columns, flags, y, key)


def attack_measures(frame: ManyFrame, cells: list[Cell], models: list, holds: list[str], noises: list[float], seeds: list[int]) -> DataFrame:
    """(cell, measure, value) of all attacks on all models: membership from confidence, labels from the residuals that passive
    parties get (noisy where the cell adds noise), routing of entities through passive parties' nodes, and the holdout's AUC.
    Rows are scored where they are; only sorted scores (many_models.curve_metrics) and sums leave a task."""
    n = len(cells)
    curves = [Curve(k, (c.learn, hold), c.learn, True) for k, (c, hold) in enumerate(zip(cells, holds, strict=True))] + [Curve(k, (hold,)) for k, hold in enumerate(holds)]
    found = curve_metrics(frame, models, curves)
    member, cell = F.col("curve") < n, F.pmod("curve", F.lit(n)).cast("int").alias("cell")
    aucs = found.select(cell, F.when(member, F.lit("membership_roc_auc")).otherwise(F.lit("holdout_roc_auc")).alias("measure"), F.col("roc_auc").alias("value"))
    advantage = found.where(member).select(cell, F.lit("membership_advantage").alias("measure"), F.greatest(F.round("gap", 12), F.lit(0.0)).alias("value"))
    sums = exposure_sums(frame, cells, models, noises, seeds)
    rows = []
    for k, (c, (learned, seen, guessed, met, nodes)) in enumerate(zip(cells, sums.tolist(), strict=True)):
        if isinstance(c.options, LogisticOptions):
            rows += [(k, "label_inference_accuracy", guessed / seen)] if seen else []
        elif learned:
            rows += [(k, "routing_exposure_fraction", met / learned), (k, "routing_events_per_entity", nodes / learned)]
    sent = frame.rows.sparkSession.createDataFrame(rows, "cell int, measure string, value double")
    return aucs.unionByName(advantage).unionByName(sent)


def exposure_sums(frame: ManyFrame, cells: list[Cell], models: list, noises: list[float], seeds: list[int]) -> np.ndarray:
    """(cells x 5) over the rows that a cell learns from: their number, those whose residual is seen, those whose label it tells,
    those that meet a passive party's node, and how many such nodes they meet."""
    noisy = list(dict.fromkeys(seed for seed, noise in zip(seeds, noises, strict=True) if noise > 0))
    drawn = [normal_quantile(clipped(hash_uniform(F.lit(seed), "id", seed="observed residual"), 1e-12, 1 - 1e-12)) for seed in noisy]
    score, n = scorer(frame, models), len(cells)
    known = [(frame.pattern(c.learn), isinstance(c.options, LogisticOptions), noise, noisy.index(seed) if noise > 0 else 0) for c, noise, seed in zip(cells, noises, seeds, strict=True)]

    def add(total, key_hash, y, x, flags, more=None):
        total, (p, met) = total.reshape(n, 5), score(x)
        for k, (learn, logistic, noise, at) in enumerate(known):
            inside = flags[:, learn]
            total[k, 0] += inside.sum()
            if logistic:
                v = p[inside, k] - y[inside] + (noise * more[inside, at] if noise > 0 else 0.0)
                seen = np.abs(v) > 1e-12
                total[k, 1] += seen.sum()
                total[k, 2] += ((v < 0) == (y[inside] == 1))[seen].sum()
            else:
                total[k, 3] += (met[inside, k] > 0).sum()
                total[k, 4] += met[inside, k].sum()

    return summed(frame, n * 5, add, drawn).reshape(n, 5)


def privacy_research(df: DataFrame, parties: dict[str, list[str]], grid: Grid | None = None, y: str = "y", key: str = "id") -> DataFrame:
    """(experiment, model, condition, strength, measure, n, mean, std, ci95_low, ci95_high): every measure at every point of
    every axis, with Student intervals across seeds. Empirical measurements, no guarantee of privacy."""
    grid = grid or Grid()
    names = list(parties)
    if max(grid.party_counts) > len(names):
        raise ValueError(f"the grid asks for {max(grid.party_counts)} parties, {len(names)} are there")
    frame = grid_frame(df, [c for cs in parties.values() for c in cs], grid, y, key)
    points = settings(grid, frame.size)
    distinct = list(dict.fromkeys((s, seed) for *_, s in points for seed in grid.seeds))
    cells, holds = [], []
    for s, seed in distinct:
        learn, hold = flags_of(s.size, seed)
        used = {p: parties[p] for p in names[: s.parties]}
        options = LogisticOptions(grid.learning_rate, s.rounds, s.l2, noise=s.noise, seed=seed) if s.model == "logistic" else GBDTOptions(s.rounds, s.depth, 0.1, s.l2, grid.bins, s.min_leaf, seed=seed)
        cells.append(Cell(learn, used, options))
        holds.append(hold)
    models: list = [None] * len(cells)
    for kind, fit in (("logistic", fit_many_logistic), ("gbdt", fit_many_gbdt)):
        own = [k for k, (s, _) in enumerate(distinct) if s.model == kind]
        for k, model in zip(own, fit(frame, [cells[k] for k in own]), strict=True):
            models[k] = model
    found = checkpointed(attack_measures(frame, cells, models, holds, [s.noise for s, _ in distinct], [seed for _, seed in distinct]))
    frame.close()
    where = {pair: k for k, pair in enumerate(distinct)}
    rows = [(where[s, seed], e, s.model, c, v) for e, c, v, s in points for seed in grid.seeds]
    named = df.sparkSession.createDataFrame(rows, "cell int, experiment string, model string, condition string, strength double")
    return interval_summary(found.join(F.broadcast(named), "cell"), ["experiment", "model", "condition", "strength", "measure"], "value")
