"""Many vertical models trained side by side over one frame: all cells of a grid, all subsets of a study.

Features stand in one array, the rows that a cell learns from in an array of flags. A round of training (an epoch, or a
level of a tree) is one job for all cells together: each task multiplies its rows with the weights of all cells and sends
one row for each number of the result. So jobs depend on rounds, never on the number of cells, rows never leave their task,
and the driver gets as many numbers as the models have weights (or histogram bins).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.session import checkpointed
from partyframe.operators.gbdt import GBDTModel, GBDTOptions, Node, limit_leaves
from partyframe.operators.logistic import LogisticModel, LogisticOptions

#: Buckets of a sketch's quantiles are exact to one part in so many.
SKETCH = 10_000
#: Rows of a batch that meet all cells at a time.
ROWS = 4096
#: Rows of the frame that a task holds, about.
TASK_ROWS = 65_536
#: Scores of all curves that a task holds and sorts before they are sent, and rows of a curve that meet in one task, about.
SORTED_SCORES = 3_000_000
RANGE_ROWS = 500_000
#: Rows from which each edge between such ranges is drawn.
EDGE_ROWS = 200


@dataclass(frozen=True)
class Cell:
    """One model of many: the name of its rows (see many_frame), its parties (the active one first) and its options."""

    learn: str
    parties: dict[str, list[str]]
    options: LogisticOptions | GBDTOptions

    def __post_init__(self):
        o = self.options
        if o.patience is not None or (isinstance(o, LogisticOptions) and (o.batches > 1 or o.tolerance)) or (isinstance(o, GBDTOptions) and min(o.row_fraction, o.feature_fraction) < 1):
            raise ValueError("models side by side take full batches, and stop and subsample for none of them")


@dataclass(frozen=True)
class ManyFrame:
    """rows: (id, key_hash, y, x array<double>, flags array<boolean>, extra columns), `size` of them; close() when done."""

    rows: DataFrame
    columns: list[str]
    flags: list[str]
    size: int

    def close(self) -> None:
        self.rows.unpersist()

    def pattern(self, name: str) -> int:
        return self.flags.index(name)


def many_frame(df: DataFrame, columns: list[str], flags: dict[str, Column], y: str = "y", key: str = "id", complete: bool = True) -> ManyFrame:
    """df in the form that all models share, dealt evenly to tasks by a hash of the key, and cached. Labels other than 0 and 1 are
    refused, missing features too where models need them complete."""
    size, *bad = df.agg(F.count(F.lit(1)), F.count_if(~F.col(y).isin(0, 1) | F.col(y).isNull()).alias("y"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    if bad[0] or (complete and any(bad)):
        raise ValueError(f"labels other than 0 and 1, or missing features: {dict(zip(['y', *columns], bad, strict=True))}")
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns))
    flag = F.array(*(F.coalesce(f, F.lit(False)) for f in flags.values()))
    rows = df.select(F.col(key).alias("id"), F.xxhash64(F.col(key).cast("string")).alias("key_hash"), F.col(y).cast("double").alias("y"), x.alias("x"), flag.alias("flags"))
    tasks = max(1, -(-size // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-size // ROWS)))
    return ManyFrame(rows.repartition(tasks, "key_hash").persist(), list(columns), list(flags), size)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def parts_of(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def summed(frame: ManyFrame, size: int, add, more: list[Column] | None = None) -> np.ndarray:
    """The sum over all rows of add(total, key_hash, y, x, flags), which adds to an array of `size` numbers; tasks send one
    row for each number that is not 0. Numbers of a row in `more` become a last argument, a column each."""
    d, p, m = len(frame.columns), len(frame.flags), len(more or [])
    added = [] if not more else [F.array(*(c.cast("double") for c in more)).alias("more")]

    def run(batches):
        total = np.zeros(size)
        for b in parts_of(batches):
            add(total, b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), d), matrix(b.column(3), p), *(matrix(c, m) for c in b.columns[4:]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "value"])

    sums = frame.rows.select("key_hash", "y", "x", "flags", *added).mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out


def mixed_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed_normal(key_hash: np.ndarray, salt: str) -> np.ndarray:
    """Normal numbers that depend on key and salt only, so a lost task repeats them (Box and Muller)."""
    import hashlib

    word = np.uint64(int.from_bytes(hashlib.sha256(salt.encode()).digest()[:8], "big"))
    one = mixed_bits(key_hash.astype(np.int64).view(np.uint64) ^ word)
    uniform = lambda bits: ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.sqrt(-2 * np.log(uniform(one))) * np.cos(2 * np.pi * uniform(mixed_bits(one)))


def squashed(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def counts(frame: ManyFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rows, rows with label 1) for each of the frame's flags."""

    def count(total, key_hash, y, x, flags):
        total = total.reshape(2, -1)
        total[0] += flags.sum(0)
        total[1] += (flags * y[:, None]).sum(0)

    return tuple(summed(frame, 2 * len(frame.flags), count).reshape(2, -1))


def label_weights(frame: ManyFrame, cells: list[Cell]) -> np.ndarray:
    """(cells x 2): what a row of label 0 and of label 1 weighs."""
    out = np.ones((len(cells), 2))
    n, ones = counts(frame) if any(c.options.class_weight == "balanced" for c in cells) else (None, None)
    for row, cell in zip(out, cells, strict=True):
        option = cell.options.class_weight
        if option == "balanced":
            k = frame.pattern(cell.learn)
            row[:] = [n[k] / (2 * m) if m else 1.0 for m in (n[k] - ones[k], ones[k])]
        elif option is not None:
            row[:] = [option.get(0, 1.0), option.get(1, 1.0)]
    return out


def fit_many_logistic(frame: ManyFrame, cells: list[Cell]) -> list[LogisticModel]:
    """The models of fit_logistic for every cell, in full batches; one job for each epoch. Where a cell asks for it, passive
    parties get clipped residuals with noise of their own, drawn from a hash of key, secret, party and epoch."""
    d, n = len(frame.columns), len(cells)
    place = {c: k for k, c in enumerate(frame.columns)}
    learn = np.array([frame.pattern(c.learn) for c in cells], int)
    weights, intercepts = np.zeros((n, d)), np.zeros(n)
    of_label = label_weights(frame, cells)
    for epoch in range(max((c.options.epochs for c in cells), default=0)):
        on = np.array([k for k, c in enumerate(cells) if epoch < c.options.epochs])
        w, b, rows_of, worth = weights[on], intercepts[on], learn[on], of_label[on]
        treated = [(at, cells[k]) for at, k in enumerate(on.tolist()) if cells[k].options.noise or cells[k].options.residual_clip]

        def add(total, key_hash, y, x, flags, w=w, b=b, rows_of=rows_of, worth=worth, treated=treated, epoch=epoch):
            total = total.reshape(len(w), d + 2)
            inside = flags[:, rows_of] * np.where(y[:, None] == 1, worth[:, 1], worth[:, 0])
            own = (squashed(x @ w.T + b) - y[:, None]) * inside
            gradient = own.T @ x
            for at, cell in treated:
                clip, noise = cell.options.residual_clip, cell.options.noise
                sent = np.clip(own[:, at], -clip, clip) if clip else own[:, at]
                for party, columns in list(cell.parties.items())[1:]:
                    drawn = noise * hashed_normal(key_hash, f"{cell.options.noise_secret or cell.options.seed}:{party}:{epoch}") if noise else 0.0
                    to = [place[c] for c in columns]
                    gradient[at, to] = (sent + drawn * (inside[:, at] > 0)) @ x[:, to]
            total[:, :d] += gradient
            total[:, d] += own.sum(0)
            total[:, d + 1] += inside.sum(0)

        sums = summed(frame, len(on) * (d + 2), add).reshape(len(on), d + 2)
        for k, row in zip(on.tolist(), sums, strict=True):
            options, count = cells[k].options, row[d + 1] or 1.0
            rate = options.rate(epoch)
            for columns in cells[k].parties.values():
                at = [place[c] for c in columns]
                gradient = row[at] / count + options.l2 * weights[k, at]
                norm = math.sqrt(float(gradient @ gradient))
                gradient *= options.clip / norm if options.clip and norm > options.clip else 1.0
                stepped = weights[k, at] - rate * gradient
                weights[k, at] = np.sign(stepped) * np.maximum(np.abs(stepped) - rate * options.l1, 0.0)
            intercepts[k] -= rate * row[d] / count
    return [LogisticModel(dict(c.parties), {col: float(weights[k, place[col]]) for cs in c.parties.values() for col in cs}, float(intercepts[k])) for k, c in enumerate(cells)]


class FlatTrees:
    """The trees of one model as arrays (feature place, bin or threshold, value, and whether a passive party owns the node)."""

    def __init__(self, model: GBDTModel, place: dict[str, int], codes: bool):
        active = next(iter(model.parties))
        size = 2 ** (model.options.depth + 1)
        self.depth = model.options.depth
        self.feature = np.full((len(model.trees), size), -1)
        self.cut, self.value, self.passive = np.zeros((len(model.trees), size)), np.zeros((len(model.trees), size)), np.zeros((len(model.trees), size), bool)
        for t, tree in enumerate(model.trees):
            for k, node in tree.items():
                if node.feature is None:
                    self.value[t, k] = model.leaf(node)
                else:
                    self.feature[t, k], self.passive[t, k] = place[node.feature], node.party != active
                    self.cut[t, k] = node.bin if codes else model.edges[node.feature][node.bin]

    def route(self, tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the node where each row ends, how many nodes of passive parties it met); missing values go right."""
        node, met, rows = np.ones(len(x), int), np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            feature = self.feature[tree, node]
            met += self.passive[tree, node]
            left = x[rows, feature] <= self.cut[tree, node]
            node = np.where(feature >= 0, 2 * node + ~left, node)
        return node, met


def quantile_edges(frame: ManyFrame, bins: dict[int, set[int]]) -> dict[tuple[int, int], dict[str, list[float]]]:
    """By (rows, bins): the distinct inner quantiles of every feature over those rows; one job with bounded sketches for all."""
    wanted = sorted({b for bs in bins.values() for b in bs})
    shares = sorted({k / b for b in wanted for k in range(1, b)})
    if not shares:
        return {}
    long = frame.rows.select("x", F.posexplode("flags").alias("pattern", "on")).where(F.col("on") & F.col("pattern").isin(*bins))
    value = lambda k: F.nullif(F.get("x", F.lit(k)), F.lit(float("nan")))
    found = long.groupBy("pattern").agg(*(F.percentile_approx(value(k), F.array(*map(F.lit, shares)), F.lit(SKETCH)).alias(f"q{k}") for k in range(len(frame.columns)))).collect()
    out = {}
    for row in found:
        for b in bins.get(row.pattern, ()):
            at = [shares.index(k / b) for k in range(1, b)]
            out[row.pattern, b] = {c: sorted({row[f"q{k}"][i] for i in at}) if row[f"q{k}"] else [] for k, c in enumerate(frame.columns)}
    return out


def coded(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin codes: how many edges lie below a value, all of them for a missing one."""
    out = np.empty(x.shape)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), len(e), np.searchsorted(e, x[:, k], side="left"))
    return out


def fit_many_gbdt(frame: ManyFrame, cells: list[Cell], edges: dict[tuple[int, int], dict[str, list[float]]] | None = None) -> list[GBDTModel]:
    """The models of fit_gbdt for every cell; one job for each level of each tree. Bins are cut at a sketch's quantiles of the
    rows that a cell learns from, unless edges are given. Tasks keep no state: margins come from the trees so far."""
    d = len(frame.columns)
    place = {c: k for k, c in enumerate(frame.columns)}
    learn = [frame.pattern(c.learn) for c in cells]
    bins: dict[int, set[int]] = {}
    for k, c in zip(learn, cells, strict=True):
        bins.setdefault(k, set()).add(c.options.bins)
    edges = edges or quantile_edges(frame, bins)

    n, ones = counts(frame)
    if any(n[k] == 0 for k in learn):
        raise ValueError("no rows to learn from")
    share = np.clip(ones / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    base = np.log(share / (1 - share))
    none = {c: [] for c in frame.columns}
    models = [GBDTModel(dict(c.parties), edges.get((k, c.options.bins), none), float(base[k]), c.options) for k, c in zip(learn, cells, strict=True)]
    for k in range(max((c.options.trees for c in cells), default=0)):
        grown: dict[int, dict[int, Node]] = {i: {1: Node(0.0, 0.0, 0)} for i, c in enumerate(cells) if k < c.options.trees}
        open_ = {i: [1] for i in grown}
        for level in range(max(cells[i].options.depth for i in grown)):
            todo = {i: nodes for i, nodes in open_.items() if nodes and level < cells[i].options.depth}
            if not todo:
                break
            hist = level_histograms(frame, {i: (models[i], learn[i], grown[i], nodes) for i, nodes in todo.items()}, place)
            for i, nodes in todo.items():
                options = cells[i].options
                features = [place[c] for cs in cells[i].parties.values() for c in cs]
                owner = {place[c]: p for p, cs in cells[i].parties.items() for c in cs}
                open_[i] = []
                for node, h in zip(nodes, hist[i], strict=True):
                    if node == 1:
                        g_all, h_all, n_all = h[:, features[0]].sum(1)
                        grown[i][1] = Node(float(g_all), float(h_all), int(n_all))
                    split = best_split(h, features, options)
                    if split is None:
                        continue
                    feature, cut, gain, g_left, h_left, n_left = split
                    mine = grown[i][node]
                    mine.feature, mine.bin, mine.gain, mine.party = frame.columns[feature], cut, gain, owner[feature]
                    grown[i][2 * node], grown[i][2 * node + 1] = Node(g_left, h_left, n_left), Node(mine.g - g_left, mine.h - h_left, mine.n - n_left)
                    open_[i] += [c for c in (2 * node, 2 * node + 1) if grown[i][c].n >= 2 * options.min_leaf]
        for i, tree in grown.items():
            models[i].trees.append(limit_leaves(tree, cells[i].options.max_leaves))
    return models


def level_histograms(frame: ManyFrame, cells: dict[int, tuple], place: dict[str, int]) -> dict[int, np.ndarray]:
    """By cell: (open node, [g, h, n], feature, bin) sums of a level, for all cells in one job."""
    names, d, spans, size = frame.columns, len(frame.columns), {}, 0
    for i, (model, _, _, nodes) in cells.items():
        spans[i] = (size, len(nodes), model.options.bins)
        size += len(nodes) * 3 * d * model.options.bins

    def add(total, key_hash, y, x, flags):
        made: dict = {}
        for i, (model, rows, tree, nodes) in cells.items():
            start, n_open, bins = spans[i]
            if (rows, bins) not in made:
                inside = flags[:, rows]
                made[rows, bins] = (coded(x[inside], [model.edges[c] for c in names]), y[inside])
            codes, own_y = made[rows, bins]
            margin = np.full(len(codes), model.base)
            done = FlatTrees(model, place, True)
            for t in range(len(model.trees)):
                margin += model.options.learning_rate * done.value[t, done.route(t, codes)[0]]
            p = squashed(margin)
            g, h = p - own_y, np.maximum(p * (1 - p), 1e-8)
            node = FlatTrees(replace(model, trees=[tree]), place, True).route(0, codes)[0]
            slot = np.full(2 ** (model.options.depth + 1), -1)
            slot[nodes] = np.arange(n_open)
            at = slot[node]
            there = at >= 0
            base = at[there] * d * bins
            view = total[start : start + n_open * 3 * d * bins].reshape(3, -1)
            for f in range(d):
                cell = base + f * bins + np.minimum(codes[there, f], bins - 1).astype(int)
                for row, value in enumerate((g[there], h[there], None)):
                    view[row] += np.bincount(cell, value, minlength=view.shape[1])

    sums = summed(frame, size, add)
    out = {}
    for i, (start, n_open, bins) in spans.items():
        out[i] = sums[start : start + n_open * 3 * d * bins].reshape(3, n_open, d, bins).transpose(1, 0, 2, 3)
    return out


def best_split(hist: np.ndarray, features: list[int], options: GBDTOptions) -> tuple | None:
    """(feature, bin, gain, g, h and n of the left side) with the largest positive gain, of equals the first in party order."""
    best = None
    for f in features:
        g, h, n = hist[:, f]
        gl, hl, nl = np.cumsum(g), np.cumsum(h), np.cumsum(n)
        part = lambda a, b: a * a / (b + options.reg_lambda)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.round(0.5 * (part(gl, hl) + part(gl[-1] - gl, hl[-1] - hl) - part(gl[-1], hl[-1])), 12)
        able = (nl >= options.min_leaf) & (nl[-1] - nl >= options.min_leaf) & (hl >= options.min_child_weight) & (hl[-1] - hl >= options.min_child_weight) & (gain > 0)
        if able.any():
            k = int(np.argmax(np.where(able, gain, -math.inf)))
            if best is None or gain[k] > best[2]:
                best = (f, k, float(gain[k]), float(gl[k]), float(hl[k]), int(nl[k]))
    return best


def scorer(frame: ManyFrame, models: list[LogisticModel | GBDTModel]):
    """A function of a matrix of features that gives (rows x models) every model's probabilities, and how many nodes of passive
    parties a row meets in its trees (0 for a logistic model)."""
    place = {c: k for k, c in enumerate(frame.columns)}
    linear = [k for k, m in enumerate(models) if isinstance(m, LogisticModel)]
    w = np.zeros((len(linear), len(frame.columns)))
    for row, k in zip(w, linear, strict=True):
        for c, value in models[k].weights.items():
            row[place[c]] = value
    b, n = np.array([models[k].intercept for k in linear]), len(models)
    forests = {k: (m.base, m.options.learning_rate, FlatTrees(m, place, False)) for k, m in enumerate(models) if isinstance(m, GBDTModel)}

    def score(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, met = np.zeros((len(x), n)), np.zeros((len(x), n), np.int64)
        if linear:
            p[:, linear] = squashed(x @ w.T + b)
        for k, (base, rate, trees) in forests.items():
            margin = np.full(len(x), base)
            for t in range(len(trees.value)):
                node, seen = trees.route(t, x)
                margin += rate * trees.value[t, node]
                met[:, k] += seen
            p[:, k] = squashed(margin)
        return p, met

    return score


def score_many(frame: ManyFrame, models: list[LogisticModel | GBDTModel]) -> DataFrame:
    """(id, y, flags, p array<double>, met array<bigint>): every row with what scorer() gives for it."""
    d, n, score = len(frame.columns), len(models), scorer(frame, models)

    def run(batches):
        for batch in parts_of(batches):
            upto = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
            lists = [pa.ListArray.from_arrays(upto, pa.array(v.ravel())) for v in score(matrix(batch.column(2), d))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *lists], ["id", "y", "flags", "p", "met"])

    kind = frame.rows.schema["id"].dataType.simpleString()
    return frame.rows.select("id", "y", "x", "flags").mapInArrow(run, f"id {kind}, y double, flags array<boolean>, p array<double>, met array<bigint>")


@dataclass(frozen=True)
class Curve:
    """Rows in the order of a model's scores: the model's place, the flags of which a row has one at least, the flag that is the
    rows' label (None: y), and whether they are ordered by how sure the model is, 2 * |p - 0.5|, in place of p."""

    cell: int
    rows: tuple[str, ...]
    label: str | None = None
    sure: bool = False


def curve_scores(frame: ManyFrame, curves: list[Curve]):
    """A function of (y, flags, p) that gives each curve's scores and labels."""
    places = [(c.cell, [frame.pattern(r) for r in c.rows], None if c.label is None else frame.pattern(c.label), c.sure) for c in curves]

    def scores(y, flags, p):
        for cell, rows, label, sure in places:
            inside = flags[:, rows].any(1)
            s = p[inside, cell]
            yield np.abs(s - 0.5) * 2.0 if sure else s, y[inside] == 1 if label is None else flags[inside, label]

    return scores


def curve_edges(frame: ManyFrame, models: list[LogisticModel | GBDTModel], curves: list[Curve]) -> list[list[float]]:
    """By curve: scores that cut it into ranges of about RANGE_ROWS rows, from a share of the rows, drawn by their hash. They
    decide how the work is dealt, never a result."""
    ranges = -(-frame.size // RANGE_ROWS)
    if ranges <= 1:
        return [[] for _ in curves]
    d, p, score, scores = len(frame.columns), len(frame.flags), scorer(frame, models), curve_scores(frame, curves)

    def run(batches):
        for b in parts_of(batches):
            found = [s for s, _ in scores(b.column(0).to_numpy(), matrix(b.column(2), p), score(matrix(b.column(1), d))[0])]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found])), pa.array(np.concatenate(found))], ["curve", "p"])

    drawn = frame.rows.where(F.pmod("key_hash", F.lit(max(1, RANGE_ROWS // EDGE_ROWS))) == 0).select("y", "x", "flags").mapInArrow(run, "curve bigint, p double")
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    out: list[list[float]] = [[] for _ in curves]
    for row in drawn.where(~F.isnan("p")).groupBy("curve").agg(F.percentile_approx("p", shares, F.lit(10 * ranges)).alias("edges")).collect():
        out[row["curve"]] = sorted(set(row["edges"]))
    return out


def curve_runs(frame: ManyFrame, models: list[LogisticModel | GBDTModel], curves: list[Curve]) -> DataFrame:
    """(curve, range, one, rows, p array<double>, n array<bigint>): in each task the distinct scores of a curve within a range
    of it, and how many of the task's rows of a label (1 or 0) have them."""
    d, width, score, scores, edges = len(frame.columns), len(frame.flags), scorer(frame, models), curve_scores(frame, curves), curve_edges(frame, models, curves)

    def sent(held):
        y, flags, p = (np.concatenate(v) for v in zip(*held, strict=True))
        heads, values, counts = [], [], []
        for curve, (s, one) in enumerate(scores(y, flags, p)):
            for label in (True, False):
                v, n = np.unique(s[one == label], return_counts=True)
                at = [0, *np.searchsorted(v, edges[curve], side="right"), len(v)]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    if a < b:
                        heads.append((curve, k, label, int(n[a:b].sum()), b - a))
                        values.append(v[a:b])
                        counts.append(n[a:b])
        if heads:
            curve, k, label, rows, lengths = zip(*heads, strict=True)
            upto = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(upto, pa.array(np.concatenate(v))) for v in (values, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(curve, pa.int64()), pa.array(k, pa.int64()), pa.array(label), pa.array(rows, pa.int64()), *lists], ["curve", "range", "one", "rows", "p", "n"])

    def run(batches):
        held, rows = [], 0
        for b in parts_of(batches):
            held.append((b.column(0).to_numpy(), matrix(b.column(2), width), score(matrix(b.column(1), d))[0]))
            rows += b.num_rows
            if rows * len(curves) >= SORTED_SCORES:
                yield from sent(held)
                held, rows = [], 0
        if held:
            yield from sent(held)

    return frame.rows.select("y", "x", "flags").mapInArrow(run, "curve bigint, range bigint, one boolean, rows bigint, p array<double>, n array<bigint>")


def curve_parts(table: pa.Table) -> pa.Table:
    """The sums of one range of a curve, from its runs; before them stand `above1` and `above0` rows of the two labels."""
    value = lambda name: table[name][0].as_py()
    pieces = lambda name: table[name].combine_chunks()
    one = np.repeat(pieces("one").to_numpy(zero_copy_only=False), pc.list_value_length(pieces("p")).to_numpy())
    scores, at = np.unique(pieces("p").flatten().to_numpy(), return_inverse=True)
    n = pieces("n").flatten().to_numpy()
    pos, neg = (np.bincount(at, n * label, len(scores))[::-1] for label in (one, ~one))
    tp, fp = value("above1") + np.cumsum(pos), value("above0") + np.cumsum(neg)
    ones, zeros = value("ones"), value("zeros")
    gap = float((tp / ones - fp / zeros).max()) if ones and zeros else None
    out = {"curve": [value("curve")], "u": [float((neg * (tp - pos / 2)).sum())], "ap": [float((pos * tp / (tp + fp)).sum())], "gap": [gap], "ones": [float(ones)], "zeros": [float(zeros)]}
    return pa.table(out, pa.schema([("curve", pa.int64()), *((c, pa.float64()) for c in list(out)[1:])]))


def curve_metrics(frame: ManyFrame, models: list[LogisticModel | GBDTModel], curves: list[Curve]) -> DataFrame:
    """(curve, roc_auc, pr_auc, gap) of every curve that has rows: the AUCs are NULL for a single class, gap is the largest
    difference of the two rates over all thresholds. Scores are sorted and counted where they are made, and meet by ranges of a
    curve, a task for each; what is sent is the distinct scores, once."""
    runs = checkpointed(curve_runs(frame, models, curves))
    totals = runs.groupBy("curve", "range").agg(*(F.sum(F.when(F.col("one") == label, F.col("rows")).otherwise(0)).alias(f"in{int(label)}") for label in (True, False)))
    above, whole = W.partitionBy("curve").orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("curve")  # a row for each range
    before = [F.coalesce(F.sum(f"in{k}").over(above), F.lit(0)).alias(f"above{k}") for k in (1, 0)]
    ends = totals.select("curve", "range", *before, F.sum("in1").over(whole).alias("ones"), F.sum("in0").over(whole).alias("zeros"))
    parts = runs.join(F.broadcast(ends), ["curve", "range"]).groupBy("curve", "range").applyInArrow(curve_parts, "curve bigint, u double, ap double, gap double, ones double, zeros double")
    sums = parts.groupBy("curve").agg(F.sum("u").alias("u"), F.sum("ap").alias("ap"), F.max("gap").alias("gap"), F.max("ones").alias("ones"), F.max("zeros").alias("zeros"))
    return sums.select("curve", F.try_divide("u", F.col("ones") * F.col("zeros")).alias("roc_auc"), F.when(F.col("zeros") > 0, F.try_divide("ap", "ones")).alias("pr_auc"), "gap")


def by_cell(scored: DataFrame, flags: list[int]) -> DataFrame:
    """(cell, id, y, p, met) for the rows in which each cell's flag (a place in flags) holds."""
    whole = scored.select("id", "y", "flags", F.posexplode(F.arrays_zip("p", "met")).alias("cell", "own"))
    return whole.where(F.get("flags", F.get(F.array(*map(F.lit, flags)), F.col("cell")))).select("cell", "id", "y", "own.p", "own.met")
