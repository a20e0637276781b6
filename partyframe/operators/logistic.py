"""Vertical logistic regression: parties hold columns, one driver loop, one distributed aggregate per batch.

Each party's columns give a partial logit; residuals weigh them into gradients. A batch is one job that returns as many
numbers as there are weights, over a cached frame, and the plan does not grow from epoch to epoch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.functions.scalar import clipped, hash_order, hash_uniform, normal_quantile, sigmoid


class MissingPartyError(ValueError):
    """A party that the model needs holds no columns here."""


@dataclass(frozen=True)
class LogisticOptions:
    learning_rate: float = 0.08
    epochs: int = 500
    l2: float = 1e-3
    l1: float = 0.0
    batches: int = 1
    schedule: str = "constant"  # or inverse_sqrt, linear_decay
    clip: float | None = None  # of each party's gradient norm
    class_weight: str | dict[int, float] | None = None  # or balanced
    tolerance: float = 0.0
    patience: int | None = None
    noise: float = 0.0  # deviation of the noise on what passive parties receive
    noise_secret: str | None = field(default=None, repr=False)  # what the noise is drawn from; without it anyone who knows the seed can repeat it
    residual_clip: float | None = None  # bound of a residual that a passive party receives
    seed: int = 42

    def __post_init__(self):
        good = self.learning_rate > 0 and self.epochs >= 0 and self.l1 >= 0 and self.l2 >= 0 and self.batches > 0 and self.tolerance >= 0 and self.noise >= 0
        if not good or (self.clip is not None and self.clip <= 0) or (self.patience is not None and self.patience <= 0) or self.schedule not in ("constant", "inverse_sqrt", "linear_decay"):
            raise ValueError("unusable options")

    def rate(self, epoch: int) -> float:
        if self.schedule == "inverse_sqrt":
            return self.learning_rate / math.sqrt(epoch + 1)
        if self.schedule == "linear_decay":
            return self.learning_rate * max(0.05, 1 - epoch / max(self.epochs, 1))
        return self.learning_rate


@dataclass(frozen=True)
class LogisticModel:
    parties: dict[str, list[str]]  # the active party first
    weights: dict[str, float]
    intercept: float = 0.0
    history: list[dict] = field(default_factory=list)

    def logit(self, present: set[str] | None = None) -> Column:
        z = F.lit(self.intercept)
        for party, columns in self.parties.items():
            if present is None or party in present:
                for c in columns:
                    z = z + F.col(c) * F.lit(self.weights[c])
        return z


def soft_threshold(w: float, by: float) -> float:
    return math.copysign(max(abs(w) - by, 0.0), w)


def class_weights(df: DataFrame, y: str, option) -> Column:
    if option is None:
        return F.lit(1.0)
    if option == "balanced":
        n, ones = df.agg(F.count(F.lit(1)), F.count_if(F.col(y) == 1)).first()
        option = {1: n / (2 * ones) if ones else 1.0, 0: n / (2 * (n - ones)) if n > ones else 1.0}
    return F.when(F.col(y) == 1, float(option.get(1, 1.0))).otherwise(float(option.get(0, 1.0)))


def mean_loss(z: Column, y: str, weight: Column) -> Column:
    p = clipped(sigmoid(z), 1e-12, 1 - 1e-12)
    one = F.col(y).cast("double")
    return F.sum(-weight * (one * F.log(p) + (1 - one) * F.log(1 - p))) / F.sum(weight)


def fit_logistic(df: DataFrame, parties: dict[str, list[str]], y: str = "y", key: str = "id", options: LogisticOptions | None = None, validation: DataFrame | None = None, start: LogisticModel | None = None) -> LogisticModel:
    """Proximal gradient descent. L2 joins the gradient before a party's gradient is clipped, L1 follows the step, the
    intercept has neither. The tolerance is tested before an update (strictly), patience counts epochs without a better
    validation loss and brings the best weights back. Passive parties get clipped and noisy residuals where asked for;
    the active party uses its own. Batches are dealt by a hash of key and epoch. NULL features are refused.
    """
    options = options or LogisticOptions()
    columns = [c for cs in parties.values() for c in cs]
    active = next(iter(parties))
    bad = df.agg(F.count_if(~F.col(y).isin(0, 1) | F.col(y).isNull()).alias("y"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    if any(bad):
        raise ValueError(f"labels other than 0 and 1, or missing features: {bad.asDict()}")
    frame = df.select(key, F.col(y).cast("int").alias(y), *(F.col(c).cast("double").alias(c) for c in columns)).withColumn("_w", class_weights(df, y, options.class_weight)).persist()
    held = validation.withColumn("_w", class_weights(validation, y, options.class_weight)).persist() if validation is not None else None
    weights = dict(start.weights) if start else dict.fromkeys(columns, 0.0)
    intercept, history, best, last = (start.intercept if start else 0.0), [], None, None
    penalty = lambda: 0.5 * options.l2 * sum(w * w for w in weights.values()) + options.l1 * sum(abs(w) for w in weights.values())
    try:
        for epoch in range(options.epochs):
            rate, loss = options.rate(epoch), None
            for batch in range(options.batches):
                z = LogisticModel(parties, weights, intercept).logit()
                inside = frame if options.batches == 1 else frame.where(hash_order(key, seed=options.seed + epoch) % options.batches == batch)
                own = (sigmoid(z) - F.col(y)) * F.col("_w")
                sent = clipped(own, -options.residual_clip, options.residual_clip) if options.residual_clip else own
                # every passive party gets noise of its own
                draw = lambda p, at=(epoch, batch): normal_quantile(clipped(hash_uniform(key, seed=":".join(map(str, (options.noise_secret or options.seed, p, *at)))), 1e-12, 1 - 1e-12)) * options.noise
                received = {p: own if p == active else sent + draw(p) if options.noise else sent for p in parties}
                scale = F.sum("_w")
                row = inside.agg(
                    scale.alias("_n"), (F.sum(own) / scale).alias("_b"), mean_loss(z, y, F.col("_w")).alias("_loss"),
                    *((F.sum(F.col(c) * received[p]) / scale).alias(c) for p, cs in parties.items() for c in cs),
                ).first()
                if row["_n"] is None:
                    continue
                if batch == 0 and options.batches == 1:
                    loss = row["_loss"] + penalty()
                    if last is not None and abs(last - loss) < options.tolerance:
                        return LogisticModel(parties, weights, intercept, [*history, {"epoch": epoch, "loss": loss, "rate": 0.0, "validation": None}])
                    last = loss
                stepped = {}
                for cs in parties.values():
                    grads = {c: row[c] + options.l2 * weights[c] for c in cs}
                    norm = math.sqrt(sum(g * g for g in grads.values()))
                    shrink = options.clip / norm if options.clip and norm > options.clip else 1.0
                    stepped |= {c: soft_threshold(weights[c] - rate * shrink * g, rate * options.l1) for c, g in grads.items()}
                weights, intercept = stepped, intercept - rate * row["_b"]
            seen = None
            if held is not None:
                seen = held.agg(mean_loss(LogisticModel(parties, weights, intercept).logit(), y, F.col("_w"))).first()[0] + penalty()
            history.append({"epoch": epoch, "loss": loss, "rate": rate, "validation": seen})
            if seen is not None and options.patience:
                if best is None or seen < best[0]:
                    best = (seen, epoch, dict(weights), intercept)
                elif epoch - best[1] >= options.patience:
                    break
        if best is not None:
            weights, intercept = best[2], best[3]
        return LogisticModel(parties, weights, intercept, history)
    finally:
        frame.unpersist()
        if held is not None:
            held.unpersist()


def score_logistic(df: DataFrame, model: LogisticModel, missing_party: str = "error", threshold: float = 0.5) -> DataFrame:
    """df with logit, p and predicted. A passive party without columns here is an error, or counts nothing with
    zero_contribution; the active party must be there."""
    present = {p for p, cs in model.parties.items() if all(c in df.columns for c in cs)}
    absent = [p for p in model.parties if p not in present]
    if absent and (missing_party != "zero_contribution" or absent[0] == next(iter(model.parties))):
        raise MissingPartyError(f"no columns of {', '.join(absent)}")
    scored = df.withColumn("logit", model.logit(present)).withColumn("p", sigmoid("logit"))
    return scored.withColumn("predicted", (F.col("p") >= threshold).cast("int"))


def history_frame(df: DataFrame, model) -> DataFrame:
    rows = [(h["epoch"], h["loss"], h["rate"], h["validation"]) for h in model.history]
    return df.sparkSession.createDataFrame(rows, "epoch int, loss double, rate double, validation double")


def message_volume(rows: int, passive: int, epochs: int, batches: int = 1, validation_rows: int = 0, stopped: bool = False) -> dict[str, int]:
    """What a run of so many epochs with updates sends between parties, in closed form; 8 bytes a number."""
    c, v = int(stopped), int(validation_rows > 0)
    messages = passive * (epochs * (1 + 2 * batches + v) + c + 1)
    scalars = passive * (epochs * (3 * rows + v * validation_rows) + (c + 1) * rows)
    return {"messages": messages, "scalars": scalars, "bytes": 8 * scalars}


def coefficient_importance(df: DataFrame, model: LogisticModel) -> DataFrame:
    """(party, feature, weight, importance): |weight * population deviation|, largest first."""
    row = df.agg(*(F.stddev_pop(c).alias(c) for c in model.weights)).first()
    rows = [(p, c, model.weights[c], abs(model.weights[c] * (row[c] or 0.0))) for p, cs in model.parties.items() for c in cs]
    return df.sparkSession.createDataFrame(rows, "party string, feature string, weight double, importance double").orderBy(F.desc("importance"), "party", "feature")
