"""Leakage measures, differentially private releases and exact sums in a prime field, over DataFrames."""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.functions.scalar import clipped, hash_order, hash_uniform, hmac_sha256, let, normal_quantile, number
from partyframe.operators.evaluate import EPSILON, curve_points, ranking_metrics, score_table
from partyframe.operators.logistic import LogisticOptions, fit_logistic, score_logistic
from partyframe.operators.relational import psi_align

# Fixed value: the Mersenne prime of the field.
PRIME = 2**61 - 1


# ---- attacks


def best_advantage(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row (threshold, advantage): the largest true minus false positive rate over all scores, 0 and 1 + epsilon; of
    equals the lowest threshold."""
    points = curve_points(df, y, p).select("threshold", F.round(F.col("tpr") - F.col("fpr"), 12).alias("advantage"))
    ends = df.sparkSession.createDataFrame([(0.0, 0.0), (1.0 + EPSILON, 0.0)], "threshold double, advantage double")
    return points.unionByName(ends).orderBy(F.desc("advantage"), "threshold").limit(1)


def membership_inference(train: DataFrame, holdout: DataFrame, p: str = "p") -> DataFrame:
    """One row: how well the confidence |p - 0.5| * 2 tells training rows from others."""
    score = lambda d, y: d.select(F.lit(y).alias("y"), (F.abs(F.col(p) - 0.5) * 2.0).alias("p"))
    both = score(train, 1).unionAll(score(holdout, 0))
    n = both.agg(F.count_if(F.col("y") == 1).alias("train_count"), F.count_if(F.col("y") == 0).alias("holdout_count"))
    return ranking_metrics(score_table(both)).select("roc_auc").crossJoin(best_advantage(both)).crossJoin(n)


def label_inference(df: DataFrame, residual: Column, y: str = "y", tolerance: float = 1e-12) -> DataFrame:
    """One row: how often the sign of a residual p - y (or of a gradient) tells the label."""
    marked = df.select(F.col(y).alias("y"), residual.alias("v"))
    exposed, guess = F.abs("v") > tolerance, (F.col("v") < 0).cast("int")
    return marked.agg(F.avg(F.when(exposed, (guess == F.col("y")).cast("double"))).alias("accuracy"), F.count_if(exposed).alias("exposed_count"), F.count_if(~exposed).alias("ambiguous_count"))


def routing_exposure(events: DataFrame, total: int, entity: str = "entity", approximate: bool = False) -> DataFrame:
    """One row: routed entity events, entities exposed, their share, events per exposed entity."""
    distinct = F.approx_count_distinct(entity, 0.01) if approximate else F.count_distinct(entity)
    sums = events.agg(F.count(entity).alias("events"), distinct.alias("unique_entities"))
    return sums.select("events", "unique_entities", (F.col("unique_entities") / float(total)).alias("exposed_fraction"), F.coalesce(F.try_divide(F.col("events").cast("double"), F.col("unique_entities")), F.lit(0.0)).alias("events_per_entity"))


def moments(df: DataFrame, left: list[str], right: list[str], centres: dict[str, float]) -> np.ndarray:
    """Sums of products of the centred columns of left with those of left and right: tasks send one matrix each, as
    (place, value) rows, so what reaches the driver is len(left) * (len(left) + len(right)) numbers for any number of rows."""
    k, names = len(left), [*left, *right]
    middle = np.array([centres[c] for c in names])

    def multiply(batches):
        total = np.zeros((k, len(names)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - middle
            total += x[:, :k].T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    out = np.zeros(k * len(names))
    for row in df.select(*(F.col(c).cast("double").alias(c) for c in names)).mapInArrow(multiply, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[row.place] = row.value
    return out.reshape(k, len(names))


@dataclass(frozen=True)
class RidgeAttacker:
    """Reads features from messages: feature = offset + message . slopes."""

    messages: list[str]
    features: list[str]
    slopes: np.ndarray  # messages x features
    offsets: np.ndarray


def fit_attacker(calibration: DataFrame, messages: list[str], features: list[str], alpha: float = 1e-3) -> RidgeAttacker:
    """A ridge regression of all features on all messages at once: means, then one pass for the Gram matrix and the cross
    products, solved on the driver. The offset is not shrunk; with alpha 0 a singular system has its smallest solution."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    refuse_unfit(calibration, messages, features)
    means = calibration.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in (*messages, *features))).first().asDict()
    k = len(messages)
    found = moments(calibration, messages, features, means)
    slopes = np.linalg.lstsq(found[:, :k] + alpha * np.eye(k), found[:, k:], rcond=None)[0]
    mean = lambda names: np.array([means[c] for c in names])
    return RidgeAttacker(list(messages), list(features), slopes, mean(features) - mean(messages) @ slopes)


def refuse_unfit(df: DataFrame, messages: list[str], features: list[str]) -> int:
    """The number of rows; fewer than two, or values that are missing or not finite, are refused."""
    if not messages or not features or set(messages) & set(features):
        raise ValueError("messages and features must be named, and apart")
    names = [*messages, *features]
    found = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(number(c).isNull()).alias(c) for c in names)).first()
    if found["_n"] < 2:
        raise ValueError("reconstruction needs two rows on each side")
    if bad := [c for c in names if found[c]]:
        raise ValueError(f"not finite: {', '.join(bad)}")
    return found["_n"]


def reconstruct_features(calibration: DataFrame, evaluation: DataFrame, messages: list[str], features: list[str], alpha: float = 1e-3) -> DataFrame:
    """(feature, r2, mae): how well a ridge attacker that has seen messages with features reads the features of others. A
    feature that does not vary has r2 1 if it is met exactly, else 0."""
    attacker = fit_attacker(calibration, messages, features, alpha)
    refuse_unfit(evaluation, messages, features)
    k = len(messages)

    def miss(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            guess = attacker.offsets + x[:, :k] @ attacker.slopes
            place = np.tile(np.arange(len(features), dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(x[:, k:].ravel()), pa.array(guess.ravel())], ["place", "x", "g"])

    guessed = evaluation.select(*(F.col(c).cast("double").alias(c) for c in (*messages, *features))).mapInArrow(miss, "place int, x double, g double")
    off = F.col("x") - F.col("g")
    sums = guessed.groupBy("place").agg(F.sum(off * off).alias("left"), (F.var_pop("x") * F.count("x")).alias("all"), F.avg(F.abs(off)).alias("mae"))
    r2 = F.when(F.col("all") > 0, 1 - F.col("left") / F.col("all")).when(F.col("left") > 0, 0.0).otherwise(1.0)
    return sums.select(F.get(F.array(*map(F.lit, features)), F.col("place")).alias("feature"), r2.alias("r2"), "mae")


def reconstruction_summary(calibration: DataFrame, evaluation: DataFrame, messages: list[str], features: list[str], alpha: float = 1e-3) -> DataFrame:
    """One row: mean and largest r2, mean error, and how many dimensions and rows there were."""
    each = reconstruct_features(calibration, evaluation, messages, features, alpha)
    counts = [F.lit(len(messages)).alias("exposed_dimensions"), F.lit(len(features)).alias("reconstructed_features"), F.lit(calibration.count()).alias("calibration_count"), F.lit(evaluation.count()).alias("evaluation_count")]
    return each.agg(F.avg("r2").alias("mean_r2"), F.max("r2").alias("max_r2"), F.avg("mae").alias("mean_mae")).select("*", *counts)


# ---- releases


@dataclass
class ZCDPAccountant:
    """Repeated Gaussian releases: rho = k / (2 s^2), epsilon = rho + 2 sqrt(rho ln(1 / delta))."""

    noise_multiplier: float
    releases: int = 0

    def __post_init__(self):
        if not math.isfinite(self.noise_multiplier) or self.noise_multiplier <= 0 or self.releases < 0:
            raise ValueError("the noise multiplier must be positive, releases not negative")

    @property
    def rho(self) -> float:
        return self.releases / (2 * self.noise_multiplier**2)

    def epsilon(self, delta: float) -> float:
        if not 0 < delta < 1:
            raise ValueError("delta must be within (0, 1)")
        return self.rho + 2 * math.sqrt(self.rho * math.log(1 / delta))


def zcdp_epsilon(releases: Column, noise_multiplier: Column, delta: float) -> Column:
    rho = releases / (2 * noise_multiplier * noise_multiplier)
    return rho + 2 * F.sqrt(rho * math.log(1 / delta))


def clip_rows(df: DataFrame, columns: list[str], bound: float) -> DataFrame:
    """Rows scaled down to an L2 norm of `bound` over the columns."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0])))
    shrink = F.when(norm > bound, bound / norm).otherwise(1.0)
    return df.withColumns({c: F.col(c) * shrink for c in columns})


def secret_key(secret: bytes) -> str:
    """A secret as text for hash columns; nobody without it can repeat what is drawn from it."""
    if len(secret) < 16:
        raise ValueError("a secret needs 16 bytes")
    return secret.hex()


def gaussian_release(df: DataFrame, columns: list[str], key: str, bound: float, noise_multiplier: float, secret: bytes, replace_one: bool = True) -> tuple[DataFrame, ZCDPAccountant]:
    """The columns clipped, with Gaussian noise of deviation sensitivity * multiplier (sensitivity 2 * bound where one
    row is replaced, bound where it is added). The noise depends on the secret, the column and the key: a lost task
    repeats it, and who lacks the secret cannot take it off again. A secret serves one release."""
    deviation = (2 * bound if replace_one else bound) * noise_multiplier
    noisy = lambda c: F.col(c) + normal_quantile(clipped(hash_uniform(key, seed=f"{secret_key(secret)}:{c}"), 1e-12, 1 - 1e-12)) * deviation
    return clip_rows(df, columns, bound).withColumns({c: noisy(c) for c in columns}), ZCDPAccountant(noise_multiplier, 1)


def fit_protected(df: DataFrame, parties: dict[str, list[str]], epochs: int, clip: float, noise_multiplier: float, y: str = "y", key: str = "id", salt: str | None = None, others: list[DataFrame] | None = None, secret: bytes | None = None):
    """Aligned entities, then training in which every passive party gets clipped residuals with noise of its own;
    (model, accountant). Without a secret a new one is drawn, so no run repeats another's noise."""
    aligned = psi_align([df, *others], key, salt or "align")[0] if others else df
    options = LogisticOptions(epochs=epochs, residual_clip=clip, noise=2 * clip * noise_multiplier, noise_secret=secret_key(secret or secrets.token_bytes(32)))
    return fit_logistic(aligned, parties, y, key, options), ZCDPAccountant(noise_multiplier, epochs * (len(parties) - 1))


def measures(df: DataFrame, attack: str, names: tuple[str, ...]) -> DataFrame:
    """(attack, measure, value) of the named columns of one row."""
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in names))
    return df.select(F.lit(attack).alias("attack"), F.explode(pairs).alias("e")).select("attack", "e.*")


def privacy_audit(train: DataFrame, holdout: DataFrame, model, y: str = "y", observed: str | None = None, routed: DataFrame | None = None, entities: int | None = None) -> DataFrame:
    """(attack, measure, value): how well a model's outputs tell training rows, and how well residuals tell labels. With a
    passive party `observed`, also how well its logits, which the active party receives, tell its features: an attacker
    learns from train and reads holdout. With routing events (operators.replay) of passive parties, how many entities they
    expose among `entities`."""
    seen, unseen = (score_logistic(df, model) for df in (train, holdout))
    rows = [
        measures(membership_inference(seen, unseen), "membership", ("roc_auc", "advantage")),
        measures(label_inference(seen, F.col("p") - F.col(y), y), "label", ("accuracy", "exposed_count", "ambiguous_count")),
    ]
    if observed is not None:
        columns = model.parties[observed]
        message = sum((F.col(c) * model.weights[c] for c in columns[1:]), F.col(columns[0]) * model.weights[columns[0]])
        sides = [df.select(message.alias("_message"), *columns) for df in (train, holdout)]
        rows.append(measures(reconstruction_summary(*sides, ["_message"], columns), f"reconstruction of {observed}", ("mean_r2", "max_r2", "mean_mae")))
    if routed is not None:
        rows.append(measures(routing_exposure(routed, entities or train.count()), "routing", ("events", "unique_entities", "exposed_fraction", "events_per_entity")))
    return reduce(DataFrame.unionByName, rows)


# ---- exact sums modulo the prime


def to_field(c: Column) -> Column:
    return F.pmod(c.cast("bigint"), F.lit(PRIME))


def from_field(c: Column) -> Column:
    return F.when(c > PRIME // 2, c - PRIME).otherwise(c).cast("bigint")


def pair_masks(round_id: str, secret: bytes):
    """A column function: HMAC-SHA256 of round and index under the pair's secret, in the field, all in the JVM. The digest is
    taken 60 bits at a time; twice 2**60 is 1 modulo the prime, so a step is a rotation of 61 bits and a sum."""
    if len(secret) < 16:
        raise ValueError("a pair's secret needs 16 bytes")

    def step(out: Column, part: Column) -> Column:
        turned = F.shiftright(out, 1) + F.shiftleft(out.bitwiseAND(F.lit(1).cast("bigint")), 60)
        return F.pmod(turned + part, F.lit(PRIME))

    def mask(index: Column) -> Column:
        digest = hmac_sha256(F.concat(F.lit(f"{round_id}:"), index.cast("string")), secret)
        number_at = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("bigint")
        return let(digest, lambda h: F.aggregate(F.array(*(number_at(h, at, 15) for at in range(5, 65, 15))), number_at(h, 1, 4), step))

    return mask


def mask_update(df: DataFrame, index: str, value: str, party: str, parties: list[str], secrets: dict[tuple[str, str], bytes], round_id: str) -> DataFrame:
    """(index, value) with a mask per peer added (towards later names) or taken off; the masks cancel in the sum."""
    if party not in parties or len(set(parties)) != len(parties):
        raise ValueError("party names must be distinct and include the party")
    out = to_field(F.col(value))
    for peer in parties:
        if peer != party:
            pair = (min(party, peer), max(party, peer))
            if pair not in secrets:
                raise ValueError(f"no secret for {pair}")
            mask = pair_masks(round_id, secrets[pair])(F.col(index))
            out = F.pmod(out + mask if party < peer else out - mask, F.lit(PRIME))
    return df.select(index, out.alias(value))


def secure_sum(updates: list[DataFrame], index: str, value: str) -> DataFrame:
    """(index, value): the sum of masked updates, masks cancelled, as signed integers."""
    all_ = updates[0]
    for u in updates[1:]:
        all_ = all_.unionByName(u)
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    return all_.groupBy(index).agg(from_field((total % F.lit(PRIME).cast("decimal(38,0)")).cast("bigint")).alias(value))


def additive_shares(df: DataFrame, index: str, value: str, shares: int, secret: bytes) -> DataFrame:
    """(index, share, value): shares that sum up to the value in the field; all but the last are drawn from the secret by
    HMAC as masks are, so a lost task repeats them."""
    if shares < 2:
        raise ValueError("two shares at least")
    draws = [pair_masks(f"share {k}", secret) for k in range(shares - 1)]
    draw = lambda k: draws[k](F.col(index))
    last = to_field(F.col(value))
    for k in range(shares - 1):
        last = F.pmod(last - draw(k), F.lit(PRIME))
    every = F.array(*(draw(k) for k in range(shares - 1)), last)
    return df.select(index, F.posexplode(every).alias("share", value))


class UnavailableBackendError(RuntimeError):
    """A cryptographic backend that is not installed here."""


def cryptographic_backend(name: str):
    """Set intersection and homomorphic sums of third parties are not part of this engine: asking for one fails."""
    raise UnavailableBackendError(f"{name} is not available; nothing weaker is used in its place")


# ---- summaries of repeated measurements


Z = 1.959963984540054
# Fixed value: the terms of the expansion of Student's 0.975 quantile in powers of one over the degrees of freedom.
T_EXPANSION = (
    Z,
    (Z**3 + Z) / 4,
    (5 * Z**5 + 16 * Z**3 + 3 * Z) / 96,
    (3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384,
    (79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160,
)


def t_critical(df: int) -> float:
    """The 0.975 quantile of Student's t with df degrees of freedom: from its distribution function's finite series, or, of many,
    by expansion around the normal quantile, where both agree to twelve digits."""
    if df > 1000:
        return sum(term / df**k for k, term in enumerate(T_EXPANSION))
    low, high = 0.0, 13.0
    for _ in range(80):
        t = (low + high) / 2
        low, high = (t, high) if t_two_sided(t, df) < 0.95 else (low, t)
    return (low + high) / 2


def t_two_sided(t: float, df: int) -> float:
    """P(|T| <= t)."""
    angle = math.atan(t / math.sqrt(df))
    cos2, term, total = math.cos(angle) ** 2, 1.0, 1.0 if df > 1 else 0.0
    for k in range(2 if df % 2 == 0 else 3, df - 1, 2):
        term *= cos2 * (k - 1) / k
        total += term
    return math.sin(angle) * total if df % 2 == 0 else 2 / math.pi * (angle + (math.sin(angle) * math.cos(angle) * total if df > 1 else 0.0))


def interval_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, std, ci95_low, ci95_high): Student intervals; one value has width 0, none gives NULLs."""
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))

    def quantiles(batches):
        for batch in batches:
            t = pa.array([t_critical(n - 1) for n in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), t], ["n", "_t"])

    table = sums.select("n").where("n > 1").distinct().mapInArrow(quantiles, "n long, _t double")
    half = F.coalesce(F.col("_t") * F.col("std") / F.sqrt("n"), F.lit(0.0))
    std = F.when(F.col("n") == 1, 0.0).otherwise(F.col("std"))
    return sums.join(table, "n", "left").select(*by, "n", "mean", std.alias("std"), (F.col("mean") - half).alias("ci95_low"), (F.col("mean") + half).alias("ci95_high"))


def clip_support(df: DataFrame, low: str, high: str, support: tuple[float, float]) -> DataFrame:
    """Interval ends within a bounded metric's support, the raw ends beside them."""
    return df.withColumns({f"{c}_raw": F.col(c) for c in (low, high)}).withColumns({c: clipped(F.col(c), *support) for c in (low, high)})


def flatten_summary(df: DataFrame, by: list[str], metric: str, stats: list[str], metrics: list[str]) -> DataFrame:
    """Rows per metric to one row with a column per metric and statistic."""
    return df.groupBy(*by).agg(*(F.max(F.when(F.col(metric) == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in stats))
