"""Projection, filter, join and alignment operators over party frames keyed by an entity id."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.scalar import hash_order, number
from partyframe.operators.audit import row_digest
from partyframe.operators.ranking import ordered_place, quantile_frame

MINIMUM_ENTITIES = 100


class MissingColumnsError(ValueError):
    """Columns that an operator needs are not there."""


class AlignmentError(ValueError):
    """Parties do not hold the same entities."""


class TargetLeakError(ValueError):
    """A linkage input names the target."""


def coerce_numeric(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Those of the columns that exist, as doubles (unparsable: NULL), after the columns to keep as they are."""
    return df.select(*keep, *(number(c).alias(c) for c in columns if c in df.columns))


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename provider columns unless the new name is taken already."""
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})


def resolve_columns(df: DataFrame, wanted: Iterable[str]) -> dict[str, str]:
    """wanted name to the actual column whose name is equal but for case and white space."""
    plain = lambda s: re.sub(r"\s+", "", s.strip()).casefold()
    actual = {plain(c): c for c in df.columns}
    return {w: actual[plain(w)] for w in wanted if plain(w) in actual}


def select_required(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna("any", subset=list(columns))


def cutoff_of(df: DataFrame, col: str, q: float = 0.70) -> DataFrame:
    """One row with the linear q-quantile of a time column in microseconds."""
    return quantile_frame(df.select(F.unix_micros(F.col(col).cast("timestamp")).cast("double").alias("_t")), "_t", q, "_cut")


def until_cutoff(df: DataFrame, col: str, q: float = 0.70) -> DataFrame:
    """Rows up to the q-quantile of their time. The quantile is one row, joined by broadcast."""
    return df.crossJoin(F.broadcast(cutoff_of(df, col, q))).where(F.unix_micros(F.col(col).cast("timestamp")) <= F.col("_cut")).drop("_cut")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, those first by a hash of seed and key (a top-n, not a sort of the table)."""
    return df.withColumn("_h", hash_order(key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")


def split_columns(df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertical split: the first half of the features is the active party's, the others the passive one's."""
    if len(features) < 2:
        raise ValueError("a vertical split needs two features")
    if len(set(features)) != len(features):
        raise ValueError("features repeat")
    half = len(features) // 2
    return df.select(key, *features[:half]), df.select(key, *features[half:])


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, checked when it runs: a repeated key fails the job. One window over the key, which a join on it reuses."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))).otherwise(F.col(key))
    return df.withColumn(key, checked.cast(df.schema[key].dataType))


def link_exact(key: str, *frames: DataFrame, least: int = 0, one_to_one: bool = True) -> DataFrame:
    """Inner join of frames on key; columns that clash get the frame's number as suffix; too few entities fail."""
    out, seen = None, {key}
    for k, frame in enumerate(frames):
        frame = frame.withColumnsRenamed({c: f"{c}_{k}" for c in frame.columns if c != key and c in seen})
        seen |= set(frame.columns)
        frame = assert_unique(frame, key) if one_to_one else frame
        out = frame if out is None else out.join(frame, key)
    if least and out.limit(least).count() < least:
        raise AlignmentError(f"fewer than {least} linked entities")
    return out


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def psi_align(frames: list[DataFrame], key: str, salt: str) -> list[DataFrame]:
    """Each frame reduced to the entities that all hold, found by salted digests of the ids; no id but the caller's own
    is compared in clear. A party whose ids repeat or are NULL, and an empty intersection, fail. The first party is the
    active one: its order is the canonical one, and as rows are joined by key no other is needed."""
    if not salt:
        raise ValueError("the salt must not be empty")
    for k, f in enumerate(frames):
        bad = f.groupBy(key).count().agg(F.count_if(F.col(key).isNull()).alias("nulls"), F.count_if(F.col("count") > 1).alias("repeated")).first()
        if bad.nulls or bad.repeated:
            raise AlignmentError(f"party {k}: ids must be there and unique; {bad.repeated} repeat" + ", some are NULL" * bool(bad.nulls))
    digests = [f.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256).alias("_d")) for f in frames]
    common = digests[0]
    for d in digests[1:]:
        common = common.join(d, "_d", "left_semi")
    if common.isEmpty():
        raise AlignmentError("the parties have no entity in common")
    own = lambda f: f.withColumn("_d", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256))
    return [own(f).join(common, "_d", "left_semi").drop("_d") for f in frames]


def require_bound(digests: dict[str, str | None], required: bool = False) -> None:
    """Order digests by party: all missing is fine unless they are required, some missing or different ones are not."""
    bound = {p: d for p, d in digests.items() if d is not None}
    if not bound and not required:
        return
    if len(bound) < len(digests):
        raise AlignmentError(f"no order digest of {', '.join(sorted(set(digests) - set(bound)))}")
    if len(set(bound.values())) > 1:
        raise AlignmentError("the parties' entities differ in number or order")


def order_digest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row with `digest`, which changes with the ids or their order: the digest of all (place, id), places by `order`, then
    id. Places come from written ranges of the order and hashes are summed in every task, so no task holds more than its range."""
    placed = ordered_place(df.select(F.col(order).alias("_order"), F.col(key).cast("string").alias("key")), [F.col("_order"), F.col("key")], "place")
    return row_digest(placed.select("key", "place")).select("digest")


def alignment_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: entities of a only, of b only, and repeated ids. All zero means that the parties can be joined."""
    each = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionAll(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    sums = each.groupBy(key).agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    return sums.agg(
        F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("only_b"),
        F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"),
    )


def require_aligned(a: DataFrame, b: DataFrame, key: str) -> None:
    r = alignment_report(a, b, key).first()
    if r.only_a or r.only_b or r.repeated:
        raise AlignmentError(f"not aligned: {r.only_a} and {r.only_b} entities are held by one party alone, {r.repeated} ids repeat")


def require_target_blind(columns: Iterable[str], target: str) -> None:
    if target.strip().casefold() in {c.strip().casefold() for c in columns}:
        raise TargetLeakError(f"linkage inputs name the target {target}")
