"""Accounting of messages between parties: metadata only, never payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partyframe.operators.ranking import running, value_bucket


def communication_log(events: DataFrame, seq: str = "seq", size: str = "bytes") -> DataFrame:
    """events with cumulative_bytes in the order of seq (unique numbers), summed by ranges and not in one task."""
    return running(events, seq, {"cumulative_bytes": F.col(size)}, value_bucket(events, seq))


def communication_totals(events: DataFrame) -> DataFrame:
    """One row: messages, scalars and bytes, and those of each direction."""
    forward, backward = F.col("direction") == "forward", F.col("direction") == "backward"
    total = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0)).cast("long")
    return events.agg(
        F.count(F.lit(1)).alias("messages"), total("scalars").alias("scalars"), total("bytes").alias("bytes"), F.count_if(forward).alias("forward_messages"), total("bytes", forward).alias("forward_bytes"),
        F.count_if(backward).alias("backward_messages"), total("bytes", backward).alias("backward_bytes"),
    )


def communication_breakdown(events: DataFrame) -> DataFrame:
    """Messages, scalars and bytes by direction, party, stage and step; missing keys are groups of their own."""
    keys = ["direction", "party", "stage", "step"]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages"), F.sum("scalars").cast("long").alias("scalars"), F.sum("bytes").cast("long").alias("bytes")).orderBy(*keys)


#: Limbs of a row's two SHA-256 hashes that are summed apart, hexadecimal digits of a half of each.
LIMBS, HALF_DIGITS = 8, 8


def canonical(df: DataFrame, name: str) -> Column:
    """A value as text that tells NULL, empty and neighbouring values apart: N, or V, its length, a colon and the value.
    Times are counted in microseconds, dates in days; nested values are JSON."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.unix_micros(c.cast("timestamp")).cast("string")
    elif isinstance(kind, T.DateType):
        text = F.unix_date(c).cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        text = F.to_json(c)
    elif isinstance(kind, T.MapType):
        text = F.to_json(F.array_sort(F.map_entries(c)))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "N").otherwise(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text))


def row_sums(df: DataFrame, *by: str) -> DataFrame:
    """(by, n, s0..s7): the number of rows, and sums of 64-bit pieces of two SHA-256 hashes of each row. Sums do not depend
    on order or partitions, are added up in every task before the shuffle, and those of two tables add to those of their
    union, so a table of any size is digested in one pass. A task adds halves of 32 bits as longs, which 2**31 rows do not
    overflow; only its totals become decimals, which cost several times as much to add."""
    text = F.concat(*(canonical(df, c) for c in sorted(df.columns) if c not in by)) if set(df.columns) - set(by) else F.lit("")
    rows = df.select(*by, text.alias("_row"), F.spark_partition_id().alias("_task"))
    hashes = rows.select(*by, "_task", *(F.sha2(F.concat(F.lit(str(k)), "_row"), 256).alias(f"_h{k}") for k in range(2)))
    per_hash = LIMBS // 2
    half = lambda k, low: F.conv(F.substring(f"_h{k // per_hash}", (2 * (k % per_hash) + low) * HALF_DIGITS + 1, HALF_DIGITS), 16, 10).cast("bigint")
    tasks = hashes.groupBy(*by, "_task").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(half(k, low)).alias(f"_{k}_{low}") for k in range(LIMBS) for low in range(2)))
    whole = lambda k: F.col(f"_{k}_0").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"_{k}_1").cast("decimal(20,0)")
    return tasks.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(whole(k)), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(LIMBS)))


def digest_of(sums: DataFrame, *by: str) -> DataFrame:
    """(by, rows, digest) from row_sums(), or from the sums of several added up."""
    return sums.select(*by, F.col("n").alias("rows"), F.sha2(F.concat_ws(":", "n", *(f"s{k}" for k in range(LIMBS))), 256).alias("digest"))


def row_digest(df: DataFrame, *by: str) -> DataFrame:
    """(by, rows, digest): the same for any order of the rows, another one if a row is added, lost, repeated or changed.
    Columns may come in any order: they are taken in that of their names. It shows accidents and edits; it is no proof against someone who looks for a
    collision among 2**100 tables."""
    return digest_of(row_sums(df, *by), *by)


class UnsafeLogFieldError(ValueError):
    """A log field that could carry row data."""


def safe_log_fields(fields: dict) -> dict:
    """The fields if all are scalars (texts of 200 characters at most); arrays, frames and the like are refused."""
    for name, value in fields.items():
        if not (value is None or isinstance(value, (str, int, float, bool))) or (isinstance(value, str) and len(value) > 200):
            raise UnsafeLogFieldError(f"{name} is no scalar")
    return fields


