"""Readers of the parties' captures: files that were fetched before, as CSV or Parquet; no connection is opened."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.operators.relational import cutoff_of, rename_aliases, sample_rows, select_required
from partyframe.sources.files import nan_to_null, read_csv

# Fixed names of the bank capture: the archive numbers its columns, publications name them.
BANK_NAMES = [
    "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6",
    "BILL_AMT1", "BILL_AMT2", "BILL_AMT3", "BILL_AMT4", "BILL_AMT5", "BILL_AMT6", "PAY_AMT1", "PAY_AMT2", "PAY_AMT3", "PAY_AMT4", "PAY_AMT5", "PAY_AMT6",
]
BANK_TARGETS = ("Y", "default payment next month", "default_payment_next_month")
TRANSACTIONS = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]


@dataclass(frozen=True)
class Capture:
    """What was read for a party: its rows, the target or a second table where it has one, and facts for the provenance."""

    party: str
    rows: DataFrame
    target: DataFrame | None = None
    claims: DataFrame | None = None
    facts: dict = field(default_factory=dict)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV where the name says so, else Parquet; NaN and infinities are NULL."""
    return read_csv(spark, path) if path.rstrip("/").endswith(".csv") else nan_to_null(spark.read.parquet(path))


def read_bank(spark: SparkSession, path: str, key: str = "ID") -> Capture:
    """Features under their published names; the target apart, if the capture has it under one of its known names."""
    df = rename_aliases(read_table(spark, path), {f"X{k}": name for k, name in enumerate(BANK_NAMES, 1)})
    named = next((c for c in BANK_TARGETS if c in df.columns), None)
    select_required(df, [key])
    target = df.select(key, F.col(named).try_cast("int").alias("y")) if named else None
    return Capture("bank", df.drop(*BANK_TARGETS), target, facts={"target": named})


def read_telecom(spark: SparkSession, path: str) -> Capture:
    """Features only: what the capture says about churn stays with its owner."""
    df = read_table(spark, path)
    return Capture("telecom", df.drop("Churn"))


def read_insurance(spark: SparkSession, policies: str, claims: str, sample: int | None = None, seed: int = 0, key: str = "IDpol") -> Capture:
    """Policies, all or `sample` of them by hash, and the claims of those policies only (a semi-join)."""
    held = read_table(spark, policies)
    select_required(held, [key])
    paid = select_required(read_table(spark, claims), [key, "ClaimAmount"])
    if sample is not None:
        held = sample_rows(held, sample, key, seed)
        paid = paid.join(held.select(key), key, "left_semi")
    return Capture("insurance", held, claims=paid, facts={"sample": sample, "seed": seed})


def read_retail(spark: SparkSession, path: str, cutoff: str | None = None, q: float = 0.70) -> Capture:
    """Transactions up to the cutoff: a given time, or the q-quantile of all times. facts say the cutoff, in microseconds,
    and how many later rows (and rows without a time) were left out."""
    df = select_required(read_table(spark, path), TRANSACTIONS).withColumn("InvoiceDate", F.col("InvoiceDate").try_cast("timestamp"))
    micros = F.unix_micros("InvoiceDate")
    at = df.select(F.unix_micros(F.lit(cutoff).cast("timestamp"))).first() if cutoff else cutoff_of(df, "InvoiceDate", q).first()
    if at is None or at[0] is None:
        raise ValueError(f"no cutoff can be told from {cutoff or path}")
    early = micros <= F.lit(at[0])
    left_out = df.agg(F.count_if(~early).alias("later"), F.count_if(micros.isNull()).alias("undated")).first()
    return Capture("retail", df.where(early), facts={"cutoff": at[0], "later": left_out.later, "undated": left_out.undated})


READERS: dict[str, Callable[..., Capture]] = {"bank": read_bank, "telecom": read_telecom, "insurance": read_insurance, "retail": read_retail}


def read_party(spark: SparkSession, name: str, *paths: str, **options) -> Capture:
    """The capture of a party by name."""
    if name not in READERS:
        raise ValueError(f"unknown party {name}; known are {', '.join(READERS)}")
    return READERS[name](spark, *paths, **options)
