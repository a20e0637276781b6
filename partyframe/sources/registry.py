"""The catalogue of public datasets that party builders know, and the licence gate."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.functions.session import checkpointed
from partyframe.operators.audit import row_digest
from partyframe.sources.files import nan_to_null, read_parquet, write_bundle

SCHEMA = "key string, party string, dataset_name string, provider string, dataset_id string, doi string, license string"
# Fixed facts about the datasets.
RECORDS = [
    ("bank", "bank", "Default of Credit Card Clients", "UCI Machine Learning Repository", "350", "10.24432/C55S3H", "CC BY 4.0"),
    ("telecom", "telecom", "Iranian Churn", "UCI Machine Learning Repository", "563", "10.24432/C5JW3Z", "CC BY 4.0"),
    ("insurance_freq", "insurance", "freMTPL2freq", "OpenML", "41214", None, None),
    ("insurance_sev", "insurance", "freMTPL2sev", "OpenML", "41215", None, None),
    ("retail", "retail", "Online Retail", "UCI Machine Learning Repository", "352", "10.24432/C5BW33", "CC BY 4.0"),
]


class LicenceError(ValueError):
    """A dataset whose licence is not known."""


def datasets(spark: SparkSession, party: str | None = None) -> DataFrame:
    df = spark.createDataFrame(RECORDS, SCHEMA)
    return df.where(F.col("party") == party) if party else df


def require_licences(records: DataFrame) -> None:
    """Fails closed: a record without a licence is not used."""
    bad = [r.key for r in records.where("license IS NULL").select("key").collect()]
    if bad:
        raise LicenceError(f"no licence is known for {', '.join(sorted(bad))}")


PROVENANCE = ["observed", "derived", "aggregated", "synthetic"]


def provenance(spark: SparkSession, rows: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """(party, feature, source, columns, kind) records; an unknown kind is refused."""
    if any(r[4] not in PROVENANCE for r in rows):
        raise ValueError(f"kinds are {PROVENANCE}")
    return spark.createDataFrame(rows, "party string, feature string, source string, columns string, kind string")


def with_provenance(records: DataFrame, spark: SparkSession) -> DataFrame:
    """Provenance records with the facts of their dataset."""
    return records.join(F.broadcast(datasets(spark).select("party", "dataset_name", "license").dropDuplicates(["party"])), "party", "left")


class ChecksumError(ValueError):
    """A source without a checksum, or a table that is not what its checksum says."""


def source_records(spark: SparkSession, party: str, captures: dict[str, DataFrame], licences: dict[str, str] | None = None, retrieved: str | None = None) -> list[dict]:
    """What is known about each dataset of a party: the catalogue's facts, its licence (given where the catalogue has none),
    the rows and the digest of what was captured. A dataset without licence or capture is refused before anything is read."""
    known = [r.asDict() for r in datasets(spark, party).collect()]  # a handful
    if not known:
        raise LicenceError(f"no dataset is known for {party}")
    for record in known:
        given = ((licences or {}).get(record["key"]) or "").strip()
        record["license"] = record["license"] or given or None
    if bad := sorted(r["key"] for r in known if r["license"] is None):
        raise LicenceError(f"no licence is known for {', '.join(bad)}")
    if bad := sorted(r["key"] for r in known if r["key"] not in captures):
        raise ChecksumError(f"nothing was captured of {', '.join(bad)}")
    day = retrieved or datetime.now(UTC).date().isoformat()
    for record in known:
        seen = row_digest(captures[record["key"]]).first()
        record |= {"retrieval_date": day, "raw_rows": seen.rows, "checksum": seen.digest, "checksum_algorithm": "order-free sum of row SHA-256", "checksum_scope": "captured rows"}
    return known


def save_provenance_bundle(folder: str, party: str, features: DataFrame, records: DataFrame, captures: dict[str, DataFrame], licences: dict[str, str] | None = None, metadata: dict | None = None, target: DataFrame | None = None) -> dict:
    """write_bundle() with metadata that prove where the features come from: a record of every source, and the rows and digest
    of the features as written. Nothing is written if a licence or a checksum is missing. The metadata are returned."""
    spark = features.sparkSession
    sources = source_records(spark, party, captures, licences, (metadata or {}).get("retrieval_date"))
    features = checkpointed(nan_to_null(features))  # what is digested is what is written
    seen = row_digest(features).first()
    first = {k: sources[0][k] for k in ("dataset_name", "provider", "dataset_id", "doi", "license", "retrieval_date")}
    whole = first | (metadata or {}) | {"party": party, "processed_rows": seen.rows, "checksum": seen.digest, "checksum_algorithm": sources[0]["checksum_algorithm"], "checksum_scope": "processed features", "sources": [s | {"processed_rows": seen.rows} for s in sources]}
    write_bundle(folder, features, with_provenance(records, spark), whole, target)
    return whole


def read_provenance_bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(features, metadata) of a bundle whose features still have the rows that its metadata state."""
    metadata = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/metadata.json").collect()))
    features = read_parquet(spark, f"{folder}/features.parquet")
    seen = row_digest(features).first()
    if (seen.rows, seen.digest) != (metadata["processed_rows"], metadata["checksum"]):
        raise ChecksumError(f"{folder} holds {seen.rows} rows that are not the {metadata['processed_rows']} it was written with")
    return features, metadata
