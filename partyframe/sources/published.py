"""Datasets as they are published: several tables under one name, all of them there or none."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.operators.audit import digest_of, row_digest, row_sums
from partyframe.sources.files import file_manifest
from partyframe.sources.runs import read_document, write_document

MANIFEST = "dataset_manifest.json"
#: Rows of a published file, at most: a task holds a whole file while it hashes its bytes.
FILE_ROWS = 2_000_000


class HalfWrittenError(ValueError):
    """A published dataset whose manifest is missing, or that is not what its manifest says."""


def moved(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder in whatever store it is in; False if that fails or new is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(new).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(path(new)) and files.rename(path(old), path(new))


def files_by_table(spark: SparkSession, folder: str) -> dict[str, dict]:
    """By table below folder: how many files it has, and a digest of their names, sizes and SHA-256."""
    place = F.split("path", "/")
    name = lambda k: F.element_at(place, k)
    found = file_manifest(spark, folder).select(name(-2).alias("table"), name(-1).alias("file"), "bytes", "sha256")
    return {r["table"]: {"files": r["rows"], "files_digest": r["digest"]} for r in row_digest(found, "table").collect()}


def publish_dataset(folder: str, tables: dict[str, DataFrame], card: dict) -> dict:
    """Write tables and a card (name, licence and the like; a licence there must be) below folder, which must not be there.

    Everything is written beside it first: each table, then, from what was written, the rows and digest of all tables and
    of their files, and the manifest last. One rename makes it the dataset, so readers see all of it or nothing, and what a failed writer leaves is never read.
    """
    if not tables or not str(card.get("license") or "").strip():
        raise ValueError("a dataset needs tables and a licence")
    if bad := [n for n in tables if not n.isidentifier()]:
        raise ValueError(f"no names of tables: {bad}")
    spark = next(iter(tables.values())).sparkSession
    staged = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{staged}/{name}")
    sums = [row_sums(spark.read.schema(df.schema).parquet(f"{staged}/{name}")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    seen = {r["table"]: {"rows": r["rows"], "digest": r["digest"]} for r in digest_of(reduce(DataFrame.unionByName, sums), "table").collect()}  # a row for each table
    files = files_by_table(spark, staged)
    stated = {name: seen[name] | files[name] | {"schema": json.loads(df.schema.json())} for name, df in tables.items()}
    manifest = {"card": card, "tables": stated}
    write_document(spark, f"{staged}/{MANIFEST}", manifest)
    if not moved(spark, staged, folder.rstrip("/")):
        raise FileExistsError(folder)
    return manifest


def read_dataset(spark: SparkSession, folder: str, check: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """(card, tables) of a published dataset. Without a manifest it is refused; with check also if a table has other rows than
    the manifest states, at the price of one pass over the bytes of all files, and one over the rows of those tables whose files
    are not the ones that were published."""
    try:
        manifest = read_document(spark, f"{folder}/{MANIFEST}")
    except AnalysisException as error:
        raise HalfWrittenError(f"{folder} has no manifest") from error
    tables, files = {}, files_by_table(spark, folder) if check else {}
    for name, stated in manifest["tables"].items():
        try:
            df = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as error:
            raise HalfWrittenError(f"{folder} lacks {name}") from error
        same = files.get(name) == {k: stated.get(k) for k in ("files", "files_digest")}
        if check and not same and row_digest(df).first().asDict() != {k: stated[k] for k in ("rows", "digest")}:
            raise HalfWrittenError(f"{folder}/{name} is not what the manifest says")
        tables[name] = df
    return manifest["card"], tables
