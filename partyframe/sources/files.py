"""Readers and writers of the engine's files: CSV, Parquet, rating archives, numpy matrices, bundles with checksums."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partyframe.functions.scalar import number
from partyframe.operators.relational import MissingColumnsError


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, the engine's only missing marker."""
    return df.select(*(number(c).alias(c) if isinstance(t.dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c, t in zip(df.columns, df.schema.fields, strict=True)))


def read_csv(spark: SparkSession, path: str, required: Iterable[str] = (), schema: T.StructType | str | None = None, header: bool = True, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV file; without a schema all columns are texts (nothing is inferred, so the file is read once)."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{path} lacks {', '.join(missing)}")
    return df


def read_parquet(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    df = nan_to_null(spark.read.parquet(path))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{path} lacks {', '.join(missing)}")
    return df


# Fixed layout of the rating archive's members.
RATING_FILES = {
    "users": "UserID int, Gender string, Age int, Occupation int, ZipCode string",
    "movies": "MovieID int, Title string, Genres string",
    "ratings": "UserID int, MovieID int, Rating int, Timestamp bigint",
}


def read_ratings(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """users, movies and ratings of an unpacked rating archive (fields end with ::, Latin-1)."""
    return {name: read_csv(spark, f"{folder}/{name}.dat", schema=schema, header=False, sep="::", encoding="ISO-8859-1") for name, schema in RATING_FILES.items()}


def read_matrix(spark: SparkSession, path: str, key: str = "row") -> DataFrame:
    """(key, f0..fk) of a numpy file: it is read by one task of Spark's binary source, so any store that Spark knows
    serves; such files hold one party's matrix and fit a task."""
    import io

    import numpy as np
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.limit(1).select(F.substring("content", 1, 1024).alias("h")).first()
    if head is None:
        raise FileNotFoundError(path)
    raw = io.BytesIO(bytes(head.h))
    version = np.lib.format.read_magic(raw)
    shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)[0]
    if len(shape) != 2:
        raise ValueError(f"{path} holds no matrix: {shape}")
    names = [f"f{k}" for k in range(shape[1])]

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                x = np.load(io.BytesIO(content.as_py()), allow_pickle=False).astype(float)
                for at in range(0, len(x), 65_536):
                    part = x[at : at + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), *(pa.array(part[:, k]) for k in range(part.shape[1]))], [key, *names])

    return files.mapInArrow(rows, f"{key} long, " + ", ".join(f"{n} double" for n in names))


def summarise(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of each table, in one job each that reads no column."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def write_bundle(folder: str, features: DataFrame, provenance: DataFrame, metadata: dict, target: DataFrame | None = None) -> None:
    """A party's bundle: features and target as Parquet, provenance as CSV, metadata as JSON."""
    spark = features.sparkSession
    features.write.mode("errorifexists").parquet(f"{folder}/features.parquet")
    provenance.coalesce(1).write.option("header", True).csv(f"{folder}/provenance.csv")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(f"{folder}/metadata.json")
    if target is not None:
        target.write.parquet(f"{folder}/target.parquet")


def write_splits(df: DataFrame, folder: str, parties: dict[str, list[str]], key: str = "id", split: str = "split") -> None:
    """Each party's columns by split, for other tools: <folder>/<party>/split=<name>/."""
    for party, columns in parties.items():
        df.select(key, split, *columns).write.partitionBy(split).parquet(f"{folder}/{party}")


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def missing_files(manifest: DataFrame, wanted: list[str]) -> DataFrame:
    """(name, present) for each file that a release needs."""
    names = manifest.sparkSession.createDataFrame([(w,) for w in wanted], "name string")
    return names.join(manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(True).alias("found")).distinct(), "name", "left").select("name", F.coalesce("found", F.lit(False)).alias("present"))


def logistic_checkpoint(model) -> str:
    """A logistic model as portable JSON; parties keep their order, the active one first."""
    return json.dumps({"parties": model.parties, "weights": model.weights, "intercept": model.intercept})


def read_logistic_checkpoint(text: str):
    from partyframe.operators.logistic import LogisticModel

    x = json.loads(text)
    return LogisticModel(x["parties"], x["weights"], x["intercept"])


def gbdt_checkpoint(model) -> tuple[str, dict[str, str]]:
    """A boosted model as portable JSON: the trees, in which splits are (feature, bin) without thresholds; and by party the
    thresholds of its own features, which only their owner needs. Parties keep their order, the active one first."""
    trees = [{str(k): [n.g, n.h, n.n, n.party, n.feature, n.bin, n.gain] for k, n in tree.items()} for tree in model.trees]
    whole = {"parties": model.parties, "base": model.base, "options": asdict(model.options), "trees": trees}
    return json.dumps(whole), {p: json.dumps({c: list(model.edges[c]) for c in cs}) for p, cs in model.parties.items()}


def read_gbdt_checkpoint(text: str, routing: dict[str, str]):
    """The model again, with the thresholds of the parties given; those of others are not known."""
    from partyframe.operators.gbdt import GBDTModel, GBDTOptions, Node

    x = json.loads(text)
    edges = {c: e for part in routing.values() for c, e in json.loads(part).items()}
    return GBDTModel(x["parties"], edges, x["base"], GBDTOptions(**x["options"]), [{int(k): Node(*n) for k, n in tree.items()} for tree in x["trees"]])
