"""The corpus pipeline: stages over `documents`, each written as Parquet and read back as the next one's input.

Every stage keeps the columns of documents but the last, which returns (doc_id, n_tokens, ids). Stages decide row by row,
by a name made of id and text: rows without id and rows that share one are judged by their own text. Of wholly repeated
rows one stays, null texts go at the first stage, and an empty table gives no rows.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.llm.bpe import bpe_encode
from partyframe.llm.decontaminate import contaminated
from partyframe.llm.exact_dedup import exact_dedup
from partyframe.llm.language_id import UNKNOWN, fit_language_id, held_out, predict_language
from partyframe.llm.ngram_join import JaccardRule, ngram_jaccard_components
from partyframe.llm.shared import ARROW_ROWS, bounded, written

#: A document is rejected if no language can be told, or if its most probable language has less than this posterior.
LEAST_LANGUAGE_SCORE = 0.5
#: Near copies share 0.8 of their five-word shingles; the four words and 0.85 of op5 are the contract of that query alone.
NEAR_COPIES = JaccardRule(words=5, num=80, den=100)


def short_batches(stage):
    """The stage, with short Arrow batches for the session from then on: the pipeline's rows are whole texts."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def row_name(text_sha: Column | None = None) -> Column:
    """A 64-bit name of a row by its id and text."""
    return F.xxhash64(F.col("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256) if text_sha is None else text_sha)


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(row_name().alias("name"), "doc_id", "text")


def without(docs: DataFrame, dropped: DataFrame, stage: str) -> DataFrame:
    """docs without the rows whose name is in dropped; the few that go are broadcast while they are proven to be few."""
    gone = bounded(written(dropped.select(F.col("name").alias("gone_name")).distinct(), f"pipeline-{stage}"))
    return docs.join(gone, row_name() == F.col("gone_name"), "left_anti")


@short_batches
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_language_id(docs.where(~held_out("doc_id")))
    found = predict_language(rows_of(docs), model, "name")
    return without(docs, found.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < LEAST_LANGUAGE_SCORE)), "languages")


@short_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest doc_id of equal texts stays, and one of its rows if they repeat."""
    found = written(exact_dedup(docs).select(row_name(F.col("text_sha256")).alias("name"), "kept"), "pipeline-copies")
    left = without(docs, found.where("NOT kept"), "copies")
    repeated = written(found.where("kept").groupBy("name").count().where("count > 1").select("name"), "pipeline-repeated")
    if repeated.isEmpty():
        return left
    again = left.join(bounded(repeated), row_name() == F.col("name"), "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, repeated, "repeated").unionByName(again)


@short_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents stays."""
    rows = rows_of(docs)
    linked = ngram_jaccard_components(rows, "name", rule=NEAR_COPIES).select("name", "component_id")
    groups = linked.groupBy("component_id").count().where("count > 1").select("component_id")
    members = written(linked.join(groups, "component_id"), "pipeline-members").join(rows.select("name", "doc_id"), "name")
    stays = members.groupBy("component_id").agg(F.min_by("name", F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("stays"))
    return without(docs, members.join(stays, "component_id").where("name <> stays"), "near")


@short_batches
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, contaminated(rows_of(docs), benchmark, "name"), "leaks")


@short_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document that is left."""
    encoded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]
#: SQL can state neither the language model nor BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
