"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .words import WordHashes, mixed, shingle_hashes, split_words

#: Buckets of the hashed words and word pairs, added count, labelled rows that the target model is fitted on at most.
BUCKETS, SMOOTHING, LABELLED_ROWS = 1 << 16, 1.0, 300_000


def ngram_buckets(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The bucket of each word and each pair of neighbouring words."""
    words = hashes.of(split_words(text))
    return (np.concatenate((mixed(words), shingle_hashes(words, 2))) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class ImportanceModel:
    log_ratio: np.ndarray  # buckets: log p(target) - log p(raw)


def labelled_sample(labels: DataFrame, target, id_col: str, rows: int, seed: int) -> DataFrame:
    """(id, target) of at most about `rows` labelled ids, chosen by a hash of the id; all of them if there are fewer."""
    marked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(target.cast("int")).alias("target"))
    n = labels.count()
    share = min(1.0, rows / max(1, n))
    return marked if share == 1 else marked.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit_importance(docs: DataFrame, labels: DataFrame, target, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS, seed: int = 0) -> ImportanceModel:
    """The raw model counts n-grams of all documents, the target model those of labelled documents for which the
    column `target` of labels holds (of repeated labels all must hold). At most about labelled_rows labels are used
    (a documented bound, so that they can be broadcast); a task sends one row for each bucket that it met."""

    def count(batches):
        hashes, held = WordHashes(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(ngram_buckets(text.as_py(), hashes), minlength=BUCKETS)
                held[0] += n
                if wanted:
                    held[1] += n
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[0][at]), pa.array(held[1][at])], ["bucket", "raw", "target"])

    known = F.broadcast(labelled_sample(labels, target, id_col, labelled_rows, seed))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(known, "id", "left").select("text", "target")
    table = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.full((2, BUCKETS), SMOOTHING)
    for k, name in enumerate(("raw", "target")):
        counts[k, table["bucket"].to_numpy()] += table[name].to_numpy()
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
    return ImportanceModel(log_p[1] - log_p[0])


def importance_weights(docs: DataFrame, model: ImportanceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_ngrams, log_weight) for every row: the summed log ratio of its n-grams; 0 for null and empty texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        hashes, ratio = WordHashes(), sent.value.log_ratio
        for batch in batches:
            at = [ngram_buckets(text.as_py(), hashes) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(a) for a in at], pa.int64()), pa.array([float(ratio[a].sum()) for a in at], pa.float64())], ["id", "n_ngrams", "log_weight"]
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    return source.mapInArrow(weigh, schema).withColumnRenamed("id", id_col)


def kth_largest(keyed: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest double of a column, exactly, by counting ever finer ranges: 2**16 counts a pass at the driver."""
    low, high = keyed.agg(F.min(col), F.max(col)).first()
    while low is not None and low < high:
        step = (high - low) / 65536
        if step == 0 or low + step == low:
            break
        inside = keyed.where(F.col(col).between(low, high))
        bins = F.least(F.floor((F.col(col) - low) / step), F.lit(65535))
        rows = sorted(((r.b, r.n, r.lo, r.hi) for r in inside.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in rows:
            if k <= n:
                low, high = lo, hi
                break
            k -= n
        else:
            return low
    if low is None or low == high:
        return low
    for value, n in ((r[0], r[1]) for r in keyed.where(F.col(col).between(low, high)).groupBy(col).count().orderBy(F.desc(col)).limit(65536).collect()):
        if k <= n:
            return value
        k -= n
    return low


def importance_resample(docs: DataFrame, model: ImportanceModel, k: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id_col, n_ngrams, log_weight, gumbel_key, kept): k documents drawn without replacement in proportion to their
    importance weights, as those with the k largest log_weight + Gumbel noise.

    The noise is a function of seed and id, so that a rerun draws the same; repeated rows share it, and rows that tie
    with the k-th key are all kept. k <= 0 keeps none, k beyond the rows all. Null ids draw as one id. Texts count whole,
    null and empty ones with weight 0; an empty table gives no rows; other columns are ignored.
    """
    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    weighed = importance_weights(docs, model, id_col, text_col)
    keyed = written(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "quality-keys")
    n = keyed.count()
    least = None if k <= 0 or not n else kth_largest(keyed, "gumbel_key", min(k, n))
    return keyed.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))
