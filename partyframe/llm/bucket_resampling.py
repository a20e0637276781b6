"""Importance resampling towards a target: documents as rows of a sparse count matrix over hashed n-gram buckets.

The matrix is built once and persisted as CSR blocks: a row of the table holds up to BLOCK_ROWS documents with their
row pointers, bucket indices and counts. Its column sums and those of the target give both distributions, a product
of each block with the vector of gains gives every document's weight. Documents are drawn by Gumbel top-k.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, bounded, forget, written

#: Buckets, longest run of words, words that a document needs to be drawn, drawn documents of a hundred.
BUCKETS, RUN, LEAST_WORDS, SHARE = 10_000, 3, 20, 5
#: Documents and stored counts in a block at most (a document has BUCKETS counts at most), bytes of a text at a time.
BLOCK_ROWS, BLOCK_COUNTS, WINDOW = 256, 1 << 16, 1 << 20
#: Blocks in an Arrow batch, bytes of a Parquet row group: readers hold one of each.
ARROW_BLOCKS, ROW_GROUP = 16, 4 << 20
#: A-Z to a-z; all other ASCII characters but digits and a-z to a space, which ends a word.
AS_WORDS = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
CSR = "words array<bigint>, features array<bigint>, row_start array<int>, buckets array<int>, counts array<int>"


def feature_counts(text: str | None, counts: np.ndarray) -> tuple[int, int]:
    """Add the features of a text to counts (BUCKETS long); (words, features). Long texts go a window at a time, the last
    words of one window before those of the next."""
    data = (text or "").encode("utf-8", "replace").translate(AS_WORDS)
    before: list[bytes] = []
    words = features = start = 0
    while start < len(data):
        end = data.find(b" ", start + WINDOW) if len(data) - start > WINDOW else -1
        end = len(data) if end < 0 else end
        new = data[start:end].split()
        own = before + new
        hashes, skip = list(map(crc32, own)), len(before)
        further = [b" " + w for w in own]
        for n in range(RUN):
            # a run that ends in a new word was not counted before: runs of n + 1 words start skip - n places on
            fresh = np.fromiter(hashes[max(0, skip - n) :], np.int64)
            counts += np.bincount(fresh % BUCKETS, minlength=BUCKETS)
            features += len(fresh)
            hashes = list(map(crc32, further[n + 1 :], hashes))
        words += len(new)
        before = own[len(own) - RUN + 1 :] if len(own) >= RUN else own
        start = end
    return words, features


def count_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sparse count matrix of the documents in CSR blocks: (ids, words, features, row_start, buckets, counts)."""

    def build(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            held = first = 0
            for k in range(len(texts)):
                counts = np.zeros(BUCKETS, np.int64)
                words, features = feature_counts(texts[k].as_py(), counts)
                at = np.flatnonzero(counts)
                rows.append((words, features, at.astype(np.int32), counts[at].astype(np.int32)))
                held += len(at)
                if len(rows) == BLOCK_ROWS or held > BLOCK_COUNTS - BUCKETS or k + 1 == len(texts):
                    yield block(keys.slice(first, len(rows)), rows)
                    rows, held, first = [], 0, k + 1

    def block(keys, rows):
        words, features, at, counts = zip(*rows, strict=True)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int32)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        cells = [keys, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(starts), pa.array(np.concatenate(at)), pa.array(np.concatenate(counts))]
        return pa.RecordBatch.from_arrays([one(c) for c in cells], ["ids", "words", "features", "row_start", "buckets", "counts"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *T._parse_datatype_string(CSR).fields])
    return source.mapInArrow(build, schema)


def column_sums(blocks: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all rows: a task sends a sum for each bucket, BUCKETS numbers reach the driver."""

    def add(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = blocks.select("buckets", "counts").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the log of its smoothed share in the target over that in the raw text, down to an
    integer."""
    s_all, t_all = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def block_weights(blocks: DataFrame, gain: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, n_features, weight) of every row of the matrix: its product with the gains, block by block."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)

    def multiply(batches):
        gain = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, features, starts, buckets, counts = (batch.column(c)[k].values for c in range(6))
                upto = np.concatenate(([0], np.cumsum(gain[buckets.to_numpy()] * counts.to_numpy())))[starts.to_numpy()]
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(np.diff(upto))], ["id", "n_words", "n_features", "weight"])

    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    source = blocks.select("ids", "words", "features", "row_start", "buckets", "counts")
    return source.mapInArrow(multiply, schema).withColumnRenamed("id", id_col)


def gumbel(key: Column, seed: int) -> Column:
    """A Gumbel number in thousandths, down to an integer, that depends on seed and key only; NULL for NULL."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw_order(candidates: DataFrame, score: str, id_col: str) -> DataFrame:
    """candidates with `rank`, from 1, by falling score and then rising id. Ranges of that order are sorted each in a task of
    its own and written; a row's place in its range and the rows of the ranges before make its rank. Wholly equal rows are
    told apart by their place in the input, so no key fills a range."""
    placed = candidates.withColumn("_in", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(F.desc(score), F.asc(id_col), F.asc("_in")).sortWithinPartitions(F.desc(score), F.asc(id_col), F.asc("_in")).drop("_in")
    ordered = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "draw-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).count().collect()  # a row for each range
    offset, offsets = 0, []
    for row in sorted(sizes):
        offsets.append((row["_part"], offset))
        offset += row["count"]
    before = ordered.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return ordered.withColumn("_part", part).join(bounded(before), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def target_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row of docs; rank is null where it is not drawn.

    Of the N documents with an id and least_words words or more, floor(share * N / 100) with the highest scores are drawn;
    score is weight plus Gumbel noise, a function of seed and id. Ties go to the smaller id. Words are runs of a-z (A-Z
    lower-cased), digits and non-ASCII characters; null, empty and wordless texts have no features and weight 0. Texts
    count whole, a window at a time. Rows without id have no score and are not drawn. Repeated rows count and are drawn
    one by one. Without target texts gains stem from the smoothing alone; an empty docs gives no rows. Other columns of
    docs and target, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, ARROW_BLOCKS):
        wanted = column_sums(count_blocks(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text"))
    matrix = written(count_blocks(docs, id_col, text_col), "csr-blocks", row_group=ROW_GROUP)
    with arrow_rows(spark, ARROW_BLOCKS):
        weighed = block_weights(matrix, gains(column_sums(matrix), wanted), id_col)
        scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)), "document-weights")
    forget(matrix)
    able = F.col(id_col).isNotNull() & (F.col("n_words") >= least_words)
    candidates = scored.where(able)
    k = share * candidates.count() // 100
    ranked = draw_order(candidates, "score", id_col).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
