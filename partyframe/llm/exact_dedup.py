"""Exact deduplication over an extendible-hash index kept in shared files (DataFrame operations only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, two_columns, written

#: Rows that a bucket of the index holds before it splits, and how many buckets the index aims at when it is large: then
#: a bucket holds twice the mean, so that few split once more.
BUCKET_ROWS, BUCKETS = 1_024, 4_096
#: Bits by which the first counting job looks below the root, and later ones below an overfull bucket.
ROOT_BITS, SPLIT_BITS = 12, 3
#: The directory has 2**MOST_DEPTH pointers at most: buckets of that depth do not split, their chains grow.
MOST_DEPTH = 18


@dataclass(frozen=True)
class Directory:
    """global_depth bits of a key select a pointer; each bucket is a prefix of local_depth bits, shared by its pointers."""

    global_depth: int
    buckets: tuple[tuple[int, int], ...]  # (prefix, local depth), in key order

    def pointers(self) -> list[tuple[int, int, int]]:
        """(pointer, bucket, local depth) for each of the 2**global_depth directory slots."""
        out = []
        for bucket, (prefix, depth) in enumerate(self.buckets):
            free = self.global_depth - depth
            out += [((prefix << free) + k, bucket, depth) for k in range(1 << free)]
        return out


def key_prefix(depth: int):
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(entries: DataFrame, bucket_rows: int) -> Directory:
    """Split overfull buckets until none holds over bucket_rows distinct keys (more where there are so many keys that the index
    would get over some BUCKETS files), doubling the directory where a bucket is as deep as it.

    The driver sees counts by key prefix only: 2**ROOT_BITS for the root, then 2**SPLIT_BITS for each bucket that is still
    overfull, of which there are fewer than keys / bucket_rows.
    """
    done: list[tuple[int, int]] = []
    overfull, depth = [0], 0
    while overfull:
        below = min(SPLIT_BITS if depth else ROOT_BITS, MOST_DEPTH - depth)
        rows = entries.where(key_prefix(depth).isin(overfull)) if depth else entries
        counts = {r[0]: r[1] for r in rows.groupBy(key_prefix(depth + below).alias("p")).agg(F.count_distinct("key")).collect()}
        bucket_rows = bucket_rows if depth else max(bucket_rows, 2 * sum(counts.values()) // BUCKETS)
        sums = [counts]
        for _ in range(below):
            up: dict[int, int] = {}
            for p, n in sums[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            sums.append(up)
        todo, deeper = [(p, 0) for p in overfull], []
        while todo:
            p, down = todo.pop()
            if sums[below - down].get(p, 0) <= bucket_rows or depth + down == MOST_DEPTH:
                done.append((p, depth + down))
            elif down == below:
                deeper.append(p)
            else:
                todo += [(2 * p, down + 1), (2 * p + 1, down + 1)]
        overfull, depth = deeper, depth + below
    top = max(d for _, d in done)
    return Directory(top, tuple(sorted(done, key=lambda x: x[0] << (64 - x[1]))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256. Of identical texts the largest id stays.

    1. Each text becomes a 64-bit key; the directory grows over the keys until no bucket is overfull.
    2. Keys go to the bucket that the directory has for them, each bucket's key range to one owner task, which makes a chain
       of each key and writes the bucket's file of the index. What goes there was counted by the sending task, so a group of
       copies is one entry for each task however large it is.
    3. Texts whose key was met more than once go to the owner of their bucket as well, again counted by their sender. It
       compares them byte by byte within their chain: a cell for each distinct text, in the bucket's second file. Where all
       texts of a chain are one, the cell leaves its text out.
    4. Documents find the bucket of their key by the directory, and in its files their cell by key, and by text where the
       chain has several cells. Groups and who stays are known to the index alone.

    Null text counts as empty; a text is held whole by one task at a time, however long. A null id never becomes keep_id
    unless its group has no other; such rows are not kept in a group with ids, and kept otherwise. Repeated rows with the
    winning id are all kept. An empty table gives no rows. Other columns of docs are ignored.
    """
    source = two_columns(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    prints = written(source.select("id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "dedup-prints")
    directory = grow_directory(prints, bucket_rows)
    heads = written(owned(in_bucket(sent(prints, "key"), directory), "key"), "dedup-heads", ("bucket",))

    repeated = written(heads.where("group_size > 1").select("bucket", "key"), "dedup-repeated")
    chained = written(in_bucket(source, directory).join(bounded(repeated), ["bucket", "key"], "left_semi"), "dedup-texts")
    cells = written(owned(sent(chained, "bucket", "key", "text"), "key", "text"), "dedup-cells", ("bucket",))
    collided = written(cells.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("cells")).where("cells > 1").select("bucket", "key"), "dedup-collided")
    several = not collided.isEmpty()

    plain = cells.join(bounded(collided), ["bucket", "key"], "left_anti") if several else cells
    index = heads.where("group_size = 1").unionByName(plain.drop("text"))
    found = in_bucket(prints, directory).join(index, ["bucket", "key"]).select("id", "sha", "keep_id", "group_size")
    if several:
        of_chains = chained.join(bounded(collided), ["bucket", "key"], "left_semi").join(cells, ["bucket", "key", "text"])
        found = found.unionByName(of_chains.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def sent(rows: DataFrame, *by: str) -> DataFrame:
    """(by, keep_id, group_size): rows counted within the task that reads them; nothing is known of other tasks yet."""
    counted = rows.groupBy(*by, F.spark_partition_id().alias("task")).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.drop("task")


def owned(entries: DataFrame, *chain: str) -> DataFrame:
    """(bucket, chain, keep_id, group_size): entries at the owners of their buckets, ranges of keys in order, each of which
    merges the entries of a chain. The aggregate runs where the rows are; there is no further shuffle."""
    at_owner = entries.repartitionByRange("bucket")
    return at_owner.groupBy("bucket", *chain).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def in_bucket(rows: DataFrame, directory: Directory) -> DataFrame:
    """rows (key, ...) with the bucket that the directory has for the key."""
    schema = T.StructType([T.StructField("pointer", T.LongType()), T.StructField("bucket", T.IntegerType())])
    slots = rows.sparkSession.createDataFrame([(p, b) for p, b, _ in directory.pointers()], schema)  # 2**MOST_DEPTH at most
    return rows.withColumn("pointer", key_prefix(directory.global_depth)).join(F.broadcast(slots), "pointer").drop("pointer")
