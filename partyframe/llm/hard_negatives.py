"""Hard negatives by exact search in k-means inverted lists.

The centroid and radius of a cluster bound every inner product with its members (Cauchy-Schwarz): it lies within
anchor . centroid -+ |anchor| * radius. Anchors visit clusters by falling upper bound, in rounds of ever more of them, leave
out clusters whose bounds lie outside all their windows, and stop when the bound falls strictly below the k-th score.
The centroids are fitted on a bounded sample; every row is in a list, so the result is exact.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import arrow_rows, forget, written

#: Rows that the centroids are fitted on, bytes of these, clusters at most (their square is about the number of rows), steps of k-means.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CLUSTERS, STEPS = 20_000, 64 << 20, 2048, 8
#: Rows of a block of a list, blocks of a list that meet one copy of a request, anchors in a request, joined rows in an Arrow batch.
BLOCK_ROWS, BLOCKS_TOGETHER, REQUEST_ANCHORS, JOINED_ROWS = 1024, 8, 256, 32
#: Clusters visited in the first round; each further round goes on to so many times as many.
FIRST, TIMES = 8, 8
#: Beyond every score.
FAR = 1 << 62


@dataclass(frozen=True)
class Index:
    """Centroids (clusters x length), radii and parts of the lists, the lists in blocks, and how vectors are stored."""

    centroids: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    lists: DataFrame
    kind: str
    exact_in_doubles: bool


def padded(column: pa.Array, length: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones ended by zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == length).all():
        return flat.reshape(-1, length)
    out = np.zeros((len(sizes), length), flat.dtype)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def k_means(sample: np.ndarray, clusters: int, steps: int = STEPS) -> np.ndarray:
    """Centroids by Lloyd's steps from evenly spaced rows of the sample; a cluster that empties keeps its centroid."""
    x = sample.astype(np.float64)
    centroids = x[np.linspace(0, len(x) - 1, clusters).astype(int)].copy()
    for _ in range(steps):
        nearest = nearest_centroids(x, centroids)[0]
        n = np.bincount(nearest, minlength=clusters)
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.flatnonzero(n))
        centroids[n > 0] = np.add.reduceat(x[order], starts) / n[n > 0][:, None]
    return centroids


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of each row."""
    x = x.astype(np.float64)
    nearest = ((centroids * centroids).sum(1) - 2 * x @ centroids.T).argmin(1)
    return nearest, np.linalg.norm(x - centroids[nearest], axis=1)


def build_index(vectors: DataFrame) -> Index:
    """The lists of (id long, label long, v array<bigint>), all of them not null. One shuffle, by ranges of cluster and id,
    so that a cluster of any size is spread over tasks."""
    spark = vectors.sparkSession
    rows, length, largest = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    length, largest = max(length or 0, 1), largest or 0
    if length * largest * largest >= 1 << 56:  # a hundred times a score must fit in 64 bits
        raise ValueError("inner products of these vectors need more than 56 bits")
    kind = "int16" if largest < 1 << 15 else "int32" if largest < 1 << 31 else "int64"
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * length)))
    share = min(1.0, most / max(rows, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < round(share * (1 << 20))).select("id", "v").toArrow().sort_by("id")
    sample = padded(chosen["v"].combine_chunks(), length) if len(chosen) else np.zeros((1, length), np.int64)
    centroids = k_means(sample, max(1, min(MOST_CLUSTERS, round(rows**0.5), len(sample))))
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            nearest, far = nearest_centroids(padded(batch.column(2), length), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(far)], ["id", "label", "v", "cluster", "far"])

    assigned = written(vectors.mapInArrow(assign, "id bigint, label bigint, v array<bigint>, cluster int, far double"), "negatives-assigned")
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for row in assigned.groupBy("cluster").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # MOST_CLUSTERS rows at most
        radii[row.cluster], sizes[row.cluster] = row.far, row.n
    parts = np.maximum(1, -(-sizes // (BLOCK_ROWS * BLOCKS_TOGETHER)))

    def pack(batches):
        held: list[tuple] = []
        for batch in batches:
            clusters = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(clusters)) + 1).tolist(), len(clusters)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and (held[0][0] != clusters[a] or sum(len(h[1]) for h in held) + b - a > BLOCK_ROWS):
                    yield block(held)
                    held = []
                for c in range(a, b, BLOCK_ROWS):
                    part = batch.slice(c, min(b - c, BLOCK_ROWS))
                    held.append((int(clusters[a]), part.column(0).to_numpy(), part.column(1).to_numpy(), padded(part.column(2), length).astype(kind)))
                    if c + BLOCK_ROWS < b:
                        yield block(held)
                        held = []
        if held:
            yield block(held)

    def block(held):
        cluster, ids = held[0][0], np.concatenate([h[1] for h in held])
        part = zlib.crc32(str(ids[0]).encode()) % int(parts[cluster])
        cells = [[cluster], [part], [ids], [np.concatenate([h[2] for h in held])], [np.concatenate([h[3] for h in held]).tobytes()]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["cluster", "part", "row_ids", "row_labels", "rows"])

    ranged = assigned.select("id", "label", "v", "cluster").repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id")
    lists = written(ranged.mapInArrow(pack, "cluster int, part int, row_ids array<bigint>, row_labels array<bigint>, rows binary"), "negatives-lists", row_group=16 << 20)
    forget(assigned)
    return Index(centroids, radii, parts, lists, kind, length * largest * largest < 1 << 53)


def requests_of(anchors: DataFrame, index: Index, begin: int, end: int) -> DataFrame:
    """Which anchors visit which lists: of each anchor's clusters by falling upper bound those at begin to end - 1 whose bounds
    meet a window of it. anchors: (id, label, v, lows, highs); a row goes to each part of a list."""
    length, kind = index.centroids.shape[1], index.kind
    sent = anchors.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.parts))

    def ask(batches):
        centroids, radii, parts = sent.value
        norms = np.linalg.norm(centroids, axis=1) + radii
        for whole in batches:
            for first in range(0, whole.num_rows, REQUEST_ANCHORS):
                batch = whole.slice(first, REQUEST_ANCHORS)
                ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), padded(batch.column(2), length)
                lows, highs = np.array(batch.column(3).to_pylist(), np.int64), np.array(batch.column(4).to_pylist(), np.int64)
                size = np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
                middle, slack = v.astype(np.float64) @ centroids.T, size * radii + 1e-9 * size * norms + 1e-9
                upper, lower = middle + slack, middle - slack
                place = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
                meets = np.zeros(upper.shape, bool)
                for k in range(lows.shape[1]):
                    meets |= (upper >= lows[:, k, None]) & (lower <= highs[:, k, None]) & (lows[:, k] <= highs[:, k])[:, None]
                meets &= (place >= begin) & (place < end)
                cells: list[list] = [[] for _ in range(7)]
                for cluster in np.flatnonzero(meets.any(0)).tolist():
                    who = meets[:, cluster]
                    row = (ids[who], labels[who], lows[who].ravel(), highs[who].ravel(), v[who].astype(kind).tobytes())
                    for part in range(parts[cluster]):
                        for cell, value in zip(cells, (cluster, part, *row), strict=True):
                            cell.append(value)
                kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["cluster", "part", "ids", "labels", "lows", "highs", "vectors"])

    source = anchors.select("id", "label", "v", "lows", "highs")
    return source.mapInArrow(ask, "cluster int, part int, ids array<bigint>, labels array<bigint>, lows array<bigint>, highs array<bigint>, vectors binary")


def best(who: np.ndarray, score: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each `who`: by falling score, then rising id."""
    order = np.lexsort((found, -score, who))
    sorted_who = who[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_who[1:] != sorted_who[:-1])))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def scored(joined: DataFrame, index: Index, same_label: bool, k: int) -> DataFrame:
    """(id, window, score, found): of each request and block the k best rows in each window of each anchor."""
    length, kind, doubles = index.centroids.shape[1], index.kind, index.exact_in_doubles

    def multiply(batches):
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for row in range(batch.num_rows):
                ids, labels, lows, highs, row_ids, row_labels = (batch.column(c)[row].values.to_numpy() for c in (0, 1, 2, 3, 5, 6))
                a, x = (np.frombuffer(batch.column(c)[row].as_buffer(), kind).reshape(-1, length).astype(np.float64 if doubles else np.int64) for c in (4, 7))
                score = (a @ x.T).astype(np.int64)
                able = ((labels[:, None] == row_labels) == same_label) & (ids[:, None] != row_ids)
                lows, highs = lows.reshape(len(ids), -1), highs.reshape(len(ids), -1)
                for window in range(lows.shape[1]):
                    inside = able & (score >= lows[:, window, None]) & (score <= highs[:, window, None])
                    if len(row_ids) > 4 * k:  # leave what k others of the block beat
                        least = np.partition(np.where(inside, score, -FAR), -k, axis=1)[:, -k]
                        inside &= score >= least[:, None]
                    who, which = np.nonzero(inside)
                    if len(who):
                        hits = score[who, which]
                        top = best(who, hits, row_ids[which], k)
                        for column, values in zip(columns, (ids[who[top]], np.full(len(top), window), hits[top], row_ids[which[top]]), strict=True):
                            column.append(values)
            cells = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(cells, ["id", "window", "score", "found"])

    source = joined.select("ids", "labels", "lows", "highs", "vectors", "row_ids", "row_labels", "rows")
    return source.mapInArrow(multiply, "id bigint, window bigint, score bigint, found bigint")


def search(anchors: DataFrame, index: Index, same_label: bool, k: int) -> DataFrame:
    """(id, window, rank, score, found): of each anchor (id, label, v, lows, highs) and each of its windows the k rows with the
    highest scores within it, ties by the smaller id; rows with the anchor's id never. Each round raises the low ends to the
    k-th scores found so far, so that clusters that cannot beat them are left out."""
    spark = anchors.sparkSession
    hits = spark.createDataFrame([], "id bigint, window bigint, score bigint, found bigint, rank int")
    by = W.partitionBy("id", "window").orderBy(F.desc("score"), "found")
    begin, end, now = 0, FIRST, anchors
    while begin < len(index.radii):
        asked = written(requests_of(now, index, begin, end), "negatives-requests", row_group=16 << 20)
        if not asked.isEmpty():
            with arrow_rows(spark, JOINED_ROWS):
                new = scored(asked.join(index.lists, ["cluster", "part"]), index, same_label, k)
                last, hits = hits, written(hits.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "negatives-hits")
            if begin:
                forget(last)
        elif not begin:
            hits = written(hits, "negatives-hits")
        forget(asked)
        begin, end = end, end * TIMES
        kth = hits.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
        raised = F.transform("lows", lambda low, at: F.greatest(low, F.coalesce(F.try_element_at("kth", at.cast("bigint")), low)))
        now = anchors.join(kth, "id", "left").withColumn("lows", raised)
    return hits


def floor_share(x: Column, percent: int) -> Column:
    """percent hundredths of an integer, down to an integer, without a detour over doubles."""
    whole = x * F.lit(percent)
    return F.call_function("div", whole - F.pmod(whole, F.lit(100)), F.lit(100))


def one_row_an_id(vectors: DataFrame) -> DataFrame:
    """Of rows that share an id the one with the smallest label, then vector; only those rows are moved."""
    repeated = written(vectors.groupBy("id").count().where("count > 1").select("id"), "negatives-repeated")
    if repeated.isEmpty():
        return vectors
    one = vectors.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    return written(vectors.join(repeated, "id", "left_anti").unionByName(one), "negatives-vectors")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), one row for each negative kept.

    vectors: (id, label, v), v an array of integers; rows with a null in id, label, v or an element of v take no part, and
    shorter vectors count as ended by zeros. Anchors are the rows for which is_anchor holds. Scores are inner products with
    the anchor; higher ones come first, ties by the smaller id. An anchor's positives are its first `positives` other rows of
    its label; a positive's negatives are the first `negatives` rows of other labels with
    least * positive <= 100 * negative <= most * positive. Of rows that share an id one stays. Scores beyond 56 bits are an
    error; an empty table gives no rows.
    """
    able = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<bigint>").alias("v"), is_anchor.alias("anchor"))
    able = one_row_an_id(written(able.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)"), "negatives-vectors"))
    index = build_index(able.drop("anchor"))
    anchors = able.where("anchor").drop("anchor")
    wide = anchors.withColumns({"lows": F.array(F.lit(-FAR)), "highs": F.array(F.lit(FAR))})
    near = search(wide, index, True, positives)
    own = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.col("found").alias("positive")))).alias("own"))  # `positives` of an id
    asked = written(anchors.join(own, "id"), "negatives-anchors")
    at = F.sequence(F.lit(0), F.lit(positives - 1))
    windows = asked.withColumns({
        "lows": F.transform(at, lambda k: F.coalesce(-floor_share(-F.get("own", k)["score"], least), F.lit(1).cast("bigint"))),
        "highs": F.transform(at, lambda k: F.coalesce(floor_share(F.get("own", k)["score"], most), F.lit(0).cast("bigint"))),
    })
    found = search(windows, index, False, negatives)
    chosen = asked.select("id", F.posexplode("own").alias("window", "pair")).select("id", F.col("window").cast("bigint").alias("window"), "pair")
    return found.join(chosen, ["id", "window"]).select(
        F.col("id").alias("anchor_id"), F.col("pair.positive").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("pair.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
