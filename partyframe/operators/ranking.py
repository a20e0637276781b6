"""Ranks and running sums over a whole table without sorting it in one task.

Rows get a bucket that grows with the order; bucket totals (bounded in number) are summed in order, and rows are
ranked within their bucket only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.session import checkpointed

#: Buckets that the order is cut into, at most; their totals are all that meets in one task.
BUCKETS = 4096
#: Quantile ranges that these fall into evenly.
PARTS = 64


def running(df: DataFrame, order: str, sums: dict[str, Column], bucket: Column, descending: bool = False) -> DataFrame:
    """df with running sums in the order of column `order` (unique values), each row included."""
    cols = df.columns
    marked = df.withColumn("_bucket", bucket).withColumns({f"_{k}": v for k, v in sums.items()})
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = marked.groupBy("_bucket").agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    before = W.orderBy(direction("_bucket")).rowsBetween(W.unboundedPreceding, -1)  # over BUCKETS rows at most
    offsets = totals.select("_bucket", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums))
    inside = W.partitionBy("_bucket").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    joined = marked.join(F.broadcast(offsets), "_bucket")
    return joined.select(*cols, *((F.col(f"_o_{k}") + F.sum(f"_{k}").over(inside)).alias(k) for k in sums))


def value_bucket(df: DataFrame, col: str) -> Column:
    """A bucket that grows with a number (one small job over df, so df is a table that is cheap to read, or written): PARTS
    approximate quantiles, each range cut evenly into as many more. An outlier widens the last range only, so the others
    still spread over their buckets."""
    x = F.col(col).cast("double")
    found = df.agg(F.percentile_approx(x, F.array(*(F.lit(k / PARTS) for k in range(PARTS + 1))), F.lit(10 * PARTS))).first()[0]
    edges = sorted(set(found or []))
    if len(edges) < 2:
        return F.lit(0)
    fine = BUCKETS // PARTS

    def within(low: int, high: int) -> Column:
        """The bucket, the range being known to be one from low to high - 1: a tree of comparisons, in generated code."""
        if high - low == 1:
            place = F.floor((x - F.lit(edges[low])) / F.lit(edges[low + 1] - edges[low]) * fine)
            return F.lit(low * fine) + F.least(F.greatest(place, F.lit(0)), F.lit(fine - 1))
        middle = (low + high) // 2
        return F.when(x < edges[middle], within(low, middle)).otherwise(within(middle, high))

    return within(0, len(edges) - 1).cast("int")


def hash_rank(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """df with the 1-based rank by `order`, 60-bit hashes as of hash_order; equal hashes are ranked in no fixed order."""
    marked = df.withColumn("_hash", order)
    ranked = running(marked, "_hash", {name: F.lit(1)}, (F.shiftrightunsigned("_hash", 48)).cast("int"))
    return ranked.drop("_hash")


def ordered_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums by `order`, a total order, each row included. Ranges of the order, drawn by Spark's sample, are sorted
    each in its task and written with their rows' places; a range's sums begin with those of the ranges before. No value,
    however many rows share it, has a range to itself if later columns of the order tell its rows apart."""
    marked = df.withColumns({f"_{k}": v for k, v in sums.items()})
    ranged = checkpointed(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    rows = sorted(tuple(r) for r in ranged.groupBy("_part").agg(*(F.sum(f"_{k}") for k in sums)).collect())  # a row for each range
    kinds = [ranged.select(F.sum(f"_{k}").alias("x")).schema["x"].dataType.simpleString() for k in sums]
    zero = [0.0 if kind == "double" else Decimal(0) if kind.startswith("decimal") else 0 for kind in kinds]
    offsets, upto = [], zero
    for part, *totals in rows:
        offsets.append((part, *upto))
        upto = [u + (x or z) for u, x, z in zip(upto, totals, zero, strict=True)]
    before = df.sparkSession.createDataFrame(offsets, ", ".join(["_part long", *(f"_b_{k} {kind}" for k, kind in zip(sums, kinds, strict=True))]))
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_part").select(*df.columns, *((F.col(f"_b_{k}") + F.sum(f"_{k}").over(inside)).alias(k) for k in sums))


def ordered_place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the 0-based place by `order`, a total order; as ordered_sums(), but a row's place in its range is its id there."""
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offset, offsets = 0, []
    for row in sorted(ranged.groupBy(part.alias("_part")).count().collect()):  # a row for each range
        offsets.append((row["_part"], offset))
        offset += row["count"]
    before = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before", "_at")


def average_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """df with the rank of a number, equal values sharing the mean of their places; NULL for NULL."""
    counts = checkpointed(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")))
    upto = running(counts, col, {"_upto": F.col("_n")}, value_bucket(counts, col))
    ranks = upto.select(F.col(col).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, F.col(col) == F.col("_v"), "left").drop("_v")


def exact_share(df: DataFrame, fraction: float, order: Column, name: str, total: int | None = None) -> DataFrame:
    """df with a boolean that is true for exactly round(n * fraction) rows, those first by hash (half to even)."""
    n = df.count() if total is None else total
    return hash_rank(df, order, "_rank").withColumn(name, F.col("_rank") <= round(n * fraction)).drop("_rank")


#: Rows up to which one aggregate finds quantiles, all distinct values in one task; of more they are bracketed first.
QUANTILE_ROWS = 100_000
#: Accuracy of the sketch that brackets a quantile, in parts of the rows; a bracket reaches two parts to both sides.
SKETCH = 10_000
#: Rows in a bracket up to which its distinct values are ranked in one task; in fuller ones ever narrower ranges are counted.
BRACKET_ROWS = 2_000_000


def order_statistic(df: DataFrame, col: str, k: int) -> float:
    """The k-th smallest value of a double column (k from 0, NULL left out), exactly: counts of BUCKETS ever narrower
    ranges reach the driver, never values."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    while low < high:
        step = (high - low) / BUCKETS
        if step == 0 or low + step == low:  # neighbouring numbers: few distinct ones are left
            for row in df.where(F.col(col).between(low, high)).groupBy(col).count().orderBy(col).toLocalIterator():
                if k < row["count"]:
                    return row[0]
                k -= row["count"]
            return high
        inside = df.where(F.col(col).between(low, high)).groupBy(F.least(F.floor((F.col(col) - low) / step), F.lit(BUCKETS - 1)).alias("b"))
        for row in sorted(inside.agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), key=lambda x: x.lo):
            if k < row.n:
                low, high = row.lo, row.hi
                break
            k -= row.n
    return low


def quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Linear quantiles (as of percentile) of the columns. The rows are counted first; many are written, so that bracketing
    does not run their plan again each time."""
    if df.count() <= QUANTILE_ROWS:
        row = df.agg(*(F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in cols)).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(qs) for c in cols}
    return bracketed_quantiles(checkpointed(df.select(*cols)), cols, qs)


def quantile_frame(df: DataFrame, col: str, q: float, name: str, written: bool = False) -> DataFrame:
    """One row with the linear q-quantile of a double column. Few rows find it in the same plan; of more it is bracketed
    first, over a copy unless df is `written` already, as an exact aggregate would gather all their values in one task."""
    if df.count() <= QUANTILE_ROWS:
        return df.agg(F.percentile(col, F.lit(q)).alias(name))
    kept = df if written else checkpointed(df.select(col))
    return df.sparkSession.createDataFrame([(bracketed_quantiles(kept, [col], [q])[col][0],)], f"{name} double")


def bracketed_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles() of a table that is cheap to read, in three passes for all columns and quantiles together: sketches
    give two values around each, one aggregate counts the rows before and between, and only those between are ranked.
    Sketches decide the cost, never the result: a quantile outside its bracket, or in one that holds too many rows, is found by
    order_statistic()."""
    reach, wanted = 2 / SKETCH, [(c, q) for c in cols for q in qs]
    edges = F.array(*(F.lit(min(max(q + side * reach, 0.0), 1.0)) for q in qs for side in (-1, 1)))
    seen = df.agg(*(x for c in cols for x in (F.count(c), F.percentile_approx(F.col(c).cast("double"), edges, F.lit(SKETCH))))).first()
    size = {c: seen[2 * k] for k, c in enumerate(cols)}
    sides = {c: seen[2 * k + 1] for k, c in enumerate(cols)}
    bracket = {(c, q): sides[c][2 * j : 2 * j + 2] for c in cols if size[c] for j, q in enumerate(qs)}
    within = {x: F.col(x[0]).between(*(F.lit(e) for e in ends)) for x, ends in bracket.items()}
    counts = df.agg(F.lit(0), *(n for x, ends in bracket.items() for n in (F.count_if(F.col(x[0]) < F.lit(ends[0])), F.count_if(within[x])))).first()[1:]
    below, inside = dict(zip(bracket, counts[::2], strict=True)), dict(zip(bracket, counts[1::2], strict=True))
    places = {x: {int(x[1] * (size[x[0]] - 1)), min(int(x[1] * (size[x[0]] - 1)) + 1, size[x[0]] - 1)} for x in bracket}
    easy = [x for x in bracket if inside[x] <= BRACKET_ROWS and all(0 <= k - below[x] < inside[x] for k in places[x])]
    found = {}
    if easy:
        each = F.array(*(F.when(within[x], F.struct(F.lit(j).alias("at"), F.col(x[0]).cast("double").alias("v"))) for j, x in enumerate(easy)))
        met = df.select(F.inline(F.filter(each, lambda e: e.isNotNull()))).groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = met.withColumn("upto", F.sum("n").over(W.partitionBy("at").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
        ks = df.sparkSession.createDataFrame([(j, k, k - below[x]) for j, x in enumerate(easy) for k in places[x]], "at int, k long, rank long")
        hit = upto.join(F.broadcast(ks), "at").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        found = {(easy[r["at"]], r["k"]): r["v"] for r in hit.collect()}  # two values of a quantile at most
    value = lambda x, k: found[x, k] if (x, k) in found else order_statistic(df, x[0], k)
    out: dict[str, list[float | None]] = {c: [] for c in cols}
    for c, q in wanted:
        if not size[c]:
            out[c].append(None)
            continue
        at = q * (size[c] - 1)
        low = value((c, q), int(at))
        high = value((c, q), int(at) + 1) if at > int(at) else low
        out[c].append(low + (high - low) * (at - int(at)))
    return out


def counted_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float | None]:
    """quantiles() of one column by order_statistic() alone, for tables of any size."""
    n, out = df.select(F.count(col)).first()[0], []
    for q in qs if n else []:
        at = q * (n - 1)
        low = order_statistic(df, col, int(at))
        high = order_statistic(df, col, int(at) + 1) if at > int(at) else low
        out.append(low + (high - low) * (at - int(at)))
    return out or [None] * len(qs)
