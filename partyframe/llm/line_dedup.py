"""Line deduplication by a deletion-neighbourhood join (DataFrame operations only).

Two lines are near if they have the same words, or if both have LEAST_WORDS words or more and one insertion, deletion
or substitution of a word turns one into the other. A line is dropped where a near line stands earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import bounded, two_columns, written

#: One edit in five words keeps 0.8 of a line; shorter lines must be equal.
LEAST_WORDS = 5
LINE = ["h1", "h2"]


def all_lines(docs: DataFrame) -> DataFrame:
    """(id, row, no, words, h1, h2) for each line with words: row tells apart documents that share an id, (h1, h2) is
    a 128-bit name of the words."""
    lines = docs.select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    words = lines.select("id", "row", "no", F.array_remove(F.split("line", " "), "").alias("words")).where(F.size("words") > 0)
    return words.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit("second"), F.col("words"))})


def order(id_col: str, no_col: str) -> Column:
    """One number that orders lines by document and position: ids are below 2**63, lines of a document below 2**32."""
    return F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(-(2**63)).cast("decimal(20,0)")) * F.lit(2**32).cast("decimal(11,0)") + F.col(no_col).cast("decimal(11,0)")


def half_keys() -> Column:
    """Hashes of first and last halves, so cut that two near lines have one in common: the edit leaves one half alone.

    A line of n words is cut as such, and as the longer partner of a line of n - 1 words.
    """
    n = F.size("words")
    keys = []
    for length in (n, n - 1):
        first = (length / 2).cast("int")
        last = length - first
        keys.append(F.xxhash64(F.lit("a"), first, F.slice("words", 1, first)))
        keys.append(F.xxhash64(F.lit("z"), last, F.slice("words", n - last + 1, last)))
    return F.array_distinct(F.array(*keys))


def variants(lines: DataFrame) -> DataFrame:
    """(ord, key, kind) for every variant within one edit, in time linear in the words of a line.

    kind 0: word i masked, position and length being part of the key. kind 1: the line itself. kind 2: the line without
    word i. A line without word i is named by the XOR of hash(word, position) before i and hash(word, position - 1) after.
    """
    each = lines.select("ord", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    whole = W.partitionBy("ord")
    upto = whole.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    named = each.withColumns({"here": F.xxhash64("word", "i"), "shifted": F.xxhash64("word", F.col("i") - 1)})
    summed = named.withColumns({"all_here": F.bit_xor("here").over(whole), "all_shifted": F.bit_xor("shifted").over(whole), "to_here": F.bit_xor("here").over(upto), "to_shifted": F.bit_xor("shifted").over(upto)})
    masked = F.col("all_here").bitwiseXOR(F.col("here"))
    without = F.col("to_here").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all_shifted")).bitwiseXOR(F.col("to_shifted"))
    keys = F.array(
        F.struct(F.xxhash64(F.lit(0), "n", "i", masked).alias("key"), F.lit(0).cast("byte").alias("kind")),
        F.struct(F.xxhash64(F.lit(1), F.col("n") - 1, without).alias("key"), F.lit(2).cast("byte").alias("kind")),
        F.when(F.col("i") == 0, F.struct(F.xxhash64(F.lit(1), "n", F.col("all_here")).alias("key"), F.lit(1).cast("byte").alias("kind"))),
    )
    return summed.select("ord", F.explode(keys).alias("v")).where("v IS NOT NULL").select("ord", "v.key", "v.kind")


def within_one_edit(a: str, b: str) -> Column:
    """Whether the word arrays in columns a and b are at edit distance 1."""
    differ = F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)

    def longer_by_one(long: str, short: str) -> Column:
        n = F.size(short)
        first = F.array_position(F.zip_with(F.slice(long, 1, n), short, lambda x, y: x != y), True).cast("int")
        same = F.when(first == 0, n).otherwise(first - 1)
        return F.slice(long, same + 2, F.greatest(F.size(long), F.lit(1))) == F.slice(short, same + 1, F.greatest(n, F.lit(1)))

    return (
        F.when(F.size(a) == F.size(b), F.size(differ) == 1)
        .when(F.size(a) == F.size(b) + 1, longer_by_one(a, b))
        .when(F.size(b) == F.size(a) + 1, longer_by_one(b, a))
        .otherwise(F.lit(False))
    )


def near_earlier(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """Names (h1, h2) of the distinct lines that have a near, different line before them."""
    long = distinct.where(F.col("n") >= LEAST_WORDS)
    halves = long.select(*LINE, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("half")
    maybe = written(halves.join(shared, "half", "left_semi").select(*LINE).distinct().join(long.select(*LINE, "first"), LINE), "lines-maybe")
    found = lines.join(bounded(maybe), LINE).where(order("id", "no") == F.col("first"))
    # one task writes each name once; repeated rows of a document give the same words again
    texts = written(found.select(F.col("first").alias("ord"), *LINE, "words").dropDuplicates(["ord", *LINE]), "lines-texts")

    emitted = written(variants(texts), "lines-variants")
    least = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("ord")))
    groups = emitted.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), least(0).alias("masked"), least(1).alias("itself"), least(2).alias("without")).where("rows > 1")
    earliest = F.when(F.col("kind") == 0, F.col("masked")).when(F.col("kind") == 1, F.col("without")).otherwise(F.col("itself"))
    before = emitted.join(groups, "key").withColumn("earlier", earliest).where("earlier < ord").groupBy("ord", "earlier").agg(F.count(F.lit(1)).alias("keys"))
    other = texts.select(F.col("ord").alias("earlier"), F.col("words").alias("other"))
    return before.join(texts, "ord").join(other, "earlier").where(within_one_edit("words", "other")).select(*LINE).distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_kept, text) for every document: its lines without those that have a near line earlier.

    Lines are ordered by document id (null first) and position; words are what spaces separate. Each line with words
    stays at its first place only, and nowhere if an earlier different line is near; lines without words always stay.
    Groups of near lines are never paired: each variant keeps the earliest line that has it, each line looks up the
    earliest line that shares one of its variants, and that pair is verified word by word.
    Null text counts as empty (one line, kept); repeated rows of one document count as one; an empty table gives no
    rows; other columns are ignored.
    """
    source = two_columns(docs, id_col, text_col)
    lines = all_lines(source)
    named = lines.select(*LINE, F.size("words").alias("n"), half_keys().alias("halves"), order("id", "no").alias("ord"))
    slots = [F.min(F.get(F.col("halves"), F.lit(k))).alias(f"half{k}") for k in range(4)]
    grouped = named.groupBy(*LINE, "n").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), *slots)
    distinct = written(grouped.select(*LINE, "n", "first", "last", F.array_compact(F.array(*(f"half{k}" for k in range(4)))).alias("halves")), "lines-distinct")
    near = written(near_earlier(distinct, lines), "lines-near")

    # what is dropped somewhere: lines that stand in several places, and those with a near line earlier
    marked = distinct.join(bounded(near).withColumn("everywhere", F.lit(True)), LINE, "left").where("first < last OR everywhere").select(*LINE, "first", "everywhere")
    gone = lines.select("id", "row", "no", *LINE).join(bounded(written(marked, "lines-marked")), LINE).where((order("id", "no") > F.col("first")) | F.col("everywhere"))
    by_doc = written(gone.groupBy("id", "row").agg(F.collect_set("no").alias("gone")), "lines-gone")
    # split below the join, so that the lines kept are looked up and not split again
    left, right = source.select("id", F.xxhash64("text").alias("row"), F.split("text", "\n").alias("parts")).alias("d"), bounded(by_doc).alias("g")
    joined = left.join(right, F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.row") == F.col("g.row")), "left").select("d.id", "parts", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.expr("transform(array_except(sequence(0, size(parts) - 1), gone), k -> parts[k])")
    return joined.select(
        F.col("id").alias(id_col),
        F.size("parts").cast("long").alias("n_lines"),
        (F.size("parts") - F.size("gone")).cast("long").alias("n_kept"),
        F.array_join(F.when(F.size("gone") == 0, F.col("parts")).otherwise(stay), "\n").alias("text"),
    )
