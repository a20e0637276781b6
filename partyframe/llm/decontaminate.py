"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only).

A document leaks an item if, at some alignment without gaps, WINDOW neighbouring tokens of the item meet equal tokens
of the document in all but SUBSTITUTIONS places. A seed is a mask over token positions: it hashes the positions that it
names and ignores the others. The masks are lossless: whatever SUBSTITUTIONS places of a window differ, one of the
masks fits between them somewhere in it, so joining equal hashes loses no leak, and the alignment is then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, two_columns, written

WINDOW, SUBSTITUTIONS = 13, 2
# Fixed masks for (13, 2): token positions that count. Found by trying all masks of weight 6; tests prove them lossless.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Item positions that are verified together with a hit, and tokens of a document that are met together; what a
#: verification reads beyond a stretch is less than PAD.
BLOCK, STRETCH, PAD = 64, 512, 128


def tolerated(length: int) -> int:
    """Places of a window of `length` tokens that may differ: in proportion for items shorter than WINDOW."""
    return SUBSTITUTIONS * min(length, WINDOW) // WINDOW


def short_masks(length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(start, mask) for items of fewer than WINDOW tokens: they are cut into one run more than may differ."""
    runs = tolerated(length) + 1
    edges = [length * k // runs for k in range(runs + 1)]
    return [(a, tuple(range(b - a))) for a, b in zip(edges, edges[1:], strict=False)]


def tokens(text: str | Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda t: F.xxhash64(t))


def seed_hashes(tag: int, mask: tuple[int, ...]) -> str:
    """SQL for the hash under a mask at every position of tok; tag tells masks apart."""
    named = ", ".join(f"tok[i + {o}]" for o in mask)
    return f"if(size(tok) > {mask[-1]}, transform(sequence(0, size(tok) - {mask[-1] + 1}), i -> xxhash64({tag}, {named})), cast(array() as array<bigint>))"


def item_seeds(items: DataFrame, short_lengths: list[int]) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(hash, item, at) for every seed of every item, and the masks by tag."""
    masks = list(MASKS)
    parts = [
        items.where(F.size("tok") >= WINDOW).select("item", F.posexplode(F.expr(seed_hashes(tag, mask))).alias("at", "hash")) for tag, mask in enumerate(MASKS)
    ]
    for n in short_lengths:
        for start, mask in short_masks(n):
            tag = len(masks)
            masks.append(mask)
            named = ", ".join(f"tok[{start + o}]" for o in mask)
            parts.append(items.where(F.size("tok") == n).select("item", F.lit(start).alias("at"), F.expr(f"xxhash64({tag}, {named})").alias("hash")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, masks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, matched, window): a row for each document and item that it leaks; matched is the largest
    number of equal tokens in a window of the item.

    Only seed hashes of documents meet those of the items (a broadcast join while the items' seeds are proven to be
    few, a shuffled one beyond that); texts are read again only for documents with a hit. Texts and items without
    tokens leak nothing; items shorter than WINDOW are compared whole; null ids compare equal to each other; of repeated
    rows one is reported; very long texts are met in stretches; an empty table on either side gives no rows; other columns
    are ignored.
    """
    items = written(two_columns(benchmark, item_col, item_text_col).select(F.col("id").alias("item"), tokens("text").alias("tok")).where(F.size("tok") > 0).distinct(), "leak-items")
    short = sorted(r.n for r in items.where(F.size("tok") < WINDOW).select(F.size("tok").alias("n")).distinct().collect())
    seeds, masks = item_seeds(items, short)

    own = two_columns(docs, id_col, text_col)
    hashed = own.select("id", tokens("text").alias("tok"))
    arrays = [F.expr(seed_hashes(tag, mask)) for tag, mask in enumerate(masks)]
    # one array of all masks' hashes; a position in it falls to the mask whose part it is in
    sizes = [F.greatest(F.size("tok") - mask[-1], F.lit(0)) for mask in masks]
    seen = hashed.select("id", *(s.alias(f"n{k}") for k, s in enumerate(sizes)), F.posexplode(F.concat(*arrays)).alias("at_all", "hash"))
    hits = seen.join(bounded(written(seeds, "leak-seeds")), "hash")
    at, before = F.col("at_all"), F.lit(0)
    for k in range(len(masks) - 1):
        before = before + F.col(f"n{k}")
        at = F.when(F.col("at_all") >= before, F.col("at_all") - before).otherwise(at)
    aligned = hits.select("id", "item", (at - F.col("at")).alias("shift"), F.floor(F.col("at") / BLOCK).cast("int").alias("block")).distinct()
    aligned = written(aligned, "leak-hits")

    wanted = bounded(aligned.select("id").distinct())
    texts = own.alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")), "left_semi").select(F.col("id").alias("doc"), tokens("text").alias("doc_tok"))
    # a document with many hits is met in stretches, so that no row carries all of a very long text
    cut = F.expr(f"transform(sequence(0, cast((size(doc_tok) - 1) div {STRETCH} as int)), k -> slice(doc_tok, k * {STRETCH} + 1, {STRETCH + PAD}))")
    parts = texts.select("doc", F.size("doc_tok").alias("n_doc"), F.posexplode(cut).alias("stretch", "part"))
    placed = aligned.withColumn("first", F.greatest(F.lit(0), -F.col("shift"), F.col("block") * BLOCK - WINDOW + 1))
    placed = placed.withColumn("at", F.expr(f"cast((first + shift) div {STRETCH} as int)"))
    pairs = placed.join(parts, F.col("id").eqNullSafe(F.col("doc")) & (F.col("at") == F.col("stretch")))
    both = pairs.alias("p").join(bounded(items).alias("i"), F.col("p.item").eqNullSafe(F.col("i.item")))
    size = F.least(F.size("tok"), F.col("n_doc") - F.col("shift"), (F.col("block") + 1) * BLOCK + 2 * WINDOW) - F.col("first")
    compared = both.where(size > 0).select(
        "p.id",
        "p.item",
        F.least(F.size("tok"), F.lit(WINDOW)).alias("window"),
        F.zip_with(F.slice("tok", F.col("first") + 1, size), F.slice("part", F.col("first") + F.col("shift") - F.col("at") * STRETCH + 1, size), lambda a, b: (a == b).cast("int")).alias("same"),
    )
    windows = F.expr("transform(sequence(0, size(same) - window), k -> aggregate(slice(same, k + 1, window), 0, (n, x) -> n + x))")
    verified = compared.where(F.size("same") >= F.col("window")).select("id", "item", "window", F.array_max(windows).alias("matched"))
    least = F.col("window") - F.floor(F.col("window") * SUBSTITUTIONS / WINDOW)
    return (
        verified.where(F.col("matched") >= least)
        .groupBy("id", "item")
        .agg(F.max("matched").alias("matched"), F.max("window").alias("window"))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("matched").cast("long").alias("matched"), F.col("window").cast("long").alias("window"))
    )
