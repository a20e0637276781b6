"""op3, op5, op8 and op10: joins of texts with texts."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from brute import components, leaks
from conftest import table
from pyspark.sql import functions as F
from shapes import LONG, empty, frame

from partyframe.llm import components as cc
from partyframe.llm import decontaminate, exact_dedup, line_dedup, ngram_join, queries
from partyframe.llm.decontaminate import MASKS, SUBSTITUTIONS, WINDOW, contaminated, short_masks, tolerated
from partyframe.llm.shared import forget, written


def read(spark, small, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(*cols).collect()]


# ---- benchmark decontamination


def test_masks_are_lossless():
    """Wherever SUBSTITUTIONS tokens of a window differ, a mask fits between them."""
    for gone in combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(not {s + o for o in mask} & set(gone) for mask in MASKS for s in range(WINDOW - mask[-1])), gone
    for n in range(1, WINDOW):
        for gone in combinations(range(n), tolerated(n)):
            assert any(not {s + o for o in mask} & set(gone) for s, mask in short_masks(n))


def test_leaks_by_brute_force(spark, small):
    found = {(r.doc_id, r.item_id): r.matched for r in queries.op3_decontamination(spark, small).collect()}
    assert found == leaks(read(spark, small, "documents", "doc_id", "text"), read(spark, small, "benchmark", "item_id", "text"))


def test_leaks_with_substitutions(spark):
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([2, 5, 12, 13, 14, 40, 200])))) for k in range(30)] + [(90, None), (91, ""), (92, "?!")]
    docs = []
    for k in range(120):
        _, item = draw.choice(items[:30])
        part = item.split()
        start = draw.randrange(len(part))
        part = part[start : start + draw.randrange(8, 60)]
        for _ in range(draw.randrange(5)):
            part[draw.randrange(len(part))] = draw.choice(vocabulary)
        docs.append((k, " ".join([*draw.choices(vocabulary, k=draw.randrange(30)), *part, *draw.choices(vocabulary, k=draw.randrange(30))])))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.matched for r in found.collect()} == leaks(docs, items)


def test_leaks_of_awkward_texts(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs away from it"), (1, "quick brown fox jumps over the lazy dog and runs away from it"), (None, "lorem ipsum dolor"), (3, None)], "item_id long, text string").withColumn("hash", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in contaminated(frame(spark), items).collect()}
    assert found == {(1, 1), (2, 1), (5, None)}
    assert contaminated(empty(spark), items).count() == contaminated(frame(spark), items.limit(0)).count() == 0


def test_leaks_do_not_depend_on_the_broadcast(spark, small, monkeypatch):
    want = table(queries.op3_decontamination(spark, small))
    monkeypatch.setattr("partyframe.llm.shared.BROADCAST_ROWS", 0)
    assert table(queries.op3_decontamination(spark, small)) == want


# ---- n-gram Jaccard join


def test_components_by_brute_force(spark, small):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_jaccard(spark, small).collect()}
    assert found == components(read(spark, small, "documents", "doc_id", "text"))


def near_copies(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts with a common passage, near copies at all distances, and short ones."""
    draw = random.Random(seed)
    vocabulary, common = [f"w{k}" for k in range(60)], "all rights reserved by the owner of this page and nobody else at all".split()
    rows: list[tuple[int, str]] = []
    for k in range(n):
        if rows and draw.random() < 0.7:
            text = draw.choice(rows)[1].split()
            for _ in range(draw.randrange(4)):
                if text:
                    at = draw.randrange(len(text))
                    text[at : at + draw.randrange(2)] = [draw.choice(vocabulary)] * draw.randrange(2)
        else:
            text = draw.choices(vocabulary, k=draw.choice([0, 1, 3, 4, 5, 20, 60, 150])) + common * draw.randrange(3)
        rows.append((k * 3 % (3 * n + 1), " ".join(text)))
    return rows


@pytest.mark.parametrize("frequent", [False, True])
def test_components_of_near_copies(spark, monkeypatch, frequent):
    if frequent:  # most shingles count as frequent: the token combinations have to find the links
        monkeypatch.setattr(ngram_join, "FREQUENT_COUNT", 2)
        monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    rows = near_copies(260, 11)
    found = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows)


def family(seed: int) -> list[tuple[int, str]]:
    """Copies of three texts with so many edits that most link with few others: half the edits are a copy's own, the
    others are shared by some, so that copies which do not link with the original link with each other."""
    draw = random.Random(seed)
    rows = []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(120)]
        for k in range(70):
            text = list(words)
            for at in draw.sample(range(120), draw.randrange(12)):
                text[at] = draw.choice([f"own{base}x{k}x{at}", f"shared{at}", f"shared{at}", ""])
            if draw.random() < 0.3:
                text[30:38] = [f"passage{j}" for j in range(8)]
            rows.append((1000 * k + base, " ".join(text)))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_components_of_far_copies(spark, words, percent):
    rows = family(words)
    found = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rule=ngram_join.JaccardRule(words, percent, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows, words, percent)


def test_components_of_awkward_texts(spark):
    rows = ngram_join.ngram_jaccard_components(frame(spark)).collect()
    assert len(rows) == 11
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert found[1] == found[2] == (14, 1)
    assert found[3] == (0, 3) and found[4] == (0, 4) and found[6] == (0, 6) and found[5] == (5, 5)
    assert ngram_join.ngram_jaccard_components(empty(spark)).count() == 0


def test_components_with_repeated_and_null_ids(spark):
    """Ids that stand for several texts, and rows without id, all with many copies."""
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text)] * 30 + [(5, text), (5, "other words that stand alone in here"), (7, "other words that stand alone in here"), (7, text + " eleven")]
    found = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and {r.component_id for r in found} == {5}


def test_connected_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(9, 9)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        return k if root[k] == k else find(root[k])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: find(k) for a, b in edges if a != b for k in (a, b)}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- exact dedup


@pytest.mark.parametrize("bucket_rows", [1, 3, 16_384])
def test_exact_dedup(spark, duck, small, bucket_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert table(exact_dedup.exact_dedup(docs, bucket_rows=bucket_rows)) == table(duck.sql(queries.OP8_SQL))


def test_directory_doubles_until_buckets_fit(spark):
    keys = [k << 48 for k in range(64)] + [1 << 62, 3 << 61]  # most share a long prefix
    entries = spark.createDataFrame([(k,) for k in keys], "key long")
    directory = exact_dedup.grow_directory(entries, 4)
    pointers = directory.pointers()
    assert len(pointers) == 1 << directory.global_depth == len({p for p, _, _ in pointers})
    held = [sum(1 for k in keys if (k % 2**64) >> (64 - d) == p) if d else len(keys) for p, d in directory.buckets]
    assert max(held) <= 4 and sum(held) == len(keys)


def test_exact_dedup_with_colliding_keys(spark, monkeypatch):
    """All texts under one key: chains hold every text, compared by bytes."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(k, f"text {k % 3}") for k in range(20)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id) for r in found} == {(k, 19 - (19 - k) % 3) for k in range(20)}


def test_groups_are_known_to_the_index_alone(spark):
    """The owner of a bucket merges what tasks have counted, without a further shuffle; without its file there is no result."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(6)
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(exact_dedup, "written", lambda df, name, by=(): made.append((name, written(df, name, by))) or made[-1][1])
        found = exact_dedup.exact_dedup(rows, bucket_rows=50)
    tables = dict(made)
    prints = tables["dedup-prints"]
    counted = exact_dedup.sent(prints.repartition(6), "key")
    assert counted.groupBy("key").count().agg(F.max("count")).first()[0] <= 6  # the hot text is an entry for each task
    directory = exact_dedup.grow_directory(prints, 50)
    plan = exact_dedup.owned(exact_dedup.in_bucket(counted, directory), "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("rangepartitioning(bucket") > 0 and "hashpartitioning(bucket" not in plan
    assert tables["dedup-heads"].select("bucket").distinct().count() > 10
    assert {(r.keep_id, r.group_size) for r in found.where("NOT kept").collect()} == {(2997, 1000)}
    forget(tables["dedup-cells"])
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound"):
        found.collect()


def test_exact_dedup_of_awkward_texts(spark):
    rows = exact_dedup.exact_dedup(frame(spark)).collect()
    assert len(rows) == 11
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows]
    assert found.count((2, 2, 3, True)) == 2 and (1, 2, 3, False) in found
    assert (3, 4, 3, False) in found and (4, 4, 3, True) in found and (None, 4, 3, False) in found and (None, None, 1, True) in found
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


# ---- line dedup


def test_lines_of_awkward_texts(spark, duck):
    lines = ["a b c d e", "a b x d e", "a b c d", "same line", "same line", "", "a b c d e f", "  a  b c d e ", "q w e r t y", "w e r t y", "q w e r t"]
    draw = random.Random(2)
    rows = [(k, "\n".join(draw.choices(lines, k=draw.randrange(6)))) for k in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("no", F.lit(1))
    duck.register("awkward", df.toPandas())
    want = duck.sql(queries.OP10_SQL.replace("FROM documents", "FROM awkward"))
    found = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))
    assert table(found) == table(want)


def test_line_shapes(spark):
    assert line_dedup.line_dedup(frame(spark)).count() == 11
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_tokens_ignore_case_and_marks(spark):
    row = spark.createDataFrame([("One, TWO--three_4!",)], "text string").select(decontaminate.tokens("text").alias("t")).first()
    assert len(row.t) == 4


# ---- beyond the bounds of broadcasts


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op9_warc_archives", "op10_line_dedup"])
def test_results_do_not_depend_on_the_broadcast(spark, small, monkeypatch, name):
    want = table(queries.queries()[name](spark, small))
    monkeypatch.setattr("partyframe.llm.shared.BROADCAST_BYTES", 0)
    assert table(queries.queries()[name](spark, small)) == want


def test_components_do_not_depend_on_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr("partyframe.llm.shared.BROADCAST_ROWS", 0)
    rows = [*family(4), *((900_000 + k, text) for k, (_, text) in enumerate(family(4)[:20]))]
    found = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows)


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"line number {k % 30_000} of a long text" for k in range(60_000))
    row = line_dedup.line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_lines == 60_000 and row.n_kept <= 30_000
