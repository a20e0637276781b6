from __future__ import annotations

import public_tokenizers
from brute import components, leaks
from pyspark.sql import functions as F
from shapes import ROWS, frame
from tokenizers import Tokenizer

import corpus_pipeline as cp
from partyframe.llm.language_id import identify_languages


def test_every_stage_by_brute_force(spark, small):
    source = spark.read.parquet(f"{small}/documents.parquet")
    docs = {r.doc_id: r.text for r in source.collect()}
    found = {r.doc_id: r for r in identify_languages(source).collect()}
    left = {k: t for k, t in docs.items() if found[k].lang_pred != "und" and found[k].score >= cp.LEAST_LANGUAGE_SCORE}
    last = {}
    for k in sorted(left):
        last[left[k]] = k
    left = {k: t for t, k in last.items()}
    roots = components(list(left.items()), 5, 80)
    left = {k: t for k, t in left.items() if roots[k][1] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaks(list(left.items()), items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in left.items() if k not in gone}
    assert {r.doc_id: list(r.ids) for r in cp.run(spark, small).collect()} == want


def test_stages_keep_the_columns_and_take_awkward_rows(spark, small):
    docs = frame(spark).withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns[:1] == ["doc_id"] and set(docs.columns) == set(columns), name
    kept = [r.doc_id for r in docs.collect()]
    assert sorted(x for x in kept if x is not None) == [2, 5, 8] and kept.count(None) == 1


def test_rows_without_id_and_with_a_shared_one_are_judged_by_their_text(spark, small):
    other = "a quite different text that says nothing of what the others say and stays where it is whatever they do"
    text, near = ROWS[0][1] + " " + " ".join(f"more{k}" for k in range(60)), ROWS[0][1] + " " + " ".join(f"more{k}" for k in range(59)) + " changed"
    rows = [(7, text), (7, other), (7, other), (None, text), (None, near), (9, near), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in cp.drop_exact_copies(spark, docs, small).collect()]
    assert sorted(left, key=str) == sorted([(7, text), (7, other), (9, near), (None, None)], key=str)
    near_left = cp.drop_near_copies(spark, cp.drop_exact_copies(spark, docs, small), small).collect()
    assert sorted(map(tuple, near_left), key=str) == sorted([(7, text), (7, other), (None, None)], key=str)
    for _, stage in cp.STAGES:
        assert stage(spark, frame(spark).limit(0), small).count() == 0


def test_near_copies_at_five_words_and_eight_tenths(spark, small):
    """94 different words, two of them changed: 80 of 100 five-word shingles are shared, but 83 of 99 of four words; a third change is too much."""
    words = [f"word{k}" for k in range(94)]
    changed = lambda *at: " ".join(f"other{k}" if k in at else w for k, w in enumerate(words))
    docs = spark.createDataFrame([(1, changed()), (2, changed(30, 60)), (3, changed(20, 45, 70))], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, small).collect()) == [1, 3]
