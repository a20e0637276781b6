from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shapes import empty, frame
from tokenizers import Tokenizer

from partyframe.llm import queries
from partyframe.llm.bpe import bpe_decode, bpe_encode

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def test_encoding_is_the_librarys(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op1_bpe_round_trip(spark, small).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_texts(spark, library):
    df = frame(spark)
    rows = bpe_decode(bpe_encode(df, VOCABULARY), VOCABULARY).collect()
    assert len(rows) == df.count()
    wanted = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == wanted
    assert all(r.text == library.decode(list(r.ids), skip_special_tokens=False) for r in rows)


def test_empty_table(spark):
    assert bpe_decode(bpe_encode(empty(spark), VOCABULARY), VOCABULARY).count() == 0


def test_random_texts(spark, library):
    seen: list[str] = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(max_size=60) | st.text(alphabet="ab '\n\t.1é中​<|endoftext|>", max_size=80))
    def collect(text):
        if all(not 0xD800 <= ord(c) < 0xE000 for c in text):
            seen.append(text)

    collect()
    df = spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string")
    for r in bpe_encode(df, VOCABULARY).collect():
        assert list(r.ids) == library.encode(seen[r.doc_id], add_special_tokens=False).ids, repr(seen[r.doc_id])
