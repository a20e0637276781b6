"""op13: SentencePiece against the library, with its own normalisation rules too."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from shapes import LONG, ROWS, empty, frame

from partyframe.llm import pieces as p
from partyframe.llm import queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
with open(MODEL, "rb") as f:
    FILE = f.read()
TEXTS = [r[1] or "" for r in ROWS if r[1] is not LONG] + [" " * k for k in range(20)] + ["▁" * k + "a" + " " * k for k in range(8)] + ["ab" * k for k in range(30)] + ["a" * k for k in range(0, 90, 7)]


def random_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    alphabet = "  ▁aabbccdeэтоabtheher\n\t0192ﬁ漢字龘😀\x00é’<s>ÅㅎｱＡ①½  éｶﾞ"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def with_rules(rule: str, prefix: int, squeeze: int) -> bytes:
    """The model with the normalisation rule of the library: fields that follow replace those before."""
    spec = next(v for k, v in p.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3)
    spec += bytes([3 << 3, prefix, 4 << 3, squeeze])
    size, out = len(spec), bytes([3 << 3 | 2])
    while True:
        out, size = out + bytes([size & 127 | (128 if size > 127 else 0)]), size >> 7
        if not size:
            return FILE + out + spec


@pytest.mark.parametrize(("rule", "prefix", "squeeze"), [("identity", 1, 0), ("identity", 0, 1), ("nmt_nfkc", 1, 1), ("nfkc", 0, 0), ("nmt_nfkc_cf", 1, 0)])
def test_ids_text_and_spans_are_the_library_s(rule, prefix, squeeze):
    file = FILE if (rule, prefix, squeeze) == ("identity", 1, 0) else with_rules(rule, prefix, squeeze)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=file), p.Pieces(file)
    texts = TEXTS + random_texts(400)
    for text, (ids, begin, end) in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist()), text
        assert (begin <= end).all() and (np.diff(begin) >= 0).all() and (np.diff(end) >= 0).all()
        for piece, a, b in zip(library.encode(text, return_type="proto").pieces, begin.tolist(), end.tolist(), strict=True):
            if not library.is_byte(piece.id) and piece.begin < piece.end:
                assert a == piece.begin and b >= piece.end  # ours holds all of a replaced character, also where pieces cut it


def test_spans_project_to_the_source():
    own = p.Pieces(with_rules("nmt_nfkc", 1, 1))
    text = "  ﬁne  ①龘 "
    ids, begin, end = own.encode(text)
    raw, shown = text.encode(), [sentencepiece.SentencePieceProcessor(model_file=MODEL).id_to_piece(i) for i in ids.tolist()]
    spans = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin, end, strict=True)]
    assert shown[:3] == ["▁fine", "▁", "1"] and spans[:3] == ["ﬁne", "  ", "①"]
    assert b"".join(raw[a:b] for a, b in zip(begin[-3:], end[-3:], strict=True)) == "龘".encode()  # byte pieces, a byte each


def test_longest_key_wins():
    found = p.Pieces(with_rules("nfkc", 1, 0)).map
    data = "éx".encode()
    assert found.longest(data, 0) == (3, "é".encode()) and found.longest(b"ex", 0) is None


def test_decoding_of_any_ids():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), p.Pieces(FILE)
    rnd = np.random.default_rng(3)
    for ids in [[], [0], [1, 2], [0, 0], [259], [259, 259], [3 + 0xE6], [3 + 0xE6, 3 + 0x41], [3 + 0xC3, 3 + 0xA9, 300], *(rnd.integers(0, 32000, 20).tolist() for _ in range(200)), *(rnd.integers(3, 259, 9).tolist() for _ in range(200))]:
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), ids
    assert own.decode(np.array([-1, 40_000, 300], np.int32)) == library.decode([300])


def test_long_texts_go_by_windows(monkeypatch):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), p.Pieces(with_rules("nmt_nfkc", 1, 1))
    whole = p.Pieces(with_rules("nmt_nfkc", 1, 1)).encode(LONG[:100_000])
    monkeypatch.setattr(p, "WINDOW", 500)
    monkeypatch.setattr(p, "REMEMBERED", 3)
    for a, b in zip(own.encode(LONG[:100_000]), whole, strict=True):
        assert (a == b).all()
    for text in ("a" * 3000, LONG[:20_000] + "\n" + "z" * 200 + " 漢字 " * 300):
        ids, _, end = p.Pieces(FILE).encode(text)
        assert ids.tolist() == library.encode(text) and end[-1] == len(text.encode())


def test_order_of_merges_matters_only_in_words_taken_apart():
    """A piece that scores higher than its parts: merging everywhere at once would go wrong."""
    own = p.Pieces(FILE)
    a, b = int(own.symbol_of[ord("a")]), int(own.symbol_of[ord("b")])
    ab, aba = next(i for i in range(32000) if own.lengths[i] == 2), next(i for i in range(32000) if own.lengths[i] == 3)
    own.merges = {(a, b): (10, ab), (ab, a): (5, aba)}
    own.pairs = p.PairTable(own.merges)
    assert np.frombuffer(own.merged_together(["ababab"])[0], np.int32).tolist() == own.merged("ababab").tolist() == [aba, b, ab]


def test_refuses_other_models():
    with pytest.raises(ValueError, match="BPE"):
        p.Pieces(FILE + bytes([2 << 3 | 2, 2, 3 << 3, 1]))


def test_query_and_awkward_rows(spark, small):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op13_sentencepiece_round_trip(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.bytes_spanned) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len(docs[r.doc_id].encode()))
    got = p.piece_encode(frame(spark), MODEL)
    assert got.columns == ["doc_id", "ids", "starts", "ends"]
    key = lambda r: (r[0] is None, r[0] or 0, len(r[1]))
    assert [(r[0], r[1]) for r in sorted(got.collect(), key=key)] == sorted(((r[0], library.encode(r[1] or "")) for r in ROWS), key=key)
    assert p.piece_encode(empty(spark), MODEL).collect() == []
    assert p.piece_decode(got.limit(0), MODEL).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.text for r in p.piece_decode(null, MODEL).collect()] == [""]
