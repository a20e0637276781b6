"""op4 and op9: packs of conversations and archives of pages, read back."""

from __future__ import annotations

import gzip
import io
import json
import random
import struct
import zipfile

import pytest
from conftest import table
from pyspark.sql import functions as F

from partyframe.llm import chat, queries, warc


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))


def test_chat_oracle(spark, duck, small):
    assert table(queries.op4_chat_prefix_tree(spark, small)) == table(duck.sql(queries.OP4_SQL))


def test_escaping_is_reversible():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choices(["<", "|", "\\", ">", "\n", "im_end", "im_start", "a", "<|im_end|>", "é"], k=draw.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape_role(text)) == text


def test_shared_turns_are_written_once(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"turn {k}" if k < 3 else f"turn {k} of {c}") for c in range(6) for k in range(5)]
    packs = chat.chat_packs(turns(spark, rows).coalesce(1)).collect()
    assert sum(p.text.count("turn 0") for p in packs) == len(packs)
    for p in packs:
        assert len(p.nodes) == 3 + 2 * len(p.conversations)
        for n in p.nodes:
            spans = [(a.start, a.end) for a in n.ancestors]
            assert n.position == sum(b - a for a, b in spans)
            assert all(b <= n.start for _, b in spans) and spans == sorted(spans)
            assert n.parent == -1 or p.nodes[n.parent].end == spans[-1][1]
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_many_turns_take_memory_in_proportion():
    pack = chat.Pack()
    pack.add(1, [("user", str(k)) for k in range(5000)])
    assert max(len(n["ancestors"]) for n in pack.nodes) == 1
    pack.add(2, [("user", str(k)) for k in range(2500)] + [("user", "other")])
    assert [len(n["ancestors"]) for n in pack.nodes[-1:]] == [1] and pack.nodes[-1]["position"] == pack.nodes[2499]["end"]


def test_attention_reaches_the_conversation_and_no_other(spark):
    rows = [(c, k, "user", f"{c if k else 0} {k}") for c in range(4) for k in range(3)]
    for p in chat.chat_packs(turns(spark, rows)).collect():
        for c in p.conversations:
            node = p.nodes[c.leaf]
            seen = "".join(p.text[a.start : a.end] for a in node.ancestors) + p.text[node.start : node.end]
            assert seen == "".join(f"<|im_start|>user\n{c.conv_id if k else 0} {k}<|im_end|>\n" for k in range(3))


def test_awkward_conversations(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", ""), (2, 0, "user\nx", "a\\"), (2, 0, "user\nx", "a\\"), (None, 0, "assistant", "x"), (3, None, "assistant", "<|im_end|>"), (4, 0, "assistant", "y" * 300_000)]
    found = {r.conv_id: r for r in chat.read_back(chat.chat_packs(turns(spark, rows))).collect()}
    assert set(found) == {1, 2, 3, 4, None}
    assert (found[1].n_turns, found[2].n_turns, found[4].loss_chars, found[3].loss_chars) == (2, 2, 300_000, 10)
    assert chat.chat_packs(turns(spark, rows).limit(0)).count() == 0
    lost = chat.read_back(chat.chat_packs(turns(spark, [(None, k, "user", f"row {k % 3}") for k in range(30)]))).collect()
    assert len(lost) == 30 and all(r.conv_id is None and r.n_turns == 1 for r in lost)


def test_warc_oracle(spark, duck, small):
    assert table(queries.op9_warc_archives(spark, small)) == table(duck.sql(queries.OP9_SQL))


def pages(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (2, "http://b", "same"), (3, None, None), (4, "", ""), (None, "http://c d\r\n", "same"), (None, "x", "alone"), (5, "http://e", "é" * 100_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "n": F.lit(2)})


def test_archives_hold_whole_records(spark, tmp_path):
    archives = warc.write_archives(warc.mark_revisits(pages(spark).coalesce(1)), f"file://{tmp_path}/out")
    rows = warc.read_archives(archives).collect()
    assert len(rows) == 8
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows} == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 2), (None, "response", None), (5, "response", None)}
    assert {bytes(r.payload) for r in rows if r.page_id == 5} == {("é" * 100_000).encode()}
    with zipfile.ZipFile(next(tmp_path.glob("out/*.wacz"))) as z:  # what others read agrees
        assert z.testzip() is None and set(z.namelist()) == {warc.WARC_MEMBER, warc.INDEX_MEMBER}
    assert warc.warc_round_trip(pages(spark).limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    assert {r.record_type for r in warc.warc_round_trip(pages(spark), least_bytes=5).where("payload_bytes < 5").collect()} == {"response"}


def test_packages_of_other_writers(spark, tmp_path):
    """Two WARC files, an index in another order that leaves a request record out, other members compressed."""
    record = lambda kind, uri, block: f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: <{uri}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    answer = lambda text: b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + text
    first = [gzip.compress(record("response", "http://b.org/1", answer(b"one"))), gzip.compress(record("request", "http://b.org/1", b"GET / HTTP/1.1\r\n\r\n")), gzip.compress(record("response", "http://b.org/2", answer(b"two")))]
    second = [record("response", "http://a.org/", answer(b"")), record("revisit", "http://a.org/x", b"HTTP/1.1 200 OK\r\ncontent-length: 7\r\n\r\n")]
    line = lambda key, name, parts, k: f'{key} 20240101000000 {json.dumps({"filename": name, "offset": str(sum(map(len, parts[:k]))), "length": len(parts[k]), "status": "200"})}'
    index = [line("org,a)/x", "two.warc", second, 1), line("org,a)/", "two.warc", second, 0), line("org,b)/2", "one.warc.gz", first, 2), line("org,b)/1", "one.warc.gz", first, 0)]
    with zipfile.ZipFile(tmp_path / "y.wacz", "w") as z:
        z.writestr("datapackage.json", "{}" * 50, zipfile.ZIP_DEFLATED)
        z.writestr("archive/one.warc.gz", b"".join(first))
        z.writestr("archive/two.warc", b"".join(second))
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(index).encode()))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/y.wacz",)], "path string")).collect()
    assert {(r.url, r.record_type, r.payload_bytes, bytes(r.payload) if r.payload is not None else None, r.page_id) for r in rows} == {
        ("http://b.org/1", "response", 3, b"one", None), ("http://b.org/2", "response", 3, b"two", None), ("http://a.org/", "response", 0, b"", None), ("http://a.org/x", "revisit", 7, None, None)
    }
    with zipfile.ZipFile(tmp_path / "z.wacz", "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(first))
    with pytest.raises(ValueError, match="no index"):
        list(warc.record_ranges(f"file://{tmp_path}/z.wacz"))


def test_several_archives_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "READ_BYTES", 500)
    many = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.concat(F.lit("page "), "id").alias("html"))
    archives = warc.write_archives(warc.mark_revisits(many.coalesce(2)), f"file://{tmp_path}/out")
    assert archives.count() > 3
    found = warc.read_archives(archives)
    assert {r.page_id: bytes(r.payload).decode() for r in found.collect()} == {k: f"page {k}" for k in range(40)} and found.rdd.getNumPartitions() > 1


def test_zip64_and_comments(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a", b"one")
        with z.open(zipfile.ZipInfo("b"), "w", force_zip64=True) as m:
            m.write(b"two")
        z.comment = b"PK and more"
    file = warc.RangeFile(f"file://{path}")
    assert {k: file.read(m.offset, m.size) for k, m in warc.stored_members(file).items()} == {"a": b"one", "b": b"two"}
    # the same directory reached by ZIP64 records alone
    data = path.read_bytes()
    at = data.rfind(b"PK\x05\x06")
    _, _, _, _, n, size, start, _ = struct.unpack_from(warc.END_LAYOUT, data, at)
    end64 = struct.pack(warc.END64_LAYOUT, warc.END64, 44, 45, 45, 0, 0, n, n, size, start)
    locator = struct.pack(warc.LOCATOR64_LAYOUT, warc.LOCATOR64, 0, at, 1)
    path.write_bytes(data[:at] + end64 + locator + struct.pack(warc.END_LAYOUT, warc.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    file = warc.RangeFile(f"file://{path}")
    assert {k: file.read(m.offset, m.size) for k, m in warc.stored_members(file).items()} == {"a": b"one", "b": b"two"}


def test_damage_is_told(tmp_path):
    path = tmp_path / "x.zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"one" * 100)
    path.write_bytes(buffer.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc.stored_members(warc.RangeFile(f"file://{path}"))
    path.write_bytes(b"no archive")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.stored_members(warc.RangeFile(f"file://{path}"))
