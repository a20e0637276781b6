"""WARC records in ZIP-packaged archives, written by tasks and read back by ranges, without extraction.

An archive is a ZIP file whose members are stored, not compressed: WARC files below archive/ (one gzip member a record)
and CDXJ indexes below indexes/ (a line a record: key, time, and JSON with file name, offset and length). A reader takes
the end of the file, the central directory (ZIP64 where sizes ask for it) and the indexes, then reads the ranges of the
records it wants. Indexes may name several WARC files, skip records, and be in any order, as other writers' are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, shared_dir, written

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of WARC data after which a task starts its next archive, bytes of records read at a time, records in an Arrow batch.
ARCHIVE_BYTES, READ_BYTES, BATCH = 512 << 20, 4 << 20, 256
#: Bytes of records that a reading task gets, about.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the ZIP format: signatures and layouts of its structures.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, END64_LAYOUT, LOCATOR64_LAYOUT, ENTRY_LAYOUT, LOCAL_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL", "<4s6H3L5H2L", "<4s5H3L2H"


# ---- writing


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit (refers_to given) with the HTTP head alone."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or ""),
        "WARC-Payload-Digest": digest,
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def cdxj_line(url: str | None, offset: int, length: int) -> str:
    """Host parts in reverse before the path, so that a sorted index keeps a site together; time; where the record is."""
    scheme, _, rest = (url or "").partition("://")
    host, slash, path = (rest if rest else scheme).partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")" + slash + path
    fields = {"url": url, "filename": WARC_MEMBER.rpartition("/")[2], "offset": str(offset), "length": str(length)}
    return f"{re.sub(r'[\x00-\x20\x7f]', '', key)} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(fields)}"


class ArchiveWriter:
    """One archive: records as they come, the index after them. It appears under its name when it is whole."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.uri = f"{folder}/{name}"
        self.files, path = fs.FileSystem.from_uri(self.uri)
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.path, self.part = path, f"{path}.{attempt}.tmp"
        self.stream = self.files.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)
        self.index: list[str] = []
        self.offset = 0

    def add(self, page_id: int | None, url: str | None, record: bytes) -> None:
        data = gzip.compress(record, 1, mtime=0)
        self.member.write(data)
        self.index.append(cdxj_line(url, self.offset, len(data)))
        self.offset += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX_MEMBER, "".join(f"{line}\n" for line in sorted(self.index)))
        self.zip.close()
        self.stream.close()
        self.files.move(self.part, self.path)
        return self.uri, len(self.index)


def mark_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, refers_to): of equal payloads of least_bytes or more the largest id is kept, the others refer to it.

    Payloads are counted by digest before any shuffle; the pages themselves stay where they are while the digests met
    more than once are few enough to broadcast, else both sides are shuffled.
    """
    source = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")
    ).withColumns({"sha": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload")})
    groups = source.where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = written(groups.where("copies > 1").select("sha", "n", "first"), "warc-repeated")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return source.join(bounded(repeated), ["sha", "n"], "left").select("id", "url", "payload", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write (id, url, payload, refers_to) as archives below folder; returns (path, records), read back from a table.

    A task names its archives by its partition, so that a task that runs again replaces what it wrote before.
    Empty partitions write nothing; a null id and a null url are written as empty.
    """

    def write(batches):
        context = TaskContext.get()
        out, part = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = ArchiveWriter(folder, f"part-{context.partitionId():06d}-{part:04d}.wacz", str(context.taskAttemptId()))
                out.add(row["id"], row["url"], warc_record(row["id"], row["url"], row["payload"].encode("utf-8", "replace"), row["refers_to"]))
                if out.offset >= ARCHIVE_BYTES:
                    path, n = out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
                    out, part = None, part + 1
        if out is not None:
            path, n = out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return written(marked.mapInArrow(write, "path string, records long"), "warc-archives")


# ---- reading


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of its data in the file
    size: int


class RangeFile:
    """A file of any file system that pyarrow knows, read by ranges."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{length} bytes at {offset} asked for, {len(data)} there")
        return data


def stored_members(file: RangeFile, below: tuple[str, ...] = ("",)) -> dict[str, Member]:
    """The members of a ZIP file in the folders `below`, by name, from its central directory; compressed ones among them
    raise ValueError, others are passed over."""
    tail_size = min(file.size, 22 + 65535 + 20)
    tail = file.read(file.size - tail_size, tail_size)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP file: it has no end of central directory")
    _, _, _, _, entries, size, start, _ = struct.unpack_from(END_LAYOUT, tail, at)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        _, _, where, _ = struct.unpack_from(LOCATOR64_LAYOUT, tail, at - 20)
        end64 = struct.unpack(END64_LAYOUT, file.read(where, 56))
        if end64[0] != END64:
            raise ValueError("the ZIP64 end of central directory is not where its locator says")
        entries, size, start = end64[7], end64[8], end64[9]
    directory, at, out = file.read(start, size), 0, {}
    for _ in range(entries):
        x = struct.unpack_from(ENTRY_LAYOUT, directory, at)
        if x[0] != ENTRY:
            raise ValueError("the central directory is damaged")
        method, packed, full, n_name, n_extra, n_comment, local = x[4], x[8], x[9], x[10], x[11], x[12], x[16]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            wide = extra[4 : 4 + length]
            if kind == 1:  # ZIP64: in this order, those that did not fit
                if full == 0xFFFFFFFF:
                    full, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
                if packed == 0xFFFFFFFF:
                    packed, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", wide)[0]
            extra = extra[4 + length :]
        at += 46 + n_name + n_extra + n_comment
        if not name.startswith(below):
            continue
        if method != 0 or packed != full:
            raise ValueError(f"member {name} is compressed; only stored members can be read by ranges")
        head = struct.unpack(LOCAL_LAYOUT, file.read(local, 30))
        if head[0] != LOCAL:
            raise ValueError(f"member {name} is not where the central directory says")
        out[name] = Member(name, local + 30 + head[9] + head[10], full)
    return out


def index_entries(file: RangeFile, members: dict[str, Member]) -> Iterator[tuple[str, int, int]]:
    """(name of the WARC member, offset, length) of each line of all indexes; their JSON starts at the first brace."""
    for name, member in members.items():
        if not (name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name)):
            continue
        data = file.read(member.offset, member.size) if member.size else b""
        for line in (gzip.decompress(data) if name.endswith(".gz") and data else data).splitlines():
            at = line.find(b"{")
            if at >= 0 and not line.startswith(b"!"):
                x = json.loads(line[at:])
                yield f"archive/{x.get('filename') or WARC_MEMBER.rpartition('/')[2]}", int(x["offset"]), int(x["length"])


def record_ranges(uri: str) -> Iterator[dict]:
    """Ranges of consecutive records, some READ_BYTES each: where they start in the file and how long each record is.
    An archive that has WARC data but no index of it raises ValueError."""
    file = RangeFile(uri)
    members = stored_members(file, ("archive/", "indexes/"))
    found = sorted(set(index_entries(file, members)))
    held = {name for name, m in members.items() if name.startswith("archive/") and m.size}
    if held - {name for name, _, _ in found}:
        raise ValueError(f"{uri}: no index of {', '.join(sorted(held - {name for name, _, _ in found}))}")
    now, end, lengths = ("", 0), 0, []
    for name, offset, length in found:
        if name not in members or offset + length > members[name].size:
            raise ValueError(f"{uri}: the index points beyond {name}")
        if lengths and (name != now[0] or offset != end or end - now[1] >= READ_BYTES):
            yield {"path": uri, "offset": members[now[0]].offset + now[1], "lengths": lengths}
            lengths = []
        if not lengths:
            now = (name, offset)
        lengths.append(length)
        end = offset + length
    if lengths:
        yield {"path": uri, "offset": members[now[0]].offset + now[1], "lengths": lengths}


def parse_record(data: bytes) -> dict | None:
    """One record, gzipped or not; None for what is neither a response nor a revisit. A payload that does not match its
    digest raises ValueError. Records of other writers have no page_id."""
    record = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    if fields.get("warc-type") not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    algorithm, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    whole = fields["warc-type"] == "response"
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else digest
    # digests are of what a transfer encoding holds
    if whole and algorithm == "sha1" and own != digest.upper() and b"\ntransfer-encoding:" not in http.lower():
        raise ValueError(f"the payload of {fields.get('warc-record-id')} does not match its digest")
    number = lambda urn: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn)) else None
    return {
        "page_id": number(fields.get("warc-record-id", "")),
        "url": fields.get("warc-target-uri", "").strip("<>"),
        "record_type": fields["warc-type"],
        "payload_digest": own,
        "payload_bytes": len(payload) if whole else int(stated[1]) if stated else None,
        "refers_to": number(fields.get("warc-refers-to", "")),
        "payload": payload if whole else None,
    }


RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(archives: DataFrame, columns: tuple[str, ...] = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")) -> DataFrame:
    """The records of the archives in column `path`: ranges are found from each archive's directory and index, dealt
    out, and read by tasks of their own. An empty list of archives gives no rows."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    arrow = pa.schema([arrow.field(c) for c in columns])

    def ranges(batches):
        kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for x in record_ranges(path):
                    yield pa.RecordBatch.from_pylist([x], kind)

    def records(batches):
        for batch in batches:
            for x in batch.to_pylist():
                data, at, rows = RangeFile(x["path"]).read(x["offset"], sum(x["lengths"])), 0, []
                for n in x["lengths"]:
                    row = parse_record(data[at : at + n])
                    if row is not None:
                        rows.append({c: row[c] for c in columns})
                    at += n
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    found = written(archives.select("path").repartition("path").mapInArrow(ranges, "path string, offset long, lengths array<long>"), "warc-ranges")
    kinds = dict(x.strip().split(" ") for x in RECORD.split(","))
    # a number of tasks of its own: by their own size the rows, which only say where to read, would all go to one
    n, size = found.agg(F.count(F.lit(1)), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    tasks = max(1, min(n, max(archives.sparkSession.sparkContext.defaultParallelism, (size or 0) // TASK_BYTES)))
    return found.repartition(tasks, "path", "offset").mapInArrow(records, ", ".join(f"{c} {kinds[c]}" for c in columns))


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Every page as a WARC record in archives below folder (the shared folder if not given), then read back from them.

    Null html is an empty payload; a null page_id comes back null and never is what others refer to unless all ids
    of its group are null (then all are responses); repeated rows with the largest id are all responses; a payload is
    held whole by one task at a time, however long; an empty table writes nothing and gives no rows. Other columns are
    ignored.
    """
    archives = write_archives(mark_revisits(pages, least_bytes), folder or shared_dir(pages.sparkSession, "warc"))
    return read_archives(archives, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
