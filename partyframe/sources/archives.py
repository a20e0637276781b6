"""Rating archives as ZIP files, in any file system that pyarrow knows: members are read by byte ranges, never unpacked."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from partyframe.sources.files import RATING_FILES

#: Lines in a batch that leaves a reader; bytes that are read ahead of a member's stream.
LINES, AHEAD = 8192, 1 << 20
#: Rows of all members that an archive gets on average, at most: a task sorts them by member.
ARCHIVE_ROWS = 1_000_000


class MissingMemberError(ValueError):
    """An archive that lacks a member it should have."""


def opened(uri: str) -> zipfile.ZipFile:
    """The archive at uri: only its central directory is read."""
    files, path = fs.FileSystem.from_uri(uri)
    return zipfile.ZipFile(io.BufferedReader(files.open_input_file(path), AHEAD))


def archives_at(uri: str) -> list[str]:
    """uri itself, or the ZIP files right below it, by name."""
    files, path = fs.FileSystem.from_uri(uri)
    if files.get_file_info(path).type != fs.FileType.Directory:
        return [uri]
    found = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".zip"))
    return [f"{uri.rstrip('/')}/{name}" for name in found]


def member_name(archive: zipfile.ZipFile, wanted: str) -> str | None:
    """The full name of a member that is called `wanted`, in whatever folder of the archive."""
    return next((n for n in archive.namelist() if n.rsplit("/", 1)[-1] == wanted), None)


class MemberPartition(InputPartition):
    def __init__(self, archive: str):
        self.archive = archive


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.member, self.encoding = options["path"], options["member"], options.get("encoding", "ISO-8859-1")

    def partitions(self) -> list[MemberPartition]:
        return [MemberPartition(uri) for uri in archives_at(self.path)]

    def read(self, partition: MemberPartition) -> Iterator[pa.RecordBatch]:
        with opened(partition.archive) as archive:
            name = member_name(archive, self.member)
            if name is None:
                raise MissingMemberError(f"{partition.archive} lacks {self.member}")
            held: list[str] = []
            for line in io.TextIOWrapper(archive.open(name), self.encoding, newline="\n"):
                held.append(line.rstrip("\r\n"))
                if len(held) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])


class ArchiveMember(DataSource):
    """format("archive_member"): the lines of one member of the ZIP file, or of every ZIP file right below the folder, at path;
    a task for each archive. A member is decompressed as a stream, so its size is bounded by nothing."""

    @classmethod
    def name(cls) -> str:
        return "archive_member"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def read_rating_archives(spark: SparkSession, uri: str) -> dict[str, DataFrame]:
    """users, movies and ratings of the rating archive at uri, or of all archives below it; fields end with ::, Latin-1. A
    field that does not fit its type is NULL. An archive without one of the members is refused before any of it is read."""
    archives = archives_at(uri)
    if not archives:
        raise FileNotFoundError(uri)
    for each in archives:
        with opened(each) as archive:
            if missing := sorted(f"{m}.dat" for m in RATING_FILES if member_name(archive, f"{m}.dat") is None):
                raise MissingMemberError(f"{each} lacks {', '.join(missing)}")
    spark.dataSource.register(ArchiveMember)
    out = {}
    for member, schema in RATING_FILES.items():
        fields = [f.split(" ") for f in schema.split(", ")]
        parts = F.split("line", "::")
        lines = spark.read.format("archive_member").option("member", f"{member}.dat").load(uri).where("line <> ''")
        out[member] = lines.select(*(F.get(parts, F.lit(k)).try_cast(kind).alias(name) for k, (name, kind) in enumerate(fields)))
    return out


def write_rating_archives(tables: dict[str, DataFrame], folder: str, archives: int = 1) -> list[str]:
    """Write users, movies and ratings as so many archives below folder, or more where they would hold over ARCHIVE_ROWS rows
    each; every archive has all members and a share of the rows. The archives' places are returned. A task writes an archive; one
    that runs again replaces it."""
    if set(tables) != set(RATING_FILES):
        raise ValueError(f"an archive has the members {sorted(RATING_FILES)}")
    lines = None
    for member, df in tables.items():
        names = [f.split(" ")[0] for f in RATING_FILES[member].split(", ")]
        line = F.concat_ws("::", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
        own = df.select(F.lit(f"{member}.dat").alias("member"), line.alias("line"))
        lines = own if lines is None else lines.unionByName(own)

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        target = f"{path}/part-{part:05d}.zip"
        left = sorted(f"{m}.dat" for m in RATING_FILES)
        with files.open_output_stream(f"{target}.{attempt}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            member = None
            for batch in batches:
                for name, own in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                    while member is None or member.name != f"ratings/{name}":
                        if member is not None:
                            member.close()
                        member = archive.open(f"ratings/{left.pop(0)}", "w", force_zip64=True)
                    member.write("".join(f"{line}\n" for _, line in own).encode("ISO-8859-1", "replace"))
            if member is not None:
                member.close()
            for name in left:
                archive.writestr(f"ratings/{name}", b"")
        files.move(f"{target}.{attempt}", target)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/part-{part:05d}.zip"])], ["archive"])

    archives = max(archives, math.ceil(sum(df.count() for df in tables.values()) / ARCHIVE_ROWS))
    dealt = lines.repartition(archives).sortWithinPartitions("member")
    return sorted(r.archive for r in dealt.mapInArrow(write, "archive string").collect())  # a name for each archive
