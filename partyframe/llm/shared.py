"""What the operators of this subpackage share: tables written to the cluster's shared folder, column guards, bounded broadcasts."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partyframe.functions.session import shared_path as shared_dir

#: A broadcast built here holds at most so many rows and bytes; beyond that the same step runs as a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Rows in a batch that goes to Python: texts are long, and both sides hold a batch whole.
ARROW_ROWS = 2048


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of `rows` rows at most for what is planned inside; the session's own setting holds again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), row_group: int | None = None) -> DataFrame:
    """Write df below the shared folder and read it back: the lineage ends there, and lost executors can reread it.
    row_group bounds the bytes of a Parquet row group, which readers of large rows hold whole."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with arrow_rows(spark, ARROW_ROWS):
        writer = df.write.option("parquet.block.size", row_group) if row_group else df.write
        writer.partitionBy(*partition_by).parquet(path) if partition_by else writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of written() frames that nothing will read again: what was made of them is written too."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) under fixed names, null texts as empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def width(df: DataFrame, name: str) -> Column:
    """About how many bytes a value takes in a broadcast."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(name), F.lit(0)) * 8 + 24
    return F.lit(8)


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if counting proves that it is within BROADCAST_ROWS and BROADCAST_BYTES, else df as it
    is. df is a written table or cheap to read, as it is read once more for this."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(reduce(Column.__add__, (width(df, c).cast("long") for c in df.columns)))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df
