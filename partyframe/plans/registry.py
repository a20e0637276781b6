"""Where queries register: a Spark query under its operator's id, and the DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS, used_tables, with_views

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


    def view(self, name: str) -> DataFrame:
        """A view of plans.views over the tables."""
        return self.spark.sql(VIEWS[name], **{t: getattr(self, t) for t in used_tables(name)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a function of Tables under the operator's id; its oracle may name views."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(views, sql) if views else sql
        return f

    return add


def r(x: str) -> str:
    """The SQL of functions.scalar.rounded."""
    return f"floor(({x}) * 10000 + 0.5003) / 10000"


def sql_hash(*cols: str, seed: int = 0) -> str:
    """The SQL of functions.scalar.hash_order."""
    return f"('0x' || substr(sha256(concat_ws(':', '{seed}', {', '.join(f'({c})::VARCHAR' for c in cols)})), 1, 15))::BIGINT"


def digest_sql(table: str, values: dict[str, str], by: str = "") -> str:
    """The SQL of audit.row_digest for columns given as SQL texts."""
    text = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE 'V' || length({v}) || ':' || {v} END" for c, v in sorted(values.items()))
    limbs = ", ".join(f"sum(('0x' || substr(h, {16 * k + 1}, 16))::UBIGINT::HUGEINT)::VARCHAR AS s{k}" for k in range(8))
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {key}n AS rows, sha256(concat_ws(':', n, {', '.join(f's{k}' for k in range(8))})) AS digest FROM (
    SELECT {key}count(*) AS n, {limbs} FROM (SELECT {key}sha256('0' || row) || sha256('1' || row) AS h FROM (SELECT {key}{text} AS row FROM {table})){group})"""
