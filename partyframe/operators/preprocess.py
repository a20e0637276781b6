"""Party-local preprocessing: fitted on training rows, a few numbers per column, then applied as plain expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partyframe.functions.scalar import bin_code, clipped, hash_order
from partyframe.operators.ranking import quantiles
from partyframe.operators.relational import MissingColumnsError

#: Distinct values of a categorical column at most: each becomes a column.
MAX_CATEGORIES = 4096


def column_types(df: DataFrame, leave: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns, as their types say."""
    cols = [f for f in df.schema.fields if f.name not in leave]
    numeric = [f.name for f in cols if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in cols if f.name not in numeric]


@dataclass
class LocalPreprocessor:
    """Impute, winsorise, scale and one-hot encode one party's columns.

    scaling: robust ((x - median) / IQR after imputing), standard (population deviation) or none. Zero spread counts
    as 1. Categories not met in training give all zeros; missing ones count as the mode (of equals the smallest).
    """

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    scaling: str = "robust"
    winsor: float | None = None
    fitted: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.scaling not in ("robust", "standard", "none"):
            raise ValueError(f"unknown scaling {self.scaling}")
        if self.winsor is not None and not 0 < self.winsor < 0.5:
            raise ValueError("winsor must be within (0, 0.5)")

    def check(self, df: DataFrame) -> None:
        missing = [c for c in [*self.numeric, *self.categorical] if c not in df.columns]
        if missing:
            raise MissingColumnsError(f"missing columns: {', '.join(missing)}")

    def fit(self, train: DataFrame) -> LocalPreprocessor:
        self.check(train)
        x = train.select(*(F.col(c).cast("double").alias(c) for c in self.numeric), *self.categorical)
        if self.numeric and self.winsor is not None:
            self.fitted["limits"] = quantiles(x.select(*self.numeric), self.numeric, [self.winsor, 1 - self.winsor])
        clip = x.select(*(self.clipped(c).alias(c) for c in self.numeric)) if self.numeric else None
        if clip is not None:
            self.fitted["median"] = {c: q[0] if q[0] is not None else 0.0 for c, q in quantiles(clip, self.numeric, [0.5]).items()}
            full = clip.select(*(F.coalesce(F.col(c), F.lit(self.fitted["median"][c])).alias(c) for c in self.numeric))
            if self.scaling == "robust":
                found = quantiles(full, self.numeric, [0.25, 0.75])
                self.fitted["scale"] = {c: (self.fitted["median"][c], (b - a) or 1.0) if a is not None else (0.0, 1.0) for c, (a, b) in found.items()}
            elif self.scaling == "standard":
                row = full.agg(*(f(c).alias(f"{n}{c}") for c in self.numeric for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
                self.fitted["scale"] = {c: (row[f"m{c}"] or 0.0, row[f"s{c}"] or 1.0) for c in self.numeric}
            else:
                self.fitted["scale"] = {c: (0.0, 1.0) for c in self.numeric}
        for c in self.categorical:
            rows = x.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(MAX_CATEGORIES + 1).collect()
            if len(rows) > MAX_CATEGORIES:
                raise ValueError(f"{c} has over {MAX_CATEGORIES} values")
            self.fitted.setdefault("mode", {})[c] = rows[0].v if rows else None
            self.fitted.setdefault("values", {})[c] = sorted(r.v for r in rows)
        return self

    def clipped(self, c: str) -> Column:
        limits = self.fitted.get("limits", {}).get(c)
        return clipped(F.col(c).cast("double"), *limits) if limits and limits[0] is not None else F.col(c).cast("double")

    def columns(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for c in self.numeric:
            middle, spread = self.fitted["scale"][c]
            out[c] = (F.coalesce(self.clipped(c), F.lit(self.fitted["median"][c])) - middle) / spread
        for c in self.categorical:
            filled = F.coalesce(F.col(c).cast("string"), F.lit(self.fitted["mode"][c]))
            out |= {f"{c}_{v}": F.coalesce((filled == v).cast("double"), F.lit(0.0)) for v in self.fitted["values"][c]}
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        self.check(df)
        return df.select(*keep, *(c.alias(name) for name, c in self.columns().items()))

    def feature_metadata(self) -> list[tuple[str, str, str]]:
        """(feature, source column, transformation) of every output column."""
        number = ", ".join(x for x in (f"winsorised at {self.winsor}" if self.winsor is not None else "", "median imputed", f"{self.scaling} scaled" if self.scaling != "none" else "") if x)
        return [*((c, c, number) for c in self.numeric), *((f"{c}_{v}", c, "mode imputed, one-hot") for c in self.categorical for v in self.fitted["values"][c])]


def fit_bins(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """The distinct inner quantiles at i / bins, ascending, of every column's finite values."""
    found = quantiles(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), columns, [k / bins for k in range(1, bins)]) if bins > 1 else {c: [] for c in columns}
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def apply_bins(edges: dict[str, list[float]]) -> dict[str, Column]:
    """Bin codes as columns: how many edges lie below the value; missing values are in the last bin."""
    return {c: bin_code(F.col(c).cast("double"), F.array(*map(F.lit, e)) if e else F.array().cast("array<double>")).cast("int") for c, e in edges.items()}


def train_zscores(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Median imputed (of training rows), then z-scored by their mean and sample deviation; 0 or no deviation counts as 1."""
    rows = df.where(train).select(*columns)
    middle = {c: q[0] if q[0] is not None else 0.0 for c, q in quantiles(rows, columns, [0.5]).items()}
    full = {c: F.coalesce(F.col(c), F.lit(middle[c])) for c in columns}
    stats = df.where(train).agg(*(f(full[c]).alias(f"{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    return df.withColumns({c: (full[c] - (stats[f"m{c}"] or 0.0)) / (stats[f"s{c}"] or 1.0) for c in columns})


def linkage_matrix(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Numbers for linkage: missing numbers are 0, texts a hash modulo 1000003 (missing ones that of <missing>)."""
    numeric, _ = column_types(df.select(*columns), [])
    code = lambda c: (hash_order(F.coalesce(F.col(c).cast("string"), F.lit("<missing>")), seed="category") % 1_000_003).cast("double")
    return {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in numeric else code(c) for c in columns}


