"""Queries of donor matching and party-local preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from partyframe.operators import linkage as ln
from partyframe.operators import preprocess as pp
from partyframe.operators import ranking
from partyframe.operators import relational as rel

from .feature_queries import round_doubles, rounds
from .registry import Tables, query, r, sql_hash

FEATURES = ["x0", "x2", "x4"]
DONOR = ["s_acctbal", "nation"]


def donors(t: Tables):
    return t.supplier.select(F.col("s_suppkey").alias("id"), "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))


def factor_sql(name: str, src: str, cols: list[str]) -> str:
    filled = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}, median({c}) OVER () AS m_{c}" for c in cols)
    mads = ", ".join(f"median(abs({c} - m_{c})) OVER () AS d_{c}" for c in cols)
    terms = " + ".join(f"tanh(({c} - m_{c}) / CASE WHEN d_{c} < 1e-12 THEN 1 ELSE d_{c} END)" for c in cols)
    return f"{name} AS (SELECT id, ({terms}) / {len(cols)} AS factor FROM (SELECT *, {mads} FROM (SELECT id, {filled} FROM {src})))"


@query("F11_row_factor", f"WITH {factor_sql('f', 'learning', FEATURES)} SELECT id, {r('factor')} AS factor FROM f", "learning")
def row_factor(t: Tables):
    return round_doubles(ln.row_factor(t.view("learning"), "id", FEATURES))


@query("J10_copula_link")  # the normal quantile is not in SQL; tests hold it against brute force
def copula(t: Tables):
    return ln.copula_link(t.view("learning"), donors(t), "id", FEATURES, DONOR, 0.25, 0.15, 42)


near_sql = """
WITH a AS (SELECT id AS anchor_id, x0 * 5000 AS score FROM learning), d AS (SELECT s_acctbal AS score, min(s_suppkey) AS donor_id FROM supplier GROUP BY s_acctbal),
low AS (SELECT anchor_id, a.score, d.donor_id, d.score AS ds FROM a ASOF LEFT JOIN d ON a.score >= d.score),
high AS (SELECT anchor_id, d.donor_id, d.score AS ds FROM a ASOF LEFT JOIN d ON a.score <= d.score)
SELECT anchor_id, CASE WHEN high.donor_id IS NULL THEN low.donor_id WHEN low.donor_id IS NULL THEN high.donor_id
    WHEN abs(low.ds - low.score) < abs(high.ds - low.score) THEN low.donor_id ELSE high.donor_id END AS donor_id FROM low JOIN high USING (anchor_id)"""


@query("J10_nearest_donor", near_sql, "learning")
def nearest(t: Tables):
    anchors = t.view("learning").select(F.col("id").alias("anchor_id"), (F.col("x0") * 5000).alias("score"))
    return ln.nearest(anchors, t.supplier.select(F.col("s_suppkey").alias("donor_id"), F.col("s_acctbal").alias("score")))


rank_sql = f"""
WITH a AS (SELECT id, row_number() OVER (ORDER BY x0, id) - 1 AS place, count(*) OVER () AS n FROM learning), d AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS spot, count(*) OVER () AS m FROM supplier),
w AS (SELECT id, greatest(0, least(m - 1, round_even(place / greatest(n - 1, 1) * (m - 1), 0)::BIGINT + ({sql_hash('id', seed=42)}) % 3 - 1)) AS spot FROM a, (SELECT count(*) AS m FROM supplier))
SELECT id AS anchor_id, s_suppkey AS donor_id FROM w JOIN d USING (spot)"""


def rank_links(t: Tables):
    return ln.rank_link(t.view("learning"), donors(t), "id", ["x0"], ["s_acctbal"])


query("J11_rank_link", rank_sql, "learning")(rank_links)


@query("J12_linkage_manifest", f"SELECT count(*) AS anchor_rows, (SELECT count(*) FROM supplier) AS donor_rows, count(DISTINCT donor_id) AS unique_donors, {r('1 - count(DISTINCT donor_id) / count(*)')} AS donor_reuse_fraction, count(DISTINCT donor_id) < count(*) AS with_replacement FROM ({rank_sql})".replace("FROM (\nWITH", "FROM (WITH"), "learning")
def manifest(t: Tables):
    return round_doubles(ln.linkage_manifest(rank_links(t), t.supplier))


@query("J13_target_blind", "SELECT o_orderkey, o_custkey FROM orders")
def blind(t: Tables):
    inputs = t.orders.select("o_orderkey", "o_custkey")
    rel.require_target_blind(inputs.columns, "o_totalprice")
    return inputs


@query("W7_double_argsort", "SELECT id, row_number() OVER (ORDER BY x0, id) - 1 AS rank FROM learning", "learning")
def argsort(t: Tables):
    return ln.dense_order(t.view("learning").select("id", "x0"), "id", "x0", "rank").select("id", "rank")


# ---- preprocessing, fitted on ids not divisible by 3

TRAIN = "id % 3 <> 0"
NUM = ["x0", "x3", "x4"]
lim = lambda c: f"(SELECT quantile_cont({c}, 0.05) FROM learning WHERE {TRAIN})", lambda c: f"(SELECT quantile_cont({c}, 0.95) FROM learning WHERE {TRAIN})"
clip_sql = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {lim[1](c)}), {lim[0](c)}) END AS {c}" for c in NUM)
fill_sql = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM c WHERE {TRAIN})) AS {c}" for c in NUM)
robust_sql = ", ".join(f"{r(f'({c} - (SELECT quantile_cont({c}, 0.5) FROM c WHERE {TRAIN})) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM f WHERE {TRAIN})')} AS {c}" for c in NUM)
standard_sql = ", ".join(f"{r(f'({c} - (SELECT avg({c}) FROM f WHERE {TRAIN})) / (SELECT stddev_pop({c}) FROM f WHERE {TRAIN})')} AS {c}" for c in NUM)


def fitted(t: Tables, scaling: str, winsor: float | None):
    x = t.view("learning")
    return round_doubles(pp.LocalPreprocessor(NUM, [], scaling, winsor).fit(x.where(TRAIN)).transform(x, "id"))


@query("F1_winsorise", f"WITH c AS (SELECT id, {clip_sql} FROM learning), f AS (SELECT id, {fill_sql} FROM c) SELECT id, {rounds(**{c: c for c in NUM})} FROM f", "learning")
def winsorise(t: Tables):
    return fitted(t, "none", 0.05)


@query("F2_median_impute", f"WITH c AS (SELECT id, x0, x3, x4 FROM learning) SELECT id, {', '.join(r(x.rpartition(' AS ')[0]) + ' AS ' + x.rpartition(' AS ')[2] for x in fill_sql.split(', coalesce')[:1])}, " + ", ".join(f"{r(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM c WHERE {TRAIN}))')} AS {c}" for c in NUM[1:]) + " FROM c", "learning")
def impute(t: Tables):
    return fitted(t, "none", None)


@query("F3_robust_scale", f"WITH c AS (SELECT id, {clip_sql} FROM learning), f AS (SELECT id, {fill_sql} FROM c) SELECT id, {robust_sql} FROM f", "learning")
def robust(t: Tables):
    return fitted(t, "robust", 0.05)


@query("F4_standard_scale", f"WITH c AS (SELECT id, {clip_sql} FROM learning), f AS (SELECT id, {fill_sql} FROM c) SELECT id, {standard_sql} FROM f", "learning")
def standard(t: Tables):
    return fitted(t, "standard", 0.05)


SEGMENTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS seg FROM customer"


def segments(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("seg"))


mode_sql = f"(SELECT seg FROM ({SEGMENTS}) WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)"


@query("F5_mode_impute", f"SELECT id, coalesce(seg, {mode_sql}) AS seg FROM ({SEGMENTS})")
def mode(t: Tables):
    x = segments(t)
    return x.select("id", F.coalesce("seg", F.lit(pp.LocalPreprocessor([], ["seg"]).fit(x).fitted["mode"]["seg"])).alias("seg"))


KNOWN = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD"]


@query("F6_one_hot", f"SELECT id, {', '.join(f'''coalesce((coalesce(seg, (SELECT seg FROM ({SEGMENTS}) WHERE seg IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) = '{v}')::INT::DOUBLE, 0) AS seg_{v}''' for v in KNOWN)} FROM ({SEGMENTS})")
def one_hot(t: Tables):
    x = segments(t)
    return pp.LocalPreprocessor([], ["seg"]).fit(x.where(F.col("seg").isin(KNOWN))).transform(x, "id")


edges_sql = lambda c, b: f"(SELECT list_sort(list_distinct(quantile_cont({c}, {[k / b for k in range(1, b)]}))) FROM learning WHERE {TRAIN})"


@query("F7_quantile_bins", f"SELECT id, {', '.join(f'(CASE WHEN {c} IS NULL THEN len(e_{c}) ELSE len(list_filter(e_{c}, lambda e: e < {c})) END)::INT AS {c}' for c in NUM)} FROM learning, (SELECT {', '.join(f'{edges_sql(c, 8)} AS e_{c}' for c in NUM)})", "learning")
def bins(t: Tables):
    x = t.view("learning")
    return x.select("id", *(c.alias(n) for n, c in pp.apply_bins(pp.fit_bins(x.where(TRAIN), NUM, 8)).items()))


@query("A22_bin_edges", " UNION ALL ".join(f"SELECT '{c}' AS feature, k AS bin, {r('e[k]')} AS edge FROM (SELECT e, unnest(range(1, len(e) + 1)) AS k FROM (SELECT {edges_sql(c, 8)} AS e))" for c in NUM), "learning")
def edges(t: Tables):
    found = pp.fit_bins(t.view("learning").where(TRAIN), NUM, 8)
    return round_doubles(t.spark.createDataFrame([(c, k, e) for c, es in found.items() for k, e in enumerate(es, 1)], "feature string, bin bigint, edge double"))


z_sql = ", ".join(f"{r(f'({c} - (SELECT avg({c}) FROM c WHERE {TRAIN})) / (SELECT stddev_samp({c}) FROM c WHERE {TRAIN})')} AS {c}" for c in NUM)


@query("F9_train_zscores", f"WITH o AS (SELECT id, x0, x3, x4 FROM learning), c AS (SELECT id, {', '.join(f'coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM o WHERE {TRAIN})) AS {c}' for c in NUM)} FROM o) SELECT id, {z_sql} FROM c", "learning")
def zscores(t: Tables):
    return round_doubles(pp.train_zscores(t.view("learning").select("id", *NUM), NUM, F.expr(TRAIN)))


@query("F8_feature_metadata", "SELECT * FROM (VALUES ('x0', 'x0', 'median imputed, robust scaled'), ('x3', 'x3', 'median imputed, robust scaled'), ('x4', 'x4', 'median imputed, robust scaled')) x(feature, source, transformation)")
def metadata(t: Tables):
    return t.spark.createDataFrame(pp.LocalPreprocessor(NUM).fit(t.view("learning")).feature_metadata(), "feature string, source string, transformation string")


@query("F10_linkage_matrix", f"SELECT c_custkey AS id, c_acctbal, (({sql_hash('c_mktsegment', seed='category')}) % 1000003)::DOUBLE AS c_mktsegment FROM customer")
def matrix(t: Tables):
    x = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    return x.select("id", *(c.alias(n) for n, c in pp.linkage_matrix(x, ["c_acctbal", "c_mktsegment"]).items()))


@query("F12_party_splits", f"""WITH s AS (SELECT id, x0, x3, x4, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql_hash('id', seed=42)}) AS k, count(*) OVER (PARTITION BY y) AS n FROM learning)),
    f AS (SELECT id, split, {', '.join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM s WHERE split = 'train')) AS {c}" for c in NUM)} FROM s)
    SELECT id, split, {', '.join(r(f"({c} - (SELECT quantile_cont({c}, 0.5) FROM s WHERE split = 'train')) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM f WHERE split = 'train')") + f' AS {c}' for c in NUM)} FROM f""", "learning")
def party_splits(t: Tables):
    from partyframe.operators.evaluate import stratified_split

    x = stratified_split(t.view("learning"), "id", "y")
    return round_doubles(pp.LocalPreprocessor(NUM).fit(x.where("split = 'train'")).transform(x, "id", "split"))


@query("A_exact_quantiles", f"SELECT {rounds(**{f'{c}_{k}': f'quantile_cont({c}, {q})' for c in NUM for k, q in enumerate((0.0, 0.1, 0.5, 0.93, 1.0))})} FROM learning", "learning")
def exact_quantiles(t: Tables):
    x = t.view("learning").select(*NUM)
    qs = [0.0, 0.1, 0.5, 0.93, 1.0]
    row = {f"{c}_{k}": v for c in NUM for k, v in enumerate(ranking.counted_quantiles(x, c, qs))}
    return round_doubles(t.spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in row)))
