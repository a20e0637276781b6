"""Queries of studies, leakage measures, accounting, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from partyframe.functions.scalar import sigmoid
from partyframe.functions.session import shared_path
from partyframe.operators import audit as au
from partyframe.operators import privacy as pv
from partyframe.operators import studies as sd
from partyframe.operators.gbdt import GBDTOptions, fit_gbdt, score_gbdt
from partyframe.operators.logistic import LogisticOptions, fit_logistic, score_logistic
from partyframe.sources import archives, files, synthetic
from partyframe.sources import registry as rg

from .evaluation_queries import AP, AUC, EDGES, at_sql, log_loss
from .feature_queries import round_doubles, rounds
from .model_queries import FIXED, PARTIES, fixed_z, learning
from .registry import Tables, digest_sql, query, r, sql_hash

FAST = LogisticOptions(0.5, 3, 0.001)
#: Queries are to give the same rows each time; real releases draw their own.
SECRET = b"only for the registered queries"
#: One party more than PARTIES has, for studies whose scenarios name four.
FOUR = {"bank": ["x0"], "telecom": ["x4"], "insurance": ["x1"], "retail": ["x2", "x3"]}


def halves(t: Tables):
    x = learning(t)
    return x.where("id % 2 = 0"), x.where("id % 2 = 1")


# ---- studies


def subset_descents(subsets: list[tuple[str, list[str]]], epochs: int = 3, rate: float = 0.5, l2: float = 0.001) -> str:
    """CTEs that train a model of each subset's columns on even ids by full batches, and `scored` (subset, y, p) of odd ids."""
    ctes = ["l AS MATERIALIZED (SELECT id, x0, x1, x2, x3, coalesce(x4, 0) AS x4, y FROM learning)"]
    scored = []
    for i, (name, columns) in enumerate(subsets):
        p = lambda k, i=i, columns=columns: f"(1 / (1 + exp(-greatest(-35, least(35, w{i}_{k}.b + {' + '.join(f'l.{c} * w{i}_{k}.{c}' for c in columns)})))))"
        ctes.append(f"w{i}_0 AS (SELECT 0::DOUBLE AS b, {', '.join(f'0::DOUBLE AS {c}' for c in columns)})")
        for k in range(epochs):
            step = ", ".join(f"any_value(w{i}_{k}.{c}) - {rate} * (avg(l.{c} * ({p(k)} - y)) + {l2} * any_value(w{i}_{k}.{c})) AS {c}" for c in columns)
            ctes.append(f"w{i}_{k + 1} AS MATERIALIZED (SELECT any_value(w{i}_{k}.b) - {rate} * avg({p(k)} - y) AS b, {step} FROM l, w{i}_{k} WHERE id % 2 = 0)")
        scored.append(f"SELECT '{name}' AS subset, y, {p(epochs)} AS p FROM l, w{i}_{epochs} WHERE id % 2 = 1")
    return "WITH " + ",\n".join(ctes) + ",\nscored AS MATERIALIZED (" + " UNION ALL ".join(scored) + ")"


ABLATION = [("+".join(names), [c for p in names for c in PARTIES[p]]) for names in (("bank",), ("bank", "retail"), ("bank", "telecom"), ("bank", "retail", "telecom"))]
by_subset_sql = f""", counts AS (SELECT subset, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY ALL),
st AS (SELECT *, sum(pos) OVER (PARTITION BY subset ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY subset ORDER BY p DESC) AS fp FROM counts),
ranks AS (SELECT subset, {AUC} AS roc_auc, {AP} AS pr_auc FROM st GROUP BY subset),
c AS (SELECT subset, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn, {log_loss} AS ll, avg((p - y) * (p - y)) AS br FROM scored GROUP BY subset),
bins AS (SELECT subset, len(list_filter({EDGES}, lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS share FROM scored GROUP BY ALL), e AS (SELECT subset, sum(n * abs(share - mean_p)) / sum(n) AS ece FROM bins GROUP BY subset)
SELECT subset, {', '.join(f'{r(v)} AS {k}' for k, v in (*dict(roc_auc='roc_auc', pr_auc='pr_auc').items(), *at_sql.items(), ('log_loss', 'll'), ('brier', 'br'), ('ece', 'ece')))} FROM ranks JOIN c USING (subset) JOIN e USING (subset)"""


@query("E1_ablation", subset_descents(ABLATION) + by_subset_sql, "learning")
def ablation(t: Tables):
    return round_doubles(sd.party_subset_scores(*halves(t), PARTIES, FAST).drop("mask"))


@query("E2_dropout")
def dropout(t: Tables):
    return sd.dropout_study(*halves(t), FOUR, FAST)


drift_sql = lambda c: f"avg({c}) OVER () + 1.5 * ({c} - avg({c}) OVER ()) + 0.3"


@query("E4_numeric_drift", f"SELECT id, {', '.join(f'CASE WHEN ({sql_hash("id", seed=42 + k)}) / 1152921504606846976.0::DOUBLE >= 0.2 THEN {r(f"v{k}")} END AS x{k}' for k in range(2))} FROM (SELECT id, {drift_sql('x0')} AS v0, {drift_sql('x1')} AS v1 FROM learning)", "learning")
def numeric_drift(t: Tables):
    return round_doubles(sd.numeric_drift(t.view("learning").select("id", "x0", "x1"), ["x0", "x1"], "id", 0.3, 1.5, 0.2))


@query("E3_drift_study")
def drift_study(t: Tables):
    train, test = halves(t)
    model = fit_logistic(train, FOUR, options=FAST)
    return sd.drift_study(test, model, FOUR, "id")


drawn_sql = f"""WITH counts AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1), top AS (SELECT min(v) AS v FROM counts WHERE n = (SELECT max(n) FROM counts)),
ends AS (SELECT c.v, n, sum(n) OVER (ORDER BY c.v) AS upto, sum(n) OVER () AS total, (c.v >= top.v)::INT AS beyond, (c.v > top.v)::INT AS above FROM counts c, top),
spans AS (SELECT v, CASE WHEN upto = n THEN -1 ELSE 0.6 * (upto - n) / total + 0.4 * above END AS low, CASE WHEN upto = total THEN 2 ELSE 0.6 * upto / total + 0.4 * beyond END AS high FROM ends)
SELECT c_custkey, v AS c_mktsegment FROM (SELECT c_custkey, ({sql_hash('c_custkey', seed=42)}) / 1152921504606846976.0::DOUBLE AS u FROM customer) JOIN spans ON u >= low AND u < high"""


@query("E5_categorical_drift", drawn_sql)
def categorical_drift(t: Tables):
    return sd.categorical_drift(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.4)


utility_sql = "SELECT mask, 0.5 + 0.1 * (mask & 1) + 0.05 * ((mask >> 1) & 1) + 0.02 * ((mask >> 2) & 1) + 0.03 * (mask & 1) * ((mask >> 1) & 1) AS value FROM (SELECT unnest(range(8)) AS mask)"


@query(
    "E6_shapley",
    f"""WITH u AS ({utility_sql}), p AS (SELECT * FROM (VALUES (1, 'telecom'), (2, 'insurance'), (4, 'retail')) x(bit, party))
    SELECT party, {rounds(shapley='sum([1/3, 1/6, 1/3][bit_count(a.mask) + 1] * (b.value - a.value))', leave_one_out='max(b.value - a.value) FILTER (b.mask = 7)')}
    FROM p JOIN u a ON a.mask & bit = 0 JOIN u b ON b.mask = a.mask + bit GROUP BY party""",
)
def shapley(t: Tables):
    m = F.col("mask")
    bit = lambda k: F.shiftright(m, k).bitwiseAND(F.lit(1))
    u = t.spark.range(8).select(F.col("id").cast("int").alias("mask")).withColumn("value", 0.5 + 0.1 * bit(0) + 0.05 * bit(1) + 0.02 * bit(2) + 0.03 * bit(0) * bit(1))
    return round_doubles(sd.shapley_values(u, ["telecom", "insurance", "retail"]))


def with_availability(t: Tables):
    x = learning(t)
    return x.withColumns({"has_retail": F.col("id") % 4 != 0, "has_telecom": F.col("id") % 3 != 0})


@query("E7_missing_methods", f"SELECT id, {rounds(x0='x0', x2='CASE WHEN id % 4 <> 0 THEN x2 ELSE 0 END', x4='CASE WHEN id % 3 <> 0 THEN coalesce(x4, 0) ELSE 0 END')}, (id % 4 <> 0)::INT::DOUBLE AS has_retail_indicator, (id % 3 <> 0)::INT::DOUBLE AS has_telecom_indicator FROM learning", "learning")
def missing_methods(t: Tables):
    out, columns = sd.prepare_missing(with_availability(t), PARTIES, {"retail": "has_retail", "telecom": "has_telecom"}, "availability_indicator")
    return round_doubles(out.select("id", "x0", "x2", "x4", *columns["bank"][2:]))


@query("E7_missing_study")
def missing_study(t: Tables):
    """All four methods trained where retail and telecom lack some entities each."""
    return sd.missing_party_study(with_availability(t), PARTIES, "id", F.col("id") % 2 == 0, FAST, {"some": {"retail": "has_retail", "telecom": "has_telecom"}})


PASSIVE = list(FOUR)[1:]
CONTRIBUTIONS = [(str(mask), [*FOUR["bank"], *(c for k, p in enumerate(PASSIVE) if mask >> k & 1 for c in FOUR[p])]) for mask in range(8)]
contribution_sql = f""", counts AS (SELECT subset::INT AS mask, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY ALL),
st AS (SELECT *, sum(pos) OVER (PARTITION BY mask ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY mask ORDER BY p DESC) AS fp FROM counts), u AS (SELECT mask, {AUC} AS value FROM st GROUP BY mask),
players AS (SELECT * FROM (VALUES {', '.join(f"({1 << k}, '{p}')" for k, p in enumerate(PASSIVE))}) x(bit, party))
SELECT party, {rounds(shapley='sum([1/3, 1/6, 1/3][bit_count(a.mask) + 1] * (b.value - a.value))', leave_one_out='max(b.value - a.value) FILTER (b.mask = 7)')}
FROM players JOIN u a ON a.mask & bit = 0 JOIN u b ON b.mask = a.mask + bit GROUP BY party"""


@query("E6_contribution", subset_descents(CONTRIBUTIONS) + contribution_sql, "learning")
def contribution(t: Tables):
    return round_doubles(sd.contribution_study(*halves(t), FOUR, FAST))


@query("E8_overlap")
def overlap(t: Tables):
    return sd.overlap_study(learning(t), PARTIES, "id", F.col("id") % 2 == 0, FAST)


permuted_sql = f"""WITH a AS (SELECT id, x0, row_number() OVER (ORDER BY {sql_hash('id', seed=42)}) AS k FROM learning), b AS (SELECT x2, row_number() OVER (ORDER BY {sql_hash('id', seed=43)}) AS k FROM learning)
SELECT id, {rounds(x0='x0', x2='x2')} FROM a JOIN b USING (k)"""


@query("E9_permuted_party", permuted_sql, "learning")
def permuted(t: Tables):
    return round_doubles(sd.permute_party(t.view("learning").select("id", "x0", "x2"), ["x2"], "id"))


@query("E10_distributed_signal")
def signal(t: Tables):
    return sd.distributed_signal(learning(t).drop("y"), PARTIES, "id").select("id", "target")


@query("E11_local_importance")
def local_importance(t: Tables):
    from partyframe.operators.logistic import coefficient_importance

    return coefficient_importance(learning(t), fit_logistic(learning(t), PARTIES, options=FAST))


@query("E12_formal_matrix")
def formal_matrix(t: Tables):
    train, test = halves(t)
    rows = None
    trees = GBDTOptions(trees=2, depth=2, bins=8)
    boosted = sd.binary_metrics(score_gbdt(test, fit_gbdt(train, PARTIES, options=trees))).select(F.lit("vertical boosting").alias("protocol"), "*")
    for name, parties in {"single party": {"bank": PARTIES["bank"]}, "pooled": {"all": [c for cs in PARTIES.values() for c in cs]}, "vertical logistic": PARTIES}.items():
        row = sd.binary_metrics(score_logistic(test, fit_logistic(train, parties, options=FAST))).select(F.lit(name).alias("protocol"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows.unionByName(boosted)


deltas_sql = "SELECT doc_id % 5 AS scenario, CASE WHEN doc_id % 2 = 0 THEN 'inference' ELSE 'retrained' END AS phase, cast(doc_id * 7919 % 1000 AS DOUBLE) / 1000 - 0.5 AS delta, doc_id FROM documents"


def deltas(t: Tables):
    return t.spark.sql(deltas_sql.replace("FROM documents", "FROM {documents}"), documents=t.documents)


@query("O6_extreme_deltas", f"SELECT phase, {rounds(least='min(delta)', most='max(delta)')}, arg_max(scenario, (abs(delta), scenario)) AS largest FROM ({deltas_sql}) GROUP BY phase")
def extremes(t: Tables):
    return round_doubles(sd.drift_summary(deltas(t), "phase", "delta"))


@query("E14_interpretation", f"SELECT doc_id, CASE WHEN delta > 0 AND delta - 0.2 > 0 THEN 'clear improvement' WHEN delta > 0 THEN 'not distinguishable' ELSE 'no improvement' END AS observation FROM ({deltas_sql})")
def interpretation(t: Tables):
    return deltas(t).select("doc_id", sd.interpret(F.col("delta"), F.col("delta") - 0.2).alias("observation"))


# ---- leakage and releases


@query("D1_zcdp", f"SELECT releases, {rounds(epsilon='releases / (2 * s * s) + 2 * sqrt(releases / (2 * s * s) * ln(1 / 0.00001))')} FROM (SELECT c_nationkey AS releases, min(c_nationkey) + 1.5 AS s FROM customer GROUP BY c_nationkey)")
def zcdp(t: Tables):
    x = t.customer.groupBy("c_nationkey").agg((F.min("c_nationkey") + 1.5).alias("s"))
    return round_doubles(x.select(F.col("c_nationkey").alias("releases"), pv.zcdp_epsilon(F.col("c_nationkey"), F.col("s"), 1e-5).alias("epsilon")))


@query("D2_clipped_release", f"SELECT id, {rounds(x0='x0 * k', x1='x1 * k')} FROM (SELECT *, CASE WHEN sqrt(x0 * x0 + x1 * x1) > 0.5 THEN 0.5 / sqrt(x0 * x0 + x1 * x1) ELSE 1 END AS k FROM learning)", "learning")
def clipped_release(t: Tables):
    return round_doubles(pv.clip_rows(t.view("learning").select("id", "x0", "x1"), ["x0", "x1"], 0.5))


@query("D2_noisy_release")
def noisy_release(t: Tables):
    return pv.gaussian_release(t.view("learning").select("id", "x0", "x1"), ["x0", "x1"], "id", 0.5, 1.0, SECRET)[0]


member_sql = """WITH src AS (SELECT (id % 3 <> 0)::INT AS y, abs(p - 0.5) * 2.0::DOUBLE AS p FROM scores), counts AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM src GROUP BY p),
st AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM counts), n AS (SELECT sum(pos) AS P, sum(neg) AS N FROM counts),
a AS (SELECT st.p, round(tp / n.P - fp / n.N, 12) AS adv FROM st, n UNION ALL SELECT 0, 0), b AS (SELECT * FROM a ORDER BY adv DESC, p LIMIT 1)"""


@query("D3_membership_inference", f"{member_sql} SELECT (SELECT {r('sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))')} FROM st) AS roc_auc, {rounds(threshold='b.p', advantage='b.adv')}, n.P::BIGINT AS train_count, n.N::BIGINT AS holdout_count FROM b, n", "scores")
def membership(t: Tables):
    x = t.view("scores")
    return round_doubles(pv.membership_inference(x.where("id % 3 <> 0"), x.where("id % 3 = 0")))


@query("D4_label_inference", f"SELECT {rounds(accuracy='avg((v < 0)::INT = y) FILTER (abs(v) > 0.05)').replace('(v < 0)::INT = y', '((v < 0)::INT = y)::INT')}, count(*) FILTER (abs(v) > 0.05) AS exposed_count, count(*) FILTER (abs(v) <= 0.05) AS ambiguous_count FROM (SELECT y, p - y - 0.03 AS v FROM scores)", "scores")
def labels_leak(t: Tables):
    return round_doubles(pv.label_inference(t.view("scores"), F.col("p") - F.col("y") - 0.03, tolerance=0.05))


@query("A19_routing_exposure", f"SELECT count(*) AS events, count(DISTINCT entity) AS unique_entities, {rounds(exposed_fraction='count(DISTINCT entity) / 5000', events_per_entity='count(*) / count(DISTINCT entity)')} FROM audit", "audit")
def exposure(t: Tables):
    return round_doubles(pv.routing_exposure(t.view("audit"), 5000))


recon_sql = f"""WITH m AS (SELECT id, {fixed_z} AS m, x0 FROM learning), f AS (SELECT covar_pop(m, x0) / (var_pop(m) + 0.001 / count(*)) AS s, avg(m) AS mm, avg(x0) AS mx FROM m WHERE id % 2 = 0),
g AS (SELECT x0, mx + s * (m - mm) AS g FROM m, f WHERE id % 2 = 1) SELECT {rounds(r2='1 - sum((x0 - g) ^ 2) / (var_pop(x0) * count(*))', mae='avg(abs(x0 - g))')} FROM g"""


@query("D5_reconstruction", recon_sql, "learning")
def reconstruction(t: Tables):
    x = learning(t).withColumn("m", FIXED.logit())
    return round_doubles(pv.reconstruct_features(x.where("id % 2 = 0"), x.where("id % 2 = 1"), ["m"], ["x0"]).select("r2", "mae"))


many_recon_sql = f"""WITH l AS (SELECT id, {fixed_z} AS m1, 1 / (1 + exp(-({fixed_z}))) - y AS m2, x1, x2, x3 FROM learning),
long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, id, m1, m2, {c} AS x FROM l" for c in ("x1", "x2", "x3"))}),
f AS (SELECT feature, avg(m1) AS a1, avg(m2) AS a2, avg(x) AS ax, count(*) * var_pop(m1) + 0.001 AS g11, count(*) * var_pop(m2) + 0.001 AS g22, count(*) * covar_pop(m1, m2) AS g12,
    count(*) * covar_pop(m1, x) AS c1, count(*) * covar_pop(m2, x) AS c2 FROM long WHERE id % 2 = 0 GROUP BY feature),
g AS (SELECT feature, x, ax + (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) * (m1 - a1) + (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) * (m2 - a2) AS g FROM long JOIN f USING (feature) WHERE id % 2 = 1)
SELECT feature, {rounds(r2='1 - sum((x - g) ^ 2) / (var_pop(x) * count(*))', mae='avg(abs(x - g))')} FROM g GROUP BY feature"""


@query("D5_reconstruction_many", many_recon_sql, "learning")
def reconstruction_many(t: Tables):
    x = learning(t).withColumn("m1", FIXED.logit()).withColumn("m2", sigmoid(FIXED.logit()) - F.col("y"))
    return round_doubles(pv.reconstruct_features(x.where("id % 2 = 0"), x.where("id % 2 = 1"), ["m1", "m2"], ["x1", "x2", "x3"]))


@query("D6_secure_sum", "SELECT c_custkey AS i, (c_custkey - 700) + (c_nationkey - 10) * 1000 + round(c_acctbal * 100)::BIGINT AS v FROM customer")
def secure_sum(t: Tables):
    names, secrets = ["a", "b", "c"], {("a", "b"): b"0123456789abcdef", ("a", "c"): b"0123456789abcdeg", ("b", "c"): b"0123456789abcdeh"}
    values = {"a": F.col("c_custkey") - 700, "b": (F.col("c_nationkey") - 10).cast("long") * 1000, "c": F.round(F.col("c_acctbal") * 100).cast("long")}
    masked = [pv.mask_update(t.customer.select(F.col("c_custkey").alias("i"), values[p].alias("v")), "i", "v", p, names, secrets, "round 1") for p in names]
    return pv.secure_sum(masked, "i", "v")


@query("D6_additive_shares", "SELECT c_custkey AS i, c_custkey - 700 AS v FROM customer")
def additive(t: Tables):
    shares = pv.additive_shares(t.customer.select(F.col("c_custkey").alias("i"), (F.col("c_custkey") - 700).alias("v")), "i", "v", 3, SECRET)
    return pv.secure_sum([shares.select("i", "v")], "i", "v")


t_sql = " + ".join(f"{term!r} / (n - 1) ^ {k}" for k, term in enumerate(pv.T_EXPANSION))  # groups are large


@query("A17_interval_summary", f"SELECT c_mktsegment, n, {rounds(mean='m', std='s', ci95_low=f'm - ({t_sql}) * s / sqrt(n)', ci95_high=f'm + ({t_sql}) * s / sqrt(n)')} FROM (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1)")
def interval_summary(t: Tables):
    return round_doubles(pv.interval_summary(t.customer, ["c_mktsegment"], "c_acctbal"))


@query("A20_flatten_summary", f"SELECT o_orderstatus, {', '.join(f'{r(f"{f}(o_totalprice) FILTER (o_orderpriority = {chr(39)}{p}{chr(39)})")} AS {p[2:].lower()}_{n}' for p in ('1-URGENT', '5-LOW') for n, f in (('mean', 'avg'), ('most', 'max')))} FROM orders GROUP BY 1")
def flatten(t: Tables):
    x = t.orders.groupBy("o_orderstatus", F.lower(F.substring("o_orderpriority", 3, 99)).alias("metric")).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return round_doubles(pv.flatten_summary(x, ["o_orderstatus"], "metric", ["mean", "most"], ["urgent", "low"]))


@query("A21_clip_support", f"SELECT id, {rounds(low='greatest(0, least(1, x0 - 0.5))', high='greatest(0, least(1, x0 + 0.5))', low_raw='x0 - 0.5', high_raw='x0 + 0.5')} FROM learning", "learning")
def clip_support(t: Tables):
    x = t.view("learning").select("id", (F.col("x0") - 0.5).alias("low"), (F.col("x0") + 0.5).alias("high"))
    return round_doubles(pv.clip_support(x, "low", "high", (0.0, 1.0)))


# ---- accounting


@query("A15_communication_totals", "SELECT count(*) AS messages, sum(scalars)::BIGINT AS scalars, sum(bytes)::BIGINT AS bytes, count(*) FILTER (direction = 'forward') AS forward_messages, (sum(bytes) FILTER (direction = 'forward'))::BIGINT AS forward_bytes, count(*) FILTER (direction = 'backward') AS backward_messages, (sum(bytes) FILTER (direction = 'backward'))::BIGINT AS backward_bytes FROM audit", "audit")
def totals(t: Tables):
    return au.communication_totals(t.view("audit"))


@query("A16_communication_breakdown", "SELECT direction, party, stage, step, count(*) AS messages, sum(scalars)::BIGINT AS scalars, sum(bytes)::BIGINT AS bytes FROM audit GROUP BY ALL", "audit")
def breakdown(t: Tables):
    return au.communication_breakdown(t.view("audit"))


@query("W4_cumulative_bytes", "SELECT seq, bytes, (sum(bytes) OVER (ORDER BY seq))::BIGINT AS cumulative_bytes FROM audit", "audit")
def cumulative(t: Tables):
    return au.communication_log(t.view("audit")).select("seq", "bytes", "cumulative_bytes")


#: lineitem's columns as the text that row_digest makes of them.
LINEITEM = {c: f"{c}::VARCHAR" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")} | {"l_shipdate": "epoch_us(l_shipdate)::VARCHAR"}


@query("A18_row_digest", digest_sql("lineitem", LINEITEM))
def row_digest(t: Tables):
    return au.row_digest(t.lineitem.select(*LINEITEM))


@query("A18_digest_by_part", digest_sql("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderdate": "epoch_us(o_orderdate)::VARCHAR"}, "o_orderstatus"))
def digest_by_part(t: Tables):
    return au.row_digest(t.orders.select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderdate"), "o_orderstatus")


@query("K2_provenance_bundle", f"SELECT 'retail' AS key, 'CC BY 4.0' AS license, rows AS raw_rows, digest AS checksum, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS processed_rows FROM ({digest_sql('lineitem', LINEITEM)})")
def provenance_bundle(t: Tables):
    folder, given = shared_path(t.spark, "provenance"), t.lineitem.select(*LINEITEM)
    features = given.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("last"))
    records = rg.provenance(t.spark, [("retail", "quantity", "lineitem", "l_quantity", "aggregated")])
    rg.save_provenance_bundle(folder, "retail", features, records, {"retail": given})
    found = rg.read_provenance_bundle(t.spark, folder)[1]["sources"]
    return t.spark.createDataFrame([(s["key"], s["license"], s["raw_rows"], s["checksum"], s["processed_rows"]) for s in found], "key string, license string, raw_rows long, checksum string, processed_rows long")


# ---- sources, sinks, streams


@query("S10_synthetic_parties")
def synthetic_parties(t: Tables):
    return synthetic.vertical_parties(t.spark, 2000)[0]


@query("S11_balanced_party")
def balanced(t: Tables):
    return synthetic.balanced_party(t.spark, 2000, 4)


@query("S12_dataset_registry", "SELECT * FROM (VALUES ('insurance_freq', 'freMTPL2freq', '41214'), ('insurance_sev', 'freMTPL2sev', '41215')) x(key, dataset_name, dataset_id)")
def catalogue(t: Tables):
    return rg.datasets(t.spark, "insurance").select("key", "dataset_name", "dataset_id")


@query("S7_csv_round_trip", f"SELECT c_custkey::VARCHAR AS c_custkey, c_name, {r('c_acctbal')} AS c_acctbal FROM customer")
def csv_round_trip(t: Tables):
    path = shared_path(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    x = files.read_csv(t.spark, path, ["c_custkey", "c_name", "c_acctbal"])
    return round_doubles(x.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal")))


archive_sql = """SELECT 'users' AS member, UserID::BIGINT AS id, Gender || ' ' || Age || ' ' || Occupation || ' ' || ZipCode AS fields FROM users
UNION ALL SELECT 'movies', MovieID, 'Title ' || MovieID || ' ' || Genres FROM movies UNION ALL SELECT 'ratings', UserID, MovieID || ' ' || Rating || ' ' || epoch_us(Timestamp) // 1000000 FROM ratings"""


@query("S6_rating_archive", archive_sql, "users movies ratings")
def rating_archive(t: Tables):
    """All three tables through ZIP archives in the shared folder."""
    folder = shared_path(t.spark, "ratings")
    whole = {
        "users": t.view("users"),
        "movies": t.view("movies").withColumn("Title", F.concat(F.lit("Title "), F.col("MovieID").cast("string"))),
        "ratings": t.view("ratings").withColumn("Timestamp", F.unix_timestamp(F.col("Timestamp").cast("timestamp"))),
    }
    archives.write_rating_archives(whole, folder, 3)
    found, out = archives.read_rating_archives(t.spark, folder), None
    for member, (key, *fields) in {"users": ("UserID", "Gender", "Age", "Occupation", "ZipCode"), "movies": ("MovieID", "Title", "Genres"), "ratings": ("UserID", "MovieID", "Rating", "Timestamp")}.items():
        rows = found[member].select(F.lit(member).alias("member"), F.col(key).cast("long").alias("id"), F.concat_ws(" ", *(F.col(c).cast("string") for c in fields)).alias("fields"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("K1_bundle", f"SELECT c_custkey, {r('c_acctbal')} AS c_acctbal FROM customer")
def bundle(t: Tables):
    folder = shared_path(t.spark, "bundle")
    records = rg.provenance(t.spark, [("bank", "c_acctbal", "customers", "c_acctbal", "observed")])
    files.write_bundle(folder, t.customer.select("c_custkey", "c_acctbal"), rg.with_provenance(records, t.spark), {"rows": t.customer.count()})
    return round_doubles(files.read_parquet(t.spark, f"{folder}/features.parquet", ["c_custkey"]))


@query("K6_party_splits", f"SELECT id, {rounds(x0='x0')}, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM learning", "learning")
def exported(t: Tables):
    folder = shared_path(t.spark, "splits")
    files.write_splits(t.view("learning").withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train")), folder, PARTIES)
    return round_doubles(t.spark.read.parquet(f"{folder}/bank").select("id", "x0", "split"))


@query("K7_file_manifest", "SELECT sum(strlen(line) + 1)::BIGINT AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256 FROM (SELECT o_orderstatus, o_orderkey, o_orderkey || '|' || o_custkey || '|' || o_orderpriority AS line FROM orders) GROUP BY o_orderstatus")
def manifest(t: Tables):
    """The files of all orders, one for each status."""
    folder = shared_path(t.spark, "manifest")
    lines = t.orders.select("o_orderstatus", "o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority").alias("line"))
    sorted_lines = lines.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey")
    sorted_lines.select("o_orderstatus", "line").write.partitionBy("o_orderstatus").text(folder)
    return files.file_manifest(t.spark, folder).where(F.col("bytes") > 0).select("bytes", "sha256")


@query("K9_model_checkpoint", f"SELECT id, {r(fixed_z)} AS logit FROM learning", "learning")
def checkpoint(t: Tables):
    return round_doubles(score_logistic(learning(t), files.read_logistic_checkpoint(files.logistic_checkpoint(FIXED))).select("id", "logit"))


@query("X_stream_traffic", "SELECT epoch_us(date_trunc('hour', ts)) AS start, direction, party, count(*) AS messages, sum(bytes)::BIGINT AS bytes FROM audit GROUP BY ALL", "audit")
def stream_traffic(t: Tables):
    from partyframe.streaming.audit import traffic

    return traffic(t.view("audit")).withColumn("start", F.unix_micros("start"))


message_sql = """SELECT event_id AS seq, (event_id % 3000)::VARCHAR AS message_id, 'party' || user_id % 4 AS sender, epoch_us(ts) - (event_id % 400) * 1000000 AS sent, epoch_us(ts) AS received, CASE WHEN event_id % 50 = 7 THEN 'x' ELSE 'y' END AS digest FROM events"""


@query(
    "X_replay_window",
    f"""WITH m AS ({message_sql}), ok AS (SELECT *, first(digest) OVER (PARTITION BY sender, message_id ORDER BY received, seq) AS known, row_number() OVER (PARTITION BY sender, message_id ORDER BY received, seq) AS k FROM m WHERE received - sent <= 300000000)
    SELECT seq, message_id, sender, CASE WHEN k = 1 THEN 'accepted' WHEN digest = known THEN 'repeat' ELSE 'conflict' END AS verdict FROM ok
    UNION ALL SELECT seq, message_id, sender, 'expired' FROM m WHERE received - sent > 300000000""",
)
def replay_window(t: Tables):
    """All events as messages in one stream; nothing that was accepted is forgotten, so SQL can say the same."""
    from partyframe.streaming.replay_window import judged

    folder, ts = shared_path(t.spark, "replay"), F.col("ts").cast("timestamp")
    t.events.select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 3000).cast("string").alias("message_id"), F.concat(F.lit("party"), (F.col("user_id") % 4).cast("string")).alias("sender"),
        F.timestamp_micros(F.unix_micros(ts) - (F.col("event_id") % 400) * 1_000_000).alias("sent_at"), ts.alias("received_at"), F.when(F.col("event_id") % 50 == 7, "x").otherwise("y").alias("digest"),
    ).write.parquet(f"{folder}/given")
    given = t.spark.read.parquet(f"{folder}/given")
    stream = t.spark.readStream.schema(given.schema).parquet(f"{folder}/given")
    return judged(stream, folder, ttl_seconds=1e9, most_entries=1_000_000).drop("received_at")
