"""Queries of party captures, run bundles, tree checkpoints and audits: written to the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from partyframe.functions.scalar import hash_order
from partyframe.functions.session import shared_path
from partyframe.operators import gbdt as gb
from partyframe.operators import privacy as pv
from partyframe.operators import privacy_research as pr
from partyframe.operators import replay
from partyframe.operators import studies as sd
from partyframe.operators.audit import communication_breakdown
from partyframe.operators.logistic import LogisticOptions, fit_logistic, score_logistic
from partyframe.operators.ranking import hash_rank
from partyframe.sources import files, parties, published, runs
from partyframe.sources import registry as rg

from .feature_queries import round_doubles, rounds
from .model_queries import EPOCHS, FIXED, OPTIONS, PARTIES, boosted, boosting, fixed_z, learning, owner_sql
from .registry import Tables, digest_sql, query, r, sql_hash
from .study_queries import FOUR

SHOWN = ["LIMIT_BAL", "AGE", "PAY_0", "BILL_AMT1", "PAY_AMT6"]


@query("S1_bank_capture", f"SELECT id AS ID, {rounds(**{c: f'{c}::DOUBLE' for c in SHOWN})}, CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS y FROM bank", "bank")
def bank_capture(t: Tables):
    path = shared_path(t.spark, "bank")
    numbered = {name: f"X{k}" for k, name in enumerate(parties.BANK_NAMES, 1)}
    given = t.view("bank").withColumnRenamed("id", "ID").withColumn("Y", (F.col("ID") % 4 == 0).cast("int"))
    given.withColumnsRenamed({c: numbered[c] for c in given.columns if c in numbered}).write.parquet(path)
    found = parties.read_party(t.spark, "bank", path)
    return round_doubles(found.rows.select("ID", *(F.col(c).cast("double").alias(c) for c in SHOWN)).join(found.target, "ID"))


@query("S2_telecom_capture", f"SELECT id, {rounds(FrequencyOfUse='FrequencyOfUse::DOUBLE', CustomerValue='CustomerValue')} FROM telecom", "telecom")
def telecom_capture(t: Tables):
    path = shared_path(t.spark, "telecom") + ".csv"
    t.view("telecom").withColumn("Churn", F.lit(1)).write.option("header", True).csv(path)
    rows = parties.read_party(t.spark, "telecom", path).rows
    return round_doubles(rows.select(F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in ("FrequencyOfUse", "CustomerValue") if "Churn" not in rows.columns)))


insurance_sql = f"""WITH held AS (SELECT IDpol, ClaimNb FROM policies ORDER BY {sql_hash('IDpol', seed=3)}, IDpol LIMIT 2000)
SELECT IDpol, ClaimNb, n AS claims, {r('total')} AS total FROM held JOIN (SELECT IDpol, count(*) AS n, sum(ClaimAmount) AS total FROM claims GROUP BY IDpol) USING (IDpol)"""


@query("S3_insurance_capture", insurance_sql, "policies claims")
def insurance_capture(t: Tables):
    folder = shared_path(t.spark, "insurance")
    t.view("policies").write.parquet(f"{folder}/policies")
    t.view("claims").write.parquet(f"{folder}/claims")
    found = parties.read_party(t.spark, "insurance", f"{folder}/policies", f"{folder}/claims", sample=2000, seed=3)
    paid = found.claims.groupBy("IDpol").agg(F.count(F.lit(1)).alias("claims"), F.sum("ClaimAmount").alias("total"))
    return round_doubles(found.rows.select("IDpol", "ClaimNb").join(paid, "IDpol"))


retail_sql = """WITH cut AS (SELECT quantile_cont(epoch_us(InvoiceDate)::DOUBLE, 0.7) AS c FROM retail)
SELECT count(*) FILTER (epoch_us(InvoiceDate) <= c) AS kept, count(*) FILTER (epoch_us(InvoiceDate) > c) AS later, count(DISTINCT InvoiceNo) FILTER (epoch_us(InvoiceDate) <= c) AS invoices FROM retail, cut"""


@query("S4_retail_capture", retail_sql, "retail")
def retail_capture(t: Tables):
    path = shared_path(t.spark, "retail")
    t.view("retail").write.parquet(path)
    found = parties.read_party(t.spark, "retail", path)
    return found.rows.agg(F.count(F.lit(1)).alias("kept"), F.lit(found.facts["later"]).cast("long").alias("later"), F.count_distinct("InvoiceNo").alias("invoices"))


@query("S5_party_dispatch", "SELECT 'bank' AS party, count(*) AS n FROM bank UNION ALL SELECT 'retail', count(*) FROM retail", "bank retail")
def dispatch(t: Tables):
    rows = None
    for name, cutoff in (("bank", {}), ("retail", {"cutoff": "2999-01-01 00:00:00"})):
        path = shared_path(t.spark, name)
        t.view(name).withColumnRenamed("id", "ID").write.parquet(path)
        row = parties.read_party(t.spark, name, path, **cutoff).rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("party"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def a_run(t: Tables, folder: str, slope: float = 1.0) -> str:
    scored = score_logistic(learning(t), FIXED).select("id", F.col("y").alias("target"), (F.col("logit") * slope).alias("logit"))
    history = t.spark.createDataFrame([(0, 0.7), (1, 0.6)], "epoch int, loss double")
    traffic = t.view("audit").groupBy("direction").agg(F.sum("bytes").alias("bytes"))
    facts = rg.provenance(t.spark, [("bank", "x0", "customers", "c_acctbal", "observed")])
    hits = scored.agg(F.avg(((F.col("logit") > 0).cast("int") == F.col("target")).cast("double"))).first()[0]
    documents = {"config": {"slope": slope}, "dataset_provenance": {"tables": ["customer", "orders"]}, "linkage_manifest": {"key": "id"}, "metrics": {"accuracy": hits}}
    tables = {"predictions": scored, "training_history": history, "communication": traffic, "feature_provenance": facts}
    return runs.write_run(t.spark, folder, 42, documents, tables, datasets={"customer": t.customer.select("c_custkey", "c_name"), "orders": t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")})


@query("K3_run_bundle", f"SELECT id, y AS target, {r(fixed_z)} AS logit FROM learning", "learning")
def run_bundle(t: Tables):
    folder = a_run(t, shared_path(t.spark, "runs"))
    if runs.changed_files(t.spark, folder).count():
        raise ValueError("the bundle does not match its manifest")
    return round_doubles(runs.read_run(t.spark, folder)[1]["predictions"])


@query(
    "K3_dataset_hashes",
    f"""SELECT 'customer' AS name, * FROM ({digest_sql("customer", {"c_custkey": "c_custkey::VARCHAR", "c_name": "c_name"})})
    UNION ALL SELECT 'orders', * FROM ({digest_sql("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus"})})""",
)
def dataset_hashes(t: Tables):
    """What a run's manifest says of the tables that it was given."""
    folder = a_run(t, shared_path(t.spark, "runs"))
    stated = runs.read_document(t.spark, f"{folder}/{runs.MANIFEST}.json")
    if not stated["dependency_versions"]["pyspark"] or runs.changed_datasets(t.spark, folder, {}) != ["customer", "orders"]:
        raise ValueError("the manifest is not complete")
    return t.spark.createDataFrame([(name, x["rows"], x["digest"]) for name, x in stated["dataset_hashes"].items()], "name string, rows long, digest string")


@query("K5_provenance_csv", "SELECT 'bank' AS party, 'x0' AS feature, 'observed' AS kind, 'Default of Credit Card Clients' AS dataset_name")
def provenance_csv(t: Tables):
    folder = shared_path(t.spark, "provenance")
    records = rg.with_provenance(rg.provenance(t.spark, [("bank", "x0", "customers", "c_acctbal", "observed")]), t.spark)
    files.write_bundle(folder, t.region, records, {})
    return files.read_csv(t.spark, f"{folder}/provenance.csv", ["party"]).select("party", "feature", "kind", "dataset_name")


@query("S14_run_artifacts", "SELECT direction, sum(bytes)::BIGINT AS bytes FROM audit GROUP BY direction", "audit")
def run_artifacts(t: Tables):
    tables = runs.read_run(t.spark, a_run(t, shared_path(t.spark, "runs")))[1]
    return tables["communication"].select("direction", F.col("bytes").cast("long").alias("bytes"))


@query("E15_main_table", f"SELECT name AS run, {r('avg(((slope * (' + fixed_z + ') > 0)::INT = y)::INT)')} AS accuracy FROM learning, (VALUES ('plain', 1), ('turned', -1)) v(name, slope) GROUP BY name", "learning")
def main_table(t: Tables):
    folder = shared_path(t.spark, "runs")
    return round_doubles(runs.main_results(t.spark, {"plain": a_run(t, folder), "turned": a_run(t, folder, -1.0)}, ("accuracy",)))


@query("E13_scaling_grid")  # seconds and memory: no engine repeats them
def scaling(t: Tables):
    """A quarter, a half and all of the entities, drawn by hash."""
    train = lambda df: fit_logistic(df, PARTIES, options=LogisticOptions(0.5, 2))
    n = t.customer.count()
    return runs.scaling_grid(t.spark, [n // 4, n // 2, n], lambda k: hash_rank(learning(t), hash_order("id", seed=1)).where(F.col("rank") <= k).drop("rank"), train)


@query("K9_tree_checkpoint", boosting() + f" SELECT id, {r('m')} AS margin FROM m2", "learning")
def tree_checkpoint(t: Tables):
    x = t.view("learning")
    model, routing = files.gbdt_checkpoint(boosted(t, OPTIONS))
    return round_doubles(gb.score_gbdt(x, files.read_gbdt_checkpoint(model, routing)).select("id", "margin"))


@query("T7_pooled_subsets")  # iterative solvers of Spark ML: comparable, not equal in coefficients
def pooled_subsets(t: Tables):
    x = learning(t)
    return sd.pooled_subsets(x.where("id % 2 = 0"), x.where("id % 2 = 1"), PARTIES, "id")


@query("E6_permutation")
def permutation(t: Tables):
    return sd.permutation_contribution(learning(t), FIXED, PARTIES, "id")


routes_sql = " UNION ALL ".join(f"SELECT {k} AS tree, b.node, {owner_sql} AS party, x.id AS entity FROM n{k}_{d} x JOIN best{k}_{d} b ON x.node = b.node" for k in range(2) for d in range(2))


def tree_routes(t: Tables):
    x = t.view("learning")
    return replay.routing_events(x, *files.gbdt_checkpoint(boosted(t, OPTIONS)))


@query("K9_replay", boosting() + f" SELECT id, {r('m')} AS margin, {r('1 / (1 + exp(-m))')} AS p FROM m2", "learning")
def replayed(t: Tables):
    return round_doubles(replay.replay_scores(t.view("learning"), *files.gbdt_checkpoint(boosted(t, OPTIONS))))


@query("T5_routing_events", boosting() + f", routes AS ({routes_sql}) SELECT tree::INT AS tree, node::INT AS node, party, count(*) AS events, count(DISTINCT entity) AS entities, sum(entity)::BIGINT AS checked FROM routes GROUP BY ALL", "learning")
def routing(t: Tables):
    return tree_routes(t).groupBy("tree", "node", "party").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("entity").alias("entities"), F.sum("entity").alias("checked"))


audit_sql = f""", s AS (SELECT id, y, 1 / (1 + exp(-({fixed_z}))) AS p, 0.4 * x2 + 0.6 * x3 AS m, x2, x3 FROM learning),
src AS (SELECT (id % 2 = 0)::INT AS y, abs(p - 0.5) * 2 AS p FROM s), counts AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM src GROUP BY p),
st AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM counts), n AS (SELECT sum(pos) AS P, sum(neg) AS N FROM counts),
long AS (SELECT 'x2' AS f, id, m, x2 AS x FROM s UNION ALL SELECT 'x3', id, m, x3 FROM s),
fit AS (SELECT f, covar_pop(m, x) / (var_pop(m) + 0.001 / count(*)) AS slope, avg(m) AS mm, avg(x) AS mx FROM long WHERE id % 2 = 0 GROUP BY f),
read AS (SELECT f, 1 - sum((x - (mx + slope * (m - mm))) ^ 2) / (var_pop(x) * count(*)) AS r2, avg(abs(x - (mx + slope * (m - mm)))) AS mae FROM long JOIN fit USING (f) WHERE id % 2 = 1 GROUP BY f),
routes AS (SELECT * FROM ({routes_sql}) WHERE party <> 'bank'), met AS (SELECT count(*) AS events, count(DISTINCT entity) AS who FROM routes), every AS (SELECT count(*) AS n FROM learning),
found AS (
    SELECT 'membership' AS attack, 'roc_auc' AS measure, (SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) FROM st) AS value
    UNION ALL SELECT 'membership', 'advantage', (SELECT greatest(0, max(round(tp / n.P - fp / n.N, 12))) FROM st, n)
    UNION ALL SELECT 'label', 'accuracy', (SELECT avg(((p - y < 0)::INT = y)::INT) FROM s WHERE id % 2 = 0)
    UNION ALL SELECT 'label', 'exposed_count', (SELECT count(*) FROM s WHERE id % 2 = 0 AND abs(p - y) > 1e-12)
    UNION ALL SELECT 'label', 'ambiguous_count', (SELECT count(*) FROM s WHERE id % 2 = 0 AND abs(p - y) <= 1e-12)
    UNION ALL SELECT 'reconstruction of retail', 'mean_r2', (SELECT avg(r2) FROM read) UNION ALL SELECT 'reconstruction of retail', 'max_r2', (SELECT max(r2) FROM read)
    UNION ALL SELECT 'reconstruction of retail', 'mean_mae', (SELECT avg(mae) FROM read)
    UNION ALL SELECT 'routing', 'events', (SELECT events FROM met) UNION ALL SELECT 'routing', 'unique_entities', (SELECT who FROM met)
    UNION ALL SELECT 'routing', 'exposed_fraction', (SELECT who / n FROM met, every) UNION ALL SELECT 'routing', 'events_per_entity', (SELECT coalesce(events / nullif(who, 0), 0) FROM met)
) SELECT attack, measure, {r('value')} AS value FROM found"""


@query("D9_privacy_audit", boosting() + audit_sql, "learning")
def privacy_audit(t: Tables):
    x = learning(t)
    routes = tree_routes(t).where("party <> 'bank'")
    return round_doubles(pv.privacy_audit(x.where("id % 2 = 0"), x.where("id % 2 = 1"), FIXED, observed="retail", routed=routes, entities=x.count()))


@query("D8_privacy_grid")
def privacy_grid(t: Tables):
    return pr.privacy_research(learning(t), FOUR, pr.Grid(logistic_rounds=(3, 6, 12)))


log_sql = f"""WITH p AS (SELECT * FROM (VALUES (0, 'retail'), (1, 'telecom')) x(k, party)), n AS (SELECT count(*) AS rows, count(*) FILTER (id % 5 = 0) AS held FROM learning),
steps AS (SELECT epoch, i FROM range({EPOCHS}) e(epoch), range(6) s(i)),
log AS (SELECT party, CASE i WHEN 2 THEN 'backward' WHEN 4 THEN 'backward' ELSE 'forward' END AS direction, CASE i WHEN 0 THEN 'epoch_logits' WHEN 5 THEN 'validation_logits' WHEN 1 THEN 'batch_logits' WHEN 3 THEN 'batch_logits' ELSE 'residuals' END AS stage,
    CASE WHEN i = 0 THEN rows WHEN i = 5 THEN held WHEN i <= 2 THEN rows - rows // 2 ELSE rows // 2 END AS scalars FROM steps, p, n
    UNION ALL SELECT party, 'forward', 'final_logits', rows FROM p, n)
SELECT direction, party, stage, count(*) AS messages, sum(scalars)::BIGINT AS scalars, (8 * sum(scalars))::BIGINT AS bytes FROM log GROUP BY ALL"""


@query("T8_communication", log_sql, "learning")
def communication(t: Tables):
    """The message log of a run with two batches over all entities, a fifth of them held for validation, by stage."""
    x = t.view("learning")
    log = replay.communication_frame(t.spark, x.count(), ["retail", "telecom"], EPOCHS, 2, x.where("id % 5 = 0").count())
    return communication_breakdown(log).groupBy("direction", "party", "stage").agg(*(F.sum(c).alias(c) for c in ("messages", "scalars", "bytes")))


@query("K8_published_dataset", f"SELECT 'bank' AS name, count(*) AS rows, {r('sum(LIMIT_BAL)')} AS total FROM bank UNION ALL SELECT 'telecom', count(*), {r('sum(CustomerValue)')} FROM telecom UNION ALL SELECT 'retail', count(*), {r('sum(Quantity)')} FROM retail UNION ALL SELECT 'policies', count(*), {r('sum(Exposure)')} FROM policies UNION ALL SELECT 'learning', count(*), {r('sum(x0)')} FROM learning", "bank telecom retail policies learning")
def published_dataset(t: Tables):
    """Five tables published under one name, read back and summed."""
    folder = shared_path(t.spark, "published")
    summed = {"bank": "LIMIT_BAL", "telecom": "CustomerValue", "retail": "Quantity", "policies": "Exposure", "learning": "x0"}
    published.publish_dataset(folder, {name: t.view(name) for name in summed}, {"name": "parties", "license": "CC BY 4.0"})
    rows = None
    for name, df in published.read_dataset(t.spark, folder)[1].items():
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(summed[name]).cast("double").alias("total")).select(F.lit(name).alias("name"), "rows", "total")
        rows = row if rows is None else rows.unionByName(row)
    return round_doubles(rows)
