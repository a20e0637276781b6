"""Queries of splits, metrics, curves, resampling and thresholds."""

from __future__ import annotations


from partyframe.operators import evaluate as ev
from partyframe.operators import ranking

from .feature_queries import round_doubles, rounds
from .registry import Tables, query, r, sql_hash

# the score table of a view: counts per score, then running counts
TABLE = """counts AS (SELECT {p} AS p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {src} GROUP BY ALL),
st AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM counts)"""
st = TABLE.format(p="p", src="scores")
AUC, AP = "sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg))", "sum(pos * tp / (tp + fp)) / sum(pos)"
EDGES = ev.linspace(0.0, 1.0, 11)[1:-1]
bins_sql = f"SELECT len(list_filter({EDGES}, lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS share FROM scores GROUP BY 1"
log_loss = f"avg(-(y * ln(greatest(least(p, 1 - {ev.EPSILON}), {ev.EPSILON})) + (1 - y) * ln(1 - greatest(least(p, 1 - {ev.EPSILON}), {ev.EPSILON}))))"


@query(
    "M1_stratified_split",
    f"""SELECT id, y, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_hash('id', seed=42)}) AS k, count(*) OVER (PARTITION BY y) AS n FROM learning)""",
    "learning",
)
def split(t: Tables):
    return ev.stratified_split(t.view("learning").select("id", "y"), "id", "y")


@query("M2_roc_auc", f"WITH {st} SELECT {rounds(roc_auc=AUC)} FROM st", "scores")
def roc_auc(t: Tables):
    return round_doubles(ev.ranking_metrics(ev.score_table(t.view("scores"))).select("roc_auc"))


@query("M3_average_precision", f"WITH {st} SELECT {rounds(pr_auc=AP)} FROM st", "scores")
def pr_auc(t: Tables):
    return round_doubles(ev.ranking_metrics(ev.score_table(t.view("scores"))).select("pr_auc"))


counts_sql = "SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM scores"
at_sql = {"precision": "tp / (tp + fp)", "recall": "tp / (tp + fn)", "f1": "2 * tp / (2 * tp + fp + fn)", "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2"}


@query(
    "M4_binary_metrics",
    f"""WITH {st}, c AS ({counts_sql}), b AS ({bins_sql}), s AS (SELECT {log_loss} AS ll, avg((p - y) * (p - y)) AS br FROM scores)
    SELECT (SELECT {r(AUC)} FROM st) AS roc_auc, (SELECT {r(AP)} FROM st) AS pr_auc, {rounds(**at_sql)}, {rounds(log_loss='ll', brier='br')},
    (SELECT {r('sum(n * abs(share - mean_p)) / sum(n)')} FROM b) AS ece FROM c, s""",
    "scores",
)
def metrics(t: Tables):
    return round_doubles(ev.binary_metrics(t.view("scores")))


@query("M5_calibration_error", f"WITH b AS ({bins_sql}) SELECT {rounds(ece='sum(n * abs(share - mean_p)) / sum(n)')} FROM b", "scores")
def ece(t: Tables):
    return round_doubles(ev.calibration_error(t.view("scores")))


@query("M6_confusion", counts_sql, "scores")
def confusion(t: Tables):
    return ev.confusion(t.view("scores"))


REPLICATES = 20
drawn_sql = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {sql_hash('id', seed=42)}) AS rk, count(*) OVER () AS n FROM scores),
drawn AS (SELECT replicate, ({sql_hash('replicate', 'j', seed=42)}) % (SELECT count(*) FROM scores) + 1 AS rk, count(*) AS times
    FROM (SELECT unnest(range({REPLICATES})) AS replicate), (SELECT unnest(range((SELECT count(*) FROM scores))) AS j) GROUP BY ALL),
rs AS (SELECT replicate, times, y, p, p2 FROM drawn JOIN ranked USING (rk))"""


def ranked_sql(p: str, name: str) -> str:
    return f"""{name}_c AS (SELECT replicate, {p} AS p, sum(times) FILTER (y = 1) AS pos0, sum(times) FILTER (y = 0) AS neg0 FROM rs GROUP BY ALL),
{name}_s AS (SELECT replicate, coalesce(pos0, 0) AS pos, coalesce(neg0, 0) AS neg, sum(coalesce(pos0, 0)) OVER w AS tp, sum(coalesce(neg0, 0)) OVER w AS fp FROM {name}_c WINDOW w AS (PARTITION BY replicate ORDER BY p DESC)),
{name} AS (SELECT replicate, {AUC} AS roc_auc, {AP} AS pr_auc FROM {name}_s GROUP BY replicate)"""


f1_drawn = "2 * coalesce(sum(times) FILTER (p >= 0.5 AND y = 1), 0) / (coalesce(sum(times) FILTER (p >= 0.5), 0) + sum(times) FILTER (y = 1))"


@query(
    "M7_bootstrap",
    f"""WITH {drawn_sql}, {ranked_sql('p', 'm')}, o AS (SELECT replicate, sum(times * (p - y) * (p - y)) / sum(times) AS brier, {f1_drawn} AS f1 FROM rs GROUP BY replicate),
    long AS (UNPIVOT (SELECT m.*, o.brier, o.f1 FROM m JOIN o USING (replicate)) ON roc_auc, pr_auc, brier, f1 INTO NAME metric VALUE value),
    {st}, whole AS (SELECT 'roc_auc' AS metric, {AUC} AS e FROM st UNION ALL SELECT 'pr_auc', {AP} FROM st UNION ALL SELECT 'brier', avg((p - y) * (p - y)) FROM scores UNION ALL SELECT 'f1', {at_sql['f1']} FROM ({counts_sql}))
    SELECT metric, {rounds(estimate='any_value(e)', lower='quantile_cont(value, 0.025)', upper='quantile_cont(value, 0.975)')}, count(value) AS valid_replicates FROM long JOIN whole USING (metric) GROUP BY metric""",
    "scores",
)
def bootstrap(t: Tables):
    return round_doubles(ev.bootstrap_intervals(t.view("scores"), "id", REPLICATES))


@query(
    "M8_paired_bootstrap",
    f"""WITH {drawn_sql}, {ranked_sql('p', 'a')}, {ranked_sql('p2', 'b')},
    d AS (SELECT replicate, a.roc_auc - b.roc_auc AS roc_auc, a.pr_auc - b.pr_auc AS pr_auc FROM a JOIN b USING (replicate)),
    long AS (UNPIVOT d ON roc_auc, pr_auc INTO NAME metric VALUE value)
    SELECT metric, {rounds(lower='quantile_cont(value, 0.025)', upper='quantile_cont(value, 0.975)')}, count(value) AS valid_replicates FROM long GROUP BY metric""",
    "scores",
)
def paired(t: Tables):
    return round_doubles(ev.paired_differences(t.view("scores"), "id", "p", "p2", REPLICATES))


BINS = 256
limits = ev.poisson_limits()
weight_sql = "CASE " + " ".join(f"WHEN u < {limit} THEN {k}" for k, limit in enumerate(limits)) + f" ELSE {len(limits)} END"
poisson_sql = f"""hashed AS (SELECT *, sha256(concat_ws(':', '42', id::VARCHAR, block::VARCHAR)) AS h FROM scores, (SELECT unnest(range({-(-REPLICATES // ev.BLOCK)})) AS block)),
pieces AS (SELECT *, block * {ev.BLOCK} + j AS replicate, ('0x' || substr(h, (8 * j + 1)::BIGINT, 8))::BIGINT AS u FROM hashed, (SELECT unnest(range({ev.BLOCK})) AS j)),
rs AS (SELECT * FROM (SELECT replicate, {weight_sql} AS times, y, p, p2 FROM pieces WHERE replicate < {REPLICATES}) WHERE times > 0)"""
binned_sql = lambda p: f"least(floor({p} * {BINS}), {BINS - 1})"


@query(
    "M7_poisson_bootstrap",
    f"""WITH {poisson_sql}, {ranked_sql(binned_sql('p'), 'm')}, o AS (SELECT replicate, sum(times * (p - y) * (p - y)) / sum(times) AS brier, {f1_drawn} AS f1 FROM rs GROUP BY replicate),
    long AS (UNPIVOT (SELECT m.*, o.brier, o.f1 FROM m JOIN o USING (replicate)) ON roc_auc, pr_auc, brier, f1 INTO NAME metric VALUE value),
    {st}, whole AS (SELECT 'roc_auc' AS metric, {AUC} AS e FROM st UNION ALL SELECT 'pr_auc', {AP} FROM st UNION ALL SELECT 'brier', avg((p - y) * (p - y)) FROM scores UNION ALL SELECT 'f1', {at_sql['f1']} FROM ({counts_sql}))
    SELECT metric, {rounds(estimate='any_value(e)', lower='quantile_cont(value, 0.025)', upper='quantile_cont(value, 0.975)')}, count(value) AS valid_replicates FROM long JOIN whole USING (metric) GROUP BY metric""",
    "scores",
)
def poisson_bootstrap(t: Tables):
    return round_doubles(ev.poisson_intervals(t.view("scores"), "id", REPLICATES, bins=BINS))


@query(
    "M8_poisson_paired",
    f"""WITH {poisson_sql}, {ranked_sql(binned_sql('p'), 'a')}, {ranked_sql(binned_sql('p2'), 'b')},
    d AS (SELECT replicate, a.roc_auc - b.roc_auc AS roc_auc, a.pr_auc - b.pr_auc AS pr_auc FROM a JOIN b USING (replicate)),
    long AS (UNPIVOT d ON roc_auc, pr_auc INTO NAME metric VALUE value)
    SELECT metric, {rounds(lower='quantile_cont(value, 0.025)', upper='quantile_cont(value, 0.975)')}, count(value) AS valid_replicates FROM long GROUP BY metric""",
    "scores",
)
def poisson_paired(t: Tables):
    return round_doubles(ev.poisson_differences(t.view("scores"), "id", "p", "p2", REPLICATES, bins=BINS))


@query(
    "O5_select_threshold",
    f"""WITH grid AS (SELECT unnest({ev.linspace(0.0, 1.0, 201)}::DOUBLE[]) AS threshold),
    f AS (SELECT threshold, 2 * count(*) FILTER (p >= threshold AND y = 1) / (count(*) FILTER (p >= threshold) + count(*) FILTER (y = 1)) AS f1 FROM scores, grid GROUP BY threshold)
    SELECT {rounds(threshold='threshold', f1='f1')} FROM (SELECT * FROM f ORDER BY f1 DESC, threshold LIMIT 1)""",
    "scores",
)
def threshold(t: Tables):
    return round_doubles(ev.select_threshold(t.view("scores")))


@query("M10_curve_points", f"WITH {st}, n AS (SELECT sum(pos) AS P, sum(neg) AS N FROM counts) SELECT {rounds(threshold='st.p', tpr='tp / n.P', fpr='fp / n.N', precision='tp / (tp + fp)', recall='tp / n.P')} FROM st, n", "scores")
def curves(t: Tables):
    return round_doubles(ev.curve_points(t.view("scores")))


@query("M11_calibration_curve", f"SELECT bin::INT AS bin, n, {rounds(mean_p='mean_p', share='share')} FROM ({bins_sql})", "scores")
def calibration(t: Tables):
    return round_doubles(ev.calibration_curve(t.view("scores")))


@query("O4_case_study", f"SELECT id, {rounds(p='p', p2='p2', shift='abs(p2 - p)')} FROM scores WHERE (p >= 0.5) <> (p2 >= 0.5) AND abs(p2 - p) >= 0.05 ORDER BY abs(p2 - p) DESC, id LIMIT 1", "scores")
def case_study(t: Tables):
    return round_doubles(ev.case_study(t.view("scores"), 0.5))


@query("W6_average_rank", f"SELECT id, {rounds(rank='rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2')} FROM scores", "scores")
def average_rank(t: Tables):
    return round_doubles(ranking.average_rank(t.view("scores").select("id", "p"), "p").select("id", "rank"))


@query(
    "W9_ks",
    f"WITH {st}, n AS (SELECT sum(pos) AS P, sum(neg) AS N FROM counts), a AS (SELECT st.p, tp / n.P - fp / n.N AS adv FROM st, n UNION ALL SELECT 0, 0 UNION ALL SELECT {1 + ev.EPSILON}, 0) SELECT {rounds(threshold='p', advantage='adv')} FROM (SELECT * FROM a ORDER BY round(adv, 12) DESC, p LIMIT 1)",
    "scores",
)
def ks(t: Tables):
    from partyframe.operators.privacy import best_advantage

    return round_doubles(best_advantage(t.view("scores")))


@query("S8_table_summary", "SELECT 'documents' AS name, count(*) AS rows, 5::BIGINT AS columns FROM documents UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def summary(t: Tables):
    from partyframe.sources.files import summarise

    return summarise({"documents": t.documents, "orders": t.orders})


