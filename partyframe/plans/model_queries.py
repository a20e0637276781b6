"""Queries of the two vertical models; their oracles run the same iterations as chained common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from partyframe.operators import gbdt as gb
from partyframe.operators import logistic as lg

from .feature_queries import round_doubles, rounds
from .registry import Tables, query, r

PARTIES = {"bank": ["x0", "x1"], "retail": ["x2", "x3"], "telecom": ["x4"]}
COLS = [c for cs in PARTIES.values() for c in cs]
EPOCHS, RATE, L2 = 8, 0.5, 0.001


def learning(t: Tables):
    """x4 without its gaps; logistic models take no missing features."""
    return t.view("learning").withColumn("x4", F.coalesce("x4", F.lit(0.0)))


def z_sql(w: str) -> str:
    return f"{w}.b + " + " + ".join(f"l.{c} * {w}.{c}" for c in COLS)


def p_sql(w: str) -> str:
    return f"(1 / (1 + exp(-greatest(-35, least(35, {z_sql(w)})))))"


def descent(epochs: int, extra: str = "") -> str:
    ctes = [f"l AS MATERIALIZED (SELECT id, {', '.join(c if c != 'x4' else 'coalesce(x4, 0) AS x4' for c in COLS)}, y FROM learning)", "w0 AS (SELECT 0::DOUBLE AS b, " + ", ".join(f"0::DOUBLE AS {c}" for c in COLS) + ")"]
    for k in range(epochs):
        w = f"w{k}"
        step = ", ".join(f"any_value({w}.{c}) - {RATE} * (avg(l.{c} * ({p_sql(w)} - y)) + {L2} * any_value({w}.{c})) AS {c}" for c in COLS)
        ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT any_value({w}.b) - {RATE} * avg({p_sql(w)} - y) AS b, {step} FROM l, {w})")
    return "WITH " + ",\n".join(ctes) + extra


def fitted(t: Tables, epochs: int = EPOCHS):
    return lg.fit_logistic(learning(t), PARTIES, options=lg.LogisticOptions(RATE, epochs, L2))


@query("T1_fit_logistic", descent(EPOCHS) + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'w{EPOCHS}.{x}')} AS weight FROM w{EPOCHS}" for c, x in [("intercept", "b"), *((c, c) for c in COLS)]), "learning")
def fit(t: Tables):
    m = fitted(t)
    return round_doubles(t.spark.createDataFrame([("intercept", m.intercept), *m.weights.items()], "feature string, weight double"))


@query("T2_score_logistic", descent(EPOCHS) + f" SELECT l.id, {r(z_sql(f'w{EPOCHS}'))} AS logit, {r(p_sql(f'w{EPOCHS}'))} AS p, ({p_sql(f'w{EPOCHS}')} >= 0.5)::INT AS predicted FROM l, w{EPOCHS}", "learning")
def score(t: Tables):
    return round_doubles(lg.score_logistic(learning(t), fitted(t)).select("id", "logit", "p", "predicted"))


W_FIXED = {"x0": 0.7, "x1": -0.5, "x2": 0.4, "x3": 0.6, "x4": -0.8}
FIXED = lg.LogisticModel(PARTIES, W_FIXED, -0.2)
fixed_z = "-0.2 + " + " + ".join(f"coalesce({c}, 0) * {w}" for c, w in W_FIXED.items())


@query("A10_logit_sum", f"SELECT id, {r(fixed_z)} AS z FROM learning", "learning")
def logit_sum(t: Tables):
    x = learning(t)
    parts = [x.select("id", sum((F.col(c) * W_FIXED[c] for c in cs[1:]), F.col(cs[0]) * W_FIXED[cs[0]]).alias(p)) for p, cs in PARTIES.items()]
    joined = parts[0].join(parts[1], "id").join(parts[2], "id")
    return round_doubles(joined.select("id", (F.lit(-0.2) + F.col("bank") + F.col("retail") + F.col("telecom")).alias("z")))


@query("A11_party_gradient", f"SELECT {rounds(**{c: f'avg(coalesce({c}, 0) * (1 / (1 + exp(-({fixed_z}))) - y))' for c in COLS})} FROM learning", "learning")
def gradient(t: Tables):
    from partyframe.functions.scalar import sigmoid

    residual = sigmoid(FIXED.logit()) - F.col("y")
    return round_doubles(learning(t).agg(*(F.avg(F.col(c) * residual).alias(c) for c in COLS)))


@query("A14_coefficient_importance", " UNION ALL ".join(f"SELECT '{p}' AS party, '{c}' AS feature, {r(str(W_FIXED[c]))} AS weight, {r(f'abs({W_FIXED[c]} * stddev_pop(coalesce({c}, 0)))')} AS importance FROM learning" for p, cs in PARTIES.items() for c in cs), "learning")
def importance(t: Tables):
    return round_doubles(lg.coefficient_importance(learning(t), FIXED))


@query("T8_training_history", descent(EPOCHS) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS epoch, (SELECT {r(f'avg(-(y * ln({p_sql(f"w{k}")}) + (1 - y) * ln(1 - {p_sql(f"w{k}")}))) + 0.5 * {L2} * (' + ' + '.join(f'any_value(w{k}.{c}) ^ 2' for c in COLS) + ')')} FROM l, w{k}) AS loss, {RATE}::DOUBLE AS rate, NULL::DOUBLE AS validation" for k in range(EPOCHS)), "learning")
def history(t: Tables):
    x = learning(t)
    return round_doubles(lg.history_frame(x, fitted(t)))


@query("A15_message_volume", f"SELECT 2 * ({EPOCHS} * 3 + 1)::BIGINT AS messages, 2 * ({EPOCHS} * 3 * count(*) + count(*)) AS scalars, 16 * ({EPOCHS} * 3 * count(*) + count(*)) AS bytes FROM learning", "learning")
def volume(t: Tables):
    v = lg.message_volume(t.view("learning").count(), 2, EPOCHS)
    return t.spark.createDataFrame([tuple(v.values())], "messages long, scalars long, bytes long")


@query("T1_options")  # mini-batches, schedules, clipping, L1 and class weights: held against numpy in tests
def options(t: Tables):
    m = lg.fit_logistic(learning(t), PARTIES, options=lg.LogisticOptions(0.3, 3, 0.01, 0.001, 2, "inverse_sqrt", 0.5, "balanced"))
    return t.spark.createDataFrame([("intercept", m.intercept), *m.weights.items()], "feature string, weight double")


@query("T9_protected_logistic")  # residuals clipped and noisy: a property test
def protected(t: Tables):
    from partyframe.operators.privacy import fit_protected

    m = fit_protected(learning(t), PARTIES, epochs=3, clip=1.0, noise_multiplier=0.5, secret=b"only for the registered queries")[0]
    return t.spark.createDataFrame([("intercept", m.intercept), *m.weights.items()], "feature string, weight double")


@query("T7_pooled_baseline")  # an iterative solver of Spark ML: comparable, not equal in coefficients
def pooled(t: Tables):
    from partyframe.operators.studies import pooled_baseline

    return pooled_baseline(learning(t), COLS, "id", "y")


# ---- boosting: one tree of depth 2, then one more

BINS, LEAF, LAMBDA, LR = 8, 5, 1.0, 0.1
OPTIONS = gb.GBDTOptions(trees=2, depth=2, learning_rate=LR, reg_lambda=LAMBDA, bins=BINS, min_leaf=LEAF)
FIRST = gb.GBDTOptions(trees=1, depth=2, learning_rate=LR, reg_lambda=LAMBDA, bins=BINS, min_leaf=LEAF)


def boosting(trees: int = 2, depth: int = 2) -> str:
    """CTEs: c (codes), e (edges), then for each tree and level: hist, cand, best; node tables and margins."""
    edge = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, {[k / BINS for k in range(1, BINS)]}))) AS e_{c}" for c in COLS)
    code = ", ".join(f"(CASE WHEN {c} IS NULL THEN len(e_{c}) ELSE len(list_filter(e_{c}, lambda e: e < {c})) END)::INT AS {c}" for c in COLS)
    out = [f"e AS MATERIALIZED (SELECT {edge} FROM learning)", f"c AS MATERIALIZED (SELECT id, y, {code} FROM learning, e)", "m0 AS (SELECT id, (SELECT ln(avg(y) / (1 - avg(y))) FROM learning) AS m FROM learning)"]
    for k in range(trees):
        out.append(f"n{k}_0 AS MATERIALIZED (SELECT c.*, m, 1 / (1 + exp(-m)) - y AS g, greatest(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))), 1e-8) AS h, 1 AS node FROM c JOIN m{k} USING (id))")
        for d in range(depth):
            t = f"{k}_{d}"
            long = " UNION ALL ".join(f"SELECT node, {f} AS f, {c} AS bin, g, h FROM n{t}" for f, c in enumerate(COLS))
            out.append(f"hist{t} AS MATERIALIZED (SELECT node, f, bin, count(*) AS n, sum(g) AS g, sum(h) AS h FROM ({long}) GROUP BY ALL)")
            out.append(f"""cand{t} AS MATERIALIZED (SELECT *, round(0.5 * (gl * gl / (hl + {LAMBDA}) + (g - gl) * (g - gl) / (h - hl + {LAMBDA}) - g * g / (h + {LAMBDA})), 12) AS gain FROM (
                SELECT node, f, bin, sum(n) OVER u AS nl, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER a AS n, sum(g) OVER a AS g, sum(h) OVER a AS h FROM hist{t}
                WINDOW u AS (PARTITION BY node, f ORDER BY bin), a AS (PARTITION BY node, f)) WHERE nl >= {LEAF} AND n - nl >= {LEAF})""")
            out.append(f"best{t} AS MATERIALIZED (SELECT * FROM cand{t} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1)")
            pick = "CASE f " + " ".join(f"WHEN {f} THEN {c}" for f, c in enumerate(COLS)) + " END"
            out.append(f"n{k}_{d + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN x.node WHEN {pick} <= b.bin THEN 2 * x.node ELSE 2 * x.node + 1 END AS node FROM n{t} x LEFT JOIN best{t} b ON x.node = b.node)")
        out.append(f"leaf{k} AS MATERIALIZED (SELECT node, -sum(g) / (sum(h) + {LAMBDA}) AS value, count(*) AS n FROM n{k}_{depth} GROUP BY node)")
        out.append(f"m{k + 1} AS MATERIALIZED (SELECT id, m + {LR} * value AS m FROM n{k}_{depth} JOIN leaf{k} USING (node))")
    return "WITH " + ",\n".join(out)


OWNER = {c: p for p, cs in PARTIES.items() for c in cs}
name_sql = "CASE b.f " + " ".join(f"WHEN {f} THEN '{c}'" for f, c in enumerate(COLS)) + " END"
owner_sql = "CASE b.f " + " ".join(f"WHEN {f} THEN '{OWNER[c]}'" for f, c in enumerate(COLS)) + " END"


def boosted(t: Tables, options=OPTIONS):
    return gb.fit_gbdt(t.view("learning"), PARTIES, options=options)


nodes_sql = " UNION ALL ".join(
    f"SELECT {k}::INT AS tree, b.node::INT AS node, {d}::INT AS depth, {owner_sql} AS party, {name_sql} AS feature, b.bin::INT AS bin, {r('b.gain')} AS gain, b.n::BIGINT AS n, NULL::DOUBLE AS value FROM best{k}_{d} b" for k in range(2) for d in range(2)
) + " UNION ALL " + " UNION ALL ".join(f"SELECT {k}, node, floor(log2(node))::INT, NULL, NULL, NULL, NULL, n, {r('value')} FROM leaf{k}" for k in range(2))


@query("T3_fit_gbdt", boosting() + " " + nodes_sql, "learning")
def fit_trees(t: Tables):
    return round_doubles(gb.tree_table(t.view("learning"), boosted(t)))


@query("T6_score_gbdt", boosting() + f" SELECT id, {r('m')} AS margin, {r('1 / (1 + exp(-m))')} AS p FROM m2", "learning")
def score_trees(t: Tables):
    x = t.view("learning")
    return round_doubles(gb.score_gbdt(x, boosted(t)).select("id", "margin", "p"))


@query("A13_split_importance", boosting() + " SELECT party, feature, count(*) AS split_count, " + rounds(gain_sum="sum(gain)", gain_mean="avg(gain)") + " FROM (" + " UNION ALL ".join(f"SELECT {owner_sql} AS party, {name_sql} AS feature, b.gain FROM best{k}_{d} b" for k in range(2) for d in range(2)) + ") GROUP BY party, feature", "learning")
def tree_importance(t: Tables):
    return round_doubles(gb.split_importance(gb.tree_table(t.view("learning"), boosted(t))))


def first_level(t: Tables):
    x = t.view("learning")
    edges = gb.fit_bins(x, COLS, BINS)
    mean = x.agg(F.avg("y")).first()[0]
    rows = x.select("id", F.lit(1).alias("node"), (F.lit(mean) - F.col("y")).alias("g"), F.lit(max(mean * (1 - mean), 1e-8)).alias("h"), *(c.alias(n) for n, c in gb.apply_bins(edges).items()))
    return rows, edges


def named(df):
    return df.withColumn("feature", F.get(F.array(*map(F.lit, COLS)), F.col("f"))).drop("f")


@query("A12_gradient_histogram", boosting(1, 1) + f" SELECT {name_sql} AS feature, b.bin::INT AS bin, b.n, {rounds(g='b.g', h='b.h')} FROM hist0_0 b", "learning")
def histogram(t: Tables):
    return round_doubles(named(gb.histograms(first_level(t)[0], COLS)).select("feature", "bin", "n", "g", "h"))


@query("W5_prefix_sums", boosting(1, 1) + f" SELECT {name_sql} AS feature, b.bin::INT AS bin, b.nl::BIGINT AS n_left, {rounds(g_left='b.gl', h_left='b.hl')} FROM cand0_0 b", "learning")
def prefix(t: Tables):
    return round_doubles(named(gb.candidates(gb.histograms(first_level(t)[0], COLS), FIRST)).select("feature", "bin", "n_left", "g_left", "h_left"))


@query("T4_split_gain", boosting(1, 1) + f" SELECT {name_sql} AS feature, b.bin::INT AS bin, {rounds(gain='b.gain')} FROM cand0_0 b", "learning")
def gains(t: Tables):
    return round_doubles(named(gb.candidates(gb.histograms(first_level(t)[0], COLS), FIRST)).select("feature", "bin", "gain"))


@query("O3_argmax_split", boosting(1, 1) + f" SELECT {name_sql} AS feature, b.bin::INT AS bin, {rounds(gain='b.gain')} FROM best0_0 b", "learning")
def argmax(t: Tables):
    return round_doubles(named(gb.best_splits(gb.candidates(gb.histograms(first_level(t)[0], COLS), FIRST))).select("feature", "bin", "gain"))


@query("T5_route", boosting(1, 1) + f" SELECT x.id, CASE WHEN {'CASE b.f ' + ' '.join(f'WHEN {f} THEN x.{c}' for f, c in enumerate(COLS)) + ' END'} <= b.bin THEN 2 ELSE 3 END AS node FROM n0_0 x, best0_0 b", "learning")
def route(t: Tables):
    x = t.view("learning")
    m = boosted(t, gb.GBDTOptions(trees=1, depth=1, bins=BINS, min_leaf=LEAF))
    root = m.trees[0][1]
    return x.select("id", F.when(F.col(root.feature) <= m.edges[root.feature][root.bin], 2).otherwise(3).alias("node"))
