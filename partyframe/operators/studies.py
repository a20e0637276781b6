"""Studies over one frame of party columns: ablation, contribution, dropout, missing parties, overlap and drift."""

from __future__ import annotations

from itertools import combinations
from math import factorial
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.functions.scalar import hash_order, hash_uniform
from partyframe.functions.session import checkpointed, shared_folder
from partyframe.operators.evaluate import binary_metrics, binary_metrics_by
from partyframe.operators.logistic import LogisticModel, LogisticOptions, score_logistic
from partyframe.operators.many_models import TASK_ROWS, Cell, Curve, ManyFrame, by_cell, curve_metrics, fit_many_logistic, many_frame, score_many
from partyframe.operators.ranking import exact_share, hash_rank, ordered_sums, quantiles

Parties = dict[str, list[str]]


def subsets(names: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(names) + 1) for c in combinations(names, k)]


def sides(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both in one frame, told apart by _train."""
    return train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False)))


def side_by_side(frame: ManyFrame, names: list[tuple], schema: str, models: list[LogisticModel], tests: list[str]) -> DataFrame:
    """(names..., metrics...): each model's metrics over the rows of its test flag, all in one plan; the frame is closed."""
    scored = checkpointed(by_cell(score_many(frame, models), [frame.pattern(t) for t in tests]).select("cell", "y", "p"))
    ranked = curve_metrics(frame, models, [Curve(k, (t,)) for k, t in enumerate(tests)]).select(F.col("curve").cast("int").alias("cell"), "roc_auc", "pr_auc")
    frame.close()
    labels = scored.sparkSession.createDataFrame([(k, *name) for k, name in enumerate(names)], f"cell int, {schema}")
    return labels.join(binary_metrics_by(scored, ["cell"], ranked=ranked), "cell", "left").drop("cell")


def party_subset_scores(train: DataFrame, test: DataFrame, parties: Parties, options: LogisticOptions, y: str = "y", key: str = "id") -> DataFrame:
    """(subset, mask, metrics...) of the model of every subset that holds the active (first) party, trained side by side."""
    active, *passive = parties
    chosen = [(active, *c) for c in subsets(passive)]
    frame = many_frame(sides(train, test), [c for cs in parties.values() for c in cs], {"learn": F.col("_train"), "test": ~F.col("_train")}, y, key)
    models = fit_many_logistic(frame, [Cell("learn", {p: parties[p] for p in names}, options) for names in chosen])
    names = [("+".join(c), sum(1 << k for k, p in enumerate(passive) if p in c)) for c in chosen]
    return side_by_side(frame, names, "subset string, mask int", models, ["test"] * len(models))


def contribution_study(train: DataFrame, test: DataFrame, parties: Parties, options: LogisticOptions, metric: str = "roc_auc", y: str = "y", key: str = "id") -> DataFrame:
    """(party, shapley, leave_one_out) of the passive parties, from the metric of a model trained for every subset of them."""
    scores = party_subset_scores(train, test, parties, options, y, key).select("mask", F.col(metric).alias("value"))
    return shapley_values(scores, list(parties)[1:])


def shapley_values(utilities: DataFrame, players: list[str], mask: str = "mask", value: str = "value") -> DataFrame:
    """(party, shapley, leave_one_out) from (mask, value) of all 2^k subsets: each row meets the row with one player more."""
    n = len(players)
    weight = lambda r: factorial(r) * factorial(n - r - 1) / factorial(n)
    weights = F.array(*(F.lit(weight(r)) for r in range(n)))
    names = utilities.sparkSession.createDataFrame([(k, 1 << k, p) for k, p in enumerate(players)], "k int, bit int, party string")
    without, with_ = utilities.select(F.col(mask).alias("m"), F.col(value).alias("v")), utilities.select(F.col(mask).alias("m2"), F.col(value).alias("v2"))
    steps = without.crossJoin(F.broadcast(names)).where(F.col("m").bitwiseAND(F.col("bit")) == 0).join(with_, F.col("m2") == F.col("m") + F.col("bit"))
    gain = F.col("v2") - F.col("v")
    everyone = (1 << n) - 1
    return steps.groupBy("party").agg(F.sum(F.element_at(weights, (F.bit_count("m") + 1).cast("int")) * gain).alias("shapley"), F.max(F.when(F.col("m2") == everyone, gain)).alias("leave_one_out"))


def mask_party(df: DataFrame, columns: list[str], has: str) -> DataFrame:
    """0 in the columns of rows that the party does not hold."""
    return df.withColumns({c: F.when(F.coalesce(F.col(has), F.lit(False)), F.col(c)).otherwise(0.0) for c in columns})


def with_indicator(df: DataFrame, has: str, name: str, missing: bool = False) -> DataFrame:
    there = F.coalesce(F.col(has), F.lit(False))
    return df.withColumn(name, (~there if missing else there).cast("double"))


METHODS = ("intersection_only", "zero_contribution", "availability_indicator", "learned_party_bias")


def prepare_missing(df: DataFrame, parties: Parties, has: dict[str, str], method: str) -> tuple[DataFrame, Parties]:
    """Rows and party columns under one way to treat entities that passive parties lack. has names a boolean column for
    each party; availability never depends on the label."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    active, *passive = parties
    if method == "intersection_only":
        kept = df
        for p in parties:
            kept = kept.where(F.col(has[p])) if p in has else kept
        return kept, dict(parties)
    out, columns = (df.where(F.col(has[active])) if active in has else df), {p: list(cs) for p, cs in parties.items()}
    for p in passive:
        out = mask_party(out, parties[p], has[p])
        if method == "availability_indicator":
            out = with_indicator(out, has[p], f"has_{p}_indicator")
            columns[active].append(f"has_{p}_indicator")
        elif method == "learned_party_bias":
            out = with_indicator(out, has[p], f"{p}_missing", missing=True)
            columns[p].append(f"{p}_missing")
    return out, columns


def availability(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """df with has_<party> for each share: exactly round(n * share) entities, drawn by a hash of party, seed and key."""
    n = df.count()
    for k, (party, share) in enumerate(shares.items()):
        df = exact_share(df, share, hash_order(key, seed=seed + k), f"has_{party}", n)
    return df


# Fixed scenarios of the dropout and the drift study.
DROPOUT = {"none": (), "telecom_absent": ("telecom",), "insurance_absent": ("insurance",), "retail_absent": ("retail",), "telecom_retail_absent": ("telecom", "retail")}


def dropout_study(train: DataFrame, test: DataFrame, parties: Parties, options: LogisticOptions, scenarios: dict[str, tuple[str, ...]] | None = None, y: str = "y", key: str = "id") -> DataFrame:
    """(scenario, phase, metrics...) where parties drop out when scoring (they count nothing), and where the model is trained
    without them; all models are trained side by side."""
    known = {name: gone for name, gone in (scenarios or DROPOUT).items() if set(gone) <= set(parties)}
    left = {name: {p: cs for p, cs in parties.items() if p not in gone} for name, gone in known.items()}
    frame = many_frame(sides(train, test), [c for cs in parties.values() for c in cs], {"learn": F.col("_train"), "test": ~F.col("_train")}, y, key)
    whole, *again = fit_many_logistic(frame, [Cell("learn", dict(parties), options), *(Cell("learn", kept, options) for kept in left.values())])
    absent = [LogisticModel(kept, {c: whole.weights[c] for cs in kept.values() for c in cs}, whole.intercept) for kept in left.values()]
    names = [(name, phase) for phase in ("inference", "retrained") for name in known]
    return side_by_side(frame, names, "scenario string, phase string", [*absent, *again], ["test"] * len(names))


# Fixed scenarios of the drift study: party, then what numeric_drift() is told, or None for drift of codes.
DRIFT = {
    "baseline": ("", {}),
    "telecom_mean_shift": ("telecom", {"shift": 0.75}),
    "insurance_variance_shift": ("insurance", {"scale": 1.5}),
    "retail_missingness_shift": ("retail", {"missing": 0.2}),
    "retail_categorical_frequency_shift": ("retail", None),
    "bank_repayment_proxy_shift": ("bank", {"shift": 0.5, "scale": 1.2}),
}


def drift_study(test: DataFrame, model, parties: Parties, key: str, scenarios: dict | None = None, levels: int = 5, y: str = "y", seed: int = 42) -> DataFrame:
    """(scenario, metrics..., roc_auc_delta): a fitted model on rows whose columns of one party have drifted. Drift of
    codes cuts the party's first column into levels of equal numbers, draws levels anew, and puts each level's mean."""
    columns_of, rows, first = test.columns, None, next(iter(scenarios or DRIFT))
    for name, (party, how) in (scenarios or DRIFT).items():
        columns, moved = parties.get(party, []), test
        if party and how is not None:
            moved = numeric_drift(test, columns, key, seed=seed, **how).fillna(0.0, columns)
        elif party:
            moved = code_drift(test, columns[0], key, levels, seed)
        own = moved.select(F.lit(name).alias("scenario"), *columns_of)
        rows = own if rows is None else rows.unionByName(own)
    found = checkpointed(binary_metrics_by(score_logistic(rows, model), ["scenario"], y=y))
    before = found.where(F.col("scenario") == first).select(F.col("roc_auc").alias("_before"))
    return found.crossJoin(F.broadcast(before)).select(*found.columns, (F.col("roc_auc") - F.col("_before")).alias("roc_auc_delta"))


def code_drift(df: DataFrame, column: str, key: str, levels: int, seed: int = 42) -> DataFrame:
    edges = quantiles(df, [column], [k / levels for k in range(1, levels)])[column]
    level = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges if e is not None), F.lit(0))
    marked = df.withColumn("_level", F.when(F.col(column).isNotNull(), level.cast("string")))
    means = marked.where("_level IS NOT NULL").groupBy("_level").agg(F.avg(column).alias("_mean"))
    drawn = categorical_drift(marked, "_level", key, seed=seed).join(F.broadcast(means), "_level", "left")
    return drawn.withColumn(column, F.col("_mean")).drop("_level", "_mean")


# Fixed shares of the overlap study.
OVERLAPS = (1.0, 0.9, 0.75, 0.5, 0.25)


def held_columns(df: DataFrame, parties: Parties, has: dict[str, str], tag: str) -> tuple[DataFrame, dict[str, Parties]]:
    """df with the columns of passive parties as each method sees them, under names with a tag; and by method the columns of
    each party. The rows stay: intersection_only is a matter of which rows are used."""
    active, *passive = parties
    shown = {p: [f"{c}{tag}" for c in parties[p]] for p in passive}
    there = {p: F.coalesce(F.col(has[p]), F.lit(False)) for p in passive}
    made = {n: F.when(there[p], F.col(c)).otherwise(0.0) for p in passive for n, c in zip(shown[p], parties[p], strict=True)}
    made |= {f"has_{p}{tag}": there[p].cast("double") for p in passive} | {f"{p}_missing{tag}": (~there[p]).cast("double") for p in passive}
    plain = {active: list(parties[active]), **shown}
    columns = {
        "intersection_only": plain,
        "zero_contribution": plain,
        "availability_indicator": {**plain, active: [*parties[active], *(f"has_{p}{tag}" for p in passive)]},
        "learned_party_bias": {active: plain[active], **{p: [*shown[p], f"{p}_missing{tag}"] for p in passive}},
    }
    return df.withColumns(made), columns


def missing_party_study(df: DataFrame, parties: Parties, key: str, train: Column, options: LogisticOptions, conditions: dict[str, dict[str, str]], methods: tuple[str, ...] = METHODS, y: str = "y") -> DataFrame:
    """(condition, method, train_rows, test_rows, metrics...): a model of each method under each condition. A condition names a
    boolean column for every passive party: whether it holds the entity. The split is the boolean column `train` and fixed
    before, so no entity changes sides between methods; all models are trained side by side."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}")
    wide, cells, names, tests = df.withColumn("_train", train), [], [], []
    flags = {"learn": F.col("_train"), "test": ~F.col("_train")}
    for k, (condition, has) in enumerate(conditions.items()):
        wide, columns = held_columns(wide, parties, has, f"@{k}")
        everyone = F.lit(True)
        for p in list(parties)[1:]:
            everyone = everyone & F.coalesce(F.col(has[p]), F.lit(False))
        flags |= {f"learn@{k}": F.col("_train") & everyone, f"test@{k}": ~F.col("_train") & everyone}
        for method in methods:
            tag = f"@{k}" if method == "intersection_only" else ""
            cells.append(Cell(f"learn{tag}", columns[method], options))
            names.append((condition, method))
            tests.append(f"test{tag}")
    used = list(dict.fromkeys(c for cell in cells for cs in cell.parties.values() for c in cs))
    frame = many_frame(wide, used, flags, y, key)
    models = fit_many_logistic(frame, cells)
    n = frame.rows.select(F.posexplode("flags").alias("k", "on")).groupBy("k").agg(F.count_if("on").alias("n")).collect()
    sizes = {frame.flags[row.k]: row.n for row in n}
    counted = [(*name, sizes.get(cell.learn, 0), sizes.get(test, 0)) for name, cell, test in zip(names, cells, tests, strict=True)]
    return side_by_side(frame, counted, "condition string, method string, train_rows long, test_rows long", models, tests)


def overlap_study(df: DataFrame, parties: Parties, key: str, train: Column, options: LogisticOptions, shares: tuple[float, ...] = OVERLAPS, methods: tuple[str, ...] = ("intersection_only", "zero_contribution"), y: str = "y", seed: int = 42) -> DataFrame:
    """(method, overlap, train_rows, test_rows, metrics...): passive parties that hold one and the same share of the entities."""
    marked, conditions = df, {}
    for k, share in enumerate(shares):
        marked = exact_share(marked, share, hash_order(key, seed=seed + 1000 + k), f"_has{k}")
        conditions[str(share)] = dict.fromkeys(list(parties)[1:], f"_has{k}")
    found = missing_party_study(marked, parties, key, train, options, conditions, methods, y)
    return found.select("method", F.col("condition").cast("double").alias("overlap"), *found.columns[2:])


def permutation_contribution(df: DataFrame, model, parties: Parties, key: str, y: str = "y", seed: int = 42) -> DataFrame:
    """(party, roc_auc_drop): what the model loses where a party's columns are dealt to other rows."""
    whole, rows = binary_metrics(score_logistic(df, model), y=y).select(F.col("roc_auc").alias("_whole")), None
    for party, columns in parties.items():
        dealt = binary_metrics(score_logistic(permute_party(df, columns, key, seed), model), y=y)
        row = dealt.crossJoin(F.broadcast(whole)).select(F.lit(party).alias("party"), (F.col("_whole") - F.col("roc_auc")).alias("roc_auc_drop"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def numeric_drift(df: DataFrame, columns: list[str], key: str, shift: float = 0.0, scale: float = 1.0, missing: float = 0.0, seed: int = 42) -> DataFrame:
    """mean + scale * (x - mean) + shift; then a share of the values becomes NULL, chosen by a hash of column and key."""
    if scale <= 0 or not 0 <= missing <= 1:
        raise ValueError("scale must be positive, missing within [0, 1]")
    means = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns))
    moved = lambda c: F.col(f"_m_{c}") + scale * (F.col(c) - F.col(f"_m_{c}")) + shift
    gone = lambda k: hash_uniform(key, seed=seed + k) < missing
    return df.crossJoin(F.broadcast(means)).withColumns({c: F.when(gone(k), None).otherwise(moved(c)) if missing else moved(c) for k, c in enumerate(columns)}).drop(*(f"_m_{c}" for c in columns))


#: Cells of [0, 1) in which draws meet the categories whose intervals overlap them.
CELLS = 4096


def categorical_drift(df: DataFrame, column: str, key: str, strength: float = 0.25, seed: int = 42) -> DataFrame:
    """Values drawn anew from (1 - s) p + s on the dominant category (of equals the first by name); NULLs stay NULL. Each
    category has an interval of [0, 1), in the order of names, and a draw falls into one; both sides meet by cells, so there
    may be as many categories as rows."""
    if not 0 <= strength <= 1:
        raise ValueError("strength must be within [0, 1]")
    counts = checkpointed(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0]
    if total is None:
        return df
    top = counts.agg(F.max("_n").alias("_n")).join(counts, "_n").agg(F.min("_v")).first()[0]
    ends = ordered_sums(counts, [F.col("_v")], {"_upto": F.col("_n")})
    edge = lambda n, beyond: (1 - strength) * n / F.lit(total) + F.when(beyond, strength).otherwise(0.0)
    low = F.when(F.col("_upto") == F.col("_n"), -1.0).otherwise(edge(F.col("_upto") - F.col("_n"), F.col("_v") > top))
    high = F.when(F.col("_upto") == total, 2.0).otherwise(edge(F.col("_upto"), F.col("_v") >= top))
    cell = lambda u: F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(u * CELLS))).cast("int")
    spans = ends.select("_v", low.alias("_low"), high.alias("_high")).withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high")))))
    drawn = df.withColumn("_u", F.when(F.col(column).isNotNull(), hash_uniform(key, seed=seed))).withColumn("_at", cell(F.col("_u")))
    met = drawn.join(spans, (F.col("_at") == F.col("_cell")) & (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")), "left")
    return met.select(*(F.col("_v").cast(df.schema[column].dataType).alias(c) if c == column else F.col(c) for c in df.columns))


def permute_party(df: DataFrame, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """The party's columns dealt to other rows: two hash orders of the keys, joined by rank."""
    own = hash_rank(df.drop(*columns), hash_order(key, seed=seed), "_rank")
    theirs = hash_rank(df.select(key, *columns), hash_order(key, seed=seed + 1), "_rank").drop(key)
    return own.join(theirs, "_rank").drop("_rank")


def distributed_signal(df: DataFrame, parties: Parties, key: str, noise: Column | None = None, seed: int = 42) -> DataFrame:
    """df with a target that all parties carry: standardised party means, two interactions, optional noise."""
    means = {p: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs) for p, cs in parties.items()}
    marked = df.withColumns({f"_s_{p}": m for p, m in means.items()})
    stats = marked.agg(*(f(f"_s_{p}").alias(f"_{n}_{p}") for p in parties for n, f in (("m", F.avg), ("d", F.stddev_pop))))
    z = [(F.col(f"_s_{p}") - F.col(f"_m_{p}")) / F.when(F.col(f"_d_{p}") > 1e-12, F.col(f"_d_{p}")).otherwise(1.0) for p in parties]
    signal = sum(z[1:], z[0])
    signal = signal + 0.35 * z[0] * z[1] if len(z) > 1 else signal
    signal = signal - 0.25 * z[2] * z[3] if len(z) > 3 else signal
    p = 1 / (1 + F.exp(-(signal + noise if noise is not None else signal)))
    joined = marked.crossJoin(F.broadcast(stats))
    return joined.withColumn("target", (hash_uniform(key, seed=seed) < p).cast("int")).select(*df.columns, "target")


#: Pooled models train as long as those of scikit-learn that they stand for: a logistic one until it stands still, at most so many
#: iterations; a boosted one for so many trees of this depth (32 leaves at most, there 31), with so many bins for a feature.
POOLED_ITERATIONS, POOLED_TREES, POOLED_DEPTH, POOLED_BINS = 1000, 100, 5, 255
#: Party subsets whose models are trained at one time.
SIDE_BY_SIDE = 2


def pooled_model(df: DataFrame, columns: list[str], kept: list[str], y: str, l2: float, iterations: int | None, boosting: bool, learn: Column | None) -> tuple:
    """(rows with the columns to keep, features and whether a row is learnt from; the model) of pooled_baseline()."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    shared_folder(df.sparkSession)  # where Spark ML cuts the lineage of trees
    x = VectorAssembler(inputCols=columns, outputCol="_x").transform(df.select(*kept, F.col(y).cast("double").alias("_y"), (F.lit(True) if learn is None else learn).alias("_learn"), *(c for c in columns if c not in kept))).persist()
    if iterations is None:
        iterations = POOLED_TREES if boosting else POOLED_ITERATIONS
    if boosting:
        kind = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=iterations, maxDepth=POOLED_DEPTH, maxBins=POOLED_BINS, seed=42)
    else:
        kind = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=l2, maxIter=iterations, standardization=False)
    model = kind.fit(x.where("_learn"))
    x.unpersist()
    return x, model


def pooled_baseline(df: DataFrame, columns: list[str], key: str, y: str, l2: float = 1e-3, iterations: int | None = None, boosting: bool = False, learn: Column | None = None) -> DataFrame:
    """(key, p) of a pooled, non-federated model of Spark ML: logistic, or boosted trees (one for each iteration); without
    iterations it trains to its end. It learns from the rows for which the column `learn` holds, or from all."""
    from pyspark.ml.functions import vector_to_array

    x, model = pooled_model(df, columns, [key], y, l2, iterations, boosting, learn)
    return model.transform(x).select(key, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def pooled_subsets(train: DataFrame, test: DataFrame, parties: Parties, key: str, y: str = "y", iterations: int | None = None) -> DataFrame:
    """(subset, model, metrics...) of pooled models over every subset that holds the active (first) party; without iterations
    they train to their end. Rows are counted, dealt evenly to tasks and written once for all models, some subsets are
    trained at one time, and the test rows' scores of all models are written once for all metrics, which come from one plan."""
    from pyspark import inheritable_thread_target
    from pyspark.ml.functions import vector_to_array

    active, *passive = parties
    wanted = list(dict.fromkeys([key, y, *(c for cs in parties.values() for c in cs)]))
    rows, given = None, sides(train.select(*wanted), test.select(*wanted)).persist()
    both = checkpointed(given.repartition(max(1, -(-given.count() // TASK_ROWS))))
    given.unpersist()

    @inheritable_thread_target(both.sparkSession)
    def trained(chosen: tuple[str, ...]) -> list[tuple]:
        columns = [c for p in (active, *chosen) for c in parties[p]]
        return [("+".join((active, *chosen)), name, *pooled_model(both, columns, [y], y, 1e-3, iterations, name == "boosting", F.col("_train"))) for name in ("logistic", "boosting")]

    with ThreadPool(SIDE_BY_SIDE) as pool:
        models = [m for ms in pool.map(trained, subsets(passive), chunksize=1) for m in ms]
    for subset, name, x, model in models:
        p = F.get(vector_to_array("probability"), F.lit(1)).alias("p")
        own = model.transform(x.where("NOT _learn")).select(F.lit(subset).alias("subset"), F.lit(name).alias("model"), F.col(y), p)
        rows = own if rows is None else rows.unionByName(own)
    return binary_metrics_by(checkpointed(rows), ["subset", "model"], y=y)


def drift_summary(df: DataFrame, by: str, delta: str) -> DataFrame:
    """Per phase: the smallest and the largest change, and the scenario that moved most."""
    return df.groupBy(by).agg(F.min(delta).alias("least"), F.max(delta).alias("most"), F.max_by("scenario", F.struct(F.abs(delta), F.col("scenario"))).alias("largest"))


def interpret(delta: Column, low: Column) -> Column:
    return F.when((delta > 0) & (low > 0), "clear improvement").when(delta > 0, "not distinguishable").otherwise("no improvement")


