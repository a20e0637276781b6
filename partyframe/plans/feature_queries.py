"""Queries of sources, projections, feature aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyframe.functions.scalar import contains_flags, hash_order, hash_uniform, normalised_npi, pseudonym, rounded, safe_ratio
from partyframe.operators import features as fe
from partyframe.operators import ranking
from partyframe.operators import relational as rel

from .registry import Tables, digest_sql, query, r, sql_hash
from .views import BILLS, DELAYS, PAYMENTS

CUTOFF = "1998-04-01 00:00:00"


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*(rounded(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def rounds(**exprs: str) -> str:
    return ", ".join(f"{r(x)} AS {name}" for name, x in exprs.items())


lists = lambda names: f"[{', '.join(f'{n}::DOUBLE' for n in names)}]"
agg = lambda xs, f: f"list_aggregate({xs}, '{f}')"
ratio = lambda a, b: f"({a}) / nullif({b}, 0)"


# ---- projections, filters, predicates


@query("P1_coerce_numeric", "SELECT id, TRY_CAST(Gender AS DOUBLE) AS Gender, " + r("TRY_CAST(ZipCode AS DOUBLE)") + " AS ZipCode, Age::DOUBLE AS Age FROM (SELECT UserID AS id, * FROM users)", "users")
def coerce(t: Tables):
    return round_doubles(rel.coerce_numeric(t.view("users").withColumnRenamed("UserID", "id"), ["Gender", "ZipCode", "Age", "absent"], ["id"]))


@query("P2_safe_ratio", f"SELECT IDpol, {rounds(ratio=ratio('ClaimNb', 'Exposure'))} FROM policies", "policies")
def safe(t: Tables):
    return round_doubles(t.view("policies").select("IDpol", safe_ratio("ClaimNb", "Exposure").alias("ratio")))


@query("P3_rename_aliases", "SELECT c_custkey AS id, c_acctbal AS LIMIT_BAL, c_nationkey AS AGE, c_name AS X2 FROM customer")
def rename(t: Tables):
    given = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("X1"), F.col("c_nationkey").alias("AGE"), F.col("c_name").alias("X2"))
    return rel.rename_aliases(given, {"X1": "LIMIT_BAL", "X2": "AGE", "X3": "absent"})


@query("P4_resolve_columns", "SELECT user_id AS id, count(*) AS usage FROM events GROUP BY user_id")
def resolve(t: Tables):
    given = t.view("telecom")
    return given.select("id", F.col(rel.resolve_columns(given, [" frequency OF use "])[" frequency OF use "]).alias("usage"))


@query("P5_select_required", "SELECT p_partkey, p_brand FROM part")
def select(t: Tables):
    return rel.select_required(t.part, ["p_partkey", "p_brand"])


@query("P6_normalise_npi", "SELECT DISTINCT CASE WHEN regexp_full_match(n, '[0-9]{10}') THEN n END AS npi FROM (SELECT trim(regexp_replace(trim(npi), '\\.0$', '')) AS n FROM (SELECT npi FROM prior UNION ALL SELECT p_name FROM part))", "prior")
def npi(t: Tables):
    return t.view("prior").select("npi").unionAll(t.part.select("p_name")).select(normalised_npi("npi").alias("npi")).distinct()


@query("P7_not_null", "SELECT InvoiceNo, StockCode, CustomerID FROM retail WHERE CustomerID IS NOT NULL", "retail")
def not_null(t: Tables):
    return rel.not_null(t.view("retail"), "CustomerID", "InvoiceDate").select("InvoiceNo", "StockCode", "CustomerID")


@query("P8_temporal_cutoff", "WITH cut AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.7) AS c FROM orders) SELECT o_orderkey, o_custkey FROM orders, cut WHERE epoch_us(o_orderdate) <= c")
def cutoff(t: Tables):
    return rel.until_cutoff(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", 0.7).select("o_orderkey", "o_custkey")


@query("P9_sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_hash('o_orderkey', seed=7)}, o_orderkey LIMIT 500")
def sample(t: Tables):
    return rel.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 500, "o_orderkey", 7)


@query("P10_split_columns", f"SELECT a.id, {rounds(x0='x0', x1='x1', x2='x2', x3='x3', x4='x4')} FROM learning a", "learning")
def split_columns(t: Tables):
    active, passive = rel.split_columns(t.view("learning"), "id", [f"x{k}" for k in range(5)])
    return round_doubles(active.join(passive, "id"))


@query("P11_stack_parties", f"SELECT id, {rounds(x0='x0', x2='x2', x4='x4')}, y FROM learning", "learning")
def stack(t: Tables):
    x = t.view("learning")
    return round_doubles(rel.link_exact("id", x.select("id", "x0"), x.select("id", "x2"), x.select("id", "x4", "y")))


@query("P12_slice_rows", f"SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_hash('id', seed=42)}) AS k, count(*) OVER (PARTITION BY y) AS n FROM learning) WHERE k <= floor(0.7::DOUBLE * n)", "learning")
def slice_rows(t: Tables):
    from partyframe.operators.evaluate import stratified_split

    return stratified_split(t.view("learning").select("id", "y"), "id", "y").where("split = 'train'").select("id", "y")


@query("P13_mask_absent", f"SELECT id, {rounds(x2='CASE WHEN id % 4 <> 0 THEN x2 ELSE 0 END', x3='CASE WHEN id % 4 <> 0 THEN x3 ELSE 0 END')} FROM learning", "learning")
def mask(t: Tables):
    from partyframe.operators.studies import mask_party

    return round_doubles(mask_party(t.view("learning").withColumn("has", F.col("id") % 4 != 0), ["x2", "x3"], "has").select("id", "x2", "x3"))


@query("P14_indicator", f"SELECT id, {rounds(x0='x0')}, (id % 4 <> 0)::INT::DOUBLE AS has_passive, (id % 4 = 0)::INT::DOUBLE AS passive_missing FROM learning", "learning")
def indicator(t: Tables):
    from partyframe.operators.studies import with_indicator

    x = t.view("learning").withColumn("has", F.col("id") % 4 != 0)
    return round_doubles(with_indicator(with_indicator(x, "has", "has_passive"), "has", "passive_missing", missing=True).select("id", "x0", "has_passive", "passive_missing"))


@query(
    "P15_availability",
    f"SELECT id, row_number() OVER (ORDER BY {sql_hash('id', seed=11)}) <= round_even(count(*) OVER () * 0.75, 0) AS has_retail FROM learning",
    "learning",
)
def availability(t: Tables):
    return ranking.exact_share(t.view("learning").select("id"), 0.75, hash_order("id", seed=11), "has_retail").select("id", "has_retail")


# ---- feature aggregates

bank_sql = f"""SELECT id, {rounds(
    mean_bill_amount=agg('b', 'avg'), median_bill_amount=agg('b', 'median'), max_bill_amount=agg('b', 'max'), bill_std=f"coalesce({agg('b', 'stddev_samp')}, 0)",
    bill_trend='BILL_AMT1 - BILL_AMT6', recent_bill_change='BILL_AMT1 - BILL_AMT2', mean_payment_amount=agg('p', 'avg'), max_payment_amount=agg('p', 'max'),
    payment_std=f"coalesce({agg('p', 'stddev_samp')}, 0)", payment_volatility=f"coalesce({agg('p', 'stddev_samp')}, 0)",
    payment_to_bill_ratio=ratio(agg('p', 'avg'), agg('list_transform(b, lambda v: abs(v))', 'avg')), recent_payment_ratio=ratio('PAY_AMT1', 'abs(BILL_AMT1)'),
    repayment_delay_mean=agg('d', 'avg'), repayment_delay_max=agg('d', 'max'), credit_utilization_proxy=ratio('BILL_AMT1', 'LIMIT_BAL'), limit_bal='LIMIT_BAL', age='AGE::DOUBLE')},
    len(list_filter(d, lambda v: v > 0))::BIGINT AS repayment_delay_count
FROM (SELECT *, {lists(BILLS)} AS b, {lists(PAYMENTS)} AS p, {lists(DELAYS)} AS d FROM bank)"""


@query("A1_bank_features", bank_sql, "bank")
def bank(t: Tables):
    return round_doubles(fe.bank_features(t.view("bank"), "id"))


telecom_sql = f"""SELECT id, {rounds(usage_intensity='FrequencyOfUse::DOUBLE', sms_intensity='FrequencyOfSMS::DOUBLE', call_failure_intensity='CallFailure / (FrequencyOfUse + 1.0::DOUBLE)',
    distinct_contact_intensity='DistinctCalledNumbers / (FrequencyOfUse + 1.0::DOUBLE)', service_tenure='SubscriptionLength::DOUBLE', usage_per_subscription_month='SecondsOfUse / (SubscriptionLength + 1.0::DOUBLE)',
    sms_to_call_ratio='FrequencyOfSMS / (FrequencyOfUse + 1.0::DOUBLE)', complaint_indicator='Complains::DOUBLE', charge_level='ChargeAmount::DOUBLE', age='Age::DOUBLE',
    customer_value_normalized='(CustomerValue - avg(CustomerValue) OVER ()) / stddev_samp(CustomerValue) OVER ()')} FROM telecom"""


@query("A2_telecom_features", telecom_sql, "telecom")
def telecom(t: Tables):
    return round_doubles(fe.telecom_features(t.view("telecom"), "id"))


severity_sql = f"SELECT IDpol, {rounds(severity_sum='coalesce(sum(ClaimAmount), 0)', severity_mean='avg(ClaimAmount)', severity_max='max(ClaimAmount)')} FROM claims GROUP BY IDpol"


@query("A3_severity", severity_sql, "claims")
def severity(t: Tables):
    return round_doubles(fe.severity_by_policy(t.view("claims")))


@query("J1_policies_with_severity", f"SELECT p.IDpol, {rounds(claim_count='ClaimNb::DOUBLE')}, severity_sum, severity_mean, severity_max FROM policies p LEFT JOIN ({severity_sql}) s ON p.IDpol = s.IDpol", "policies claims")
def policies_with_severity(t: Tables):
    return round_doubles(fe.insurance_features(t.view("policies"), t.view("claims")).select("IDpol", "claim_count", "severity_sum", "severity_mean", "severity_max"))


@query(
    "A4_insurance_features",
    f"""SELECT IDpol, {rounds(claim_count='ClaimNb::DOUBLE', exposure='Exposure', bonus_malus='BonusMalus::DOUBLE', vehicle_age='VehAge::DOUBLE', driver_age='DrivAge::DOUBLE', vehicle_power='VehPower::DOUBLE',
    density='Density', has_claim='(ClaimNb > 0)::INT::DOUBLE', claim_frequency=ratio('ClaimNb', 'Exposure'))} FROM policies""",
    "policies",
)
def insurance(t: Tables):
    return round_doubles(fe.insurance_features(t.view("policies")))


retail_sql = f"""
WITH kept AS (SELECT *, Quantity * UnitPrice AS v, InvoiceNo LIKE 'C%' OR Quantity < 0 AS cancelled FROM retail WHERE CustomerID IS NOT NULL AND InvoiceDate <= TIMESTAMP '{CUTOFF}'),
top AS (SELECT quantile_cont(v, 0.9) AS q FROM kept),
sums AS (
    SELECT CustomerID, count(*) AS n, count(DISTINCT InvoiceNo) AS invoices, sum(v) AS total, avg(v) AS mean_v, quantile_cont(v, 0.5) AS median_v, max(v) AS max_v, coalesce(stddev_samp(v), 0) AS std_v,
        sum(Quantity) AS quantity, avg(Quantity) AS mean_q, count(DISTINCT StockCode) AS products, count(DISTINCT InvoiceDate::DATE) AS days, count(*) FILTER (cancelled) AS cancels,
        (epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(max(InvoiceDate))) / 86400e6 AS recent, avg((v >= q)::INT) AS high
    FROM kept, top GROUP BY CustomerID)
SELECT CustomerID, n AS purchase_count, invoices AS invoice_count, products AS unique_products, days AS active_days, cancels AS cancellation_count, invoices AS frequency,
    {rounds(total_spend='total', average_order_value='mean_v', median_order_value='median_v', max_order_value='max_v', spend_std='std_v', quantity_sum='quantity', mean_quantity='mean_q', product_diversity='products / n',
            purchase_frequency='n / days', recency_days='recent', cancellation_ratio='cancels / n', high_value_purchase_ratio='high', recency='recent', monetary='total')}
FROM sums"""


def at_cutoff():
    return F.lit(CUTOFF).cast("timestamp_ntz").cast("timestamp")


@query("A5_retail_features", retail_sql, "retail")
def retail(t: Tables):
    return round_doubles(fe.retail_features(t.view("retail"), at_cutoff()))


payments_sql = "SELECT trim(regexp_replace(trim(npi), '\\.0$', '')) AS npi, count(*) AS payment_count, sum(amount) AS payment_sum, avg(amount) AS payment_mean FROM {} GROUP BY 1"


@query("A6_prior_payments", f"SELECT npi, payment_count, {rounds(payment_sum='payment_sum', payment_mean='payment_mean')} FROM ({payments_sql.format('prior')}) WHERE payment_count >= 3", "prior")
def prior_payments(t: Tables):
    return round_doubles(fe.payments_by_provider(t.view("prior"), 3))


label_sql = f"SELECT npi, payment_sum AS future_sum, (payment_sum >= quantile_cont(payment_sum, 0.75) OVER ())::INT AS target FROM ({payments_sql.format('future')})"


@query("A7_future_label", f"SELECT npi, {rounds(future_sum='future_sum')}, target FROM ({label_sql})", "future")
def future_label(t: Tables):
    sums = fe.payments_by_provider(t.view("future")).select("npi", F.col("payment_sum").alias("future_sum"))
    return round_doubles(fe.quantile_label(sums, "future_sum", 0.75))


KINDS = ("ECONOMY", "PROMO", "LARGE", "SMALL")
split_sql = """SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY Timestamp, MovieID, Rating) - 1 AS row_number, count(*) OVER (PARTITION BY UserID) AS user_count FROM ratings"""
early_sql = f"""SELECT UserID, count(*) AS rating_count, avg(Rating) AS mean_rating, coalesce(stddev_samp(Rating), 0) AS rating_std, avg((Rating >= 4)::INT) AS high_rating_fraction, count(DISTINCT MovieID) AS unique_movies,
    {', '.join(f"avg(contains(Genres, '{g}')::INT) AS genre_{g.lower()}_fraction" for g in KINDS)}
FROM split LEFT JOIN movies USING (MovieID) WHERE row_number < floor(0.8::DOUBLE * user_count) GROUP BY UserID"""
late_sql = "SELECT UserID, (avg(Rating) >= 4)::INT AS target FROM split WHERE row_number >= floor(0.8::DOUBLE * user_count) GROUP BY UserID"
early_rounds = rounds(**{c: c for c in ("mean_rating", "rating_std", "high_rating_fraction", *(f"genre_{g.lower()}_fraction" for g in KINDS))})
temporal_sql = f"""
WITH split AS ({split_sql}), early AS ({early_sql}), late AS ({late_sql})
SELECT UserID, (Gender = 'M')::INT::DOUBLE AS gender_male, Age::DOUBLE AS age_code, Occupation::DOUBLE AS occupation_code, regexp_extract(ZipCode, '([0-9]{{3}})', 1)::DOUBLE AS zip_prefix,
    rating_count, unique_movies, {early_rounds}, target
FROM users JOIN early USING (UserID) JOIN late USING (UserID)"""


def linked_users(t: Tables) -> DataFrame:
    return round_doubles(fe.temporal_parties(t.view("users"), t.view("ratings"), t.view("movies"), KINDS))


query("J5_linked_temporal_parties", temporal_sql, "ratings movies users")(linked_users)


@query("A8_early_aggregates", f"WITH split AS ({split_sql}) SELECT UserID, rating_count, unique_movies, {early_rounds} FROM ({early_sql})", "ratings movies")
def early_aggregates(t: Tables):
    return linked_users(t).drop("gender_male", "age_code", "occupation_code", "zip_prefix", "target")


@query("A9_late_label", f"WITH split AS ({split_sql}), early AS ({early_sql}) SELECT UserID, target FROM ({late_sql}) JOIN early USING (UserID)", "ratings movies")
def late_label(t: Tables):
    return linked_users(t).select("UserID", "target")


@query("J3_ratings_with_movies", "SELECT UserID, MovieID, Rating, Genres FROM ratings LEFT JOIN (SELECT * FROM movies WHERE MovieID % 5 <> 0) USING (MovieID)", "ratings movies")
def ratings_with_movies(t: Tables):
    movies = rel.assert_unique(t.view("movies").where("MovieID % 5 <> 0"), "MovieID")
    return t.view("ratings").join(movies, "MovieID", "left").select("UserID", "MovieID", "Rating", "Genres")


providers_sql = f"""
SELECT p.npi, payment_count AS prior_payment_count, {rounds(prior_payment_sum='payment_sum', prior_payment_mean='payment_mean', quality='quality', future_sum='future_sum')}, taxonomy, target
FROM ({payments_sql.format('prior')}) p JOIN registry USING (npi) JOIN (SELECT npi, quality FROM care QUALIFY row_number() OVER (PARTITION BY npi ORDER BY seq) = 1) USING (npi) JOIN ({label_sql}) f USING (npi)"""


@query("J2_linked_providers", providers_sql, "prior future registry care")
def linked_providers(t: Tables):
    return round_doubles(fe.link_providers(t.view("prior"), t.view("future"), t.view("registry"), t.view("care"), "seq"))


# ---- windows, sorts, set operations


@query("W1_cumcount", f"SELECT UserID, MovieID, Rating, row_number FROM ({split_sql})", "ratings")
def cumcount(t: Tables):
    return fe.temporal_split(t.view("ratings")).select("UserID", "MovieID", "Rating", F.col("row_number").cast("long").alias("row_number"))


@query("W2_group_size", f"SELECT UserID, MovieID, Rating, user_count FROM ({split_sql})", "ratings")
def group_size(t: Tables):
    return fe.temporal_split(t.view("ratings")).select("UserID", "MovieID", "Rating", "user_count")


@query("W3_temporal_split", f"SELECT UserID, MovieID, Rating, row_number < floor(0.8::DOUBLE * user_count) AS is_early FROM ({split_sql})", "ratings")
def early_late(t: Tables):
    return fe.temporal_split(t.view("ratings")).select("UserID", "MovieID", "Rating", "is_early")


@query("W8_keep_first", f"SELECT npi, {rounds(quality='quality')} FROM care QUALIFY row_number() OVER (PARTITION BY npi ORDER BY seq) = 1", "care")
def keep_first(t: Tables):
    return round_doubles(rel.keep_first(t.view("care"), "npi", "seq").select("npi", "quality"))


@query("O1_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
def sort(t: Tables):
    return t.customer.select("c_custkey", "c_name").orderBy("c_custkey")


@query("U1_union", f"SELECT npi, {rounds(amount='amount')}, NULL::VARCHAR AS taxonomy FROM prior UNION ALL SELECT npi, NULL, taxonomy FROM registry", "prior registry")
def union(t: Tables):
    return round_doubles(t.view("prior").unionByName(t.view("registry"), allowMissingColumns=True))


@query("U2_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def intersection(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("id")).intersect(t.events.select(F.col("user_id").alias("id")))


@query("U3_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def difference(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("id")).exceptAll(t.events.select(F.col("user_id").alias("id")).distinct())


@query("U4_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def distinct(t: Tables):
    return t.events.select("user_id", "event_type").distinct()


# ---- joins by key


@query("J4_semi_join", f"WITH kept AS (SELECT IDpol FROM policies ORDER BY {sql_hash('IDpol', seed=3)}, IDpol LIMIT 1000) SELECT IDpol, {rounds(ClaimAmount='ClaimAmount')} FROM claims SEMI JOIN kept USING (IDpol)", "policies claims")
def semi_join(t: Tables):
    return round_doubles(t.view("claims").join(rel.sample_rows(t.view("policies").select("IDpol"), 1000, "IDpol", 3), "IDpol", "left_semi"))


@query("J6_exact_intersection", "SELECT o_orderkey AS TransactionID, o_totalprice AS amount, l_shipmode AS id_01 FROM orders JOIN (SELECT l_orderkey, min(l_returnflag) AS l_shipmode FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def exact_intersection(t: Tables):
    transactions = t.orders.select(F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").alias("amount"))
    identity = t.lineitem.groupBy(F.col("l_orderkey").alias("TransactionID")).agg(F.min("l_returnflag").alias("id_01"))
    return rel.link_exact("TransactionID", transactions, identity)


@query("J7_psi_align", "SELECT id FROM learning WHERE id IN (SELECT id FROM telecom) AND id % 3 <> 0", "learning telecom")
def psi(t: Tables):
    frames = [t.view("learning").select("id"), t.view("telecom").select("id"), t.customer.select(F.col("c_custkey").alias("id")).where("id % 3 <> 0")]
    return rel.psi_align(frames, "id", "a salt")[0]


order_digest_sql = f"""SELECT digest FROM ({digest_sql("(SELECT row_number() OVER (ORDER BY c_custkey, c_name) - 1 AS place, c_name AS key FROM customer)", {"place": "place::VARCHAR", "key": "key"})})"""


@query("J8_order_digest", order_digest_sql)
def order_digest(t: Tables):
    return rel.order_digest(t.customer, "c_name", "c_custkey")


@query("J9_alignment", "SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events)) AS only_a, (SELECT count(*) FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer)) AS only_b, 0::BIGINT AS repeated")
def alignment(t: Tables):
    return rel.alignment_report(t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")).distinct(), "id")


# ---- scalar functions


@query(
    "F_scalar_strings",
    "SELECT page_id, lower(trim(url)) AS low, contains(url, 'example.com') AS has, starts_with(url, 'https') AS secure, regexp_extract(url, '([0-9]+)', 1) AS digits, lpad(page_id::VARCHAR, 12, '0') AS padded, regexp_replace(url, '[?#].*$', '') AS bare FROM pages",
)
def strings(t: Tables):
    u = F.col("url")
    return t.pages.select("page_id", F.lower(F.trim(u)).alias("low"), F.contains(u, F.lit("example.com")).alias("has"), F.startswith(u, F.lit("https")).alias("secure"), F.regexp_extract(u, "([0-9]+)", 1).alias("digits"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("padded"), F.regexp_replace(u, r"[?#].*$", "").alias("bare"))


@query(
    "F_scalar_dates",
    f"SELECT event_id, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS micros, {rounds(days=chr(39).join(['(epoch_us(TIMESTAMP ', '2024-06-01 00:00:00', ') - epoch_us(ts)) / 86400e6']))} FROM events",
)
def dates(t: Tables):
    from partyframe.functions.scalar import fractional_days

    ts = F.col("ts").cast("timestamp")
    day = F.unix_micros(F.to_date("ts").cast("timestamp"))
    return round_doubles(t.events.select("event_id", (F.unix_micros(ts) - day).alias("micros"), fractional_days(F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("days")))


@query("F_pseudonym", "SELECT c_custkey AS id, sha256('salt:' || c_custkey) AS pseudonym, substr(sha256('uci350:' || c_custkey), 1, 20) AS short FROM customer")
def pseudonyms(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("id"), pseudonym("c_custkey", "salt").alias("pseudonym"), F.substring(pseudonym("c_custkey", "uci350"), 1, 20).alias("short"))


@query("F_genre_flags", f"SELECT MovieID, {', '.join(f'''contains(Genres, '{g}')::INT::DOUBLE AS genre_{g.lower()}''' for g in KINDS)} FROM movies", "movies")
def genre_flags(t: Tables):
    return t.view("movies").select("MovieID", *(c.alias(k) for k, c in contains_flags("Genres", list(KINDS), "genre_").items()))


@query("F_hash_uniform", f"SELECT doc_id, {rounds(u='(' + sql_hash('doc_id', seed=5) + ') / 1152921504606846976.0::DOUBLE')} FROM documents")
def uniform(t: Tables):
    return round_doubles(t.documents.select("doc_id", hash_uniform("doc_id", seed=5).alias("u")))


