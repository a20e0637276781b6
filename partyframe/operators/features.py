"""Party features: row-wise and grouped aggregates over each party's own source.

Every builder takes the source's columns as they come (missing ones leave their features out), never fails on
unparsable numbers, and returns one row per key. Keys are explicit; no result depends on row order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from partyframe.functions.scalar import contains_flags, fractional_days, normalised_npi, number, row_mean, row_median, row_std, safe_ratio
from partyframe.functions.session import checkpointed
from partyframe.operators.ranking import quantile_frame
from partyframe.operators.relational import MINIMUM_ENTITIES, AlignmentError, assert_unique, keep_first, resolve_columns, select_required

BILLS = tuple(f"BILL_AMT{k}" for k in range(1, 7))
PAYMENTS = tuple(f"PAY_AMT{k}" for k in range(1, 7))
DELAYS = ("PAY_0", *(f"PAY_{k}" for k in range(2, 7)))
#: Ratings that a task gets on average, at most, when they are dealt by user.
USER_ROWS = 500_000
# Fixed genres that have a feature.
GENRES = ("Action", "Comedy", "Drama", "Romance", "Sci-Fi", "Thriller", "Crime", "Adventure")


def bank_features(frame: DataFrame, key: str) -> DataFrame:
    """Behaviour over the monthly bills, payments and repayment delays that the source has; all row-wise, no shuffle."""
    have = {c for c in frame.columns}
    bills, payments, delays = ([c for c in names if c in have] for names in (BILLS, PAYMENTS, DELAYS))
    plain = frame.select(key, *(number(c).alias(c) for c in [*bills, *payments, *delays, "LIMIT_BAL", "AGE"] if c in have))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    most = lambda cols: F.array_max(F.array(*cols))
    out: dict[str, Column] = {}
    if bills:
        out |= {"mean_bill_amount": row_mean(*bills), "median_bill_amount": row_median(*bills), "max_bill_amount": most(bills), "bill_std": zero(row_std(*bills))}
    if len(bills) > 1:
        out |= {"bill_trend": F.col(bills[0]) - F.col(bills[-1]), "recent_bill_change": F.col(bills[0]) - F.col(bills[1])}
    if payments:
        spread = zero(row_std(*payments))
        out |= {"mean_payment_amount": row_mean(*payments), "max_payment_amount": most(payments), "payment_std": spread, "payment_volatility": spread}
    if bills and payments:
        plain = plain.withColumns({f"_abs{k}": F.abs(c) for k, c in enumerate(bills)})
        out["payment_to_bill_ratio"] = safe_ratio(row_mean(*payments), row_mean(*(f"_abs{k}" for k in range(len(bills)))))
        out["recent_payment_ratio"] = safe_ratio(F.col(payments[0]), F.abs(bills[0]))
    if delays:
        late = F.size(F.filter(F.array(*delays), lambda x: x > 0)).cast("long")
        out |= {"repayment_delay_mean": row_mean(*delays), "repayment_delay_max": most(delays), "repayment_delay_count": late}
    if bills and "LIMIT_BAL" in have:
        out["credit_utilization_proxy"] = safe_ratio(bills[0], "LIMIT_BAL")
    out |= {c.lower(): F.col(c) for c in ("LIMIT_BAL", "AGE") if c in have}
    return plain.select(key, *(v.alias(k) for k, v in out.items()))


# name of a feature source: its column
TELECOM = {
    "failures": "Call Failure", "complains": "Complains", "tenure": "Subscription Length", "charge": "Charge Amount", "seconds": "Seconds of Use",
    "usage": "Frequency of use", "sms": "Frequency of SMS", "contacts": "Distinct Called Numbers", "age": "Age", "worth": "Customer Value",
}


def telecom_features(frame: DataFrame, key: str) -> DataFrame:
    """Intensities and ratios; the customer value as z-score of the source (two numbers, joined by broadcast)."""
    found = resolve_columns(frame, TELECOM.values())
    x = {name: number(found[column]) for name, column in TELECOM.items() if column in found}
    plain = frame.select(key, *(c.alias(name) for name, c in x.items()))
    over = lambda a, b: safe_ratio(F.col(a), F.col(b) + 1.0)
    wanted = {
        "usage_intensity": (("usage",), F.col), "sms_intensity": (("sms",), F.col), "call_failure_intensity": (("failures", "usage"), over),
        "distinct_contact_intensity": (("contacts", "usage"), over), "service_tenure": (("tenure",), F.col), "usage_per_subscription_month": (("seconds", "tenure"), over),
        "sms_to_call_ratio": (("sms", "usage"), over), "complaint_indicator": (("complains",), F.col), "charge_level": (("charge",), F.col), "age": (("age",), F.col),
    }
    out = {name: f(*args) for name, (args, f) in wanted.items() if all(a in x for a in args)}
    if "worth" in x:
        stats = plain.agg(F.avg("worth").alias("_mean"), F.stddev_samp("worth").alias("_std"))
        plain = plain.crossJoin(F.broadcast(stats))
        out["customer_value_normalized"] = (F.col("worth") - F.col("_mean")) / F.when(F.col("_std") > 1e-12, F.col("_std")).otherwise(1.0)
    return plain.select(key, *(v.alias(k) for k, v in out.items()))


def severity_by_policy(claims: DataFrame, key: str = "IDpol", amount: str = "ClaimAmount") -> DataFrame:
    """Sum, mean and maximum of the claims of each policy; the sum of no amounts is 0."""
    x = number(amount)
    return claims.groupBy(key).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("severity_sum"), F.avg(x).alias("severity_mean"), F.max(x).alias("severity_max"))


INSURANCE = {"ClaimNb": "claim_count", "Exposure": "exposure", "BonusMalus": "bonus_malus", "VehAge": "vehicle_age", "DrivAge": "driver_age", "VehPower": "vehicle_power", "Density": "density"}


def insurance_features(policies: DataFrame, claims: DataFrame | None = None, key: str = "IDpol") -> DataFrame:
    """A row per policy; claims are aggregated before they are joined, so that policies do not multiply."""
    have = [c for c in INSURANCE if c in policies.columns]
    out = policies.select(key, *(number(c).alias(INSURANCE[c]) for c in have))
    if claims is not None:
        out = out.join(severity_by_policy(claims, key), key, "left")
    if "ClaimNb" in have:
        out = out.withColumn("has_claim", F.coalesce(F.col("claim_count") > 0, F.lit(False)).cast("double"))
        if "Exposure" in have:
            out = out.withColumn("claim_frequency", safe_ratio("claim_count", "exposure"))
    return out


def clean_transactions(frame: DataFrame, cutoff: Column) -> DataFrame:
    """Transactions with a customer and a time up to the cutoff (a timestamp expression), with line_value and cancelled."""
    plain = select_required(frame, ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"])
    plain = plain.withColumns({"InvoiceDate": F.col("InvoiceDate").try_cast("timestamp"), "Quantity": number("Quantity"), "UnitPrice": number("UnitPrice"), "InvoiceNo": F.col("InvoiceNo").cast("string")})
    kept = plain.where(F.col("CustomerID").isNotNull() & F.col("InvoiceDate").isNotNull() & (F.col("InvoiceDate") <= cutoff))
    cancelled = F.startswith("InvoiceNo", F.lit("C")) | F.coalesce(F.col("Quantity") < 0, F.lit(False))
    return kept.withColumns({"line_value": F.col("Quantity") * F.col("UnitPrice"), "cancelled": F.coalesce(cancelled, F.lit(False))})


def distinct_counts(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """(key, a count of distinct values for each of `kinds`), NULL left out, a row for each key that is not NULL. Values are
    texts of one column, told apart by their kind, and made distinct in each task before the shuffle."""
    each = F.array(*(F.struct(F.lit(k).alias("_kind"), c.cast("string").alias("_value")) for k, c in enumerate(kinds.values())))
    met = rows.where(F.col(key).isNotNull()).select(key, F.inline(each)).distinct()
    return met.groupBy(key).agg(*(F.count_if((F.col("_kind") == k) & F.col("_value").isNotNull()).alias(name) for k, name in enumerate(kinds)))


def retail_features(frame: DataFrame, cutoff: Column, key: str = "CustomerID") -> DataFrame:
    """Recency, frequency and value per customer over transactions up to the cutoff, which must be given: without one the
    features would see the whole future. The cleaned transactions are written, as they are read for the 0.9 quantile of line
    values (one row, joined by broadcast), for the sums and for the distinct counts; those count (customer, kind, value), so
    that sums keep one row a customer before the shuffle and a hot customer's values spread over tasks."""
    wanted = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "line_value", "cancelled"]
    rows = checkpointed(clean_transactions(frame, cutoff).select(key, *(c for c in wanted if c != key)))
    top = quantile_frame(rows, "line_value", 0.9, "_top", written=True)
    value = F.col("line_value")
    sums = (
        rows.crossJoin(F.broadcast(top))
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("purchase_count"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias("total_spend"),
            F.avg(value).alias("average_order_value"),
            F.percentile(value, F.lit(0.5)).alias("median_order_value"),
            F.max(value).alias("max_order_value"),
            F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spend_std"),
            F.coalesce(F.sum("Quantity"), F.lit(0.0)).alias("quantity_sum"),
            F.avg("Quantity").alias("mean_quantity"),
            F.count_if("cancelled").alias("cancellation_count"),
            F.max("InvoiceDate").alias("_last"),
            F.avg(F.coalesce(value >= F.col("_top"), F.lit(False)).cast("double")).alias("high_value_purchase_ratio"),
        )
    )
    kinds = {"invoice_count": F.col("InvoiceNo"), "unique_products": F.col("StockCode"), "active_days": F.to_date("InvoiceDate")}
    grouped = sums.join(distinct_counts(rows, key, kinds), key)
    derived = {
        "product_diversity": safe_ratio("unique_products", "purchase_count"),
        "purchase_frequency": safe_ratio("purchase_count", "active_days"),
        "recency_days": fractional_days(cutoff, F.col("_last")),
        "cancellation_ratio": safe_ratio("cancellation_count", "purchase_count"),
    }
    return grouped.withColumns(derived).withColumns({"recency": F.col("recency_days"), "frequency": F.col("invoice_count"), "monetary": F.col("total_spend")}).drop("_last")


def payments_by_provider(payments: DataFrame, least: int = 1, npi: str = "npi", amount: str = "amount") -> DataFrame:
    """Count, sum and mean of payments per valid provider number, for providers with `least` payments or more."""
    x = payments.select(normalised_npi(npi).alias("npi"), number(amount).alias("amount")).where("npi IS NOT NULL")
    sums = x.groupBy("npi").agg(F.count(F.lit(1)).alias("payment_count"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("payment_sum"), F.avg("amount").alias("payment_mean"))
    return sums.where(F.col("payment_count") >= least)


def quantile_label(sums: DataFrame, value: str, q: float = 0.75, name: str = "target") -> DataFrame:
    """1 where the value reaches the q-quantile of all values (one row, joined by broadcast)."""
    cut = quantile_frame(sums, value, q, "_cut")
    return sums.crossJoin(F.broadcast(cut)).withColumn(name, (F.col(value) >= F.col("_cut")).cast("int")).drop("_cut")


def link_providers(prior: DataFrame, future: DataFrame, nppes: DataFrame, care: DataFrame, care_order: str, q: float = 0.75, least_payments: int = 1, minimum: int = MINIMUM_ENTITIES) -> DataFrame:
    """Prior payments, registry, care and the label of later payments, linked by exact provider number: one to one, since
    every side has a row per number by then. care keeps its first row of each number by care_order. Joins reuse the
    partitioning by npi that the aggregates end with."""
    past = payments_by_provider(prior, least_payments).withColumnsRenamed({c: f"prior_{c}" for c in ("payment_count", "payment_sum", "payment_mean")})
    later = quantile_label(payments_by_provider(future).select("npi", F.col("payment_sum").alias("future_sum")), "future_sum", q)
    clean = lambda f: f.withColumn("npi", normalised_npi("npi")).where("npi IS NOT NULL")
    linked = past.join(keep_first(clean(nppes), "npi", *[c for c in nppes.columns if c != "npi"]), "npi").join(keep_first(clean(care), "npi", care_order).drop(care_order), "npi").join(later, "npi")
    if minimum and linked.limit(minimum).count() < minimum:
        raise AlignmentError(f"fewer than {minimum} linked providers")
    return linked


def temporal_split(ratings: DataFrame, user: str = "UserID", order: tuple[str, ...] = ("Timestamp", "MovieID", "Rating"), early: float = 0.8) -> DataFrame:
    """ratings with row_number (from 0), user_count and is_early: the first floor(0.8 n) of each user. One sort per user."""
    mine = W.partitionBy(user)
    return ratings.withColumns({"row_number": F.row_number().over(mine.orderBy(*order)) - 1, "user_count": F.count(F.lit(1)).over(mine)}).withColumn(
        "is_early", F.col("row_number") < F.floor(F.lit(early) * F.col("user_count"))
    )


def temporal_parties(users: DataFrame, ratings: DataFrame, movies: DataFrame, genres: tuple[str, ...] = GENRES, like: float = 4.0, minimum: int = MINIMUM_ENTITIES) -> DataFrame:
    """One row per user that has all parts: demographics (active party), aggregates of the early ratings (passive
    party) and the target, whether the mean of the later ratings is at least `like`.

    Ratings meet movies first, by broadcast when Spark sees that they are small. Then they are counted and dealt by user to so
    many tasks that each has about USER_ROWS of them; windows and aggregate stay there. A user's distinct movies are the first
    rows of each in that user's order, found by a sort, so the aggregate keeps one row a user and not one a rating.
    """
    wanted = select_required(ratings, ["UserID", "MovieID", "Rating", "Timestamp"])
    flags = contains_flags("Genres", list(genres), "genre_")
    kinds = assert_unique(select_required(movies, ["MovieID", "Genres"]), "MovieID").select("MovieID", *(c.alias(g) for g, c in flags.items()))
    parts = max(int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(wanted.count() / USER_ROWS))
    dealt = wanted.join(kinds, "MovieID", "left").fillna(0.0, list(flags)).repartition(parts, "UserID")
    met = F.row_number().over(W.partitionBy("UserID", "MovieID").orderBy("row_number"))
    flagged = temporal_split(dealt).withColumn("_first", F.col("MovieID").isNotNull() & (met == 1)).withColumn("Rating", number("Rating"))
    early, rating = F.col("is_early"), F.col("Rating")
    when_early = lambda c: F.when(early, c)
    mean = lambda c: F.coalesce(F.avg(when_early(c)), F.lit(0.0))
    sums = flagged.groupBy("UserID").agg(
        F.count_if(early).alias("rating_count"),
        mean(rating).alias("mean_rating"),
        F.coalesce(F.stddev_samp(when_early(rating)), F.lit(0.0)).alias("rating_std"),
        mean((rating >= like).cast("double")).alias("high_rating_fraction"),
        F.count_if(early & F.col("_first")).alias("unique_movies"),
        *(mean(F.col(g)).alias(f"{g}_fraction") for g in flags),
        F.avg(F.when(~early, rating)).alias("_late"),
    )
    passive = sums.where("rating_count > 0 AND _late IS NOT NULL").withColumn("target", (F.col("_late") >= like).cast("int")).drop("_late")
    plain = select_required(users, ["UserID", "Gender", "Age", "Occupation", "ZipCode"])
    active = plain.select(
        "UserID",
        F.coalesce(F.col("Gender") == "M", F.lit(False)).cast("double").alias("gender_male"),
        number("Age").alias("age_code"),
        number("Occupation").alias("occupation_code"),
        number(F.regexp_extract(F.coalesce(F.col("ZipCode").cast("string"), F.lit("")), r"(\d{3})", 1)).alias("zip_prefix"),
    )
    linked = active.join(passive, "UserID")
    if minimum and linked.limit(minimum).count() < minimum:
        raise AlignmentError(f"fewer than {minimum} linked users")
    return linked
