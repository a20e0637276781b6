"""The driver's tables seen as the sources of the domain. The texts are portable SQL: Spark runs them over DataFrames,
oracles put them in front of their own query as common table expressions."""

from __future__ import annotations

slots = lambda name, value: ", ".join(f"sum(CASE WHEN o_orderkey % 6 = {k} THEN {value} END) AS {name[k]}" for k in range(6))
BILLS = [f"BILL_AMT{k}" for k in range(1, 7)]
PAYMENTS = [f"PAY_AMT{k}" for k in range(1, 7)]
DELAYS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]

VIEWS: dict[str, str] = {
    # one row a customer: six bills, payments and delays (NULL where a slot has no order)
    "bank": f"""SELECT c_custkey AS id, c_acctbal * 10 AS LIMIT_BAL, c_custkey % 60 + 18 AS AGE,
        {slots(BILLS, "o_totalprice")},
        {slots(PAYMENTS, "CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")},
        {slots(DELAYS, "CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE -1 END")}
        FROM {{customer}} LEFT JOIN {{orders}} ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal""",
    # one row a user of the event log
    "telecom": """SELECT user_id AS id, count(*) AS FrequencyOfUse, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS FrequencyOfSMS,
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS CallFailure, sum(value) AS SecondsOfUse, count(DISTINCT props) AS DistinctCalledNumbers,
        user_id % 24 AS SubscriptionLength, max(CASE WHEN event_type = 'error' AND value > 50 THEN 1 ELSE 0 END) AS Complains,
        user_id % 10 AS ChargeAmount, avg(value) AS CustomerValue, user_id % 50 + 18 AS Age FROM {events} GROUP BY user_id""",
    # policies and their claims
    "policies": """SELECT o_orderkey AS IDpol, coalesce(n, 0) AS ClaimNb, (o_orderkey % 12) / cast(12 AS DOUBLE) AS Exposure, o_orderkey % 100 + 50 AS BonusMalus,
        o_orderkey % 20 AS VehAge, o_orderkey % 60 + 18 AS DrivAge, o_custkey % 9 + 4 AS VehPower, o_totalprice / 100 AS Density
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber <= 4 GROUP BY l_orderkey) x ON o_orderkey = l_orderkey""",
    "claims": "SELECT l_orderkey AS IDpol, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS ClaimAmount FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber <= 4",
    # retail transactions: some cancelled, some without a customer
    "retail": """SELECT concat(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'C' ELSE '' END, cast(o_orderkey AS VARCHAR(20))) AS InvoiceNo, l_partkey AS StockCode,
        CASE WHEN l_linenumber = 7 AND o_orderkey % 50 = 1 THEN -l_quantity ELSE l_quantity END AS Quantity, o_orderdate AS InvoiceDate,
        l_extendedprice / l_quantity AS UnitPrice, CASE WHEN o_orderkey % 97 <> 5 THEN o_custkey END AS CustomerID FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # ratings in time, users and rated things
    "ratings": "SELECT o_custkey AS UserID, l_partkey AS MovieID, cast(l_quantity AS BIGINT) % 5 + 1 AS Rating, o_orderdate AS Timestamp FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "users": """SELECT c_custkey AS UserID, CASE WHEN c_custkey % 3 = 0 THEN 'M' ELSE 'F' END AS Gender, c_custkey % 60 + 18 AS Age, c_nationkey AS Occupation,
        concat(CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END, cast(110001 + c_custkey AS VARCHAR(20))) AS ZipCode FROM {customer}""",
    "movies": "SELECT p_partkey AS MovieID, concat(p_type, '|', p_brand) AS Genres FROM {part}",
    # payments to providers, with identifiers as they come; three files about providers
    "prior": "SELECT concat(' ', cast(1000000000 + o_custkey AS VARCHAR(20)), '.0') AS npi, o_totalprice AS amount FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-04-01 00:00:00'",
    "future": "SELECT concat(cast(1000000000 + o_custkey AS VARCHAR(20)), ' ') AS npi, o_totalprice AS amount FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-04-01 00:00:00'",
    "registry": "SELECT cast(1000000000 + c_custkey AS VARCHAR(20)) AS npi, c_mktsegment AS taxonomy FROM {customer} WHERE c_custkey % 7 <> 0",
    "care": "SELECT cast(1000000000 + c_custkey AS VARCHAR(20)) AS npi, c_acctbal AS quality, c_nationkey AS seq FROM {customer} UNION ALL SELECT cast(1000000000 + c_custkey AS VARCHAR(20)), -c_acctbal, c_nationkey + 100 FROM {customer}",
    # labels with a score; and the same with a second one
    "scores": """SELECT doc_id AS id, quality AS y, (cast(doc_id * 7919 % 1000 AS DOUBLE) * 0.55 + quality * 400 + cast(doc_id * 31 % 17 AS DOUBLE)) / 1000 AS p,
        (cast(doc_id * 104729 % 1000 AS DOUBLE) * 0.8 + quality * 150) / 1000 AS p2 FROM {labels} WHERE quality IS NOT NULL""",
    # a learning frame: x0 and x1 are the active party's, x2 and x3 another's, x4 a third's
    "learning": """SELECT c_custkey AS id, c_acctbal / 5000 AS x0, cast(c_nationkey AS DOUBLE) / 25 AS x1, coalesce(n, 0) / cast(20 AS DOUBLE) AS x2, coalesce(total, 0) / 5000000 AS x3,
        CASE WHEN c_custkey % 13 <> 4 THEN cast(c_custkey * 7919 % 1000 AS DOUBLE) / 1000 END AS x4,
        CASE WHEN c_acctbal / 5000 + cast(c_custkey * 7919 % 1000 AS DOUBLE) / 1000 + cast(c_custkey * 104729 % 1000 AS DOUBLE) / 1000 > 2 THEN 1 ELSE 0 END AS y
        FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) t ON c_custkey = o_custkey""",
    # what went over the wire: an audit log
    "audit": """SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'backward' ELSE 'forward' END AS direction, concat('party', cast(user_id % 4 AS VARCHAR(9))) AS party,
        CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS stage, event_id % 5 AS step, event_id % 9 + 1 AS scalars, 8 * (event_id % 9 + 1) AS bytes, user_id AS entity, ts FROM {events}""",
}


def used_tables(name: str) -> list[str]:
    import string

    return sorted({f for _, f, _, _ in string.Formatter().parse(VIEWS[name]) if f})


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """sql for DuckDB, the named views in front of it."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in used_tables(n)})})" for n in names.split())
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    return f"{head}{ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}{ctes}\n{body}"
