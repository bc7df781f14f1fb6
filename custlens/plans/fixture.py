"""The customer table the analytics run on, derived from the TPC-H-style
test tables (one row per customer), in Spark and as DuckDB SQL.

The Spark builder and the SQL text implement the same rules (FIXTURES.md §3):
aggregates come from orders and lineitem, profile columns are deterministic
functions of the customer key ``k`` so nulls, sentinels and messy strings
exist on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.sources.io import testdata

# Category labels cycled by key (ordinal maps' labels plus one
# label the maps do not know), seasons, genders.
AGE_LABELS = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+", None]
SPENDING_LABELS = ["Low", "Medium", "High", "Very High", "Unknown"]
LOYALTY_LABELS = ["Bronze", "Silver", "Gold", "Platinum", "Unknown"]
CHURN_RISK_LABELS = ["Low", "Medium", "High", "Very High", "Unknown"]
BASKET_LABELS = ["Small", "Medium", "Large", "Very Large", "Unknown"]
TIME_OF_DAY_LABELS = ["Morning", "Afternoon", "Evening", "Night", "Unknown"]
GENDER_LABELS = ["F", "M", None]
SEASON_LABELS = ["Automne", "Hiver", "Printemps", "Été"]

#: Lines of orders that a task of the join with orders takes, and of the sums by customer
#: and part after it; customers that a task of their join with the sums takes.
JOIN_ROWS, PAIR_ROWS, CUSTOMER_ROWS = 1_000_000, 250_000, 50_000

CUSTOMER_COLUMNS = [
    "CustomerID", "Recency", "Frequency", "MonetaryTotal", "MonetaryAvg",
    "MonetaryStd", "MonetaryMin", "MonetaryMax", "CancelledTransactions",
    "TotalTransactions", "TotalQuantity", "UniqueProducts", "ReturnRatio",
    "CustomerTenureDays", "FirstPurchaseDaysAgo", "AvgDaysBetweenPurchases",
    "Age", "SupportTicketsCount", "SatisfactionScore", "NewsletterSubscribed",
    "RegistrationDate", "LastLoginIP", "AgeCategory", "SpendingCategory",
    "LoyaltyLevel", "ChurnRiskCategory", "BasketSizeCategory",
    "PreferredTimeOfDay", "CustomerType", "Country", "Region", "Gender",
    "FavoriteSeason", "Churn",
]
TEXT_COLUMNS = [
    "NewsletterSubscribed", "RegistrationDate", "LastLoginIP", "AgeCategory", "SpendingCategory",
    "LoyaltyLevel", "ChurnRiskCategory", "BasketSizeCategory", "PreferredTimeOfDay", "CustomerType",
    "Country", "Region", "Gender", "FavoriteSeason",
]
NUMERIC_COLUMNS = [c for c in CUSTOMER_COLUMNS if c not in TEXT_COLUMNS]


def _cycle(k: Column, labels: list) -> Column:
    m = k % len(labels)
    out = None
    for i, lab in enumerate(labels):
        val = F.lit(lab) if lab is not None else F.lit(None).cast("string")
        out = F.when(m == i, val) if out is None else out.when(m == i, val)
    return out


def _pad2(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _registration_date(k: Column) -> Column:
    y = 2010 + k % 13
    m = 1 + k % 12
    d = F.when(k % 5 == 2, 13 + k % 16).otherwise(1 + k % 28)
    ys = y.cast("string")
    return (F.when(k % 5 == 0, F.concat_ws("/", _pad2(d), _pad2(m), _pad2(y % 100)))
             .when(k % 5 == 1, F.concat_ws("-", ys, _pad2(m), _pad2(d)))
             .when(k % 5 == 2, F.concat_ws("/", _pad2(m), _pad2(d), ys))
             .when(k % 5 == 3, F.concat_ws("/", _pad2(d), _pad2(m), ys))
             .when(k % 10 == 9, F.lit("not a date")))


def _last_login_ip(k: Column) -> Column:
    s = lambda c: c.cast("string")
    dot = lambda *parts: F.concat_ws(".", *parts)
    m = k % 9
    return (F.when(m == 0, dot(F.lit("10"), s(k % 256), s(k % 7), F.lit("1")))
             .when(m == 1, dot(F.lit("192.168"), s(k % 256), s(k % 100)))
             .when(m == 2, dot(F.lit("172"), s(k % 40), F.lit("0"), s(k % 200 + 1)))
             .when(m == 3, F.lit("999.1.1.1"))
             .when(m == 4, F.lit("unknown"))
             .when(m == 6, F.lit("fe80::1"))
             .when(m == 7, dot(s((k * 7) % 223 + 1), s(k % 256), s(k % 100), s(k % 250)))
             .when(m == 8, dot(F.lit("8.8"), s(k % 256), s(k % 256))))


def customer_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per c_custkey with the reference's customer columns."""
    orders = (testdata(spark, sf_dir, "orders")
              .select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    lineitem = (testdata(spark, sf_dir, "lineitem")
                .select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"))
    customer = testdata(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = testdata(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = testdata(spark, sf_dir, "region").select("r_regionkey", "r_name")

    o = orders.select(
        "o_orderkey", "o_custkey",
        F.to_date("o_orderdate").alias("odate"),
        F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice"))
         .otherwise(F.col("o_totalprice")).alias("amount"))
    # the anchor is one scalar: a global aggregate read back as a literal
    anchor, n_owners = o.agg(F.max("odate"), F.approx_count_distinct("o_custkey")).first()

    oa = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("Frequency"),
        F.sum("amount").alias("MonetaryTotal"),
        F.avg("amount").alias("MonetaryAvg"),
        F.stddev_samp("amount").alias("MonetaryStd"),
        F.min("amount").alias("MonetaryMin"),
        F.max("amount").alias("MonetaryMax"),
        F.count_if(F.col("amount") < 0).cast("bigint").alias("CancelledTransactions"),
        F.min("odate").alias("first_d"),
        F.max("odate").alias("last_d"))

    lines, owners = lineitem, orders.select("o_orderkey", "o_custkey")
    n_lines = lineitem.count()
    parts = math.ceil(n_lines / JOIN_ROWS)
    if parts > 1:  # a task's sort and hash table stay as they are when the tables grow
        lines, owners = lines.repartition(parts, "l_orderkey"), owners.repartition(parts, "o_orderkey")
    bought = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("k"), "l_partkey", "l_quantity", "l_returnflag")
    if parts > 1:  # by both: a customer of many lines is spread over tasks
        bought = bought.repartition(math.ceil(n_lines / PAIR_ROWS), "k", "l_partkey")
    la = bought.groupBy("k").agg(
        F.count(F.lit(1)).alias("TotalTransactions"),
        F.sum("l_quantity").alias("TotalQuantity"),
        F.countDistinct("l_partkey").alias("UniqueProducts"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double")
         .alias("ReturnRatio"))

    geo = (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    c = (customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
         .select(F.col("c_custkey").alias("k"), "c_mktsegment", "n_name", "r_name"))

    shares = math.ceil(max(customer.count(), n_owners) / CUSTOMER_ROWS)
    if shares > 1:  # the sums are one row a customer: a task's sorts stay as they are when the tables grow
        c, oa, la = (t.repartition(shares, "k") for t in (c, oa, la))
    j = c.join(oa, "k", "left").join(la, "k", "left")
    k = F.col("k")
    a = F.lit(anchor)
    recency = (F.datediff(a, F.col("last_d")) + 1).cast("bigint")
    tenure = F.datediff(F.col("last_d"), F.col("first_d")).cast("bigint")
    out = j.select(
        k.alias("CustomerID"),
        recency.alias("Recency"),
        "Frequency", "MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin",
        "MonetaryMax", "CancelledTransactions", "TotalTransactions", "TotalQuantity",
        "UniqueProducts", "ReturnRatio",
        tenure.alias("CustomerTenureDays"),
        (F.datediff(a, F.col("first_d")) + 1).cast("bigint").alias("FirstPurchaseDaysAgo"),
        F.try_divide(tenure, F.when(F.col("Frequency") != 1, F.col("Frequency") - 1))
         .cast("double").alias("AvgDaysBetweenPurchases"),
        F.when(k % 10 >= 3, 18 + k % 63).cast("bigint").alias("Age"),
        F.when(k % 29 == 0, -1).when(k % 31 == 0, 999).otherwise(k % 16)
         .cast("bigint").alias("SupportTicketsCount"),
        F.when(k % 37 == 0, -1).when(k % 41 == 0, 99).otherwise(1 + k % 5)
         .cast("bigint").alias("SatisfactionScore"),
        F.lit("Yes").alias("NewsletterSubscribed"),
        _registration_date(k).alias("RegistrationDate"),
        _last_login_ip(k).alias("LastLoginIP"),
        _cycle(k, AGE_LABELS).alias("AgeCategory"),
        _cycle(k, SPENDING_LABELS).alias("SpendingCategory"),
        _cycle(k, LOYALTY_LABELS).alias("LoyaltyLevel"),
        _cycle(k, CHURN_RISK_LABELS).alias("ChurnRiskCategory"),
        _cycle(k, BASKET_LABELS).alias("BasketSizeCategory"),
        _cycle(k, TIME_OF_DAY_LABELS).alias("PreferredTimeOfDay"),
        F.col("c_mktsegment").alias("CustomerType"),
        F.col("n_name").alias("Country"),
        F.col("r_name").alias("Region"),
        _cycle(k, GENDER_LABELS).alias("Gender"),
        _cycle(k, SEASON_LABELS).alias("FavoriteSeason"),
        F.when(recency > 250, 1).otherwise(0).cast("bigint").alias("Churn"),
    )
    return out


# ---------------------------------------------------------------------------
# DuckDB twin.  ``sql_with(names, body)`` prepends the CTEs a query needs.
# ---------------------------------------------------------------------------

def _sql_cycle(labels: list) -> str:
    parts = []
    for i, lab in enumerate(labels):
        v = "NULL" if lab is None else "'" + lab.replace("'", "''") + "'"
        parts.append(f"WHEN {i} THEN {v}")
    return f"CASE k % {len(labels)} " + " ".join(parts) + " END"


_CUST_SQL = f"""
cl_orders AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS odate,
         CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount
  FROM orders),
cl_anchor AS (SELECT max(odate) AS anchor FROM cl_orders),
cl_oa AS (
  SELECT o_custkey AS k, count(*) AS Frequency, sum(amount) AS MonetaryTotal,
         avg(amount) AS MonetaryAvg, stddev_samp(amount) AS MonetaryStd,
         min(amount) AS MonetaryMin, max(amount) AS MonetaryMax,
         CAST(count_if(amount < 0) AS BIGINT) AS CancelledTransactions,
         min(odate) AS first_d, max(odate) AS last_d
  FROM cl_orders GROUP BY o_custkey),
cl_la AS (
  SELECT o.o_custkey AS k, count(*) AS TotalTransactions, sum(l.l_quantity) AS TotalQuantity,
         count(DISTINCT l.l_partkey) AS UniqueProducts,
         CAST(avg(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS ReturnRatio
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey),
cl_base AS (
  SELECT c.c_custkey AS k, c.c_mktsegment, n.n_name, r.r_name, oa.*, la.TotalTransactions,
         la.TotalQuantity, la.UniqueProducts, la.ReturnRatio, a.anchor
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN cl_oa oa ON oa.k = c.c_custkey
  LEFT JOIN cl_la la ON la.k = c.c_custkey
  CROSS JOIN cl_anchor a),
cust AS (
  SELECT k AS CustomerID,
    CAST(date_diff('day', last_d, anchor) + 1 AS BIGINT) AS Recency,
    Frequency, MonetaryTotal, MonetaryAvg, MonetaryStd, MonetaryMin, MonetaryMax,
    CancelledTransactions, TotalTransactions, TotalQuantity, UniqueProducts, ReturnRatio,
    CAST(date_diff('day', first_d, last_d) AS BIGINT) AS CustomerTenureDays,
    CAST(date_diff('day', first_d, anchor) + 1 AS BIGINT) AS FirstPurchaseDaysAgo,
    CAST(date_diff('day', first_d, last_d) / NULLIF(Frequency - 1, 0) AS DOUBLE) AS AvgDaysBetweenPurchases,
    CAST(CASE WHEN k % 10 >= 3 THEN 18 + k % 63 END AS BIGINT) AS Age,
    CAST(CASE WHEN k % 29 = 0 THEN -1 WHEN k % 31 = 0 THEN 999 ELSE k % 16 END AS BIGINT) AS SupportTicketsCount,
    CAST(CASE WHEN k % 37 = 0 THEN -1 WHEN k % 41 = 0 THEN 99 ELSE 1 + k % 5 END AS BIGINT) AS SatisfactionScore,
    'Yes' AS NewsletterSubscribed,
    CASE k % 5
      WHEN 0 THEN lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || '/' ||
                  lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '/' || lpad(CAST((2010 + k % 13) % 100 AS VARCHAR), 2, '0')
      WHEN 1 THEN CAST(2010 + k % 13 AS VARCHAR) || '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '-' ||
                  lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0')
      WHEN 2 THEN lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '/' || lpad(CAST(13 + k % 16 AS VARCHAR), 2, '0') || '/' ||
                  CAST(2010 + k % 13 AS VARCHAR)
      WHEN 3 THEN lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '/' ||
                  CAST(2010 + k % 13 AS VARCHAR)
      ELSE CASE WHEN k % 10 = 9 THEN 'not a date' END
    END AS RegistrationDate,
    CASE k % 9
      WHEN 0 THEN '10.' || CAST(k % 256 AS VARCHAR) || '.' || CAST(k % 7 AS VARCHAR) || '.1'
      WHEN 1 THEN '192.168.' || CAST(k % 256 AS VARCHAR) || '.' || CAST(k % 100 AS VARCHAR)
      WHEN 2 THEN '172.' || CAST(k % 40 AS VARCHAR) || '.0.' || CAST(k % 200 + 1 AS VARCHAR)
      WHEN 3 THEN '999.1.1.1'
      WHEN 4 THEN 'unknown'
      WHEN 6 THEN 'fe80::1'
      WHEN 7 THEN CAST((k * 7) % 223 + 1 AS VARCHAR) || '.' || CAST(k % 256 AS VARCHAR) || '.' ||
                  CAST(k % 100 AS VARCHAR) || '.' || CAST(k % 250 AS VARCHAR)
      WHEN 8 THEN '8.8.' || CAST(k % 256 AS VARCHAR) || '.' || CAST(k % 256 AS VARCHAR)
    END AS LastLoginIP,
    {_sql_cycle(AGE_LABELS)} AS AgeCategory,
    {_sql_cycle(SPENDING_LABELS)} AS SpendingCategory,
    {_sql_cycle(LOYALTY_LABELS)} AS LoyaltyLevel,
    {_sql_cycle(CHURN_RISK_LABELS)} AS ChurnRiskCategory,
    {_sql_cycle(BASKET_LABELS)} AS BasketSizeCategory,
    {_sql_cycle(TIME_OF_DAY_LABELS)} AS PreferredTimeOfDay,
    c_mktsegment AS CustomerType, n_name AS Country, r_name AS Region,
    {_sql_cycle(GENDER_LABELS)} AS Gender,
    {_sql_cycle(SEASON_LABELS)} AS FavoriteSeason,
    CAST(CASE WHEN date_diff('day', last_d, anchor) + 1 > 250 THEN 1 ELSE 0 END AS BIGINT) AS Churn
  FROM cl_base)"""

SQL_CTES: dict[str, str] = {"cust": _CUST_SQL}
SQL_DEPS: dict[str, list[str]] = {"cust": []}


def register_cte(name: str, sql: str, deps: list[str]) -> None:
    SQL_CTES[name] = sql
    SQL_DEPS[name] = deps


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in SQL_DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def sql_with(names: list[str], body: str, extra: str = "") -> str:
    """``WITH <needed CTEs>[, extra] <body>`` for the DuckDB oracle."""
    ctes = [SQL_CTES[n].strip() for n in _closure(names)]
    if extra.strip():
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body
