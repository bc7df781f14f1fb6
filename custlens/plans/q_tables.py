"""Registered queries: sources/sinks (S) and projection/schema (P)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions.scalars import round_even as _re

from custlens.functions import scalars as S
from custlens.operators import schema as P
from custlens.operators import features as M
from custlens.plans.catalog import customers, processed, rd, register
from custlens.plans.fixture import CUSTOMER_COLUMNS, sql_with
from custlens.plans.sqlgen import PROC_COLUMNS, qi, sel_rounded
from custlens.session import scratch_path
from custlens.sources import io

CUST_D = {"MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin", "MonetaryMax",
          "TotalQuantity", "ReturnRatio", "AvgDaysBetweenPurchases"}
PROC_D = CUST_D | {"AvgBasketValue", "Country_encoded"}


def _cust_sql(cols=None, exclude=()) -> str:
    cols = [c for c in (cols or CUSTOMER_COLUMNS) if c not in exclude]
    return sel_rounded(cols, CUST_D)


def _proc_sql(cols=None, exclude=(), rename=None) -> str:
    cols = [c for c in (cols or PROC_COLUMNS) if c not in exclude]
    return sel_rounded(cols, PROC_D, rename)


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


# --- S ---------------------------------------------------------------------------

@register("s01_csv_source", sql_with(["cust"], f"SELECT {_cust_sql()} FROM cust"))
def q_s01(spark: SparkSession, sf: str) -> DataFrame:
    """Customer table written as CSV with a header, read back with an explicit schema."""
    cust = customers(spark, sf)
    path = _scratch(spark, "s01.csv")
    io.write_table(cust, path, fmt="csv")
    return rd(io.read_table(spark, path, schema=cust.schema, fmt="csv"))


@register("s02_schema_peek", """SELECT CAST(ordinal_position AS BIGINT) AS ordinal, column_name
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def q_s02(spark: SparkSession, sf: str) -> DataFrame:
    cols = io.table_columns(spark, f"{sf}/lineitem.parquet")
    return P.name_pattern_frame(spark, cols)


@register("s03_label_vector", sql_with(["cust"], "SELECT CustomerID, Churn FROM cust"))
def q_s03(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark, "s03.csv")
    io.write_table(customers(spark, sf).select("CustomerID", "Churn"), path, fmt="csv")
    return io.read_table(spark, path, schema="CustomerID long, Churn long", fmt="csv")


@register("s04_table_sink", sql_with(["proc"], f"SELECT {_proc_sql()} FROM proc"))
def q_s04(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark, "s04")
    io.write_table(processed(spark, sf), path)
    return rd(io.read_table(spark, path))


_S05_COLS = ["CustomerID", "Churn", "MonetaryTotal", "Recency", "Frequency", "Age"]


@register("s05_load_or_build", sql_with(["proc"], f"SELECT {_proc_sql(_S05_COLS)} FROM proc"))
def q_s05(spark: SparkSession, sf: str) -> DataFrame:
    """On one path: the first call builds and writes, the second needs a column
    that the stored table lacks and rebuilds, the third reuses the table."""
    path = _scratch(spark, "s05")
    build = lambda: processed(spark, sf).select("CustomerID", "Churn", "MonetaryTotal", "Recency")
    io.load_or_build_features(spark, path, build, ["CustomerID", "Churn"])
    full = lambda: processed(spark, sf)
    io.load_or_build_features(spark, path, full, _S05_COLS)

    def never() -> DataFrame:
        raise AssertionError("the stored table has every column")

    return rd(io.load_or_build_features(spark, path, never, _S05_COLS))


@register("s06_artefact_store", sql_with(["proc"], """
SELECT feature, round_even(center, 6) AS center, round_even(scale, 6) AS scale FROM (
  SELECT 'Recency' AS feature, avg(Recency) AS center, stddev_pop(Recency) AS scale FROM proc
  UNION ALL SELECT 'MonetaryTotal', avg(MonetaryTotal), stddev_pop(MonetaryTotal) FROM proc
  UNION ALL SELECT 'Frequency', avg(Frequency), stddev_pop(Frequency) FROM proc)"""))
def q_s06(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted scaler parameters saved as a Parquet table and loaded back."""
    fit = M.standard_fit(processed(spark, sf), ["Recency", "MonetaryTotal", "Frequency"])
    d = _scratch(spark, "s06")
    io.save_artefacts(spark, d, {"scaler": fit.to_frame(spark)},
                      meta={"features": ["Recency", "MonetaryTotal", "Frequency"]})
    params, _, meta = io.load_artefacts(spark, d, ["scaler"])
    back = M.ColumnAffine.from_frame(params["scaler"])
    assert meta["features"] == ["Recency", "MonetaryTotal", "Frequency"]
    return rd(back.to_frame(spark))


@register("s07_records_to_df", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_s07(spark: SparkSession, sf: str) -> DataFrame:
    ev = io.testdata(spark, sf, "events").select("event_id", F.col("props").alias("value"))
    return io.records_to_df(ev, "k long", keep=["event_id"])


# --- P ---------------------------------------------------------------------------

_TYPE_SQL = ("CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'HUGEINT') THEN 'int64' "
             "WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float64' WHEN column_type = 'BOOLEAN' THEN 'bool' "
             "ELSE 'object' END")


@register("p01_numeric_columns", sql_with(["cust"], f"""
SELECT CAST(row_number() OVER () AS BIGINT) AS ordinal, column_name
FROM (DESCRIBE SELECT * FROM cust) WHERE {_TYPE_SQL} IN ('int64', 'float64')"""))
def q_p01(spark: SparkSession, sf: str) -> DataFrame:
    return P.name_pattern_frame(spark, P.numeric_columns(customers(spark, sf)))


def _distinct_union(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {qi(c)}) AS BIGINT) AS n_unique FROM {src}"
                              for c in cols)


_CUST_STR = ["NewsletterSubscribed", "RegistrationDate", "LastLoginIP", "AgeCategory", "SpendingCategory",
             "LoyaltyLevel", "ChurnRiskCategory", "BasketSizeCategory", "PreferredTimeOfDay", "CustomerType",
             "Country", "Region", "Gender", "FavoriteSeason"]


@register("p02_categorical_profile", sql_with(["cust"], _distinct_union(_CUST_STR, "cust")))
def q_p02(spark: SparkSession, sf: str) -> DataFrame:
    return P.categorical_profile(customers(spark, sf))


@register("p03_safe_drop", sql_with(["cust"], f"SELECT {_cust_sql(exclude=['MonetaryStd'])} FROM cust"))
def q_p03(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.safe_drop(customers(spark, sf), ["MonetaryStd", "NotAColumn"]))


_P04_DROP = [c for c in CUSTOMER_COLUMNS if "Monetary" in c or "Tenure" in c]


@register("p04_drop_matching", sql_with(["cust"], f"SELECT {_cust_sql(exclude=_P04_DROP)} FROM cust"))
def q_p04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.drop_matching(customers(spark, sf), ["Monetary", "Tenure"]))


@register("p05_find_columns", sql_with(["cust"], """
SELECT CAST(row_number() OVER () AS BIGINT) AS ordinal, column_name FROM (DESCRIBE SELECT * FROM cust)
WHERE lower(column_name) LIKE '%ticket%' OR lower(column_name) LIKE '%support%'
   OR (lower(column_name) LIKE '%return%' AND lower(column_name) LIKE '%ratio%')"""))
def q_p05(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    hits = [x for x in c.columns if x in P.find_columns(c, any_of=["ticket", "support"])
            or x in P.find_columns(c, all_of=["return", "ratio"])]
    return P.name_pattern_frame(spark, hits)


@register("p06_clean_names", sql_with(["proc"], f"SELECT {_proc_sql(rename={'Region_MIDDLE EAST': 'Region_MIDDLE_EAST'})} FROM proc"))
def q_p06(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.clean_names(processed(spark, sf)))


@register("p07_drop_leaky_churn", sql_with(["proc"], f"""SELECT {_proc_sql(exclude=[
    c for c in PROC_COLUMNS if c in P.LEAKY_CHURN_FEATURES or c in ('Churn', 'CustomerID')])} FROM proc"""))
def q_p07(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.drop_leaky(processed(spark, sf), "churn"))


@register("p08_drop_leaky_cluster", sql_with(["proc"], f"""SELECT {_proc_sql(exclude=[
    c for c in PROC_COLUMNS if c in P.LEAKY_CLUSTERING_FEATURES])} FROM proc"""))
def q_p08(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.drop_leaky(processed(spark, sf), "cluster"))


@register("p09_drop_redundant", sql_with(["proc"], f"""SELECT {_proc_sql(exclude=[
    c for c in PROC_COLUMNS if c in P.REDUNDANT_COLUMNS])} FROM proc"""))
def q_p09(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.drop_redundant(processed(spark, sf)))


@register("p10_drop_constant", sql_with(["cust"], f"SELECT {_cust_sql(exclude=['NewsletterSubscribed'])} FROM cust"))
def q_p10(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.drop_constant_columns(customers(spark, sf))[0])


@register("p11_null_sentinels", sql_with(["cust"], """SELECT CustomerID,
  CASE WHEN SupportTicketsCount IN (-1, 999) THEN NULL ELSE SupportTicketsCount END AS SupportTicketsCount,
  CASE WHEN SatisfactionScore IN (-1, 99) THEN NULL ELSE SatisfactionScore END AS SatisfactionScore FROM cust"""))
def q_p11(spark: SparkSession, sf: str) -> DataFrame:
    return P.null_sentinels(customers(spark, sf).select("CustomerID", "SupportTicketsCount", "SatisfactionScore"),
                            M.SENTINELS)


@register("p12_filter_positive", sql_with(["proc"], """SELECT
  CAST(count_if(MonetaryTotal > 0) AS BIGINT) AS n_kept,
  CAST(count_if(NOT (MonetaryTotal > 0) OR MonetaryTotal IS NULL) AS BIGINT) AS n_removed,
  round_even(sum(CASE WHEN MonetaryTotal > 0 THEN MonetaryTotal END), 4) AS kept_total FROM proc"""))
def q_p12(spark: SparkSession, sf: str) -> DataFrame:
    kept, counts = P.filter_positive(processed(spark, sf))
    total = kept.agg(_re(F.sum("MonetaryTotal"), 4)).first()[0]
    return counts.withColumn("kept_total", F.lit(total))


_ALIGN = ["CustomerID", "Age", "MonetaryStd", "NotInTable", "Churn"]


@register("p13_align_fill0", sql_with(["proc"], """SELECT CustomerID, coalesce(Age, 0) AS Age,
  round_even(coalesce(MonetaryStd, 0), 6) AS MonetaryStd, CAST(0 AS DOUBLE) AS NotInTable, Churn FROM proc"""))
def q_p13(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.align_schema(processed(spark, sf), _ALIGN, fill=0))


@register("p14_align_keep_null", sql_with(["proc"], """SELECT CustomerID, Age,
  round_even(MonetaryStd, 6) AS MonetaryStd, CAST(NULL AS DOUBLE) AS NotInTable, Churn FROM proc"""))
def q_p14(spark: SparkSession, sf: str) -> DataFrame:
    return rd(P.align_schema(processed(spark, sf), _ALIGN, fill=None))


@register("p15_to_numeric", sql_with(["cust"], """SELECT CustomerID, TRY_CAST(Age AS DOUBLE) AS Age,
  TRY_CAST(LastLoginIP AS DOUBLE) AS LastLoginIP, TRY_CAST(RegistrationDate AS DOUBLE) AS RegistrationDate,
  TRY_CAST(Gender AS DOUBLE) AS Gender FROM cust"""))
def q_p15(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", "Age", "LastLoginIP", "RegistrationDate", "Gender")
    return P.to_numeric(c, exempt=["CustomerID"])


@register("p16_union_aligned", sql_with(["cust", "proc"], """
SELECT CustomerID, round_even(MonetaryTotal, 6) AS MonetaryTotal, Churn FROM proc WHERE Churn = 1
UNION ALL BY NAME SELECT CustomerID, Region FROM cust WHERE Churn = 0"""))
def q_p16(spark: SparkSession, sf: str) -> DataFrame:
    a = rd(processed(spark, sf).where("Churn = 1").select("CustomerID", "MonetaryTotal", "Churn"))
    b = customers(spark, sf).where("Churn = 0").select("CustomerID", "Region")
    return P.union_aligned(a, b)


@register("p17_top_n_abs", sql_with(["cust"], """SELECT CustomerID, round_even(MonetaryTotal, 6) AS MonetaryTotal
FROM cust ORDER BY abs(MonetaryTotal) DESC, CustomerID LIMIT 10"""))
def q_p17(spark: SparkSession, sf: str) -> DataFrame:
    """A top-10 report: the limit is the feature."""
    return rd(P.top_n(customers(spark, sf).select("CustomerID", "MonetaryTotal"), 10, "MonetaryTotal",
                      by_abs=True, tiebreak=["CustomerID"]))


@register("p18_sample_n", sql_with(["cust"], """SELECT CustomerID, Region, Churn FROM cust
ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID LIMIT 10"""))
def q_p18(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: exactly n rows is the feature."""
    return P.sample_n(customers(spark, sf), 10, 42, "CustomerID").select("CustomerID", "Region", "Churn")


@register("p19_first_distinct", sql_with(["cust"], """SELECT DISTINCT RegistrationDate FROM cust
ORDER BY RegistrationDate NULLS FIRST LIMIT 30"""))
def q_p19(spark: SparkSession, sf: str) -> DataFrame:
    return P.first_distinct(customers(spark, sf), "RegistrationDate", 30)


def _schema_profile_sql() -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count({qi(c)}) AS BIGINT) AS non_null, CAST(count(*) AS BIGINT) AS n FROM cust"
        for c in CUSTOMER_COLUMNS)
    return sql_with(["cust"], f"""
SELECT CAST(d.rn AS BIGINT) AS ordinal, d.column_name, d.data_type, c.non_null,
  c.n - c.non_null AS null_count, round_even((c.n - c.non_null) * CAST(100 AS DOUBLE) / c.n, 2) AS null_pct
FROM (SELECT row_number() OVER () AS rn, column_name, {_TYPE_SQL} AS data_type FROM (DESCRIBE SELECT * FROM cust)) d
JOIN ({counts}) c ON c.column_name = d.column_name""")


@register("p20_schema_profile", _schema_profile_sql())
def q_p20(spark: SparkSession, sf: str) -> DataFrame:
    from custlens.operators.profile import pandas_dtype
    c = customers(spark, sf)
    prof = P.schema_profile(c)
    types = {f.name: pandas_dtype(f.dataType) for f in c.schema.fields}
    m = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return prof.withColumn("data_type", F.element_at(m, F.col("column_name")))


# keep scalar helpers importable for tests
__all__ = ["S"]
