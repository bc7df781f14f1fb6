"""Registered queries: aggregation and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.operators import profile as A
from custlens.operators.sampling import stratified_split
from custlens.plans.catalog import customers, processed, rd, register, scaled_cached
from custlens.operators.schema import numeric_columns
from custlens.plans.fixture import CUSTOMER_COLUMNS, NUMERIC_COLUMNS, sql_with
from custlens.plans.sqlgen import PROC_COLUMNS, qi

R6 = "round_even({}, 6)"


def r6(e: str) -> str:
    return R6.format(e)


@register("a01_value_counts", sql_with(["cust"], f"""SELECT Region AS value, CAST(count(*) AS BIGINT) AS n_rows,
  {r6("count(*) * CAST(100 AS DOUBLE) / (SELECT count(Region) FROM cust)")} AS pct FROM cust WHERE Region IS NOT NULL GROUP BY Region"""))
def q_a01(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(customers(spark, sf), "Region")


@register("a02_value_counts_by_value", sql_with(["cust"], f"""SELECT SatisfactionScore AS value, CAST(count(*) AS BIGINT) AS n_rows,
  {r6("count(*) * CAST(100 AS DOUBLE) / (SELECT count(SatisfactionScore) FROM cust)")} AS pct FROM cust
  WHERE SatisfactionScore IS NOT NULL GROUP BY SatisfactionScore ORDER BY SatisfactionScore"""))
def q_a02(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(customers(spark, sf), "SatisfactionScore").orderBy("value")


@register("a03_special_counts", sql_with(["cust"], f"""SELECT v AS value, CAST(n AS BIGINT) AS n_rows,
  {r6("n * CAST(100 AS DOUBLE) / t")} AS pct FROM (
  SELECT CAST(-1 AS BIGINT) AS v, count_if(SupportTicketsCount = -1) AS n, count(*) AS t FROM cust
  UNION ALL SELECT CAST(999 AS BIGINT), count_if(SupportTicketsCount = 999), count(*) FROM cust)"""))
def q_a03(spark: SparkSession, sf: str) -> DataFrame:
    return A.special_counts(customers(spark, sf), "SupportTicketsCount", [-1, 999])


_A04 = ["Recency", "Frequency", "MonetaryTotal", "Age"]


@register("a04_profile_by", sql_with(["cust"], "SELECT Churn, " + ", ".join(
    f"{r6(f'avg({c})')} AS {c}" for c in _A04) + " FROM cust GROUP BY Churn"))
def q_a04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.profile_by(customers(spark, sf), "Churn", _A04))


@register("a05_sizes_by", sql_with(["cust"], f"""SELECT CustomerType, CAST(count(*) AS BIGINT) AS n_rows,
  {r6("count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM cust)")} AS pct FROM cust GROUP BY CustomerType"""))
def q_a05(spark: SparkSession, sf: str) -> DataFrame:
    return A.sizes_by(customers(spark, sf), "CustomerType")


@register("a06_crosstab", sql_with(["cust"], """SELECT Region, CAST(count_if(Churn = 0) AS BIGINT) AS Churn_0,
  CAST(count_if(Churn = 1) AS BIGINT) AS Churn_1 FROM cust WHERE Region IS NOT NULL GROUP BY Region"""))
def q_a06(spark: SparkSession, sf: str) -> DataFrame:
    return A.crosstab(customers(spark, sf), "Region", "Churn", [0, 1])


@register("a07_crosstab_pct", sql_with(["cust"], f"""SELECT Gender,
  {r6("count_if(Churn = 0) * CAST(100 AS DOUBLE) / count(*)")} AS Churn_0,
  {r6("count_if(Churn = 1) * CAST(100 AS DOUBLE) / count(*)")} AS Churn_1
  FROM cust WHERE Gender IS NOT NULL GROUP BY Gender"""))
def q_a07(spark: SparkSession, sf: str) -> DataFrame:
    return A.crosstab_pct(customers(spark, sf), "Gender", "Churn", [0, 1])


def _describe_sql(cols: list[str], src: str) -> str:
    parts = [f"""SELECT '{c}' AS feature, CAST(count({qi(c)}) AS BIGINT) AS count, {r6(f'avg({qi(c)})')} AS mean,
  {r6(f'stddev_samp({qi(c)})')} AS std, {r6(f'CAST(min({qi(c)}) AS DOUBLE)')} AS min,
  {r6(f'quantile_cont({qi(c)}, 0.25)')} AS p25, {r6(f'quantile_cont({qi(c)}, 0.5)')} AS p50,
  {r6(f'quantile_cont({qi(c)}, 0.75)')} AS p75, {r6(f'CAST(max({qi(c)}) AS DOUBLE)')} AS max FROM {src}""" for c in cols]
    return " UNION ALL ".join(parts)


@register("a08_describe", sql_with(["cust"], _describe_sql(NUMERIC_COLUMNS, "cust")))
def q_a08(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return rd(A.describe_exact(c, numeric_columns(c)))


_PS = [0.01, 0.25, 0.5, 0.75, 0.99]


@register("a09_quantiles", sql_with(["cust"], " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({p} AS DOUBLE) AS p, {r6(f'quantile_cont({c}, {p})')} AS value FROM cust"
    for c in NUMERIC_COLUMNS for p in _PS)))
def q_a09(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return rd(A.quantiles(c, numeric_columns(c), _PS))


def _iqr_sql() -> str:
    parts = []
    for c in NUMERIC_COLUMNS:
        parts.append(f"""SELECT '{c}' AS feature, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
  (SELECT count_if({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) FROM cust) AS n,
  (SELECT count(*) FROM cust) AS t
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM cust) b""")
    body = " UNION ALL ".join(parts)
    return sql_with(["cust"], f"""SELECT feature, round_even(q1, 3) AS q1, round_even(q3, 3) AS q3, round_even(iqr, 3) AS iqr,
  round_even(lo, 3) AS lower_bound, round_even(hi, 3) AS upper_bound, CAST(n AS BIGINT) AS n_outliers,
  round_even(n * CAST(100 AS DOUBLE) / t, 2) AS outlier_pct FROM ({body})""")


@register("a10_iqr_outliers", _iqr_sql())
def q_a10(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return A.iqr_outliers(c, numeric_columns(c))


def _null_union(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({qi(c)} IS NULL) AS n_missing, count(*) AS n FROM {src}"
                              for c in cols)


@register("a11_missing_report", sql_with(["cust"], f"""SELECT column_name, CAST(n_missing AS BIGINT) AS n_missing,
  round_even(n_missing * CAST(100 AS DOUBLE) / n, 2) AS pct_missing FROM ({_null_union(CUSTOMER_COLUMNS, 'cust')})
  WHERE n_missing > 0"""))
def q_a11(spark: SparkSession, sf: str) -> DataFrame:
    return A.missing_report(customers(spark, sf))


def _proc_cols_sql():
    from custlens.plans.sqlgen import PROC_COLUMNS
    return PROC_COLUMNS


@register("a12_null_total", sql_with(["proc"], f"""SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing
  FROM ({_null_union(_proc_cols_sql(), 'proc')})"""))
def q_a12(spark: SparkSession, sf: str) -> DataFrame:
    return A.null_total(processed(spark, sf))


@register("a13_nulls_by", sql_with(["cust"], """SELECT Churn, CAST(count_if(Age IS NULL) AS BIGINT) AS n_missing
  FROM cust GROUP BY Churn"""))
def q_a13(spark: SparkSession, sf: str) -> DataFrame:
    return A.nulls_by(customers(spark, sf), "Churn", "Age")


@register("a14_dtype_counts", sql_with(["cust"], """SELECT dtype, CAST(count(*) AS BIGINT) AS n_columns FROM (
  SELECT CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'HUGEINT') THEN 'int64'
    WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float64' WHEN column_type = 'BOOLEAN' THEN 'bool' ELSE 'object' END AS dtype
  FROM (DESCRIBE SELECT * FROM cust)) GROUP BY dtype"""))
def q_a14(spark: SparkSession, sf: str) -> DataFrame:
    return A.dtype_counts(customers(spark, sf))


_MON = ["MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin", "MonetaryMax"]


@register("a15_numeric_summary", sql_with(["cust"], " UNION ALL ".join(f"""SELECT '{c}' AS feature,
  {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max, {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.5)')} AS median,
  {r6(f'stddev_samp({c})')} AS std, {r6(f'count_if({c} < 0) * CAST(100 AS DOUBLE) / count(*)')} AS negative_pct,
  {r6(f'count_if({c} = 0) * CAST(100 AS DOUBLE) / count(*)')} AS zero_pct FROM cust""" for c in _MON)))
def q_a15(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.numeric_summary(customers(spark, sf), _MON))


_A16 = _MON + ["TotalQuantity", "Recency", "AvgDaysBetweenPurchases"]


@register("a16_negative_audit", sql_with(["cust"], "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT '{c}' AS feature,
  CAST(count_if({c} < 0) AS BIGINT) AS n_negative, {r6(f'count_if({c} < 0) * CAST(100 AS DOUBLE) / count(*)')} AS negative_pct,
  {r6(f'CAST(min({c}) AS DOUBLE)')} AS min, {r6(f'CAST(max({c}) AS DOUBLE)')} AS max, {r6(f'avg({c})')} AS mean FROM cust"""
    for c in _A16) + ") WHERE n_negative > 0"))
def q_a16(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.negative_audit(customers(spark, sf), _A16))


@register("a17_rate_comparison", sql_with(["cust"], f"""SELECT CAST(count_if(MonetaryTotal < 0) AS BIGINT) AS n_subgroup,
  {r6("avg(CASE WHEN MonetaryTotal < 0 THEN CAST(Churn AS DOUBLE) END)")} AS subgroup_rate,
  {r6("avg(CAST(Churn AS DOUBLE))")} AS overall_rate FROM cust"""))
def q_a17(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.rate_comparison(customers(spark, sf), F.col("MonetaryTotal") < 0))


def _corr_sql(cols: list[str], src: str, upper_only: bool, threshold: float | None = None) -> str:
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if (i < j if upper_only else True)]
    aggs = ", ".join(f"corr(CAST({qi(cols[min(i, j)])} AS DOUBLE), CAST({qi(cols[max(i, j)])} AS DOUBLE)) AS r_{i}_{j}"
                     for i, j in pairs)
    structs = ", ".join(f"{{'feature_1': '{cols[i]}', 'feature_2': '{cols[j]}', 'corr': r_{i}_{j}}}" for i, j in pairs)
    body = f"SELECT unnest([{structs}], recursive := true) FROM (SELECT {aggs} FROM {src})"
    where = f" WHERE abs(corr) > {threshold}" if threshold is not None else ""
    return f"SELECT feature_1, feature_2, {r6('CASE WHEN isnan(corr) THEN NULL ELSE corr END')} AS corr FROM ({body}){where}"


@register("a18_corr_matrix", sql_with(["cust"], _corr_sql(NUMERIC_COLUMNS, "cust", False)))
def q_a18(spark: SparkSession, sf: str) -> DataFrame:
    """All numeric columns."""
    c = customers(spark, sf)
    return rd(A.corr_matrix(c, numeric_columns(c)))


@register("a19_high_corr_pairs", sql_with(["proc"], _corr_sql(PROC_COLUMNS, "proc", True, 0.8)))
def q_a19(spark: SparkSession, sf: str) -> DataFrame:
    """All numeric columns of the processed table, which has no others."""
    p = processed(spark, sf)
    return rd(A.high_corr_pairs(p, numeric_columns(p), 0.8))


@register("a20_distinct_counts", sql_with(["cust"], " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {qi(c)}) AS BIGINT) AS n_unique FROM cust" for c in CUSTOMER_COLUMNS)))
def q_a20(spark: SparkSession, sf: str) -> DataFrame:
    return A.distinct_counts(customers(spark, sf))


def _near_constant_sql() -> str:
    vc = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({qi(c)} AS VARCHAR) AS v FROM cust WHERE {qi(c)} IS NOT NULL"
                            for c in CUSTOMER_COLUMNS)
    return sql_with(["cust"], f"""SELECT column_name, CAST(n_unique AS BIGINT) AS n_unique, top_value,
  {r6("top_count * CAST(100 AS DOUBLE) / (SELECT count(*) FROM cust)")} AS top_pct FROM (
  SELECT column_name, count(*) AS n_unique, arg_min(v, (-c, v)) AS top_value, max(c) AS top_count FROM (
    SELECT column_name, v, count(*) AS c FROM ({vc}) GROUP BY column_name, v) GROUP BY column_name)
  WHERE n_unique <= 1 OR n_unique < 0.01 * (SELECT count(*) FROM cust)""")


@register("a21_near_constant", _near_constant_sql())
def q_a21(spark: SparkSession, sf: str) -> DataFrame:
    return A.near_constant(customers(spark, sf))


@register("a22_target_encode", sql_with(["cust"], f"""SELECT CustomerID,
  {r6("avg(CAST(Churn AS DOUBLE)) OVER (PARTITION BY Country)")} AS Country_encoded FROM cust"""))
def q_a22(spark: SparkSession, sf: str) -> DataFrame:
    from custlens.functions.scalars import target_encode
    return rd(target_encode(customers(spark, sf).select("CustomerID", "Country", "Churn"), "Country", "Churn")
              .select("CustomerID", "Country_encoded"))


def _hist_sql() -> str:
    return sql_with(["cust"], f"""SELECT i.bin, {r6("m.lo + i.bin * m.w")} AS bin_start, {r6("m.lo + (i.bin + 1) * m.w")} AS bin_end,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(30)) i
CROSS JOIN (SELECT CAST(min(Recency) AS DOUBLE) AS lo, (CAST(max(Recency) AS DOUBLE) - CAST(min(Recency) AS DOUBLE)) / 30 AS w FROM cust) m
LEFT JOIN (SELECT b, count(*) AS n FROM (SELECT CAST(least(floor((CAST(Recency AS DOUBLE) - m2.lo) / m2.w), 29) AS BIGINT) AS b
    FROM cust CROSS JOIN (SELECT CAST(min(Recency) AS DOUBLE) AS lo, (CAST(max(Recency) AS DOUBLE) - CAST(min(Recency) AS DOUBLE)) / 30 AS w FROM cust) m2
    WHERE Recency IS NOT NULL) GROUP BY b) c ON c.b = i.bin""")


@register("a23_histogram", _hist_sql())
def q_a23(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.histogram(customers(spark, sf), "Recency", 30))


def _box_sql() -> str:
    def one(grp: str, cond: str) -> str:
        return f"""SELECT {grp} AS grp, q1, med, q3,
  (SELECT min(MonetaryTotal) FROM cust WHERE {cond} AND MonetaryTotal >= b.q1 - 1.5 * (b.q3 - b.q1)) AS wl,
  (SELECT max(MonetaryTotal) FROM cust WHERE {cond} AND MonetaryTotal <= b.q3 + 1.5 * (b.q3 - b.q1)) AS wh,
  (SELECT count_if(MonetaryTotal < b.q1 - 1.5 * (b.q3 - b.q1) OR MonetaryTotal > b.q3 + 1.5 * (b.q3 - b.q1)) FROM cust WHERE {cond}) AS nf
  FROM (SELECT quantile_cont(MonetaryTotal, 0.25) AS q1, quantile_cont(MonetaryTotal, 0.5) AS med,
               quantile_cont(MonetaryTotal, 0.75) AS q3 FROM cust WHERE {cond}) b"""
    body = " UNION ALL ".join([one("'0'", "Churn = 0"), one("'1'", "Churn = 1")])
    return sql_with(["cust"], f"""SELECT grp, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3,
  {r6('wl')} AS whisker_low, {r6('wh')} AS whisker_high, CAST(nf AS BIGINT) AS n_fliers FROM ({body})""")


@register("a24_box_stats", _box_sql())
def q_a24(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.box_stats(customers(spark, sf), "MonetaryTotal", "Churn", groups=[0, 1]))


def _summary_sql() -> str:
    nulls = _null_union(CUSTOMER_COLUMNS, "cust")
    return sql_with(["cust"], f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(CUSTOMER_COLUMNS)} AS BIGINT) AS n_columns,
  {r6("avg(CAST(Churn AS DOUBLE))")} AS target_rate,
  (SELECT CAST(count(*) AS BIGINT) FROM (DESCRIBE SELECT * FROM cust) WHERE column_type IN ('BIGINT', 'DOUBLE', 'INTEGER')) AS n_numeric,
  (SELECT CAST(count(*) AS BIGINT) FROM (DESCRIBE SELECT * FROM cust) WHERE column_type = 'VARCHAR') AS n_categorical,
  (SELECT CAST(count(*) AS BIGINT) FROM ({nulls}) WHERE n_missing > 0) AS n_null_columns,
  (SELECT CAST(count(*) AS BIGINT) FROM ({" UNION ALL ".join(
      f"SELECT count(DISTINCT {qi(c)}) + max(CASE WHEN {qi(c)} IS NULL THEN 1 ELSE 0 END) AS d FROM cust" for c in CUSTOMER_COLUMNS)})
   WHERE d = 1) AS n_constant
FROM cust""")


@register("a25_exploration_summary", _summary_sql())
def q_a25(spark: SparkSession, sf: str) -> DataFrame:
    return rd(A.exploration_summary(customers(spark, sf)))


SPLIT_SQL = """csplit AS (SELECT CustomerID, Churn, CASE WHEN row_number() OVER (PARTITION BY Churn
  ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1 < ceil(0.2 * count(*) OVER (PARTITION BY Churn))
  THEN 'test' ELSE 'train' END AS split FROM cust)"""


@register("a26_split_balance", sql_with(["cust"], f"""SELECT split, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(Churn) AS BIGINT) AS n_positive, {r6("avg(CAST(Churn AS DOUBLE))")} AS positive_rate FROM csplit GROUP BY split""",
    extra=SPLIT_SQL))
def q_a26(spark: SparkSession, sf: str) -> DataFrame:
    s = stratified_split(customers(spark, sf).select("CustomerID", "Churn"), "Churn", 0.2, 42, "CustomerID")
    return rd(A.split_balance(s, "split", "Churn"))


def _kde_sql() -> str:
    return sql_with(["cscaled", "proc"], f"""
SELECT k.Churn, g.ix, g.iy, {r6("g.gx")} AS gx, {r6("g.gy")} AS gy, {r6("sum(exp(-0.5 * (k.ia * (g.gx - k.px) * (g.gx - k.px) + 2 * k.ib * (g.gx - k.px) * (g.gy - k.py) + k.id * (g.gy - k.py) * (g.gy - k.py)))) * max(k.norm)")} AS density
FROM (SELECT p.*, s.ia, s.ib, s.id, s.norm FROM pts p JOIN (
        SELECT Churn, d / det AS ia, -b / det AS ib, a / det AS id, 1.0 / (2 * pi() * sqrt(det) * n) AS norm FROM (
          SELECT Churn, n, a, b, d, a * d - b * b AS det FROM (
            SELECT Churn, count(*) AS n, var_samp(px) * pow(count(*), CAST(-2 AS DOUBLE) / 6) AS a,
                   covar_samp(px, py) * pow(count(*), CAST(-2 AS DOUBLE) / 6) AS b, var_samp(py) * pow(count(*), CAST(-2 AS DOUBLE) / 6) AS d
            FROM pts GROUP BY Churn))) s ON s.Churn = p.Churn) k
CROSS JOIN (SELECT ix, iy, m.x0 + (m.x1 - m.x0) * ix / 79 AS gx, m.y0 + (m.y1 - m.y0) * iy / 79 AS gy
            FROM (SELECT CAST(range % 80 AS BIGINT) AS ix, CAST(range // 80 AS BIGINT) AS iy FROM range(6400)) c
            CROSS JOIN (SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM pts) m) g
GROUP BY k.Churn, g.ix, g.iy, g.gx, g.gy""", extra="""pts AS (SELECT CAST(p.Churn AS BIGINT) AS Churn, s.MonetaryTotal AS px, s.Frequency AS py
  FROM cscaled s JOIN proc p ON p.CustomerID = s.CustomerID)""")


@register("a27_kde_grid", _kde_sql())
def q_a27(spark: SparkSession, sf: str) -> DataFrame:
    pts = scaled_cached(spark, sf).join(processed(spark, sf).select("CustomerID", "Churn"), "CustomerID")
    return rd(A.kde_grid(pts, "MonetaryTotal", "Frequency", "Churn", 80))
