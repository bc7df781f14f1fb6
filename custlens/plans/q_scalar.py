"""Registered queries: scalar functions (F) and joins/lookups (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions import scalars as S
from custlens.operators import joins as J
from custlens.operators.sampling import assign_folds
from custlens.operators import ranking as W
from custlens.operators import regress as G
from custlens.plans.catalog import (customers, processed, rd, register, scored, segments_cached,
                                    segment_labels_cached, spend_standin)
from custlens.plans.fixture import register_cte, sql_with
from custlens.plans.sqlgen import (ONE_HOT_VOCAB_TESTDATA, lit, qi, sql_first_octet, sql_ip_private, sql_lookup,
                                   sql_ordinal, sql_parse_date)
from custlens.sources.io import testdata

# --- F01-F04 dates -------------------------------------------------------------------

_D = sql_parse_date("RegistrationDate")


@register("f01_parse_mixed_date", sql_with(["cust"], f"SELECT CustomerID, RegistrationDate, {_D} AS reg_date FROM cust"))
def q_f01(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return c.select("CustomerID", "RegistrationDate", S.parse_mixed_date("RegistrationDate").alias("reg_date"))


@register("f02_date_parts", sql_with(["cust"], f"""SELECT CustomerID, CAST(year({_D}) AS BIGINT) AS RegYear,
  CAST(month({_D}) AS BIGINT) AS RegMonth, CAST(day({_D}) AS BIGINT) AS RegDay,
  CAST(isodow({_D}) - 1 AS BIGINT) AS RegWeekday FROM cust"""))
def q_f02(spark: SparkSession, sf: str) -> DataFrame:
    return S.date_parts(customers(spark, sf).select("CustomerID", "RegistrationDate"))


@register("f03_parse_failures", sql_with(["cust"], f"SELECT CAST(count_if({_D} IS NULL) AS BIGINT) AS n_failed FROM cust"))
def q_f03(spark: SparkSession, sf: str) -> DataFrame:
    return S.parse_failures(customers(spark, sf))


@register("f04_date_format_profile", sql_with(["cust"], """
SELECT date_format, CAST(count(*) AS BIGINT) AS n_rows,
  round_even(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM cust), 6) AS pct
FROM (SELECT CASE
    WHEN contains(RegistrationDate, '/') THEN CASE
      WHEN len(string_split(RegistrationDate, '/')) < 3 THEN 'Other'
      WHEN length(string_split(RegistrationDate, '/')[3]) = 2 AND length(string_split(RegistrationDate, '/')[1]) = 2 THEN 'DD/MM/YY'
      WHEN length(string_split(RegistrationDate, '/')[3]) = 4 AND length(string_split(RegistrationDate, '/')[1]) = 2 THEN 'MM/DD/YYYY'
      ELSE 'Other' END
    WHEN contains(RegistrationDate, '-') THEN 'YYYY-MM-DD' END AS date_format FROM cust)
WHERE date_format IS NOT NULL GROUP BY date_format"""))
def q_f04(spark: SparkSession, sf: str) -> DataFrame:
    return S.date_format_profile(customers(spark, sf))


# --- F05-F09 --------------------------------------------------------------------------

@register("f05_ip_is_private", sql_with(["cust"], f"SELECT CustomerID, LastLoginIP, {sql_ip_private('LastLoginIP')} AS IP_IsPrivate FROM cust"))
def q_f05(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return c.select("CustomerID", "LastLoginIP", S.ip_is_private("LastLoginIP").alias("IP_IsPrivate"))


@register("f06_ip_first_octet", sql_with(["cust"], f"SELECT CustomerID, {sql_first_octet('LastLoginIP')} AS IP_FirstOctet FROM cust"))
def q_f06(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("CustomerID", S.ip_first_octet("LastLoginIP").alias("IP_FirstOctet"))


@register("f07_avg_basket", sql_with(["cust"], """SELECT CustomerID,
  round_even(MonetaryTotal / NULLIF(CAST(Frequency AS DOUBLE), 0), 6) AS AvgBasketValue FROM cust"""))
def q_f07(spark: SparkSession, sf: str) -> DataFrame:
    return rd(S.avg_basket(customers(spark, sf)).select("CustomerID", "AvgBasketValue"))


@register("f08_monetary_per_day", sql_with(["cust"], """SELECT CustomerID,
  round_even(MonetaryTotal / CAST(Recency + 1 AS DOUBLE), 6) AS MonetaryPerDay FROM cust"""))
def q_f08(spark: SparkSession, sf: str) -> DataFrame:
    return rd(S.monetary_per_day(customers(spark, sf)).select("CustomerID", "MonetaryPerDay"))


@register("f09_tenure_ratio", sql_with(["cust"], """SELECT CustomerID,
  round_even(CAST(Recency AS DOUBLE) / NULLIF(CAST(CustomerTenureDays AS DOUBLE), 0), 6) AS TenureRatio FROM cust"""))
def q_f09(spark: SparkSession, sf: str) -> DataFrame:
    return rd(S.tenure_ratio(customers(spark, sf)).select("CustomerID", "TenureRatio"))


# --- F10-F11 encodings ---------------------------------------------------------------

_ORD = list(S.ORDINAL_MAPS_LIBRARY)


@register("f10_ordinal_library", sql_with(["cust"], "SELECT CustomerID, " + ", ".join(
    f"{sql_ordinal(c, m)} AS {qi(c)}" for c, m in S.ORDINAL_MAPS_LIBRARY.items()) + " FROM cust"))
def q_f10(spark: SparkSession, sf: str) -> DataFrame:
    return S.ordinal_encode(customers(spark, sf).select("CustomerID", *_ORD), S.ORDINAL_MAPS_LIBRARY)


@register("f10b_ordinal_notebook", sql_with(["cust"], "SELECT CustomerID, " + ", ".join(
    f"{sql_ordinal(c, m)} AS {qi(c)}" for c, m in S.ORDINAL_MAPS_NOTEBOOK.items()) + " FROM cust"))
def q_f10b(spark: SparkSession, sf: str) -> DataFrame:
    return S.ordinal_encode(customers(spark, sf).select("CustomerID", *_ORD), S.ORDINAL_MAPS_NOTEBOOK)


@register("f11_one_hot", sql_with(["cust"], "SELECT CustomerID, " + ", ".join(
    f"CAST(CASE WHEN {qi(c)} = {lit(v)} THEN 1 ELSE 0 END AS BIGINT) AS {qi(c + '_' + v)}"
    for c, vals in ONE_HOT_VOCAB_TESTDATA.items() for v in vals) + " FROM cust"))
def q_f11(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", *ONE_HOT_VOCAB_TESTDATA)
    return S.one_hot(c, list(ONE_HOT_VOCAB_TESTDATA))[0]


_WIDE = ["RegistrationDate", "LastLoginIP", "Country"]


@register("f11b_one_hot_vector", sql_with(["cust"], " UNION ALL ".join(
    f"""SELECT CustomerID, '{c}' AS column_name, CASE WHEN {qi(c)} IS NOT NULL THEN
  CAST(dense_rank() OVER (ORDER BY {qi(c)} NULLS LAST) - 1 AS BIGINT) END AS place, (SELECT count(DISTINCT {qi(c)}) FROM cust) AS width FROM cust""" for c in _WIDE)))
def q_f11b(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse one-hot vectors of wide columns, as the place of each row's 1
    (null: no entry) and the vector's width."""
    coded, model = S.one_hot_vector(customers(spark, sf).select("CustomerID", *_WIDE), _WIDE)
    widths = dict(zip(_WIDE, map(len, model.stages[0].labelsArray)))
    entry = F.array(*[F.struct(F.lit(c).alias("column_name"), S.hot_place(f"{c}_onehot").alias("place"), F.lit(widths[c]).cast("bigint").alias("width")) for c in _WIDE])
    return coded.select("CustomerID", F.explode(entry).alias("e")).select("CustomerID", "e.*")


# --- F12-F14 -----------------------------------------------------------------------------

@register("f12_log1p", sql_with(["cust"], """SELECT CustomerID,
  round_even(CASE WHEN MonetaryTotal > -1 THEN ln(1 + MonetaryTotal) END, 6) AS log_plain,
  round_even(ln(1 + greatest(MonetaryTotal, 0)), 6) AS log_floor,
  round_even(ln(1 + Recency), 6) AS log_recency FROM cust"""))
def q_f12(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", F.col("MonetaryTotal").alias("log_plain"),
                                    F.col("MonetaryTotal").alias("log_floor"), F.col("Recency").alias("log_recency"))
    c = S.log1p_cols(c, ["log_plain", "log_recency"])
    return rd(S.log1p_cols(c, ["log_floor"], floor=True))


@register("f13_clip", sql_with(["cust"], """SELECT CustomerID,
  round_even(least(greatest(MonetaryTotal, 0), 20000), 6) AS MonetaryTotal,
  CASE WHEN Age IS NULL THEN NULL ELSE least(greatest(Age, 25), 60) END AS Age FROM cust"""))
def q_f13(spark: SparkSession, sf: str) -> DataFrame:
    c = S.clip(customers(spark, sf).select("CustomerID", "MonetaryTotal", "Age"),
               {"MonetaryTotal": (0, 20000), "Age": (25, 60)})
    return rd(c.withColumn("Age", F.col("Age").cast("bigint")))


@register("f14_round_even", sql_with(["cust"], """SELECT CustomerID, round_even(MonetaryAvg, 2) AS MonetaryAvg2,
  round_even(MonetaryTotal, 0) AS MonetaryTotal0 FROM cust"""))
def q_f14(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return c.select("CustomerID", S.round_even("MonetaryAvg", 2).alias("MonetaryAvg2"),
                    S.round_even("MonetaryTotal", 0).alias("MonetaryTotal0"))


# --- F15-F21 reporting ----------------------------------------------------------------------

SCORED_SQL = """scored AS (SELECT CustomerID, Churn,
  CAST(0.6 AS DOUBLE) * ((CustomerID * 7919) % 97) / CAST(97 AS DOUBLE) + CAST(0.4 AS DOUBLE) * Churn AS p
  FROM cust)"""
register_cte("scored", SCORED_SQL, ["cust"])


@register("f15_risk_band", sql_with(["scored"], """SELECT CustomerID, round_even(p, 6) AS p,
  CASE WHEN p >= 0.75 THEN 'Critique' WHEN p >= 0.5 THEN 'Élevé' WHEN p >= 0.25 THEN 'Modéré' ELSE 'Faible' END AS risk_band
  FROM scored"""))
def q_f15(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return rd(s.select("CustomerID", "p", S.risk_band("p").alias("risk_band")))


@register("f16_risk_flag", sql_with(["scored"], """SELECT CustomerID,
  CASE WHEN p >= 0.5 THEN 'Élevé' ELSE 'Faible' END AS risk FROM scored"""))
def q_f16(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("CustomerID", S.risk_flag("p").alias("risk"))


@register("f17_churn_label", sql_with(["scored"], """SELECT CustomerID,
  CASE WHEN p >= 0.5 THEN 'Parti' ELSE 'Fidèle' END AS churn_label,
  CASE WHEN p >= 0.5 THEN 'Client Parti (Churned)' ELSE 'Client Fidèle' END AS churn_text FROM scored"""))
def q_f17(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return s.select("CustomerID", S.churn_label("pred").alias("churn_label"),
                    S.churn_label("pred", long=True).alias("churn_text"))


_ACTION_SQL = sql_lookup("label", S.SEGMENT_ACTIONS, S.DEFAULT_ACTION)


@register("f18b_churn_advice", sql_with(["scored"], "SELECT CustomerID, CASE WHEN p >= 0.5 THEN '" + " | ".join(S.CHURN_ADVICE[1]).replace("'", "''")
                                         + "' ELSE '" + " | ".join(S.CHURN_ADVICE[0]).replace("'", "''") + "' END AS advice FROM scored"))
def q_f18b(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("CustomerID", F.concat_ws(" | ", S.churn_advice("pred")).alias("advice"))


@register("f18_action_for", sql_with(["clabels"], f"""SELECT s.CustomerID, l.label, {_ACTION_SQL} AS action
FROM cseg s JOIN clabels l ON l.cluster = s.cluster"""))
def q_f18(spark: SparkSession, sf: str) -> DataFrame:
    seg = segments_cached(spark, sf)
    lab = segment_labels_cached(spark, sf)
    return seg.join(lab, "cluster").select("CustomerID", "label", S.action_for("label").alias("action"))


def auc_sql(src: str, grp: str | None = None) -> str:
    """AUC with ties 1/2 per group of ``src(grp, y, p)``."""
    g = grp or "0"
    return f"""(SELECT g, sum(pos * (coalesce(below, 0) + 0.5 * neg)) / (max(tp) * max(tn)) AS auc FROM (
  SELECT g, p, pos, neg, sum(neg) OVER (PARTITION BY g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
         sum(pos) OVER (PARTITION BY g) AS tp, sum(neg) OVER (PARTITION BY g) AS tn FROM (
    SELECT g, p, count_if(y = 1) AS pos, count_if(y <> 1) AS neg
    FROM (SELECT {g} AS g, y, p FROM {src}) GROUP BY g, p)) GROUP BY g)"""


FOLDS_SQL = """folds AS (SELECT CustomerID, Churn AS y, p,
  (row_number() OVER (PARTITION BY Churn ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1) % 5 AS fold
  FROM scored)"""
register_cte("folds", FOLDS_SQL, ["scored"])

SPEND_SQL = """spend AS (SELECT CustomerID, MonetaryTotal AS actual,
  CAST(1.1 AS DOUBLE) * MonetaryTotal + CAST((CustomerID % 13) * 100 AS DOUBLE) AS predicted FROM proc)"""
register_cte("spend", SPEND_SQL, ["proc"])


@register("f19_verdicts", sql_with(["folds", "spend"], f"""
SELECT round_even(a.auc, 6) AS auc, CASE WHEN a.auc > 0.98 THEN 'Fuite possible' ELSE 'OK' END AS auc_verdict,
  round_even(r.r2, 6) AS r2, CASE WHEN r.r2 >= 0.7 THEN 'Bon' WHEN r.r2 >= 0.5 THEN 'Acceptable' ELSE 'Faible' END AS r2_verdict,
  round_even(f.sd, 6) AS cv_auc_std, CASE WHEN f.sd < 0.03 THEN 'Stable' ELSE 'Instable' END AS cv_verdict
FROM {auc_sql("(SELECT Churn AS y, p FROM scored)")} a,
  (SELECT 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2 FROM spend) r,
  (SELECT stddev_pop(auc) AS sd FROM {auc_sql("folds", "fold")}) f"""))
def q_f19(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    auc = W.roc_auc(s, "Churn", "p").first()[0]
    r2 = G.regression_metrics(spend_standin(spark, sf)).first()["r2"]
    folds = assign_folds(s, 5, "Churn", 42, "CustomerID")
    # all folds' AUCs in one grouped job, their spread as one aggregate
    sd = W.roc_auc(folds, "Churn", "p", by=["fold"]).agg(F.stddev_pop("roc_auc")).first()[0]
    t = spark.createDataFrame([(auc, r2, sd)], "auc double, r2 double, cv_auc_std double")
    return rd(t.select("auc", S.verdict_auc(F.col("auc")).alias("auc_verdict"), "r2",
                       S.verdict_r2(F.col("r2")).alias("r2_verdict"), "cv_auc_std",
                       S.verdict_cv_std(F.col("cv_auc_std")).alias("cv_verdict")))


@register("f20_format_segments", sql_with(["clabels"], """
SELECT l.label, printf('%d clients (%s%%)', CAST(coalesce(g.n, 0) AS BIGINT),
    printf('%.1f', round_even(coalesce(g.n, 0) * CAST(100 AS DOUBLE) / t.total, 1))) AS size_text,
  printf('%.1f', round_even(coalesce(round_even(g.churn, 2), 0) * CAST(100 AS DOUBLE), 1)) || '%' AS churn_text,
  printf('%.2f', coalesce(round_even(g.sat, 2), 0)) || '/5' AS satisfaction_text
FROM clabels l LEFT JOIN (SELECT cluster, count(*) AS n, avg(SatisfactionScore) AS sat, avg(CAST(Churn AS DOUBLE)) AS churn
  FROM cseg GROUP BY cluster) g ON g.cluster = l.cluster CROSS JOIN (SELECT count(*) AS total FROM cseg) t"""))
def q_f20(spark: SparkSession, sf: str) -> DataFrame:
    from custlens.operators.clustering import segment_report
    r = segment_report(segments_cached(spark, sf), segment_labels_cached(spark, sf))
    return r.select("label", "size_text", "churn_text", "satisfaction_text")


@register("f21_minmax_profile", sql_with(["cseg"], """
SELECT cluster, round_even((freq - min(freq) OVER ()) / (max(freq) OVER () - min(freq) OVER () + 1e-9), 6) AS Frequency,
  round_even((mon - min(mon) OVER ()) / (max(mon) OVER () - min(mon) OVER () + 1e-9), 6) AS MonetaryTotal,
  round_even((ch - min(ch) OVER ()) / (max(ch) OVER () - min(ch) OVER () + 1e-9), 6) AS Churn
FROM (SELECT cluster, avg(Frequency) AS freq, avg(MonetaryTotal) AS mon, avg(CAST(Churn AS DOUBLE)) AS ch
      FROM cseg GROUP BY cluster)"""))
def q_f21(spark: SparkSession, sf: str) -> DataFrame:
    seg = segments_cached(spark, sf)
    g = seg.groupBy("cluster").agg(F.avg("Frequency").alias("Frequency"), F.avg("MonetaryTotal").alias("MonetaryTotal"),
                                   F.avg(F.col("Churn").cast("double")).alias("Churn"))
    return rd(S.minmax_profile(g, "cluster", ["Frequency", "MonetaryTotal", "Churn"]))


# --- J ----------------------------------------------------------------------------------

@register("j01_lookup", sql_with(["cust"], """SELECT c.CustomerID, c.Country, n.n_nationkey, n.n_regionkey
FROM cust c LEFT JOIN nation n ON n.n_name = c.Country"""))
def q_j01(spark: SparkSession, sf: str) -> DataFrame:
    dim = testdata(spark, sf, "nation").select(F.col("n_name").alias("Country"), "n_nationkey", "n_regionkey")
    return J.lookup(customers(spark, sf).select("CustomerID", "Country"), dim, "Country")


@register("j02_lookup_default", sql_with(["cust"], """SELECT c.CustomerID, c.CustomerType,
  coalesce(d.segment_label, 'Inconnu') AS segment_label
FROM cust c LEFT JOIN (SELECT * FROM (VALUES ('AUTOMOBILE', 'Auto'), ('BUILDING', 'Batiment'), ('MACHINERY', 'Machines'))
  t(CustomerType, segment_label)) d ON d.CustomerType = c.CustomerType"""))
def q_j02(spark: SparkSession, sf: str) -> DataFrame:
    # A partial display table for market segments.
    dim = spark.createDataFrame([("AUTOMOBILE", "Auto"), ("BUILDING", "Batiment"), ("MACHINERY", "Machines")],
                                "CustomerType string, segment_label string")
    return J.lookup_default(customers(spark, sf).select("CustomerID", "CustomerType"), dim, "CustomerType",
                            {"segment_label": "Inconnu"})


@register("j03_join_summary", sql_with(["cust"], """SELECT Region, round_even(avg(MonetaryTotal), 6) AS MonetaryTotal,
  round_even(avg(Recency), 6) AS Recency, CAST(count(*) AS BIGINT) AS n_clients FROM cust GROUP BY Region"""))
def q_j03(spark: SparkSession, sf: str) -> DataFrame:
    return rd(J.join_summary(customers(spark, sf), "Region", ["MonetaryTotal", "Recency"]))


@register("j04_invert_map", sql_with(["clabels"], "SELECT label AS cluster, cluster AS label FROM clabels"))
def q_j04(spark: SparkSession, sf: str) -> DataFrame:
    return J.invert_map(segment_labels_cached(spark, sf), "cluster", "label")


@register("j05_attach", sql_with(["cust", "proc"], """SELECT p.CustomerID, p.Recency, round_even(p.AvgBasketValue, 6) AS AvgBasketValue, c.Churn
FROM (SELECT CustomerID, Recency, AvgBasketValue FROM proc WHERE MonetaryTotal > 0) p
JOIN (SELECT CustomerID, Churn FROM cust) c ON c.CustomerID = p.CustomerID"""))
def q_j05(spark: SparkSession, sf: str) -> DataFrame:
    """Labels brought back to the filtered clustering rows (MonetaryTotal > 0,
    P12) from the source table through the explicit key."""
    labels = customers(spark, sf).select("CustomerID", "Churn")
    feats = processed(spark, sf).where(F.col("MonetaryTotal") > 0).select("CustomerID", "Recency", "AvgBasketValue")
    return rd(J.attach(feats, labels, "CustomerID"))


def _knn_sql() -> str:
    return sql_with(["cust"], """
SELECT CustomerID, nn_CustomerID, round_even(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM (
  SELECT q.CustomerID, d.CustomerID AS nn_CustomerID,
    sqrt(((CAST(q.Recency AS DOUBLE) - d.Recency) * (CAST(q.Recency AS DOUBLE) - d.Recency)
        + (CAST(q.Frequency AS DOUBLE) - d.Frequency) * (CAST(q.Frequency AS DOUBLE) - d.Frequency)
        + (q.TotalQuantity - d.TotalQuantity) * (q.TotalQuantity - d.TotalQuantity)) * CAST(3 AS DOUBLE) / 3) AS distance,
    row_number() OVER (PARTITION BY q.CustomerID ORDER BY
      sqrt(((CAST(q.Recency AS DOUBLE) - d.Recency) * (CAST(q.Recency AS DOUBLE) - d.Recency)
        + (CAST(q.Frequency AS DOUBLE) - d.Frequency) * (CAST(q.Frequency AS DOUBLE) - d.Frequency)
        + (q.TotalQuantity - d.TotalQuantity) * (q.TotalQuantity - d.TotalQuantity)) * CAST(3 AS DOUBLE) / 3), d.CustomerID) AS rank
  FROM cust q JOIN cust d ON q.CustomerID <> d.CustomerID) WHERE rank <= 5""")


@register("j06_knn_join", _knn_sql())
def q_j06(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest other customers of every customer (exact)."""
    c = customers(spark, sf).select("CustomerID", "Recency", "Frequency", "TotalQuantity")
    return rd(J.knn_join(c, c, "CustomerID", "CustomerID", ["Recency", "Frequency", "TotalQuantity"], 5,
                         exclude_self=True))
