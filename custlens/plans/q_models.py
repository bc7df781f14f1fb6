"""Registered queries: ranking (W), splits (R), fitted transforms (M),
clustering (C), classification (B), regression (G) and scoring (O)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions import scalars as S
from custlens.operators import classify as B
from custlens.operators import clustering as C
from custlens.operators import features as M
from custlens.operators import ranking as W
from custlens.operators import regress as G
from custlens.operators import sampling as R
from custlens.operators import scoring as O
from custlens.operators.schema import numeric_columns
from custlens.plans.catalog import (cached_object, cluster_fit, customers, preprocessed, processed, rd, register,
                                    scaled_cached, scored, segment_labels, segment_labels_cached, segments_cached, spend_standin)
from custlens.plans.fixture import NUMERIC_COLUMNS, register_cte, sql_with
from custlens.plans.q_scalar import auc_sql
from custlens.plans.sqlgen import CF, LOGC, PROC_COLUMNS, knn_impute_ctes, qi, sel_rounded
from custlens.plans.q_tables import PROC_D
from custlens.session import cut_lineage, materialise_table, scratch_path
from custlens.sources import io


def r6(e: str) -> str:
    return f"round_even({e}, 6)"


# --- shared SQL pieces --------------------------------------------------------------

register_cte("csplit", """csplit AS (SELECT CustomerID, Churn, CASE WHEN row_number() OVER (PARTITION BY Churn
  ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1 < ceil(0.2 * count(*) OVER (PARTITION BY Churn))
  THEN 'test' ELSE 'train' END AS split FROM cust)""", ["cust"])

register_cte("roc", """sc AS (SELECT p, count_if(Churn = 1) AS pos, count_if(Churn <> 1) AS neg FROM scored GROUP BY p),
cum AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cp,
               sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn FROM sc),
tot AS (SELECT sum(pos) AS tot_pos, sum(neg) AS tot_neg FROM sc),
roc AS (SELECT p AS threshold, cn / tot_neg AS fpr, cp / tot_pos AS tpr FROM cum, tot)""", ["scored"])

register_cte("pts", """pts AS (SELECT a.CustomerID AS k, a.cluster AS c, s.MonetaryTotal AS x, s.Recency AS y, s.Frequency AS z
  FROM cassign a JOIN cscaled s ON s.CustomerID = a.CustomerID)""", ["cassign"])


# --- W ----------------------------------------------------------------------------------

@register("w01_label_clusters", sql_with(["clabels"], "SELECT cluster, label FROM clabels"))
def q_w01(spark: SparkSession, sf: str) -> DataFrame:
    return segment_labels_cached(spark, sf)


def pca_input(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Processed numeric features (no key/target) with the split label,
    KNN-imputed then standard scaled: both fitted on the training split and
    applied to all rows."""
    def build():
        p = split_rows(spark, sf)
        feats = [c for c in numeric_columns(p) if c not in ("CustomerID", "Churn")]
        x = p.select("CustomerID", "Churn", "split", *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
        imp = M.knn_impute_fit(x.where("split = 'train'"), feats, "CustomerID")
        xi = cut_lineage(M.knn_impute_apply(imp, x))
        xs = M.standard_fit(xi.where("split = 'train'"), feats).apply(xi)
        return materialise_table(xs, "pca_input"), feats
    return cached_object(spark, "pca_input", sf, build)


def pca_full(spark: SparkSession, sf: str) -> M.PcaFit:
    """PCA of the training split."""
    def build():
        x, feats = pca_input(spark, sf)
        return M.pca_fit(x.where("split = 'train'"), feats)
    return cached_object(spark, "pca_full", sf, build)


@register("w02_components_for")
def q_w02(spark: SparkSession, sf: str) -> DataFrame:
    return M.components_for(pca_full(spark, sf).explained(spark))


@register("w03_roc_curve", sql_with(["roc"], f"""SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr,
  CAST(0 AS DOUBLE) AS tpr UNION ALL SELECT {r6('threshold')}, {r6('fpr')}, {r6('tpr')} FROM roc"""))
def q_w03(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.roc_curve(scored(spark, sf), "Churn", "p"))


@register("w04_pr_curve", sql_with(["roc"], f"""SELECT {r6('p')} AS threshold, {r6('cp / (cp + cn)')} AS precision,
  {r6('cp / tot_pos')} AS recall FROM cum, tot WHERE p >= (SELECT max(p) FROM cum, tot WHERE cp >= tot_pos)
  UNION ALL SELECT NULL, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)"""))
def q_w04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.pr_curve(scored(spark, sf), "Churn", "p"))


@register("w05_nearest_threshold", sql_with(["roc"], f"""SELECT {r6('threshold')} AS threshold, {r6('fpr')} AS fpr,
  {r6('tpr')} AS tpr FROM roc ORDER BY abs(threshold - 0.5), -threshold LIMIT 1"""))
def q_w05(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.nearest_threshold(W.roc_curve(scored(spark, sf), "Churn", "p"), 0.5))


# --- B01/B02/W06 models (invariant-checked) ----------------------------------------------

def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Processed rows with the stratified 80/20 split label."""
    def build():
        sp = R.stratified_split(customers(spark, sf).select("CustomerID", "Churn"), "Churn", 0.2, 42)
        return materialise_table(processed(spark, sf).join(sp.select("CustomerID", "split"), "CustomerID"), "split_rows")
    return cached_object(spark, "split_rows", sf, build)


def churn_prep(spark: SparkSession, sf: str) -> B.ChurnPrep:
    return cached_object(spark, "churn_prep", sf, lambda: B.prepare_churn(
        split_rows(spark, sf).where("split = 'train'").drop("split")))


def churn_model(spark: SparkSession, sf: str) -> B.ChurnModel:
    return cached_object(spark, "churn_model", sf, lambda: B.train_churn(
        split_rows(spark, sf).where("split = 'train'").drop("split"), prep=churn_prep(spark, sf)))


@register("b01_train_churn")
def q_b01(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of the churn model (fit on the training split)."""
    test = split_rows(spark, sf).where("split = 'test'")
    return B.predict_churn(churn_model(spark, sf), test, keep=["Churn"])


#: Text columns with about a value per customer, beside some with few.
_WIDE = ["RegistrationDate", "LastLoginIP", "Country", "Gender"]


@register("b01b_train_wide")
def q_b01b(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of a forest over prepared numeric columns and the sparse
    one-hot vectors of text columns, two of them with a vocabulary that grows with
    the customers."""
    prep = churn_prep(spark, sf)
    numeric = [c for c in prep.features if not any(c.startswith(f"{w}_") for w in _WIDE)]
    text = customers(spark, sf).select("CustomerID", *[F.col(c).alias(f"{c}_text") for c in _WIDE])
    wide = [f"{c}_text" for c in _WIDE]
    test = split_rows(spark, sf).where("split = 'test'").select("CustomerID", "Churn", *[F.col(f"`{c}`").cast("double").alias(c) for c in prep.features])
    test = prep.scaler.apply(M.knn_impute_apply(prep.imputer, test))
    model = B.train_wide_forest(prep.rows.join(text, "CustomerID"), numeric, wide)
    return B.predict_wide_forest(model, test.join(text, "CustomerID"), ["CustomerID", "Churn"])


@register("b02_predict_churn")
def q_b02(spark: SparkSession, sf: str) -> DataFrame:
    return B.predict_churn(churn_model(spark, sf), processed(spark, sf))


@register("w06_importance_rank")
def q_w06(spark: SparkSession, sf: str) -> DataFrame:
    m = churn_model(spark, sf)
    return rd(W.importance_rank(spark, m.forest.featureImportances, m.features, 15))


# --- B03-B06 on the deterministic score -----------------------------------------------------

@register("b03_roc_auc", sql_with(["scored"], f"SELECT {r6('auc')} AS roc_auc FROM {auc_sql('(SELECT Churn AS y, p FROM scored)')}"))
def q_b03(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.roc_auc(scored(spark, sf), "Churn", "p"))


@register("b04_average_precision", sql_with(["roc"], f"SELECT {r6('sum(pos / tot_pos * (cp / (cp + cn)))')} AS average_precision FROM cum, tot"))
def q_b04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.average_precision(scored(spark, sf), "Churn", "p"))


_CONF = """c AS (SELECT count_if(Churn = 0 AND pred = 0) AS tn, count_if(Churn = 0 AND pred = 1) AS fp,
  count_if(Churn = 1 AND pred = 0) AS fn, count_if(Churn = 1 AND pred = 1) AS tp
  FROM (SELECT Churn, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored))"""


@register("b05_confusion", sql_with(["scored"], f"""SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
  CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, {r6('(tn + tp) / (tn + fp + fn + tp)')} AS accuracy,
  {r6('tp / nullif(tp + fn, 0)')} AS recall, {r6('tp / nullif(tp + fp, 0)')} AS precision FROM c""", extra=_CONF))
def q_b05(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.confusion(scored(spark, sf), "Churn", "pred"))


@register("b06_classification_report", sql_with(["scored"], f"""SELECT label, {r6('pr')} AS precision, {r6('rc')} AS recall,
  {r6('f')} AS f1_score, CAST(s AS BIGINT) AS support FROM (
  SELECT '0' AS label, p0 AS pr, r0 AS rc, f0 AS f, s0 AS s FROM f
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, (tn + tp) / (s0 + s1), s0 + s1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
    (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f)""", extra=_CONF + """,
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
  coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
  CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0 FROM c),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM m)"""))
def q_b06(spark: SparkSession, sf: str) -> DataFrame:
    return rd(W.classification_report(scored(spark, sf), "Churn", "pred"))


def churn_grid(spark: SparkSession, sf: str):
    def build():
        p = churn_prep(spark, sf)
        return B.grid_search(p.rows, p.features)
    return cached_object(spark, "churn_grid", sf, build)


@register("b07_grid_search")
def q_b07(spark: SparkSession, sf: str) -> DataFrame:
    """Mean positive-class F1 of every grid point over 5 stratified folds, the
    best marked."""
    grid, best, _ = churn_grid(spark, sf)
    rows = [(g["num_trees"], g["max_depth"], g["min_instances"], g["mean_f1"], all(g[k] == v for k, v in best.items())) for g in grid]
    return spark.createDataFrame(rows, "num_trees long, max_depth long, min_instances long, mean_f1 double, best boolean")


@register("b08_cross_val")
def q_b08(spark: SparkSession, sf: str) -> DataFrame:
    """Per-fold F1 and AUC of the grid's best point, plus mean (fold -1) and
    population std (fold -2) rows."""
    p = churn_prep(spark, sf)
    per = B.cross_val(spark, p.rows, p.features, **churn_grid(spark, sf)[1])
    summ = per.agg(F.lit(-1).cast("long").alias("fold"), F.avg("f1").alias("f1"), F.avg("auc").alias("auc"))
    sd = per.agg(F.lit(-2).cast("long").alias("fold"), F.stddev_pop("f1").alias("f1"), F.stddev_pop("auc").alias("auc"))
    return per.unionByName(summ).unionByName(sd)


# --- R -------------------------------------------------------------------------------------

@register("r01_stratified_split", sql_with(["csplit"], "SELECT CustomerID, Churn, split FROM csplit"))
def q_r01(spark: SparkSession, sf: str) -> DataFrame:
    return R.stratified_split(customers(spark, sf).select("CustomerID", "Churn"), "Churn", 0.2, 42)


@register("r02_random_split", sql_with(["cust"], """SELECT CustomerID, CASE WHEN row_number() OVER (
  ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1 < ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM cust"""))
def q_r02(spark: SparkSession, sf: str) -> DataFrame:
    return R.random_split(customers(spark, sf).select("CustomerID"), 0.2, 42)


@register("r03_assign_folds", sql_with(["cust"], """SELECT CustomerID,
  CAST((row_number() OVER (PARTITION BY Churn ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1) % 5 AS BIGINT) AS fold_stratified,
  CAST((row_number() OVER (ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1) % 5 AS BIGINT) AS fold_plain FROM cust"""))
def q_r03(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", "Churn")
    a = R.assign_folds(c, 5, "Churn", 42, out="fold_stratified")
    b = R.assign_folds(c.select("CustomerID"), 5, None, 42, out="fold_plain")
    return a.join(b, "CustomerID").select("CustomerID", "fold_stratified", "fold_plain")


@register("r04_class_weights", sql_with(["cust"], f"""SELECT Churn, CAST(count(*) AS BIGINT) AS n_class,
  {r6('(SELECT count(*) FROM cust) / (2.0 * count(*))')} AS weight FROM cust GROUP BY Churn"""))
def q_r04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(R.class_weights(customers(spark, sf), "Churn"))


def _smote_input(spark: SparkSession, sf: str) -> DataFrame:
    sp = R.stratified_split(customers(spark, sf).select("CustomerID", "Churn"), "Churn", 0.2, 42)
    return (scaled_cached(spark, sf).join(sp.where("split = 'train'"), "CustomerID")
            .select("CustomerID", "Churn", *CF))


def _smote_sql() -> str:
    ss = " + ".join(f"(a.{qi(c)} - b.{qi(c)}) * (a.{qi(c)} - b.{qi(c)})" for c in CF)
    real = ", ".join(f"{r6(qi(c))} AS {qi(c)}" for c in CF)
    made = ", ".join(f"{r6(f'x.{qi(c)} + g.u * (z.{qi(c)} - x.{qi(c)})')} AS {qi(c)}" for c in CF)
    return sql_with(["csplit", "cscaled"], f"""
SELECT CustomerID, {real}, CAST(Churn AS BIGINT) AS Churn, CAST(0 AS BIGINT) AS synthetic FROM tr
UNION ALL
SELECT CAST(NULL AS BIGINT), {made}, CAST(x.Churn AS BIGINT), CAST(1 AS BIGINT)
FROM gen g JOIN nn ON nn.src = g.src AND nn.j = g.j JOIN mino x ON x.CustomerID = g.src JOIN mino z ON z.CustomerID = nn.nb""",
                    extra=f"""tr AS (SELECT s.*, c.Churn FROM cscaled s JOIN csplit c ON c.CustomerID = s.CustomerID WHERE c.split = 'train'),
cnt AS (SELECT Churn, count(*) AS n FROM tr GROUP BY Churn),
lim AS (SELECT min(n) AS n_min, max(n) - min(n) AS need, least(5, min(n) - 1) AS kk FROM cnt),
mino AS (SELECT * FROM tr WHERE Churn = (SELECT Churn FROM cnt ORDER BY n, Churn LIMIT 1)),
ranked AS (SELECT CustomerID, row_number() OVER (ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1 AS pos FROM mino),
gen AS (SELECT r.CustomerID AS src, (i.range * 31 + 42) % l.kk + 1 AS j, ((i.range * 7919 + 42 * 13 + 7) % 10007) / CAST(10007 AS DOUBLE) AS u
  FROM (SELECT unnest(range(need)) AS range FROM lim) i, lim l, ranked r WHERE r.pos = i.range % l.n_min),
nn AS (SELECT a.CustomerID AS src, b.CustomerID AS nb, row_number() OVER (PARTITION BY a.CustomerID
    ORDER BY sqrt(({ss}) * CAST({len(CF)} AS DOUBLE) / {len(CF)}), b.CustomerID) AS j
  FROM mino a JOIN mino b ON a.CustomerID <> b.CustomerID)""")


@register("r05_smote", _smote_sql())
def q_r05(spark: SparkSession, sf: str) -> DataFrame:
    """The training split with its synthetic minority rows (key null)."""
    out = R.smote(_smote_input(spark, sf), "Churn", CF, "CustomerID", k=5, seed=42)
    return rd(out.withColumns({"Churn": F.col("Churn").cast("bigint"), "synthetic": F.col("synthetic").cast("bigint")}))


# --- M --------------------------------------------------------------------------------------

_M01 = ["Age", "SatisfactionScore", "SupportTicketsCount", "MonetaryTotal"]


@register("m01_knn_impute", sql_with(["proc"], "SELECT CustomerID, " + ", ".join(f"{r6(qi(c))} AS {qi(c)}" for c in _M01)
                                     + " FROM mi_out",
                                     extra="m1src AS (SELECT CustomerID, " + ", ".join(qi(c) for c in _M01) + " FROM proc),\n"
                                     + knn_impute_ctes("mi", "m1src", "CustomerID", _M01)))
def q_m01(spark: SparkSession, sf: str) -> DataFrame:
    x = processed(spark, sf).select("CustomerID", *_M01)
    return rd(M.knn_impute_apply(M.knn_impute_fit(x, _M01, "CustomerID"), x))


_M02 = [c for c in NUMERIC_COLUMNS if c != "CustomerID"]


@register("m02_robust_scale", sql_with(["cust"], "SELECT CustomerID, " + ", ".join(
    f"{r6(f'({c} - s.med_{c}) / (CASE WHEN s.iqr_{c} = 0 THEN 1 ELSE s.iqr_{c} END)')} AS {c}" for c in _M02)
    + " FROM cust CROSS JOIN (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS med_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}" for c in _M02)
    + " FROM cust) s"))
def q_m02(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", *_M02)
    return rd(M.robust_fit(c, _M02).apply(c))


_M03_SQL = "SELECT CustomerID, " + ", ".join(
    f"({c} - s.m_{c}) / (CASE WHEN s.s_{c} = 0 THEN 1 ELSE s.s_{c} END) AS {c}" for c in _M02) \
    + " FROM cust CROSS JOIN (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _M02) + " FROM cust) s"


@register("m03_standard_scale", sql_with(["cust"], "SELECT CustomerID, " + ", ".join(f"{r6(c)} AS {c}" for c in _M02)
                                         + f" FROM ({_M03_SQL})"))
def q_m03(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", *_M02)
    return rd(M.standard_fit(c, _M02).apply(c))


@register("m04_scaling_check", sql_with(["cust"], f"""SELECT {r6('avg(v)')} AS global_mean, {r6('stddev_pop(v)')} AS global_std
  FROM (SELECT unnest([{', '.join(_M02)}]) AS v FROM ({_M03_SQL}))"""))
def q_m04(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", *_M02)
    return rd(M.scaling_check(M.standard_fit(c, _M02).apply(c), _M02))


_M05 = _M02


@register("m05_winsorize", sql_with(["cust"], "SELECT CustomerID, " + ", ".join(
    f"{r6(f'CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, b.lo_{c}), b.hi_{c}) END')} AS {c}" for c in _M05)
    + " FROM cust CROSS JOIN (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in _M05) + " FROM cust) b"))
def q_m05(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select("CustomerID", *_M05)
    return rd(M.winsorize_fit(c, _M05).apply(c))


#: Covariance matrix [a b; b d] of two features and its eigenvalues.
_TWO_EIGENVALUES = """e0 AS (SELECT var_samp(CAST(Recency AS DOUBLE)) AS a,
  covar_samp(CAST(Recency AS DOUBLE), CAST(Frequency AS DOUBLE)) AS b, var_samp(CAST(Frequency AS DOUBLE)) AS d FROM cust),
e AS (SELECT a, d, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l1,
  (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS l2 FROM e0)"""


@register("m06_pca_explained", sql_with(["cust"], f"""SELECT CAST(1 AS BIGINT) AS component, {r6('l1 / (a + d)')} AS explained_variance_ratio FROM e
  UNION ALL SELECT CAST(2 AS BIGINT), {r6('l2 / (a + d)')} FROM e""", extra=_TWO_EIGENVALUES))
def q_m06(spark: SparkSession, sf: str) -> DataFrame:
    """PCA of two features: explained-variance ratios (closed form in the oracle)."""
    c = customers(spark, sf).select(F.col("Recency").cast("double"), F.col("Frequency").cast("double"))
    return rd(M.pca_fit(c, ["Recency", "Frequency"]).explained(spark))


@register("w02b_components_for_two", sql_with(["cust"], "SELECT " + ", ".join(
    f"CAST(CASE WHEN l1 / (a + d) >= {t} THEN 1 ELSE 2 END AS BIGINT) AS n_components_{round(100 * t)}" for t in (0.7, 0.8, 0.9, 0.95)) + " FROM e", extra=_TWO_EIGENVALUES))
def q_w02b(spark: SparkSession, sf: str) -> DataFrame:
    """W02 on the two features of M06, whose eigenvalues SQL has in closed form."""
    c = customers(spark, sf).select(F.col("Recency").cast("double"), F.col("Frequency").cast("double"))
    return M.components_for(M.pca_fit(c, ["Recency", "Frequency"]).explained(spark), [0.7, 0.8, 0.9, 0.95])


def _k_for(spark: SparkSession, sf: str, t: float = 0.9) -> int:
    return int(M.components_for(pca_full(spark, sf).explained(spark), [t]).first()[0])


@register("m07_pca_project")
def q_m07(spark: SparkSession, sf: str) -> DataFrame:
    """Projection on the components that reach 90 % of the variance."""
    x, _ = pca_input(spark, sf)
    return M.pca_apply(pca_full(spark, sf), x, ["CustomerID", "Churn", "split"], _k_for(spark, sf))


@register("m08_pca_display")
def q_m08(spark: SparkSession, sf: str) -> DataFrame:
    """2-D and 3-D projections for display (first components of the same fit)."""
    x, _ = pca_input(spark, sf)
    p3 = M.pca_apply(pca_full(spark, sf), x, ["CustomerID", "Churn", "split"], 3)
    return p3.select("CustomerID", "Churn", "split", "PC1", "PC2", "PC3")


@register("m09_pca_loadings")
def q_m09(spark: SparkSession, sf: str) -> DataFrame:
    """Top 5 features per component (PC1-PC6) by |loading|, the top 8 of PC1-PC3
    (ranks up to 8), and the 20 features with the largest max |loading| over
    PC1-PC6 (component 0)."""
    ld = pca_full(spark, sf).loadings(spark).where("component <= 6")
    from pyspark.sql import Window
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    top = ld.withColumn("rank", F.row_number().over(w)).where("rank <= 5 or component <= 3 and rank <= 8")
    best = (ld.groupBy("feature").agg(F.max(F.abs("loading")).alias("loading"))
              .withColumn("component", F.lit(0).cast("long"))
              .withColumn("rank", F.row_number().over(Window.orderBy(F.col("loading").desc(), "feature")))
              .where("rank <= 20"))
    return rd(top.unionByName(best.select(*top.columns)))


@register("m10_preprocess", sql_with(["proc"], f"SELECT {sel_rounded(PROC_COLUMNS, PROC_D)} FROM proc"))
def q_m10(spark: SparkSession, sf: str) -> DataFrame:
    return rd(M.preprocess(customers(spark, sf), target="Churn").df)


@register("m11_cluster_prep_fit", sql_with(["cscaled"], "SELECT CustomerID, " + ", ".join(
    f"{r6(qi(c))} AS {qi(c)}" for c in CF) + " FROM cscaled"))
def q_m11(spark: SparkSession, sf: str) -> DataFrame:
    return rd(scaled_cached(spark, sf))


def _replay_sql() -> str:
    imp = knn_impute_ctes("kr", "proc", "CustomerID", CF, donors="cbase")
    lg = []
    for i, c in enumerate(CF):
        e = f"CASE WHEN {qi(c)} IS NULL THEN NULL ELSE least(greatest({qi(c)}, w.lo{i}), w.hi{i}) END"
        lg.append(f"ln(1 + greatest({e}, 0)) AS {qi(c)}" if c in LOGC else f"{e} AS {qi(c)}")
    logged = "rl AS (SELECT CustomerID, " + ", ".join(lg) + " FROM kr_out CROSS JOIN cw w)"
    scaled = "rscaled AS (SELECT CustomerID, " + ", ".join(
        f"({qi(c)} - s.med{i}) / (CASE WHEN s.iqr{i} = 0 THEN 1 ELSE s.iqr{i} END) AS {qi(c)}"
        for i, c in enumerate(CF)) + " FROM rl CROSS JOIN crs s)"
    return ",\n".join([imp, logged, scaled])


@register("m12_cluster_prep_replay", sql_with(["cscaled"], "SELECT CustomerID, " + ", ".join(
    f"{r6(qi(c))} AS {qi(c)}" for c in CF) + " FROM rscaled", extra=_replay_sql()))
def q_m12(spark: SparkSession, sf: str) -> DataFrame:
    prep, _ = cluster_fit(spark, sf)
    return rd(M.cluster_prep_apply(prep, processed(spark, sf)))


# --- C ----------------------------------------------------------------------------------------

_KCOLS = ["MonetaryTotal", "Recency", "Frequency"]


def _assigned_points(spark: SparkSession, sf: str) -> DataFrame:
    seg = segments_cached(spark, sf).select("CustomerID", "cluster")
    return scaled_cached(spark, sf).select("CustomerID", *_KCOLS).join(seg, "CustomerID")


def kmeans_model(spark: SparkSession, sf: str):
    return cached_object(spark, "kmeans", sf, lambda: C.kmeans_fit(scaled_cached(spark, sf), CF, 4, 20, 42))


@register("c01_kmeans_fit")
def q_c01(spark: SparkSession, sf: str) -> DataFrame:
    """Best of 20 seeded k-means runs (k = 4) on the nine scaled features."""
    m = kmeans_model(spark, sf)
    rows = [(i, *[float(v) for v in ctr], m.cost) for i, ctr in enumerate(m.centre_lists())]
    return spark.createDataFrame(rows, "cluster long, " + ", ".join(f"{c} double" for c in CF) + ", training_cost double")


def fitted_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Profile columns of every clustered customer with the cluster of the fitted
    k-means (nine scaled features)."""
    def build():
        a = C.kmeans_predict(kmeans_model(spark, sf), scaled_cached(spark, sf), CF).select("CustomerID", "cluster")
        base = processed(spark, sf).where(F.col("MonetaryTotal") > 0)
        return materialise_table(base.select("CustomerID", "Frequency", "MonetaryTotal", "CustomerTenureDays", "SatisfactionScore", "Churn", "Recency")
                                 .join(a, "CustomerID"), "fitted_segments")
    return cached_object(spark, "fitted_segments", sf, build)


@register("c11b_fitted_report")
def q_c11b(spark: SparkSession, sf: str) -> DataFrame:
    """The segment report over the fitted k-means: fit, label, report."""
    seg = fitted_segments(spark, sf)
    return C.segment_report(seg, segment_labels(spark, seg))


@register("c02_k_sweep")
def q_c02(spark: SparkSession, sf: str) -> DataFrame:
    """Inertia and silhouette for k = 2..8 on the first 10 principal components."""
    x, _ = pca_input(spark, sf)
    pcs = materialise_table(M.pca_apply(pca_full(spark, sf), x.where("split = 'train'"), ["CustomerID"], 10), "pcs")
    return C.k_sweep(spark, pcs, [f"PC{i}" for i in range(1, 11)], range(2, 9))


@register("c03_assign_fixed", sql_with(["cassign"], f"SELECT CustomerID, cluster, {r6('dist2')} AS dist2 FROM cassign"))
def q_c03(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.assign(scaled_cached(spark, sf), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS)
              .select("CustomerID", "cluster", "dist2"))


@register("c04_inertia", sql_with(["cassign"], f"SELECT {r6('sum(dist2)')} AS inertia FROM cassign"))
def q_c04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.inertia(C.assign(scaled_cached(spark, sf), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS)))


@register("c05_silhouette", sql_with(["pts"], f"""SELECT {r6('avg(coalesce(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 0))')} AS silhouette
FROM pts LEFT JOIN (SELECT k, max(CASE WHEN qc = c THEN s / n END) AS a, min(CASE WHEN qc <> c THEN s / n END) AS b FROM (
  SELECT p.k, p.c, q.c AS qc, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) AS s,
         count(*) AS n FROM pts p JOIN pts q ON p.k <> q.k GROUP BY p.k, p.c, q.c) GROUP BY k) r USING (k)"""))
def q_c05(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.silhouette_exact(_assigned_points(spark, sf), _KCOLS, "CustomerID"))


@register("c05c_silhouette_bounds")
def q_c05c(spark: SparkSession, sf: str) -> DataFrame:
    """The Euclidean silhouette over all clustering features, between certified bounds."""
    from custlens.operators.silhouette import silhouette_bounds
    points = C.assign(scaled_cached(spark, sf), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS)
    return silhouette_bounds(points, CF)


@register("c05b_silhouette_sq", sql_with(["pts"], f"""SELECT {r6('avg(CASE WHEN nown <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_sq
FROM (SELECT k, max(CASE WHEN sc = c THEN d * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN sc <> c THEN d END) AS b,
             max(CASE WHEN sc = c THEN n END) AS nown FROM (
  SELECT p.k, p.c, s.c AS sc, s.n, (p.x * p.x + p.y * p.y + p.z * p.z) - 2 * (p.x * s.mx + p.y * s.my + p.z * s.mz) + s.yy AS d
  FROM pts p CROSS JOIN (SELECT c, count(*) AS n, avg(x * x + y * y + z * z) AS yy, avg(x) AS mx, avg(y) AS my, avg(z) AS mz
                         FROM pts GROUP BY c) s) GROUP BY k)"""))
def q_c05b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.silhouette_sq(_assigned_points(spark, sf), _KCOLS))


@register("c06_davies_bouldin", sql_with(["pts"], f"""SELECT {r6('avg(r)')} AS davies_bouldin FROM (
  SELECT a.c, max((sa.s + sb.s) / sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my) + (a.mz - b.mz) * (a.mz - b.mz))) AS r
  FROM cen a JOIN cen b ON a.c <> b.c JOIN sc sa ON sa.c = a.c JOIN sc sb ON sb.c = b.c GROUP BY a.c)""",
    extra="""cen AS (SELECT c, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pts GROUP BY c),
sc AS (SELECT p.c, avg(sqrt((p.x - e.mx) * (p.x - e.mx) + (p.y - e.my) * (p.y - e.my) + (p.z - e.mz) * (p.z - e.mz))) AS s
  FROM pts p JOIN cen e ON e.c = p.c GROUP BY p.c)"""))
def q_c06(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.davies_bouldin(_assigned_points(spark, sf), _KCOLS))


@register("c07_calinski_harabasz", sql_with(["pts"], f"""SELECT {r6('(bw.b * (g.n - bw.k)) / (bw.w * (bw.k - 1))')} AS calinski_harabasz
FROM (SELECT count(*) AS n, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM pts) g,
LATERAL (SELECT count(*) AS k, sum(n * ((mx - g.gx) * (mx - g.gx) + (my - g.gy) * (my - g.gy) + (mz - g.gz) * (mz - g.gz))) AS b,
         sum(n * (vx + vy + vz)) AS w FROM (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz,
           var_pop(x) AS vx, var_pop(y) AS vy, var_pop(z) AS vz FROM pts GROUP BY c)) bw"""))
def q_c07(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.calinski_harabasz(_assigned_points(spark, sf), _KCOLS))


@register("c08_centroids", sql_with(["pts"], f"""SELECT c AS cluster, {r6('avg(x)')} AS MonetaryTotal, {r6('avg(y)')} AS Recency,
  {r6('avg(z)')} AS Frequency FROM pts GROUP BY c"""))
def q_c08(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.centroids_of(_assigned_points(spark, sf), _KCOLS))


# --- C03-C08 over all nine clustering features: the fixed clusters' means, one k-means step ---

def _gap(a: str, b: str) -> str:
    """Squared distance of two rows over the nine features."""
    return "(" + " + ".join(f"({a}.{qi(c)} - {b}.{qi(c)}) * ({a}.{qi(c)} - {b}.{qi(c)})" for c in CF) + ")"


def _means(prefix: str = "") -> str:
    return ", ".join(f"avg({prefix}{qi(c)}) AS {qi(c)}" for c in CF)


register_cte("pts9", f"""cstart AS (SELECT a.cluster, {_means("s.")} FROM cscaled s JOIN cassign a ON a.CustomerID = s.CustomerID GROUP BY a.cluster),
pts9 AS (SELECT * FROM (SELECT s.*, e.cluster, {_gap("s", "e")} AS dist2,
  row_number() OVER (PARTITION BY s.CustomerID ORDER BY {_gap("s", "e")}, e.cluster) AS place FROM cscaled s CROSS JOIN cstart e) WHERE place = 1),
cen9 AS (SELECT cluster, count(*) AS n, {_means()} FROM pts9 GROUP BY cluster)""", ["cscaled", "cassign"])


def _nine_points(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        start = C.assign(scaled_cached(spark, sf), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS)
        return materialise_table(C.reassign(start, CF).select("CustomerID", *CF, "cluster", "dist2"), "nine_points")
    return cached_object(spark, "nine_points", sf, build)


@register("c03b_assign_nine", sql_with(["pts9"], f"SELECT CustomerID, cluster, {r6('dist2')} AS dist2 FROM pts9"))
def q_c03b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(_nine_points(spark, sf).select("CustomerID", "cluster", "dist2"))


@register("c04b_inertia_nine", sql_with(["pts9"], f"SELECT {r6('sum(dist2)')} AS inertia FROM pts9"))
def q_c04b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.inertia(_nine_points(spark, sf)))


@register("c05d_silhouette_nine", sql_with(["pts9"], f"""SELECT {r6('avg(coalesce(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 0))')} AS silhouette
FROM pts9 LEFT JOIN (SELECT CustomerID, max(CASE WHEN qc = c THEN s / n END) AS a, min(CASE WHEN qc <> c THEN s / n END) AS b FROM (
  SELECT p.CustomerID, p.cluster AS c, q.cluster AS qc, sum(sqrt({_gap("p", "q")})) AS s, count(*) AS n
  FROM pts9 p JOIN pts9 q ON p.CustomerID <> q.CustomerID GROUP BY p.CustomerID, p.cluster, q.cluster) GROUP BY CustomerID) r USING (CustomerID)"""))
def q_c05d(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.silhouette_exact(_nine_points(spark, sf), CF, "CustomerID"))


@register("c05e_silhouette_sq_nine", sql_with(["pts9"], f"""SELECT {r6('avg(CASE WHEN nown <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette_sq
FROM (SELECT CustomerID, max(CASE WHEN sc = c THEN d * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN sc <> c THEN d END) AS b, max(CASE WHEN sc = c THEN n END) AS nown FROM (
  SELECT p.CustomerID, p.cluster AS c, e.cluster AS sc, e.n, {_gap("p", "e")} + w.v AS d FROM pts9 p CROSS JOIN cen9 e
  JOIN (SELECT p.cluster, avg({_gap("p", "e")}) AS v FROM pts9 p JOIN cen9 e ON e.cluster = p.cluster GROUP BY p.cluster) w ON w.cluster = e.cluster) GROUP BY CustomerID)"""))
def q_c05e(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.silhouette_sq(_nine_points(spark, sf), CF))


@register("c06b_davies_bouldin_nine", sql_with(["pts9"], f"""SELECT {r6('avg(r)')} AS davies_bouldin FROM (
  SELECT a.cluster, max((sa.s + sb.s) / sqrt({_gap("a", "b")})) AS r FROM cen9 a JOIN cen9 b ON a.cluster <> b.cluster
  JOIN sc9 sa ON sa.cluster = a.cluster JOIN sc9 sb ON sb.cluster = b.cluster GROUP BY a.cluster)""",
    extra=f"sc9 AS (SELECT p.cluster, avg(sqrt({_gap('p', 'e')})) AS s FROM pts9 p JOIN cen9 e ON e.cluster = p.cluster GROUP BY p.cluster)"))
def q_c06b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.davies_bouldin(_nine_points(spark, sf), CF))


@register("c07b_calinski_harabasz_nine", sql_with(["pts9"], f"""SELECT {r6('(b.between_ss * (b.n - b.k)) / (w.within_ss * (b.k - 1))')} AS calinski_harabasz
FROM (SELECT count(*) AS k, sum(e.n) AS n, sum(e.n * {_gap("e", "g")}) AS between_ss FROM cen9 e CROSS JOIN (SELECT {_means()} FROM pts9) g) b
CROSS JOIN (SELECT sum({_gap("p", "e")}) AS within_ss FROM pts9 p JOIN cen9 e ON e.cluster = p.cluster) w"""))
def q_c07b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.calinski_harabasz(_nine_points(spark, sf), CF))


@register("c08b_centroids_nine", sql_with(["pts9"], "SELECT cluster, " + ", ".join(f"{r6(qi(c))} AS {qi(c)}" for c in CF) + " FROM cen9"))
def q_c08b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.centroids_of(_nine_points(spark, sf), CF))


_PROF = ["MonetaryTotal", "Recency", "Frequency", "Churn", "SatisfactionScore"]


@register("c09_cluster_profile", sql_with(["clabels"], "SELECT s.cluster, l.label, " + ", ".join(
    f"{r6(f'avg(CAST(s.{c} AS DOUBLE))')} AS {c}" for c in _PROF) + """, CAST(count(*) AS BIGINT) AS n_clients
  FROM cseg s JOIN clabels l ON l.cluster = s.cluster GROUP BY s.cluster, l.label"""))
def q_c09(spark: SparkSession, sf: str) -> DataFrame:
    seg = segments_cached(spark, sf).withColumn("Churn", F.col("Churn").cast("double"))
    prof = C.cluster_profile(seg, _PROF)
    return rd(prof.join(segment_labels_cached(spark, sf), "cluster"))


@register("c10_validate_segments", sql_with(["clabels"], f"""SELECT label, {r6('churn_rate')} AS churn_rate, n_clients,
  CASE WHEN label IN ('VIP', 'Fidele') AND churn_rate < 0.4 THEN '[OK]' WHEN label IN ('Occasionnel', 'A Risque') THEN '[OK]'
       ELSE '[!]' END AS status FROM (
  SELECT l.label, avg(CAST(s.Churn AS DOUBLE)) AS churn_rate, CAST(count(*) AS BIGINT) AS n_clients
  FROM cseg s JOIN clabels l ON l.cluster = s.cluster GROUP BY l.label)"""))
def q_c10(spark: SparkSession, sf: str) -> DataFrame:
    seg = segments_cached(spark, sf).join(segment_labels_cached(spark, sf), "cluster")
    return rd(C.validate_segments(seg))


@register("c12_churn_by_cluster", sql_with(["cseg"], f"""SELECT cluster, {r6('r')} AS churn_rate, {r6('g')} AS global_churn_rate,
  {r6('r - g')} AS delta FROM (SELECT cluster, avg(CAST(Churn AS DOUBLE)) AS r FROM cseg GROUP BY cluster)
  CROSS JOIN (SELECT avg(CAST(Churn AS DOUBLE)) AS g FROM cseg)"""))
def q_c12(spark: SparkSession, sf: str) -> DataFrame:
    return rd(C.churn_by_cluster(segments_cached(spark, sf)))


# --- G ------------------------------------------------------------------------------------------

def spend_split(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        sp = R.random_split(customers(spark, sf).select("CustomerID"), 0.2, 42)
        return materialise_table(processed(spark, sf).join(sp, "CustomerID"), "spend_split")
    return cached_object(spark, "spend_split", sf, build)


def spend_model(spark: SparkSession, sf: str) -> G.SpendModel:
    return cached_object(spark, "spend_model", sf, lambda: G.train_spend(
        spend_split(spark, sf).where("split = 'train'").drop("split")))


@register("g01_train_spend")
def q_g01(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of the OLS spend model (robust scaling, as the script)."""
    test = spend_split(spark, sf).where("split = 'test'")
    return G.predict_spend(spend_model(spark, sf), test, keep=["MonetaryTotal"])


_SPEND_METRICS = f"""SELECT {r6('1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*))')} AS r2,
  {r6('avg(abs(actual - predicted))')} AS mae, {r6('sqrt(sum((actual - predicted) * (actual - predicted)) / count(*))')} AS rmse FROM spend"""


@register("g02_regression_metrics", sql_with(["spend"], _SPEND_METRICS))
def q_g02(spark: SparkSession, sf: str) -> DataFrame:
    return rd(G.regression_metrics(spend_standin(spark, sf)))


@register("g03_residuals", sql_with(["spend"], f"""SELECT CustomerID, {r6('actual')} AS actual, {r6('predicted')} AS predicted,
  {r6('actual - predicted')} AS residual FROM spend"""))
def q_g03(spark: SparkSession, sf: str) -> DataFrame:
    return rd(G.residuals(spend_standin(spark, sf), "CustomerID"))


@register("g03b_residual_ranges", sql_with(["spend"], "SELECT " + ", ".join(
    f"{r6(f'{f}({e})')} AS {f}_{n}" for n, e in [("actual", "actual"), ("predicted", "predicted"),
                                                  ("residual", "actual - predicted")] for f in ["min", "max"]) + " FROM spend"))
def q_g03b(spark: SparkSession, sf: str) -> DataFrame:
    return rd(G.residual_ranges(G.residuals(spend_standin(spark, sf), "CustomerID")))


@register("g04_residual_stats", sql_with(["spend"], f"""SELECT {r6('m')} AS residual_mean, {r6('s')} AS residual_std,
  (SELECT CAST(count_if(abs(actual - predicted) > 2 * s) AS BIGINT) FROM spend) AS n_beyond_2sigma
  FROM (SELECT avg(actual - predicted) AS m, stddev_pop(actual - predicted) AS s FROM spend)"""))
def q_g04(spark: SparkSession, sf: str) -> DataFrame:
    return rd(G.residual_stats(G.residuals(spend_standin(spark, sf), "CustomerID")))


@register("g05_cross_val_r2")
def q_g05(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a target are in no fold."""
    tr = spend_split(spark, sf).where("split = 'train'").drop("split")
    m = spend_model(spark, sf)
    x = m.scaler.apply(M.knn_impute_apply(m.imputer, tr.select("CustomerID", "MonetaryTotal", *[
        F.col(f"`{c}`").cast("double").alias(c) for c in m.features])))
    return G.cross_val_r2(spark, x, m.features, "MonetaryTotal")


#: One feature, so that SQL's regr_* fit the same lines.
_G05B = sql_with(["proc"], f"""
SELECT t.fold, {r6("1 - sum((MonetaryTotal - (l.b0 + l.b * Frequency)) * (MonetaryTotal - (l.b0 + l.b * Frequency))) / (var_pop(MonetaryTotal) * count(*))")} AS r2
FROM folded t JOIN lines l ON l.fold = t.fold GROUP BY t.fold""", extra="""
folded AS (SELECT MonetaryTotal, CAST(Frequency AS DOUBLE) AS Frequency, CAST((row_number() OVER (ORDER BY (CustomerID * 7919 + 42) % 10007, CustomerID) - 1) % 5 AS BIGINT) AS fold
  FROM proc WHERE MonetaryTotal IS NOT NULL AND Frequency IS NOT NULL),
lines AS (SELECT f.fold, regr_slope(t.MonetaryTotal, t.Frequency) AS b, regr_intercept(t.MonetaryTotal, t.Frequency) AS b0
  FROM (SELECT DISTINCT fold FROM folded) f JOIN folded t ON t.fold <> f.fold GROUP BY f.fold)""")


@register("g05b_cross_val_r2_one", _G05B)
def q_g05b(spark: SparkSession, sf: str) -> DataFrame:
    """G05 on one feature: MonetaryTotal on Frequency."""
    return rd(G.cross_val_r2(spark, processed(spark, sf), ["Frequency"], "MonetaryTotal"))


@register("g06_target_stats", sql_with(["proc"], f"""SELECT {r6('avg(MonetaryTotal)')} AS mean, {r6('stddev_samp(MonetaryTotal)')} AS std,
  {r6('min(MonetaryTotal)')} AS min, {r6('max(MonetaryTotal)')} AS max FROM proc"""))
def q_g06(spark: SparkSession, sf: str) -> DataFrame:
    return rd(G.target_stats(processed(spark, sf)))


# --- O --------------------------------------------------------------------------------------------

def artefacts(spark: SparkSession, sf: str, models: tuple[str, ...] = ("churn", "spend", "segment")) -> O.Artefacts:
    """Stored state for scoring, with the models asked for and no other: "segment" is the
    fitted k-means with its labels, without it the fixed centroids that SQL can replay."""
    def build():
        proc = processed(spark, sf)
        prep, _ = cluster_fit(spark, sf)
        types = {f.name: f.dataType for f in proc.schema.fields}
        base = (proc.columns, preprocessed(spark, sf).vocab, prep)
        churn = churn_model(spark, sf) if "churn" in models else None
        spend = spend_model(spark, sf) if "spend" in models else None
        if "segment" not in models:
            return O.Artefacts(*base, C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS, segment_labels_cached(spark, sf), churn, spend, types)
        seg = fitted_segments(spark, sf)
        centres = kmeans_model(spark, sf).centre_lists()
        return O.Artefacts(*base, centres, CF, segment_labels(spark, seg), churn, spend, types)
    return cached_object(spark, f"artefacts-{models}", sf, build)


def _raw_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a raw record, without the label."""
    return customers(spark, sf).drop("Churn")


@register("o01_score_churn")
def q_o01(spark: SparkSession, sf: str) -> DataFrame:
    return O.score_churn(_raw_all(spark, sf), artefacts(spark, sf, ("churn",)))


@register("o02_score_spend")
def q_o02(spark: SparkSession, sf: str) -> DataFrame:
    return O.score_spend(_raw_all(spark, sf), artefacts(spark, sf, ("spend",)))


@register("o03_score_segment", sql_with(["clabels"], """SELECT r.CustomerID, r.cluster AS cluster_id,
  coalesce(l.label, 'Inconnu') AS cluster_label FROM ra r LEFT JOIN clabels l ON l.cluster = r.cluster""",
    extra=_replay_sql() + """,
ra AS (SELECT CustomerID, CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1
  WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster FROM (SELECT CustomerID, """ + ", ".join(
        f"(MonetaryTotal - ({m})) * (MonetaryTotal - ({m})) + (Recency - ({r})) * (Recency - ({r})) + (Frequency - ({f})) * (Frequency - ({f})) AS d{j}"
        for j, (m, r, f) in enumerate(C.FIXED_CENTROIDS)) + " FROM rscaled))"))
def q_o03(spark: SparkSession, sf: str) -> DataFrame:
    """Segment of every processed customer from the stored preparation."""
    return O.score_segment(processed(spark, sf), artefacts(spark, sf, ()))


@register("o04_score_all")
def q_o04(spark: SparkSession, sf: str) -> DataFrame:
    return O.score_all(_raw_all(spark, sf), artefacts(spark, sf))


@register("o05_score_batch")
def q_o05(spark: SparkSession, sf: str) -> DataFrame:
    """File to file, from artefacts that were saved and loaded."""
    d = scratch_path(spark, f"o05-{uuid.uuid4().hex[:8]}")
    raw = _raw_all(spark, sf)
    io.write_table(raw, d + "/in")
    O.save_scoring(spark, d + "/store", artefacts(spark, sf))
    return O.score_batch(spark, d + "/in", d + "/out", O.load_scoring(spark, d + "/store"), schema=raw.schema)


@register("o06_headline", sql_with(["spend", "scored", "proc"], f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM proc) AS n_clients,
  CAST({len(PROC_COLUMNS)} AS BIGINT) AS n_features,
  (SELECT round_even(avg(CAST(Churn AS DOUBLE)) * 100, 1) FROM proc) AS churn_rate_pct,
  (SELECT {r6('auc')} FROM {auc_sql('(SELECT Churn AS y, p FROM scored)')}) AS auc,
  (SELECT {r6('2.0 * count_if(Churn = 1 AND p >= 0.5) / (2.0 * count_if(Churn = 1 AND p >= 0.5) + count_if(Churn = 0 AND p >= 0.5) + count_if(Churn = 1 AND p < 0.5))')} FROM scored) AS f1,
  (SELECT {r6('1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*))')} FROM spend) AS r2,
  CAST(4 AS BIGINT) AS n_clusters"""))
def q_o06(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    auc = W.roc_auc(s, "Churn", "p").first()[0]
    f1 = W.classification_report(s, "Churn", "pred").where("label = '1'").first()["f1_score"]
    r2 = G.regression_metrics(spend_standin(spark, sf)).first()["r2"]
    proc = processed(spark, sf)
    return rd(O.headline(spark, proc, len(proc.columns), {"auc": auc, "f1": f1, "r2": r2}, 4))


@register("o07_recap", sql_with(["spend", "scored", "pts"], f"""
SELECT 'KMeans' AS model, 'Clustering' AS task, 'inertia' AS metric_1, {r6('(SELECT sum(dist2) FROM cassign)')} AS value_1,
  'n_clusters' AS metric_2, CAST(4 AS DOUBLE) AS value_2, 'OK' AS verdict
UNION ALL SELECT 'RandomForest', 'Classification', 'roc_auc', {r6('a.auc')}, 'accuracy',
  (SELECT {r6('count_if((p >= 0.5) = (Churn = 1)) / count(*)')} FROM scored),
  CASE WHEN a.auc > 0.98 THEN 'Fuite possible' ELSE 'OK' END FROM {auc_sql('(SELECT Churn AS y, p FROM scored)')} a
UNION ALL SELECT 'LinearRegression', 'Regression', 'r2', {r6('r2')}, 'mae', {r6('mae')},
  CASE WHEN r2 >= 0.7 THEN 'Bon' WHEN r2 >= 0.5 THEN 'Acceptable' ELSE 'Faible' END FROM (
  SELECT 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2,
         avg(abs(actual - predicted)) AS mae FROM spend)"""))
def q_o07(spark: SparkSession, sf: str) -> DataFrame:
    """One row per model with two metrics and a verdict (metrics from the
    deterministic stand-ins so the table is exactly reproducible)."""
    s = scored(spark, sf)
    inertia = C.inertia(C.assign(scaled_cached(spark, sf), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS)).first()[0]
    auc = W.roc_auc(s, "Churn", "p").first()[0]
    acc = W.confusion(s, "Churn", "pred").first()["accuracy"]
    g = G.regression_metrics(spend_standin(spark, sf)).first()
    t = O.recap(spark, [("KMeans", "Clustering", "inertia", inertia, "n_clusters", 4.0, "OK"),
                        ("RandomForest", "Classification", "roc_auc", auc, "accuracy", acc, None),
                        ("LinearRegression", "Regression", "r2", g["r2"], "mae", g["mae"], None)])
    v = (F.when(F.col("model") == "RandomForest", S.verdict_auc(F.col("value_1")))
          .when(F.col("model") == "LinearRegression", S.verdict_r2(F.col("value_1")))
          .otherwise(F.col("verdict")))
    return rd(t.withColumn("verdict", v))
