"""Registered queries: one per operator of the inventory, each a Spark job
over the provided tables, most with a DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions import scalars as S
from custlens.functions.scalars import round_even as _re

from custlens.operators import clustering as C
from custlens.operators import features as M
from custlens.plans import sqlgen  # noqa: F401  (registers oracle CTEs)
from custlens.plans.fixture import customer_fixture, sql_with
from custlens.session import cut_lineage, materialise_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c, d: int = 6):
    """Round doubles before value hashing (half-even on both sides)."""
    c = F.col(c) if isinstance(c, str) else c
    return _re(c.cast("double"), d)


def rd(df: DataFrame, d: int = 6) -> DataFrame:
    """Round every double column half-even (the oracle does the same)."""
    return df.select(*[_re(F.col(f"`{f.name}`"), d).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


# ---------------------------------------------------------------------------
# shared building blocks (per session + sf, so repeated queries reuse them)
# ---------------------------------------------------------------------------

_MATERIALISED: dict[tuple, DataFrame] = {}


def _materialise(spark: SparkSession, name: str, sf: str, build) -> DataFrame:
    """Build once per session and scale, and cut the lineage with a reliable
    checkpoint: later passes (fits, quantile rounds, reports) re-read it."""
    key = (id(spark), spark.sparkContext.applicationId, name, sf)
    if key not in _MATERIALISED:
        _MATERIALISED[key] = materialise_table(build(), name)
    return _MATERIALISED[key]


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return _materialise(spark, "customers", sf, lambda: customer_fixture(spark, sf))


def preprocessed(spark: SparkSession, sf: str) -> M.Preprocessed:
    """The fitted preprocessing (M10) once per session: its frame feeds
    ``processed`` and its one-hot vocabulary the scoring artefacts."""
    return cached_object(spark, "preprocessed", sf, lambda: M.preprocess(customers(spark, sf), target="Churn"))


def processed(spark: SparkSession, sf: str) -> DataFrame:
    return _materialise(spark, "processed", sf, lambda: preprocessed(spark, sf).df)


_OBJECTS: dict[tuple, object] = {}


def cached_object(spark: SparkSession, name: str, sf: str, build):
    """Fitted objects (params, models) built once per session and scale."""
    key = (id(spark), spark.sparkContext.applicationId, name, sf)
    if key not in _OBJECTS:
        _OBJECTS[key] = build()
    return _OBJECTS[key]


def cluster_fit(spark: SparkSession, sf: str):
    """M11 on processed rows with MonetaryTotal > 0: (ClusterPrep, scaled rows)."""
    def build():
        base = processed(spark, sf).where(F.col("MonetaryTotal") > 0)
        prep, scaled = M.cluster_prep_fit(base)
        return prep, materialise_table(scaled, "cluster_scaled")
    return cached_object(spark, "cluster_fit", sf, build)


def cluster_segments(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed rows with MonetaryTotal > 0, their scaled clustering features
    (M11 fit) and the fixed-centroid assignment joined to the profile columns."""
    proc = processed(spark, sf)
    base = proc.where(F.col("MonetaryTotal") > 0)
    _, scaled = cluster_fit(spark, sf)
    assigned = C.assign(scaled, C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS)
    seg = (base.select("CustomerID", "Frequency", "MonetaryTotal", "CustomerTenureDays",
                       "SatisfactionScore", "Churn", "Recency")
               .join(assigned.select("CustomerID", "cluster", "dist2"), "CustomerID"))
    return base, scaled, seg


def segments_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The assigned segment rows of ``cluster_segments``, built once per session."""
    return _materialise(spark, "segments", sf, lambda: cluster_segments(spark, sf)[2])


def scaled_cached(spark: SparkSession, sf: str) -> DataFrame:
    return _materialise(spark, "scaled", sf, lambda: cluster_segments(spark, sf)[1])


def segment_labels_cached(spark: SparkSession, sf: str) -> DataFrame:
    return _materialise(spark, "labels", sf, lambda: segment_labels(spark, segments_cached(spark, sf)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic score stand-in: p = .6 * ((k * 7919) % 97) / 97 + .4 * Churn."""
    c = customers(spark, sf)
    k = F.col("CustomerID")
    p = F.lit(0.6) * ((k * 7919) % 97) / F.lit(97.0) + F.lit(0.4) * F.col("Churn")
    return (c.select("CustomerID", "Churn", p.alias("p"))
             .withColumn("pred", F.when(F.col("p") >= 0.5, 1).otherwise(0).cast("bigint")))


def spend_standin(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic regression output: 1.1 * MonetaryTotal + (k % 13) * 100."""
    p = processed(spark, sf)
    return p.select("CustomerID", F.col("MonetaryTotal").alias("actual"),
                    (F.lit(1.1) * F.col("MonetaryTotal") + ((F.col("CustomerID") % 13) * 100).cast("double"))
                    .alias("predicted"))


def segment_labels(spark: SparkSession, seg: DataFrame, k: int = 4) -> DataFrame:
    ids = spark.range(k).select(F.col("id").alias("cluster"))
    prof = ids.join(C.cluster_profile(seg, ["MonetaryTotal"]), "cluster", "left")
    return C.label_clusters(prof.withColumn("MonetaryTotal", F.coalesce("MonetaryTotal", F.lit(float("-inf")))))


# ---------------------------------------------------------------------------
# C11 flagship: segment report
# ---------------------------------------------------------------------------

def _mean(c: str) -> str:
    return f"coalesce(round_even(g.{c}, 2), 0)"


def _printed(e: str, d: int) -> str:
    return f"printf('%.{d}f', round_even({e}, {d}))"


_SHARE = "round_even(coalesce(g.n, 0) * CAST(100 AS DOUBLE) / t.total, 1)"
_CHURN_PCT = f"round_even({_mean('churn')} * CAST(100 AS DOUBLE), 1)"

_SEG_REPORT_SQL = sql_with(["clabels"], f"""
SELECT l.cluster AS cluster_id, l.label,
  {sqlgen.sql_lookup("l.label", S.SEGMENT_DISPLAY, S.DEFAULT_DISPLAY)} AS segment_name,
  CAST(coalesce(g.n, 0) AS BIGINT) AS n_clients, {_SHARE}::DOUBLE AS share_pct, {_CHURN_PCT}::DOUBLE AS churn_pct,
  {_mean("freq")}::DOUBLE AS frequency, {_mean("mon")}::DOUBLE AS monetary, {_mean("ten")}::DOUBLE AS tenure_days, {_mean("sat")}::DOUBLE AS satisfaction,
  {sqlgen.sql_lookup("l.label", S.SEGMENT_ACTIONS, S.DEFAULT_ACTION)} AS action,
  printf('%d clients (%s%%)', CAST(coalesce(g.n, 0) AS BIGINT), printf('%.1f', {_SHARE})) AS size_text,
  printf('%.1f', {_CHURN_PCT}) || '%' AS churn_text,
  printf('%.2f', {_mean("sat")}) || '/5' AS satisfaction_text,
  {_printed(_mean("freq"), 1)} || ' achats' AS frequency_text,
  {_printed(_mean("mon"), 0)} || ' €' AS monetary_text,
  {_printed(_mean("ten"), 0)} || ' jours' AS tenure_text,
  'Priorité : ' || l.label AS badge,
  {sqlgen.sql_lookup("l.label", S.SEGMENT_CHURN_LEVEL, S.DEFAULT_CHURN_LEVEL)} AS churn_level
FROM clabels l
LEFT JOIN (SELECT cluster, count(*) AS n, avg(Frequency) AS freq, avg(MonetaryTotal) AS mon,
                  avg(CustomerTenureDays) AS ten, avg(SatisfactionScore) AS sat,
                  avg(CAST(Churn AS DOUBLE)) AS churn
           FROM cseg GROUP BY cluster) g ON g.cluster = l.cluster
CROSS JOIN (SELECT count(*) AS total FROM cseg) t
""")


@register("c11_segment_report", _SEG_REPORT_SQL)
def q_segment_report(spark: SparkSession, sf: str) -> DataFrame:
    """The stored preparation is replayed on the customers, then assignment,
    labels and report."""
    prep, _ = cluster_fit(spark, sf)
    base = processed(spark, sf).where(F.col("MonetaryTotal") > 0)
    a = C.assign(M.cluster_prep_apply(prep, base), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS).select("CustomerID", "cluster")
    seg = materialise_table(base.select("CustomerID", "Frequency", "MonetaryTotal", "CustomerTenureDays", "SatisfactionScore", "Churn")
                            .join(a, "CustomerID"), "report_segments")
    return C.segment_report(seg, segment_labels(spark, seg))


def _load_all() -> None:
    """Import the query modules so their ``register`` calls run."""
    from custlens.plans import q_tables  # noqa: F401
    from custlens.plans import q_scalar  # noqa: F401
    from custlens.plans import q_profile  # noqa: F401
    from custlens.plans import q_models  # noqa: F401


_load_all()
