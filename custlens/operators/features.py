"""Feature transforms with fitted state.

Fitted state is small (one value per feature, or a donor DataFrame that
stays distributed); it converts to/from a DataFrame for the artefact store.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlens.functions import scalars as S
from custlens.operators.knn_wide import wide_candidates
from custlens.operators.quantiles import exact_quantiles
from custlens.operators.schema import drop_constant_columns, null_sentinels

# --- M01: KNN imputation -----------------------------------------------------


@dataclass
class KnnImputer:
    cols: list[str]
    key: str
    k: int
    donors: DataFrame            # fit rows: key + cols (stays distributed)
    means: dict[str, float | None]


def knn_impute_fit(df: DataFrame, cols: list[str], key: str, k: int = 5) -> KnnImputer:
    donors = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    row = donors.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return KnnImputer(cols, key, k, donors, {c: row[c] for c in cols})


def knn_impute_apply(model: KnnImputer, df: DataFrame) -> DataFrame:
    """Each missing cell becomes the mean of that feature over the k nearest
    donors having it (NaN-aware Euclidean over the coordinates both rows
    have; ties by donor key); with no comparable donor, the fit mean.

    Candidates per (receiver, missing feature) come from the block co-group
    kernel; donors with nothing in common are never candidates (they hold a
    slot but carry no weight in the reference)."""
    cols, key, k = model.cols, model.key, model.k
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    receivers = df.where(any_null).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    w = Window.partitionBy("_qk", "_f").orderBy(F.col("_dist").asc_nulls_last(), "_dk")
    top = (wide_candidates(receivers, model.donors, key, key, cols, k, per_feature=True)
           .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k))
    filled = top.groupBy("_qk").agg(*[F.avg(F.when(F.col("_f") == i, F.col("_v"))).alias(f"_imp_{i}")
                                      for i in range(len(cols))])
    filled = filled.withColumnRenamed("_qk", key)
    # receivers are a subset of df: AQE turns this into a broadcast join when
    # the runtime size is small and keeps a shuffle join otherwise
    out = df.join(filled, key, "left")
    repl = {}
    for i, c in enumerate(cols):
        mean = model.means[c]
        repl[c] = F.coalesce(F.col(c).cast("double"), F.col(f"_imp_{i}"),
                             F.lit(mean).cast("double"))
    return out.withColumns(repl).drop(*[f"_imp_{i}" for i in range(len(cols))])


# --- M02/M03/M05: scalers and winsorising --------------------------------------


@dataclass
class ColumnAffine:
    """x -> (x - center) / scale per column (robust or standard scaling)."""
    center: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c])
                               for c in self.center if c in df.columns})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, self.center[c], self.scale[c]) for c in self.center],
                                     "feature string, center double, scale double")

    @staticmethod
    def from_frame(df: DataFrame) -> "ColumnAffine":
        rows = df.collect()  # one row per feature
        return ColumnAffine({r.feature: r.center for r in rows}, {r.feature: r.scale for r in rows})


def robust_fit(df: DataFrame, cols: list[str]) -> ColumnAffine:
    """centre = median, scale = Q3 - Q1 (0 -> 1), exact quantiles."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    center, scale = {}, {}
    for c in cols:
        med = q[(c, 0.5)]
        iqr = (q[(c, 0.75)] - q[(c, 0.25)]) if med is not None else None
        center[c] = med if med is not None else 0.0
        scale[c] = iqr if iqr not in (None, 0.0) else 1.0
    return ColumnAffine(center, scale)


def standard_fit(df: DataFrame, cols: list[str]) -> ColumnAffine:
    """centre = mean, scale = population std (0 -> 1)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    center = {c: (row[f"m_{i}"] if row[f"m_{i}"] is not None else 0.0) for i, c in enumerate(cols)}
    scale = {c: (row[f"s_{i}"] if row[f"s_{i}"] not in (None, 0.0) else 1.0) for i, c in enumerate(cols)}
    return ColumnAffine(center, scale)


def scaling_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population std of all scaled values together."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    return long.agg(F.avg("v").alias("global_mean"), F.stddev_pop("v").alias("global_std"))


@dataclass
class ClipBounds:
    bounds: dict[str, tuple[float | None, float | None]]

    def apply(self, df: DataFrame) -> DataFrame:
        return S.clip(df, self.bounds)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in self.bounds.items()],
                                     "feature string, lo double, hi double")

    @staticmethod
    def from_frame(df: DataFrame) -> "ClipBounds":
        return ClipBounds({r.feature: (r.lo, r.hi) for r in df.collect()})  # one row per feature


def winsorize_fit(df: DataFrame, cols: list[str], lo: float = 0.01, hi: float = 0.99) -> ClipBounds:
    """Learn p1/p99 (linear interpolation)."""
    q = exact_quantiles(df, cols, [lo, hi])
    return ClipBounds({c: (q[(c, lo)], q[(c, hi)]) for c in cols})


# --- M06-M09: PCA -----------------------------------------------------------


@dataclass
class PcaFit:
    cols: list[str]
    centre: ColumnAffine
    model: object               # pyspark.ml.feature.PCAModel
    k: int

    def explained(self, spark: SparkSession) -> DataFrame:
        ev = [float(x) for x in self.model.explainedVariance.toArray()]
        return spark.createDataFrame([(i + 1, v) for i, v in enumerate(ev)],
                                     "component long, explained_variance_ratio double")

    def loadings(self, spark: SparkSession) -> DataFrame:
        pc = self.model.pc.toArray()
        rows = [(f, j + 1, float(pc[i, j])) for i, f in enumerate(self.cols) for j in range(pc.shape[1])]
        return spark.createDataFrame(rows, "feature string, component long, loading double")


def pca_fit(df: DataFrame, cols: list[str], k: int | None = None) -> PcaFit:
    """PCA on centred input (Spark's PCA does not centre), over the rows that have
    every column."""
    df = df.dropna(subset=cols)
    centre = standard_fit(df, cols)
    centre = ColumnAffine(centre.center, {c: 1.0 for c in cols})
    vec = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="error") \
        .transform(centre.apply(df))
    k = k or len(cols)
    model = PCA(k=k, inputCol="_features", outputCol="_pcs").fit(vec)
    return PcaFit(cols, centre, model, k)


def pca_apply(fit: PcaFit, df: DataFrame, keep: list[str], k: int | None = None) -> DataFrame:
    """Project onto the first k components, as PC1..PCk columns."""
    k = k or fit.k
    vec = VectorAssembler(inputCols=fit.cols, outputCol="_features").transform(fit.centre.apply(df))
    out = fit.model.transform(vec).select(*keep, vector_to_array("_pcs").alias("_a"))
    return out.select(*keep, *[F.col("_a")[j].alias(f"PC{j + 1}") for j in range(k)])


def components_for(explained: DataFrame, thresholds=(0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """Cumulative explained variance and components needed per threshold.
    The input has one row per component (bounded by the feature count)."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = explained.withColumn("cumulative", F.sum("explained_variance_ratio").over(w))
    return cum.agg(*[F.min(F.when(F.col("cumulative") >= t, F.col("component"))).alias(
        f"n_components_{int(round(t * 100))}") for t in thresholds])


# --- M10: preprocessing chain ----------------------------------------------------

# Sentinel codes that mean "missing".
SENTINELS = {"SupportTicketsCount": [-1, 999], "SatisfactionScore": [-1, 99]}


@dataclass
class Preprocessed:
    df: DataFrame
    vocab: list[tuple[str, str]] = field(default_factory=list)
    dropped_constant: list[str] = field(default_factory=list)


def preprocess(df: DataFrame, target: str | None = None, drop_constant: bool = True,
               vocab: list[tuple[str, str]] | None = None,
               ordinal_maps=S.ORDINAL_MAPS_LIBRARY) -> Preprocessed:
    """Constants -> sentinels -> dates -> IP -> basket -> encodings."""
    dropped: list[str] = []
    if drop_constant:
        df, dropped = drop_constant_columns(df)
    df = null_sentinels(df, SENTINELS)
    if "RegistrationDate" in df.columns:
        df = S.date_parts(df, "RegistrationDate")
    if "LastLoginIP" in df.columns:
        df = S.ip_features(df, "LastLoginIP")
    df = S.avg_basket(df)
    df = S.ordinal_encode(df, ordinal_maps)
    df, vocab = S.one_hot(df, S.ONE_HOT_COLS, vocab)
    if "Country" in df.columns:
        if target and target in df.columns:
            df = S.target_encode(df, "Country", target)
        else:
            df = df.drop("Country")
    return Preprocessed(df, vocab, dropped)


# --- M11/M12: clustering preparation ---------------------------------------------

# The nine clustering features and the five log-transformed ones.
CLUSTERING_FEATURES = ["Recency", "Frequency", "MonetaryTotal", "SatisfactionScore",
                       "ReturnRatio", "UniqueProducts", "AvgDaysBetweenPurchases",
                       "Age", "SupportTicketsCount"]
LOG_COLS_CLUSTERING = ["Recency", "Frequency", "MonetaryTotal", "UniqueProducts",
                       "AvgDaysBetweenPurchases"]


@dataclass
class ClusterPrep:
    imputer: KnnImputer
    clip: ClipBounds
    scaler: ColumnAffine
    features: list[str]
    log_cols: list[str]


def cluster_prep_fit(df: DataFrame, key: str = "CustomerID", persist: bool = True) -> tuple[ClusterPrep, DataFrame]:
    """Filter MonetaryTotal > 0, nine features, KNN-impute, winsorise,
    log1p (no floor, as in training), robust scale.  Returns the params and
    the scaled training rows (key + features)."""
    from custlens.session import cut_lineage
    base = df.where(F.col("MonetaryTotal") > 0)
    feats = [c for c in CLUSTERING_FEATURES if c in base.columns]
    x = base.select(key, *[F.col(c).cast("double").alias(c) for c in feats])
    imp = knn_impute_fit(x, feats, key)
    xi = knn_impute_apply(imp, x)
    if persist:
        xi = cut_lineage(xi)
    clipb = winsorize_fit(xi, feats)
    xl = S.log1p_cols(clipb.apply(xi), LOG_COLS_CLUSTERING)
    scaler = robust_fit(xl, feats)
    return ClusterPrep(imp, clipb, scaler, feats, LOG_COLS_CLUSTERING), scaler.apply(xl)


def cluster_prep_apply(prep: ClusterPrep, df: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Replay stored params (log floors at 0, as at scoring)."""
    x = df.select(key, *[F.col(c).cast("double").alias(c) for c in prep.features])
    xi = knn_impute_apply(prep.imputer, x)
    xl = S.log1p_cols(prep.clip.apply(xi), prep.log_cols, floor=True)
    return prep.scaler.apply(xl)
