"""Spend regression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.operators import features as M
from custlens.operators.gram import Moments, group_moments, held_out_r2, least_squares
from custlens.operators.sampling import assign_folds
from custlens.operators.schema import numeric_columns
from custlens.session import cut_lineage


@dataclass
class LinearModel:
    """Coefficients by feature, intercept, and the rows the fit used and left out."""
    coefficients: dict[str, float]
    intercept: float
    n_rows: int = 0
    n_dropped: int = 0

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """One expression over the features; a feature of weight 0 is not read."""
        terms = [F.col(f"`{c}`") * F.lit(w) for c, w in self.coefficients.items() if w != 0.0]
        return df.withColumn(out, reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))


@dataclass
class SpendModel:
    features: list[str]
    imputer: M.KnnImputer
    scaler: M.ColumnAffine
    line: LinearModel


def spend_features(df: DataFrame, key: str = "CustomerID", target: str = "MonetaryTotal",
                   drop_churn: bool = False) -> list[str]:
    drop = {key, target} | ({"Churn"} if drop_churn else set())
    return [c for c in numeric_columns(df) if c not in drop]


def fit_line(df: DataFrame, feats: list[str], target: str) -> LinearModel:
    """Least squares by one scan for the Gram matrix, of least norm where features are
    collinear.  Rows without a target or a feature are left out and counted; a feature
    that no row has gets 0.  Without a row everything is 0."""
    # NaN counts as missing; a feature without any value would leave no row
    have = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"c{i}") for i, c in enumerate(feats)]).first()
    used = [c for i, c in enumerate(feats) if have[f"c{i}"]]
    m = group_moments(df, [*used, target]).get("")
    if m is None:
        return LinearModel(dict.fromkeys(feats, 0.0), 0.0, 0, have["_n"])
    b, b0 = least_squares(m)
    return LinearModel({**dict.fromkeys(feats, 0.0), **dict(zip(used, b.tolist()))}, b0, int(m.n), have["_n"] - int(m.n))


def train_spend(train: DataFrame, key: str = "CustomerID", target: str = "MonetaryTotal",
                scaling: str = "robust", drop_churn: bool = False) -> SpendModel:
    """KNN-impute -> robust (script) or standard (notebook) scale -> OLS.  Rows
    without a target teach nothing; ``line.n_dropped`` counts them."""
    feats = spend_features(train, key, target, drop_churn)
    x = train.select(key, F.col(target).cast("double").alias(target),
                     *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
    known = x.where(F.col(target).isNotNull() & ~F.isnan(target))
    imp = M.knn_impute_fit(known, feats, key)
    xi = cut_lineage(M.knn_impute_apply(imp, known))
    scaler = M.robust_fit(xi, feats) if scaling == "robust" else M.standard_fit(xi, feats)
    line = fit_line(scaler.apply(xi), feats, target)
    line.n_dropped += x.count() - xi.count()
    return SpendModel(feats, imp, scaler, line)


def predict_spend(model: SpendModel, df: DataFrame, key: str = "CustomerID",
                  keep: list[str] = ()) -> DataFrame:
    cols = [F.col(f"`{c}`").cast("double").alias(c) if c in df.columns else F.lit(None).cast("double").alias(c)
            for c in model.features]
    x = df.select(key, *keep, *cols)
    xs = model.scaler.apply(M.knn_impute_apply(model.imputer, x))
    return model.line.predict(xs).select(key, *keep, "predicted")


def regression_metrics(df: DataFrame, y: str = "actual", yhat: str = "predicted") -> DataFrame:
    """R2, MAE, RMSE in one aggregation (mean of y from the same pass)."""
    a, p = F.col(y).cast("double"), F.col(yhat).cast("double")
    s = df.agg(F.sum((a - p) * (a - p)).alias("sse"), F.avg(F.abs(a - p)).alias("mae"),
               F.var_pop(a).alias("vy"), F.count(F.lit(1)).alias("n"))
    return s.select((1 - F.col("sse") / (F.col("vy") * F.col("n"))).alias("r2"), "mae",
                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def residuals(df: DataFrame, key: str, y: str = "actual", yhat: str = "predicted") -> DataFrame:
    """Actual, predicted, residual per row."""
    return df.select(key, F.col(y).cast("double").alias("actual"),
                     F.col(yhat).cast("double").alias("predicted"),
                     (F.col(y) - F.col(yhat)).cast("double").alias("residual"))


def residual_ranges(res: DataFrame) -> DataFrame:
    """Ranges of actual, predicted and residual."""
    return res.agg(*[f(c).alias(f"{n}_{c}") for c in ["actual", "predicted", "residual"]
                     for n, f in [("min", F.min), ("max", F.max)]])


def residual_stats(res: DataFrame) -> DataFrame:
    """Mean, population std, rows beyond 2 sigma (one scalar pass, then a count)."""
    m = res.agg(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s")).first()
    return res.agg(F.lit(m["m"]).alias("residual_mean"), F.lit(m["s"]).alias("residual_std"),
                   F.count_if(F.abs(F.col("residual")) > F.lit(2 * m["s"])).cast("bigint").alias("n_beyond_2sigma"))


def cross_val_r2(spark: SparkSession, df: DataFrame, feats: list[str], target: str,
                 key: str = "CustomerID", folds: int = 5, seed: int = 42) -> DataFrame:
    """5-fold R2 of OLS (plain folds), from one Gram matrix per fold: a fold's line
    is solved from the sum of the other folds' matrices (added up, not subtracted, so
    nothing cancels) and judged on its own, without another scan.  Rows that lack the
    target or a feature are in no fold."""
    # folds take several passes, and what comes before (imputing) is dear; the rows to
    # use are marked by one column, as a filter over many columns is slow to plan
    cols = [*feats, target]
    x = df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    there = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`") for c in cols])
    x = cut_lineage(x.withColumn("_there", there)).where("_there").drop("_there")
    by = group_moments(assign_folds(x, folds, None, seed, key, out="_fold"), cols, "_fold")
    d = len(feats) + 1
    none = Moments(0.0, np.zeros(d), np.zeros((d, d)))
    each = [by.get(str(f), none) for f in range(folds)]
    rows = []
    for f, own in enumerate(each):
        rest = reduce(lambda a, b: a + b, [m for g, m in enumerate(each) if g != f], none)
        rows.append((f, held_out_r2(own, *least_squares(rest)) if rest.n else None))
    return spark.createDataFrame(rows, "fold long, r2 double")


def target_stats(df: DataFrame, y: str = "MonetaryTotal") -> DataFrame:
    """Mean, std (n-1), min, max of the target."""
    return df.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                  F.min(y).cast("double").alias("min"), F.max(y).cast("double").alias("max"))
