"""Aggregation and profiling.

Column-wide reports are one aggregation over all columns followed by an
unpivot, never a scan per column.  Totals needed as denominators are single
scalars read back from a global aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions.scalars import round_even as _re
from pyspark.sql import types as T

from custlens.operators.gram import pairwise_moments
from custlens.operators.quantiles import exact_quantiles
from custlens.operators.ranking import running_sums
from custlens.operators.schema import (
    _q, categorical_columns, constant_columns, distinct_counts_long, numeric_columns,
)


def _total(df: DataFrame) -> int:
    return df.count()


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share (%) per value (nulls excluded, as pandas)."""
    total = df.where(_q(col).isNotNull()).count()
    g = df.where(_q(col).isNotNull()).groupBy(_q(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("pct", _re(F.col("n_rows") * 100.0 / F.lit(float(max(total, 1))), 6))


def special_counts(df: DataFrame, col: str, vals: list) -> DataFrame:
    """Count and % of each listed special value, in one pass."""
    row_exprs = [F.count_if(_q(col) == F.lit(v)).alias(f"c{i}") for i, v in enumerate(vals)]
    wide = df.agg(*row_exprs, F.count(F.lit(1)).alias("_n"))
    stack = ", ".join(f"CAST({v} AS BIGINT), c{i}" for i, v in enumerate(vals))
    long = wide.selectExpr("_n", f"stack({len(vals)}, {stack}) AS (value, n_rows)")
    return long.select("value", F.col("n_rows").cast("bigint").alias("n_rows"),
                       _re(F.col("n_rows") * 100.0 / F.col("_n"), 6).alias("pct"))


def profile_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Mean of several columns per group (partial + final hash aggregate)."""
    return df.groupBy(key).agg(*[F.avg(_q(c)).alias(c) for c in cols])


def sizes_by(df: DataFrame, key: str) -> DataFrame:
    """Size and share per group."""
    total = _total(df)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "pct", _re(F.col("n_rows") * 100.0 / F.lit(float(max(total, 1))), 6))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    """A06/A07, a row per pair of values that occurs: count and share (%) of
    the row total.  No bound on the number of values."""
    n = df.where(_q(a).isNotNull() & _q(b).isNotNull()).groupBy(_q(a).alias(a), _q(b).alias(b)).agg(F.count(F.lit(1)).alias("n_rows"))
    total = n.groupBy(a).agg(F.sum("n_rows").alias("_t"))
    return n.join(total, a).select(a, b, "n_rows", _re(F.col("n_rows") * 100.0 / F.col("_t"), 6).alias("pct"))


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Contingency table with a column per value of ``b`` (given, or
    learned).  Beyond Spark's ``spark.sql.pivotMaxValues`` columns the pivot
    fails; ``crosstab_long`` has no such bound."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a)
    t = (t.pivot(b) if values is None else t.pivot(b, values)).count()
    values = [c for c in t.columns if c != a]
    return t.fillna(0, subset=values).select(a, *[F.col(f"`{v}`").cast("bigint").alias(f"{b}_{v}") for v in values])


def crosstab_pct(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Row-normalised contingency table in %."""
    t = crosstab(df, a, b, values)
    vcols = [c for c in t.columns if c != a]
    tot = reduce(lambda x, y: x + y, [F.col(f"`{c}`") for c in vcols])
    return t.select(a, *[_re(F.col(f"`{c}`") * 100.0 / tot, 6).alias(c) for c in vcols])


def describe_exact(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 % (linear), max."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    agg = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.min(_q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(_q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    rows = [(c, int(agg[f"n{i}"]), agg[f"m{i}"], agg[f"s{i}"], agg[f"lo{i}"],
             q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], agg[f"hi{i}"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, count bigint, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")


def quantiles(df: DataFrame, cols: list[str], ps: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles (long format)."""
    q = exact_quantiles(df, cols, ps)
    return df.sparkSession.createDataFrame([(c, float(p), q[(c, p)]) for c in cols for p in ps],
                                           "feature string, p double, value double")


def iqr_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: Q1, Q3, IQR, fences (3 dp), outlier count and % (2 dp)."""
    q = exact_quantiles(df, cols, [0.25, 0.75])
    n = _total(df)
    bounds = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:  # no value: null fences, no outlier
            bounds[c] = (None,) * 5
            continue
        iqr = q3 - q1
        bounds[c] = (q1, q3, iqr, q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    cnt = df.agg(*[F.count_if((_q(c) < F.lit(b[3])) | (_q(c) > F.lit(b[4]))).alias(f"o{i}")
                   for i, (c, b) in enumerate(bounds.items())]).first()
    rows = []
    for i, (c, (q1, q3, iqr, lo, hi)) in enumerate(bounds.items()):
        rows.append((c, q1, q3, iqr, lo, hi, int(cnt[f"o{i}"])))
    out = df.sparkSession.createDataFrame(
        rows, "feature string, q1 double, q3 double, iqr double, lower_bound double, "
              "upper_bound double, n_outliers bigint")
    return out.select("feature", *[_re(c, 3).alias(c) for c in
                                   ["q1", "q3", "iqr", "lower_bound", "upper_bound"]],
                      "n_outliers",
                      _re(F.col("n_outliers") * 100.0 / F.lit(float(n)), 2).alias("outlier_pct"))


def null_counts(df: DataFrame) -> DataFrame:
    """Per column null count in one aggregation, unpivoted."""
    cols = df.columns
    wide = df.agg(*[F.count_if(_q(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)],
                  F.count(F.lit(1)).alias("_n"))
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    return wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (column_name, n_missing)")


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and % (2 dp)."""
    long = null_counts(df).where(F.col("n_missing") > 0)
    return long.select("column_name", F.col("n_missing").cast("bigint").alias("n_missing"),
                       _re(F.col("n_missing") * 100.0 / F.col("_n"), 2).alias("pct_missing"))


def null_total(df: DataFrame) -> DataFrame:
    """Total nulls left."""
    return null_counts(df).agg(F.sum("n_missing").cast("bigint").alias("total_missing"))


def nulls_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Nulls of a column per group."""
    return df.groupBy(key).agg(F.count_if(_q(col).isNull()).cast("bigint").alias("n_missing"))


def pandas_dtype(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int64"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "float64"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "object"


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per dtype (schema only, no scan)."""
    spark = df.sparkSession
    names = [(f.name, pandas_dtype(f.dataType)) for f in df.schema.fields]
    return (spark.createDataFrame(names, "column_name string, dtype string")
            .groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns")))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min, max, mean, median, std (n-1), negative %, zero % per column."""
    q = exact_quantiles(df, cols, [0.5])
    agg = df.agg(*[F.min(_q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(_q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(cols)],
                 *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(_q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.count_if(_q(c) < 0).alias(f"neg{i}") for i, c in enumerate(cols)],
                 *[F.count_if(_q(c) == 0).alias(f"zero{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("_n")).first()
    n = agg["_n"]
    rows = [(c, agg[f"lo{i}"], agg[f"hi{i}"], agg[f"m{i}"], q[(c, 0.5)], agg[f"s{i}"],
             agg[f"neg{i}"] * 100.0 / n, agg[f"zero{i}"] * 100.0 / n) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "feature string, min double, max double, mean double, median double, std double, "
              "negative_pct double, zero_pct double")


def negative_audit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns with negatives: count, %, min, max, mean."""
    wide = df.agg(*[F.count_if(_q(c) < 0).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[F.min(_q(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(cols)],
                  *[F.max(_q(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(cols)],
                  *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                  F.count(F.lit(1)).alias("_n"))
    stack = ", ".join(f"'{c}', n{i}, lo{i}, hi{i}, m{i}" for i, c in enumerate(cols))
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (feature, n_negative, min, max, mean)")
    return long.where(F.col("n_negative") > 0).select(
        "feature", F.col("n_negative").cast("bigint").alias("n_negative"),
        (F.col("n_negative") * 100.0 / F.col("_n")).alias("negative_pct"), "min", "max", "mean")


def rate_comparison(df: DataFrame, pred, target: str = "Churn") -> DataFrame:
    """Target rate within a subgroup vs overall, one pass."""
    y = F.col(target).cast("double")
    return df.agg(F.count_if(pred).cast("bigint").alias("n_subgroup"),
                  F.avg(F.when(pred, y)).alias("subgroup_rate"),
                  F.avg(y).alias("overall_rate"))


def _correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """i, j, corr of all ordered pairs of places in ``cols``."""
    m = pairwise_moments(df, cols)
    r = F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))
    r = F.when((F.col("n") > 1) & (F.col("vi") > 0) & (F.col("vj") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(r, F.lit(None)))))
    return m.select("i", "j", F.nullif(r, F.lit(float("nan"))).alias("corr"))


def _named(pairs: DataFrame, cols: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.select(F.get(names, F.col("i")).alias("feature_1"), F.get(names, F.col("j")).alias("feature_2"), "corr")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson, pairwise-complete, every ordered pair, from one scan that adds up
    a Gram matrix (``operators/gram.py``).  A constant column (or one constant where the
    other is present) has null correlations, and so have fewer than two rows."""
    return _named(_correlations(df, cols), cols)


def high_corr_pairs(df: DataFrame, cols: list[str], threshold: float = 0.8) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold (column order)."""
    return _named(_correlations(df, cols).where((F.col("i") < F.col("j")) & (F.abs("corr") > threshold)), cols)


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Exact distinct counts (one unpivot + one distinct)."""
    return distinct_counts_long(df, cols or df.columns)


def near_constant(df: DataFrame, ratio: float = 0.01) -> DataFrame:
    """Constant (nulls ignored, an all-null column too) or fewer than ``ratio`` distinct values
    per row; modal value (ties -> smallest) and its share of all rows."""
    cols = df.columns
    n = _total(df)
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("v")) for c in cols])).alias("p"))
    vc = (pairs.select("p.column_name", "p.v").where(F.col("v").isNotNull())
          .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c")))
    per = vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("top_value"),
        F.max("c").alias("top_count"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    per = names.join(per, "column_name", "left").withColumns({
        "n_unique": F.coalesce("n_unique", F.lit(0)), "top_count": F.coalesce("top_count", F.lit(0))})
    return per.where((F.col("n_unique") <= 1) | (F.col("n_unique") < F.lit(ratio * n))).select(
        "column_name", F.col("n_unique").cast("bigint").alias("n_unique"), "top_value",
        _re(F.col("top_count") * 100.0 / F.lit(float(n)), 6).alias("top_pct"))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; min = max uses
    [v - 0.5, v + 0.5] (numpy rule).  Empty bins are reported with 0."""
    mm = df.agg(F.min(_q(col)).cast("double"), F.max(_q(col)).cast("double")).first()
    lo, hi = mm[0], mm[1]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, bin_start double, bin_end double, n_rows bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    w = (hi - lo) / bins
    b = F.least(F.floor((_q(col).cast("double") - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(_q(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    grid = spark.range(bins).select(F.col("id").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("bin_start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("bin_end"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


def box_stats(df: DataFrame, col: str, by: str | None = None, groups: list | None = None) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme points inside the
    fences) and number of fliers; per group when ``by`` is given.

    Long form: one row per (group, distinct value) with its count, running
    counts in two levels, and the wanted order statistics picked by rank, so
    there is no bound on the number of groups and no group in one task.  A
    group without a value has null quartiles and no flier."""
    x = df.select((F.lit(None).cast("string") if by is None else F.col(by)).alias("grp"), _q(col).cast("double").alias("v"))
    if by is not None:
        x = x.where(F.col("grp").isNotNull() if groups is None else F.col("grp").isin(groups))
        x = x.withColumn("grp", F.col("grp").cast("string"))
    every = x.select(F.coalesce("grp", F.lit("")).alias("g"), "v")
    names = every.groupBy("g").agg(F.count("v").alias("n"))
    g = every.where(F.col("v").isNotNull()).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    cum = running_sums(g, "v", ["c"], descending=False, by=["g"]).join(names, "g")

    def at(p: float) -> list:
        """The two order statistics around quantile p, and the share of the upper."""
        h = (F.col("n") - 1) * F.lit(p)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("n") - 1)
        pick = lambda r: F.min(F.when(F.col("cum_c") > r, F.col("v")))
        return [pick(lo), pick(hi), F.max(h - lo)]

    ps = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = cum.groupBy("g").agg(*[e.alias(f"{k}_{i}") for k, p in ps.items() for i, e in enumerate(at(p))])
    q = q.select("g", *[(F.col(f"{k}_0") + (F.col(f"{k}_1") - F.col(f"{k}_0")) * F.col(f"{k}_2")).alias(k) for k in ps])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    f = g.join(q, "g").groupBy("g").agg(
        F.min(F.when(F.col("v") >= low, F.col("v"))).alias("whisker_low"), F.max(F.when(F.col("v") <= high, F.col("v"))).alias("whisker_high"),
        F.sum(F.when((F.col("v") < low) | (F.col("v") > high), F.col("c")).otherwise(0)).alias("n_fliers"))
    out = names.join(q, "g", "left").join(f, "g", "left")
    name = F.lit(None).cast("string") if by is None else F.col("g")
    return out.select(name.alias("grp"), "q1", "median", "q3", "whisker_low", "whisker_high",
                      F.coalesce("n_fliers", F.lit(0)).cast("bigint").alias("n_fliers"))


def exploration_summary(df: DataFrame, target: str = "Churn") -> DataFrame:
    """One row: rows, columns, target rate, numeric/categorical counts,
    columns with nulls, constant columns."""
    nulls = null_counts(df).where(F.col("n_missing") > 0).count()
    const = len(constant_columns(df))
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.avg(F.col(target).cast("double")).alias("target_rate")).first()
    return df.sparkSession.createDataFrame(
        [(int(agg["n_rows"]), len(df.columns), agg["target_rate"], len(numeric_columns(df)),
          len(categorical_columns(df)), int(nulls), const)],
        "n_rows bigint, n_columns bigint, target_rate double, n_numeric bigint, "
        "n_categorical bigint, n_null_columns bigint, n_constant bigint")


def split_balance(df: DataFrame, split: str = "split", target: str = "Churn") -> DataFrame:
    """Rows and positive rate per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.sum(F.col(target).cast("bigint")).alias("n_positive"),
                                 F.avg(F.col(target).cast("double")).alias("positive_rate"))


#: Points whose kernels a task evaluates at a time.
#: Largest exponent of a factor of a kernel.
KDE_REACH = 300.0


def kernel_sums(px: np.ndarray, py: np.ndarray, gx: np.ndarray, gy: np.ndarray, a: float, b: float, d: float) -> np.ndarray:
    """Sums over the points of exp(-(a x^2 + 2 b x y + d y^2) / 2), x and y from the point,
    at every place of the grid (rows: gy).

    About a middle the kernel is a factor of the place, one of the place's x and the point,
    and one of its y and the point, so the sums are a matrix product.  Points whose factors
    would grow past e^KDE_REACH are parted (a point alone has none)."""
    if not len(px):
        return np.zeros((len(gy), len(gx)))
    cx, cy = (px.min() + px.max()) / 2, (py.min() + py.max()) / 2
    u, v, x, y = px - cx, py - cy, gx - cx, gy - cy
    s, t = a * u + b * v, b * u + d * v
    if len(px) > 1 and np.abs(x).max() * np.abs(s).max() + np.abs(y).max() * np.abs(t).max() > KDE_REACH:
        order = np.argsort(px if a * np.ptp(px) ** 2 >= d * np.ptp(py) ** 2 else py, kind="stable")
        return sum(kernel_sums(px[part], py[part], gx, gy, a, b, d) for part in np.array_split(order, 2))
    quad = lambda e, f: np.exp(-0.5 * (a * e * e + 2 * b * e * f + d * f * f))
    return quad(x[None, :], y[:, None]) * ((np.exp(y[:, None] * t) * quad(u, v)) @ np.exp(x[:, None] * s).T)


def kde_grid(df: DataFrame, x: str, y: str, by: str, n: int = 80) -> DataFrame:
    """2-D Gaussian KDE (Scott bandwidth, full covariance) per class,
    evaluated on one n x n grid spanning all rows.

    A task adds the kernels of its points, by matrix products (``kernel_sums``),
    into one dense n x n accumulator per class and emits classes x n x n rows at its end, however many points it
    has; those are added up by cell.  Points without a class or a coordinate
    do not count.  A class whose covariance is singular (or of one point) has
    null densities.  No point: no row."""
    spark = df.sparkSession
    pts = df.select(F.col(by).cast("long").alias("c"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")) \
        .where(F.col("c").isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull())
    st = pts.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("px").alias("vx"), F.var_samp("py").alias("vy"), F.covar_samp("px", "py").alias("cxy"),
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")).collect()  # one row per class
    if not st:
        return spark.createDataFrame([], f"{by} long, ix long, iy long, gx double, gy double, density double")
    (x0, x1), (y0, y1) = [(min(r[f"{v}0"] for r in st), max(r[f"{v}1"] for r in st)) for v in "xy"]
    params = {}
    for r in st:
        f2 = r["n"] ** (-2.0 / 6.0)
        a, b, d = ((r[v] or 0.0) * f2 for v in ("vx", "cxy", "vy"))
        det = a * d - b * b
        params[r["c"]] = (d / det, -b / det, a / det, 1.0 / (2 * math.pi * math.sqrt(det) * r["n"])) if r["n"] > 1 and det > 0 else None
    at = np.arange(n)
    gx, gy = x0 + (x1 - x0) * at / (n - 1), y0 + (y1 - y0) * at / (n - 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            c, px, py = (v.to_numpy() for v in batch.columns)
            for k in np.unique(c).tolist():
                if params.get(k) is None:
                    continue
                ia, ib, id_, _ = params[k]
                sums = held.setdefault(k, np.zeros((n, n)))
                own = c == k
                sums += kernel_sums(px[own], py[own], gx, gy, ia, ib, id_)
        iy, ix = np.divmod(np.arange(n * n), n)
        for k, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, k)), pa.array(ix), pa.array(iy), pa.array(sums.ravel())], names=["c", "ix", "iy", "s"])

    sums = pts.mapInArrow(add_up, "c long, ix long, iy long, s double").groupBy("c", "ix", "iy").agg(F.sum("s").alias("s"))
    classes = spark.createDataFrame([(k, v[3] if v else None) for k, v in params.items()], "c long, norm double")
    cells = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ix")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("iy"))
    cells = cells.select("c", "norm", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"))
    return cells.join(sums, ["c", "ix", "iy"], "left").select(
        F.col("c").alias(by), "ix", "iy", (F.lit(x0) + F.lit(x1 - x0) * F.col("ix") / F.lit(n - 1)).alias("gx"),
        (F.lit(y0) + F.lit(y1 - y0) * F.col("iy") / F.lit(n - 1)).alias("gy"), (F.col("s") * F.col("norm")).alias("density"))
