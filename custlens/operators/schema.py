"""Projection, filter and schema operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions.scalars import round_even as _re
from pyspark.sql import types as T


def _q(c: str):
    return F.col(f"`{c}`")


def numeric_columns(df: DataFrame) -> list[str]:
    """Ints and floats (booleans and decimals excluded, as in pandas)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                       T.FloatType, T.DoubleType))]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def categorical_profile(df: DataFrame) -> DataFrame:
    """String columns with their distinct (non-null) counts."""
    return distinct_counts_long(df, categorical_columns(df))


def safe_drop(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_matching(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop columns whose name contains any pattern."""
    return df.drop(*[c for c in df.columns if any(p in c for p in patterns)])


def find_columns(df: DataFrame, any_of: list[str] = (), all_of: list[str] = ()) -> list[str]:
    """Case-insensitive token match on names, in column order."""
    out = []
    for c in df.columns:
        lc = c.lower()
        if any_of and not any(t.lower() in lc for t in any_of):
            continue
        if all_of and not all(t.lower() in lc for t in all_of):
            continue
        out.append(c)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Spaces -> '_', apostrophes removed."""
    ren = {c: c.replace(" ", "_").replace("'", "") for c in df.columns}
    return df.withColumnsRenamed({a: b for a, b in ren.items() if a != b})


# Features the churn model must not see (direct proxies).
LEAKY_CHURN_FEATURES = [
    "Recency", "CustomerTenureDays", "FirstPurchaseDaysAgo", "TenureRatio", "MonetaryPerDay",
    "ChurnRiskCategory", "LoyaltyLevel", "SpendingCategory",
    "CustomerType_Perdu", "CustomerType_Hyperactif", "CustomerType_Nouveau",
    "CustomerType_Occasionnel", "CustomerType_Regulier",
    "RFMSegment_Champions", "RFMSegment_Dormants", "RFMSegment_Fideles", "RFMSegment_Potentiels",
    "AccountStatus_Closed", "AccountStatus_Suspended", "AccountStatus_Active", "AccountStatus_Pending",
    "CustomerType_Régulier", "RFMSegment_Fidèles",
]

# Features declared leaky for clustering.
LEAKY_CLUSTERING_FEATURES = [
    "Churn", "ChurnRiskCategory", "SpendingCategory", "LoyaltyLevel", "BasketSizeCategory",
    "RFMSegment_Champions", "RFMSegment_Dormants", "RFMSegment_Fideles", "RFMSegment_Potentiels",
    "RFMSegment_Fidèles", "CustomerType_Hyperactif", "CustomerType_Nouveau",
    "CustomerType_Occasionnel", "CustomerType_Perdu", "CustomerType_Regulier",
    "CustomerType_Régulier", "AccountStatus_Closed", "AccountStatus_Suspended",
]

# Redundant (multicollinear) columns.
REDUNDANT_COLUMNS = ["UniqueInvoices", "UniqueDescriptions", "CancelledTransactions",
                     "MonetaryMin", "MinQuantity", "AvgLinesPerInvoice"]


def drop_leaky(df: DataFrame, task: str = "churn", target: str = "Churn",
               key: str = "CustomerID") -> DataFrame:
    """Drop leak lists (+ target and id for churn)."""
    if task == "churn":
        return safe_drop(df, LEAKY_CHURN_FEATURES + [target, key])
    return safe_drop(df, LEAKY_CLUSTERING_FEATURES)


def drop_redundant(df: DataFrame, cols: list[str] = REDUNDANT_COLUMNS) -> DataFrame:
    """P09."""
    return safe_drop(df, cols)


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with one distinct value counting null as a value, in one pass
    without distinct aggregation: all null, or no null and min == max."""
    cols = df.columns
    row = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[(F.min(_q(c)) == F.max(_q(c))).alias(f"e{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("_rows")).first()
    n = row["_rows"]
    if n <= 1:
        return []
    return [c for i, c in enumerate(cols)
            if row[f"n{i}"] == 0 or (row[f"n{i}"] == n and row[f"e{i}"])]


def distinct_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact distinct (non-null) count per column through one unpivot + one
    distinct, instead of one Expand copy of the data per distinct aggregate."""
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_unique bigint")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _q(c).cast("string").alias("v")) for c in cols])).alias("p"))
    d = pairs.select("p.column_name", "p.v").where(F.col("v").isNotNull()).distinct()
    counted = d.groupBy("column_name").agg(F.count(F.lit(1)).cast("bigint").alias("n_unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return names.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"))


def drop_constant_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """P10: drop constant columns (skipped for <= 1 row)."""
    const = constant_columns(df)
    return df.drop(*const), const


def null_sentinels(df: DataFrame, spec: dict[str, list]) -> DataFrame:
    """Listed codes -> null."""
    return df.withColumns({c: F.when(~_q(c).isin(*vals) | _q(c).isNull(), _q(c))
                           for c, vals in spec.items() if c in df.columns})


def filter_positive(df: DataFrame, col: str = "MonetaryTotal") -> tuple[DataFrame, DataFrame]:
    """Keep col > 0; second frame reports kept/removed counts in one pass."""
    counts = df.agg(F.count_if(_q(col) > 0).cast("bigint").alias("n_kept"),
                    F.count_if(~(_q(col) > 0) | _q(col).isNull()).cast("bigint").alias("n_removed"))
    return df.where(_q(col) > 0), counts


def align_schema(df: DataFrame, cols: list[str], fill=None,
                 types: dict[str, T.DataType] | None = None) -> DataFrame:
    """P13 (fill=0) / P14 (fill=None): add missing, drop extras, order."""
    out = []
    for c in cols:
        if c in df.columns:
            e = _q(c)
            if fill is not None:
                e = F.coalesce(e, F.lit(fill))
        else:
            t = (types or {}).get(c, T.DoubleType())
            e = F.lit(fill).cast(t) if fill is not None else F.lit(None).cast(t)
        out.append(e.alias(c))
    return df.select(*out)


def to_numeric(df: DataFrame, exempt: list[str] = ()) -> DataFrame:
    """Every non-exempt column to double; unparsable -> null."""
    return df.withColumns({c: _q(c).cast("string").try_cast("double")
                           for c in df.columns if c not in exempt})


def union_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate by name, missing columns null."""
    return a.unionByName(b, allowMissingColumns=True)


def top_n(df: DataFrame, n: int, by: str, ascending: bool = False, by_abs: bool = False,
          tiebreak: list[str] = ()) -> DataFrame:
    """Sorted head (TakeOrderedAndProject: per-partition top-n, no full sort)."""
    e = F.abs(_q(by)) if by_abs else _q(by)
    e = e.asc() if ascending else e.desc()
    return df.orderBy(e, *[_q(t) for t in tiebreak]).limit(n)


def hash_rank_expr(key: str, seed: int, modulus: int = 10007) -> F.Column:
    """Portable arithmetic hash of an integer key (same value in any SQL engine)."""
    return F.pmod(F.pmod(F.col(key), F.lit(modulus)) * F.lit(7919) + F.lit(seed), F.lit(modulus))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Seeded sample of exactly n rows (a sampling operator: the limit is the feature)."""
    return df.orderBy(hash_rank_expr(key, seed), _q(key)).limit(n)


def first_distinct(df: DataFrame, col: str, n: int = 30) -> DataFrame:
    """First n distinct values in value order."""
    return df.select(_q(col)).distinct().orderBy(_q(col).asc_nulls_first()).limit(n)


def schema_profile(df: DataFrame) -> DataFrame:
    """P20: ordinal, name, type, non-null, null, null % - one aggregation."""
    cols = df.columns
    row_exprs = [F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(cols)] + [F.count(F.lit(1)).alias("_n")]
    wide = df.agg(*row_exprs)
    stack = ", ".join(f"{i + 1}L, '{c}', '{df.schema[c].dataType.simpleString()}', c{i}"
                      for i, c in enumerate(cols))
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (ordinal, column_name, data_type, non_null)")
    return long.select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "column_name", "data_type",
        F.col("non_null").cast("bigint").alias("non_null"),
        (F.col("_n") - F.col("non_null")).cast("bigint").alias("null_count"),
        _re((F.col("_n") - F.col("non_null")) * 100.0 / F.col("_n"), 2).cast("double").alias("null_pct"))


def name_pattern_frame(spark: SparkSession, cols: list[str]) -> DataFrame:
    """Emit a list of names as a table (for P04/P05 results)."""
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cols)], "ordinal long, column_name string")


_SAFE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
