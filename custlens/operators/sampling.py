"""Splits, folds and re-balancing.

Exact per-stratum positions come from a two-level prefix sum: rows are
bucketed by contiguous ranges of (hash, key), bucket sizes form a small
table whose running totals give each bucket's offset, and row_number runs
only inside a bucket (about ``bucket_rows`` rows), never over a whole class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.operators.joins import knn_join

HASH_MOD = 10007
HASH_MUL = 7919


def key_hash(key: str, seed: int) -> Column:
    """Portable arithmetic hash of an integer key in [0, 10007); the key is
    reduced first, so no key overflows."""
    return F.pmod(F.pmod(F.col(key), F.lit(HASH_MOD)) * F.lit(HASH_MUL) + F.lit(seed), F.lit(HASH_MOD))


def stratum_positions(df: DataFrame, key: str, seed: int, strata: list[str] | None = None,
                      bucket_rows: int = 1_000_000) -> DataFrame:
    """Add ``_pos`` (0-based rank within the stratum by (hash, key)) and
    ``_n`` (stratum size).  A null label is a stratum of its own; rows with a
    null key come first in their stratum, ordered and bucketed by a hash of
    the whole row."""
    strata = strata or []
    names = [f"_s{i}" for i in range(len(strata))]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])

    def same(left: DataFrame, right: DataFrame, extra: list[str]) -> Column:
        on = [left[s].eqNullSafe(right[n]) for s, n in zip(strata, names)] + [left[e] == right[f"{e}r"] for e in extra]
        return reduce(lambda x, y: x & y, on, F.lit(True))

    stats = df.groupBy(*[F.col(s).alias(n) for s, n in zip(strata, names)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min(key).alias("_kmin"), F.max(key).alias("_kmax"))
    # one row per stratum; AQE broadcasts it where it is small
    b = df.join(stats, same(df, stats, []))
    # key-range width per bucket so that a (hash, key-range) bucket holds ~bucket_rows rows
    width = F.greatest(F.lit(1.0), F.ceil((F.col("_kmax").cast("double") - F.col("_kmin").cast("double") + 1)
                                          * F.lit(float(HASH_MOD) * bucket_rows) / F.col("_n")))
    lots = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(bucket_rows))).cast("bigint")
    b = b.withColumns({
        "_h": F.coalesce(key_hash(key, seed), F.lit(-1)).cast("bigint"),
        "_kb": F.coalesce(F.floor((F.col(key).cast("double") - F.col("_kmin").cast("double")) / width), F.pmod(whole, lots)).cast("bigint")})
    counts = b.groupBy(*[F.col(s).alias(n) for s, n in zip(strata, names)], F.col("_h").alias("_hr"), F.col("_kb").alias("_kbr")).agg(
        F.count(F.lit(1)).alias("_c"))
    # bucket table: about n / bucket_rows + 10007 rows per stratum
    wo = Window.partitionBy(*names).orderBy("_hr", "_kbr").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0))).drop("_c")
    wi = Window.partitionBy(*strata, "_h", "_kb").orderBy(F.col(key).asc_nulls_first(), whole)
    out = b.join(offsets, same(b, offsets, ["_h", "_kb"]))
    return out.select(*[b[c] for c in df.columns],
                      (F.col("_off") + F.row_number().over(wi) - 1).cast("bigint").alias("_pos"), F.col("_n").cast("bigint").alias("_n"))


def stratified_split(df: DataFrame, y: str, test_frac: float = 0.2, seed: int = 42,
                     key: str = "CustomerID", out: str = "split") -> DataFrame:
    """Exact per-class test counts ceil(frac * n_class), rows ranked by
    a seeded hash of the key."""
    p = stratum_positions(df, key, seed, [y])
    test = F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_frac))
    return p.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_pos", "_n")


def random_split(df: DataFrame, test_frac: float = 0.2, seed: int = 42, key: str = "CustomerID",
                 out: str = "split") -> DataFrame:
    """ceil(frac * n) test rows by seeded key hash (stable under any partitioning)."""
    p = stratum_positions(df, key, seed, [])
    test = F.col("_pos") < F.ceil(F.col("_n") * F.lit(test_frac))
    return p.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_pos", "_n")


def assign_folds(df: DataFrame, k: int = 5, y: str | None = None, seed: int = 42,
                 key: str = "CustomerID", out: str = "fold") -> DataFrame:
    """fold = position % k within each stratum (stratified when y given)."""
    p = stratum_positions(df, key, seed, [y] if y else [])
    return p.withColumn(out, (F.col("_pos") % k).cast("bigint")).drop("_pos", "_n")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (classes * count)."""
    g = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_class"))
    rows = g.collect()  # one row per class
    n = sum(r["n_class"] for r in rows)
    k = len(rows)
    return g.withColumn("weight", F.lit(float(n)) / (F.lit(float(k)) * F.col("n_class")))


def with_class_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, y).select(y, F.col("weight").alias(out))
    return df.join(w, y)   # one row per class: AQE broadcasts it


def smote(df: DataFrame, y: str, cols: list[str], key: str = "CustomerID", k: int = 5,
          seed: int = 42) -> DataFrame:
    """Oversample the minority class to parity.  Synthetic row i uses
    minority row (i mod n_min) in hash order, its j-th nearest minority
    neighbour (j and the gap u derived from hashes of i), x + u * (nn - x).
    Output: original rows plus synthetic ones (``synthetic`` = 1, key null)."""
    cnt = {r[y]: r["c"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("c")).collect()}
    (minor, n_min), (_, n_maj) = sorted(cnt.items(), key=lambda kv: kv[1])[0], \
        sorted(cnt.items(), key=lambda kv: kv[1])[-1]
    need = n_maj - n_min
    base = df.withColumn("synthetic", F.lit(0))
    if need <= 0 or n_min < 2:
        return base
    mino = df.where(F.col(y) == F.lit(minor)).select(key, *cols)
    pos = stratum_positions(mino, key, seed).select(key, "_pos")
    kk = min(k, n_min - 1)
    nn = knn_join(mino, mino, key, key, cols, kk, exclude_self=True)
    nn = nn.select(F.col(key).alias("_src"), F.col(f"nn_{key}").alias("_nb"), F.col("rank").alias("_j"))
    reps = F.ceil((F.lit(need) - F.col("_pos")) / F.lit(n_min)).cast("int")
    gen = (pos.where(F.col("_pos") < need)
              .select(F.col(key).alias("_src"), "_pos",
                      F.explode(F.sequence(F.lit(0), reps - 1)).alias("_t"))
              .withColumn("_i", F.col("_pos") + F.col("_t") * F.lit(n_min))
              .withColumn("_j", (F.pmod(F.col("_i") * F.lit(31) + F.lit(seed), F.lit(kk)) + 1).cast("bigint"))
              .withColumn("_u", F.pmod(F.col("_i") * F.lit(HASH_MUL) + F.lit(seed * 13 + 7), F.lit(HASH_MOD))
                          / F.lit(float(HASH_MOD))))
    x = mino.select(F.col(key).alias("_src"), *[F.col(c).cast("double").alias(f"_x_{i}") for i, c in enumerate(cols)])
    z = mino.select(F.col(key).alias("_nb"), *[F.col(c).cast("double").alias(f"_z_{i}") for i, c in enumerate(cols)])
    syn = (gen.join(nn, ["_src", "_j"]).join(x, "_src").join(z, "_nb")
              .select(F.lit(None).cast(df.schema[key].dataType).alias(key),
                      *[(F.col(f"_x_{i}") + F.col("_u") * (F.col(f"_z_{i}") - F.col(f"_x_{i}"))).alias(c)
                        for i, c in enumerate(cols)],
                      F.lit(minor).cast(df.schema[y].dataType).alias(y),
                      F.lit(1).alias("synthetic")))
    return base.select(key, *[F.col(c).cast("double").alias(c) for c in cols], y, "synthetic") \
        .unionByName(syn)
