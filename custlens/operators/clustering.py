"""Clustering (C01-C12) and cluster labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custlens.functions.scalars import round_even as _re

from custlens.functions import scalars as S
from custlens.operators.kmeans_batch import KMeansRun, best_run, kmeans_runs

# Segment names given to clusters by descending mean spend.
BASE_LABELS = ["VIP", "Fidele", "Occasionnel", "A Risque"]


def _sq(cols_a: list[Column], cols_b: list) -> Column:
    return reduce(lambda x, y: x + y, [(a - F.lit(float(b)) if not isinstance(b, Column) else a - b) *
                                       (a - F.lit(float(b)) if not isinstance(b, Column) else a - b)
                                       for a, b in zip(cols_a, cols_b)])


def assign(df: DataFrame, centroids: list[list[float]], cols: list[str],
           out: str = "cluster") -> DataFrame:
    """Nearest centroid (lowest id on ties) and its squared distance.
    Centroids are k x d literals, so every row is scored in place."""
    x = [F.col(c).cast("double") for c in cols]
    cand = F.array(*[F.struct(_sq(x, ctr).alias("d2"), F.lit(j).cast("bigint").alias("id"))
                     for j, ctr in enumerate(centroids)])
    best = F.array_min(cand)
    return df.withColumn("_best", best).withColumns(
        {out: F.col("_best.id"), "dist2": F.col("_best.d2")}).drop("_best")


def inertia(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances to the assigned centroid."""
    return assigned.agg(F.sum("dist2").alias("inertia"))


def centroids_of(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Centroid table (mean of members)."""
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols])


def reassign(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """One k-means step over ``cols``: the clusters' means (k rows on the driver),
    then every row to the nearest of them, with its squared distance.  Clusters
    keep their ids; one without members gets no mean and so no rows.  Rows
    without a cluster do not enter a mean; a column without a value in a cluster
    counts as 0 there."""
    means = sorted(centroids_of(df.where(F.col(cluster).isNotNull()), cols, cluster).collect(), key=lambda r: r[cluster])
    if not means:
        return df.withColumn("dist2", F.lit(None).cast("double"))
    near = assign(df.drop(cluster, "dist2"), [[float(r[c] or 0.0) for c in cols] for r in means], cols, "_place")
    ids = F.array(*[F.lit(r[cluster]) for r in means])
    return near.withColumn(cluster, F.get(ids, F.col("_place").cast("int"))).drop("_place")


def silhouette_exact(df: DataFrame, cols: list[str], key: str, cluster: str = "cluster") -> DataFrame:
    """C05, Euclidean: mean of (b - a) / max(a, b); singleton clusters score 0.

    The work is quadratic by definition of the metric.  Rows stay distributed;
    pairs of blocks of bounded size meet once and each emits, per row of both and
    cluster, the sum and count of distances to the other block (vectorised),
    so only k numbers per row and block are shuffled.  ``silhouette_sq`` is the
    linear-cost squared-Euclidean form used by Spark's evaluator.
    """
    from custlens.operators.knn_wide import grouped_distance_sums
    sums = grouped_distance_sums(df, key, cluster, cols).groupBy("_qk", "_qg", "_dg").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    per = sums.groupBy("_qk", "_qg").agg(
        F.max(F.when(F.col("_dg") == F.col("_qg"), mean)).alias("a"),
        F.min(F.when(F.col("_dg") != F.col("_qg"), mean)).alias("b"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b")))
    # rows whose cluster has no other member have no 'a' -> score 0
    return per.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def silhouette_sq(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """C05, squared Euclidean in linear time (ClusteringEvaluator's metric):
    mean squared distance to a cluster = ||x||^2 - 2 x.mu + mean ||y||^2."""
    x = [F.col(c).cast("double") for c in cols]
    norm = reduce(lambda a, b: a + b, [c * c for c in x])
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("yy"),
                                    *[F.avg(c).alias(f"mu{i}") for i, c in enumerate(cols)])
    st = stats.collect()  # one row per cluster (k rows)
    rows = []
    for r in st:
        ms = reduce(lambda a, b: a + b, [x[i] * F.lit(float(r[f"mu{i}"])) for i in range(len(cols))])
        rows.append((r[cluster], r["n"], norm - 2 * ms + F.lit(float(r["yy"]))))
    own = None
    other = None
    for cid, n, md in rows:
        a_val = md * F.lit(float(n)) / F.lit(float(max(n - 1, 1)))
        own = F.when(F.col(cluster) == cid, a_val) if own is None else own.when(F.col(cluster) == cid, a_val)
        o = F.when(F.col(cluster) != cid, md)
        other = o if other is None else F.least(other, o)
    sizes = {cid: n for cid, n, _ in rows}
    single = F.col(cluster).isin([c for c, n in sizes.items() if n <= 1] or [-1])
    s = F.when(single, F.lit(0.0)).otherwise((other - own) / F.greatest(own, other))
    return df.agg(F.avg(s).alias("silhouette_sq"))


def davies_bouldin(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j)."""
    cent = centroids_of(df, cols, cluster)
    crow = {r[cluster]: [float(r[c]) for c in cols] for r in cent.collect()}  # k rows
    x = [F.col(c).cast("double") for c in cols]
    dist_own = None
    for cid, ctr in crow.items():
        e = F.sqrt(_sq(x, ctr))
        dist_own = F.when(F.col(cluster) == cid, e) if dist_own is None else dist_own.when(F.col(cluster) == cid, e)
    scat = {r[cluster]: r["s"] for r in df.groupBy(cluster).agg(F.avg(dist_own).alias("s")).collect()}
    spark = df.sparkSession
    ids = sorted(crow)
    vals = []
    for i in ids:
        best = 0.0
        for j in ids:
            if i == j:
                continue
            dij = sum((a - b) ** 2 for a, b in zip(crow[i], crow[j])) ** 0.5
            best = max(best, (scat[i] + scat[j]) / dij if dij > 0 else float("inf"))
        vals.append((int(i), float(scat[i]), float(best)))
    per = spark.createDataFrame(vals, "cluster long, scatter double, worst_ratio double")
    return per.agg(F.avg("worst_ratio").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """(B / (k-1)) / (W / (n-k)) with between/within sums of squares."""
    x = [F.col(c).cast("double") for c in cols]
    g = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"g{i}") for i, c in enumerate(x)]).first()
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                    *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                                    *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)]).collect()
    n, k = g["n"], len(stats)
    between = sum(r["n"] * sum((r[f"m{i}"] - g[f"g{i}"]) ** 2 for i in range(len(cols))) for r in stats)
    within = sum(r["n"] * sum(r[f"v{i}"] for i in range(len(cols))) for r in stats)
    ch = 1.0 if within == 0 else (between * (n - k)) / (within * (k - 1)) if k > 1 else None
    return df.sparkSession.createDataFrame([(ch,)], "calinski_harabasz double")


def cluster_profile(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """C09 (raw): per-cluster means and sizes in one aggregation."""
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols],
                                   F.count(F.lit(1)).alias("n_clients"))


def label_clusters(profile: DataFrame, cluster: str = "cluster", by: str = "MonetaryTotal",
                   labels: list[str] = BASE_LABELS) -> DataFrame:
    """Rank clusters by mean spend (desc; id breaks ties) and name them.
    ``profile`` holds one row per cluster, so the global window is k rows."""
    w = Window.orderBy(F.col(by).desc(), F.col(cluster))
    lut = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(i + 1), F.lit(lab))])
    return profile.select(cluster, F.element_at(lut, F.row_number().over(w)).alias("label"))


def validate_segments(df: DataFrame, label: str = "label", target: str = "Churn") -> DataFrame:
    """Churn per label against the 40 % rule."""
    g = df.groupBy(label).agg(F.avg(F.col(target).cast("double")).alias("churn_rate"),
                              F.count(F.lit(1)).alias("n_clients"))
    return g.withColumn("status", S.verdict_segment(F.col(label), F.col("churn_rate")))


def churn_by_cluster(df: DataFrame, cluster: str = "cluster", target: str = "Churn") -> DataFrame:
    """Churn per cluster with the global rate alongside (one scalar)."""
    glob = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    return (df.groupBy(cluster).agg(F.avg(F.col(target).cast("double")).alias("churn_rate"))
              .withColumn("global_churn_rate", F.lit(glob))
              .withColumn("delta", F.col("churn_rate") - F.col("global_churn_rate")))


# --- C01/C02: fitting ------------------------------------------------------------


def kmeans_fit(df: DataFrame, cols: list[str], k: int = 4, n_init: int = 10, seed: int = 42,
               max_iter: int = 300) -> KMeansRun:
    """Seeded k-means restarts, all advanced by one pass over the rows at a time
    (``operators/kmeans_batch.py``); the lowest cost wins (ties: the earliest seed)."""
    return best_run(kmeans_runs(df, cols, [(k, seed + i) for i in range(n_init)], max_iter))


def kmeans_predict(model: KMeansRun, df: DataFrame, cols: list[str], out: str = "cluster") -> DataFrame:
    return assign(df, model.centre_lists(), cols, out).drop("dist2")


def k_sweep(spark: SparkSession, df: DataFrame, cols: list[str], ks=range(2, 9), seed: int = 42,
            n_init: int = 10, eps: float = 0.05) -> DataFrame:
    """Per k the inertia of the best of ``n_init`` restarts (the restarts of every k
    share their passes over the rows), its Euclidean silhouette with the bounds it is
    certain to lie between (``operators/silhouette.py``), and the squared-Euclidean one."""
    from custlens.operators.silhouette import silhouette_bounds
    every = kmeans_runs(df, cols, [(k, seed + i) for k in ks for i in range(n_init)])
    rows = []
    for k in ks:
        m = best_run([r for r in every if r.k == k])
        labelled = kmeans_predict(m, df.select(*cols), cols)
        s = silhouette_bounds(labelled, cols, "cluster", eps).first()
        rows.append((k, m.cost, s["silhouette"], s["low"], s["high"], silhouette_sq(labelled, cols).first()[0]))
    return spark.createDataFrame(rows, "k long, inertia double, silhouette double, silhouette_low double, silhouette_high double, silhouette_sq double")


# --- C11: segment report (flagship) -------------------------------------------------

# Fixed centroids on scaled (MonetaryTotal, Recency, Frequency).
FIXED_CENTROIDS = [[0.5, -0.5, 0.5], [0.0, 0.0, 0.0], [-0.5, 0.5, -0.5], [-1.0, 1.0, -1.0]]
FIXED_CENTROID_COLS = ["MonetaryTotal", "Recency", "Frequency"]


def segment_report(assigned: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """C11: per segment size, share, churn and means, action, formatted text.
    Every labelled cluster appears; an empty one reports zeros."""
    total = assigned.count()
    g = assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_clients"),
        F.avg("Frequency").alias("freq"), F.avg("MonetaryTotal").alias("mon"),
        F.avg("CustomerTenureDays").alias("ten"), F.avg("SatisfactionScore").alias("sat"),
        F.avg(F.col("Churn").cast("double")).alias("churn"))
    r = labels.join(g, cluster, "left")   # labels: k rows
    z = lambda c: F.coalesce(_re(F.col(c), 2), F.lit(0.0))
    n = F.coalesce(F.col("n_clients"), F.lit(0)).cast("bigint")
    share = _re(n * 100.0 / F.lit(float(total)), 1) if total else F.lit(0.0)
    churn_pct = z("churn") * 100.0
    return r.select(
        F.col(cluster).cast("bigint").alias("cluster_id"),
        F.col("label"),
        S.display_name("label").alias("segment_name"),
        n.alias("n_clients"),
        share.alias("share_pct"),
        _re(churn_pct, 1).alias("churn_pct"),
        z("freq").alias("frequency"), z("mon").alias("monetary"),
        z("ten").alias("tenure_days"), z("sat").alias("satisfaction"),
        S.action_for("label").alias("action"),
        F.format_string("%d clients (%s%%)", n, S.fmt_fixed(share, 1)).alias("size_text"),
        F.concat(S.fmt_fixed(churn_pct, 1), F.lit("%")).alias("churn_text"),
        F.concat(S.fmt_fixed(z("sat"), 2), F.lit("/5")).alias("satisfaction_text"),
        F.concat(S.fmt_fixed(z("freq"), 1), F.lit(" achats")).alias("frequency_text"),
        F.concat(S.fmt_fixed(z("mon"), 0), F.lit(" €")).alias("monetary_text"),
        F.concat(S.fmt_fixed(z("ten"), 0), F.lit(" jours")).alias("tenure_text"),
        F.concat(F.lit("Priorité : "), F.col("label")).alias("badge"),
        S.churn_level("label").alias("churn_level"),
    )
