import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import profile as A
from custlens.operators import quantiles as Q
from custlens.operators import ranking as W
from custlens.operators import schema as P


def test_exact_quantiles_vs_numpy(spark):
    random.seed(3)
    vals = [random.choice([1.0, 2.0, 2.0]) if i % 4 else random.gauss(0, 5) for i in range(5000)]
    vals += [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    arr = np.array([v for v in vals if v is not None])
    for lim in (50_000, 100):   # direct fetch, and forced sketch bracketing
        got = Q.exact_quantiles(df, ["x"], ps, collect_limit=lim)
        for p in ps:
            assert got[("x", p)] == float(np.quantile(arr, p))
    # a tiny fetch limit: several narrowing rounds before the final fetch
    got = Q.exact_quantiles(df, ["x"], ps, collect_limit=3, accuracy=2)
    for p in ps:
        assert got[("x", p)] == float(np.quantile(arr, p))


def test_quantiles_all_null_and_single(spark):
    df = spark.createDataFrame([(None, 4.0)], "a double, b double")
    got = Q.exact_quantiles(df, ["a", "b"], [0.5])
    assert got[("a", 0.5)] is None and got[("b", 0.5)] == 4.0


def test_roc_auc_and_ap_bruteforce(spark):
    random.seed(5)
    rows = [(int(random.random() < 0.4), round(random.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(W.roc_auc(df, "y", "p").first()[0] - auc) < 1e-12
    # grouped: one AUC per group in one job, each equal to its own pair count
    gdf = spark.createDataFrame([(i % 3, y, p) for i, (y, p) in enumerate(rows)], "g int, y int, p double")
    got = {r.g: r.roc_auc for r in W.roc_auc(gdf, "y", "p", by=["g"]).collect()}
    for g in range(3):
        sub = [(y, p) for i, (y, p) in enumerate(rows) if i % 3 == g]
        gp = [p for y, p in sub if y == 1]
        gn = [p for y, p in sub if y == 0]
        want = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in gp for b in gn) / (len(gp) * len(gn))
        assert abs(got[g] - want) < 1e-12
    # average precision: sum over distinct thresholds of (R_n - R_{n-1}) P_n
    ths = sorted({p for _, p in rows}, reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    assert abs(W.average_precision(df, "y", "p").first()[0] - ap) < 1e-12
    roc = W.roc_curve(df, "y", "p").collect()
    assert roc[0].fpr == 0.0 and roc[0].tpr == 0.0
    assert max(r.tpr for r in roc) == 1.0


def test_running_sums_many_buckets(spark):
    df = spark.createDataFrame([(float(i % 37), 1) for i in range(1000)], "score double, c long")
    g = df.groupBy("score").agg(F.sum("c").alias("c"))
    r = W.running_sums(g, "score", ["c"], descending=False, n_buckets=5).orderBy("score").collect()
    assert [x.cum_c for x in r][-1] == 1000
    assert all(b.cum_c > a.cum_c for a, b in zip(r, r[1:]))


def test_edge_frames(spark):
    df = spark.createDataFrame([(1, None, 5, None), (2, None, 5, 7), (3, None, 5, None)],
                               "k int, allnull int, const int, one int")
    assert set(P.constant_columns(df)) == {"allnull", "const"}    # null + one value is not constant
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    assert P.drop_constant_columns(one)[1] == []                   # skipped for one row
    nc = {r.column_name for r in A.near_constant(df).collect()}
    assert {"allnull", "const", "one"} <= nc
    h = A.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).collect()
    assert sum(r.n_rows for r in h) == 2 and h[0].bin_start == 2.5


def test_iqr_zero_scale_and_box(spark):
    from custlens.operators import features as M
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (9.0,)], "x double")
    fit = M.robust_fit(df, ["x"])
    assert fit.scale["x"] == 1.0 and fit.center["x"] == 1.0
    b = A.box_stats(df, "x").first()
    assert b.n_fliers == 1 and b.whisker_high == 1.0


def test_kde_grid_equals_the_sum_of_kernels(spark):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(int(k % 2), *map(float, r.normal(size=2) * [1, 3] + k % 2)) for k in range(301)]
    rows += [(5, 1.0, 1.0), (5, 2.0, 2.0), (6, 0.0, 0.0), (None, 9.0, 9.0), (1, None, 2.0)]  # a singular class, one point
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(6)
    got = A.kde_grid(df, "x", "y", "g", 12).toPandas()
    assert len(got) == 4 * 144
    for g in (0, 1):
        p = np.array([(x, y) for k, x, y in rows if k == g and x is not None])
        cov = np.cov(p.T) * len(p) ** (-2 / 6)
        own = got[got.g == g]
        d = own[["gx", "gy"]].to_numpy()[:, None, :] - p[None]
        want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)).sum(1) / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * len(p))
        assert np.allclose(own.density, want, rtol=1e-9)
    assert got[got.g >= 5].density.isna().all()
    assert A.kde_grid(df.where("false"), "x", "y", "g", 12).collect() == []


@pytest.mark.parametrize("far", [1.0, 400.0])
def test_kernel_sums_are_the_points_kernels(far):
    r = np.random.default_rng(5)
    p = r.normal(size=(300, 2)) * [1.0, 3.0]
    p[0] *= far
    p[1] = p[2]
    gx, gy = np.linspace(p[:, 0].min(), p[:, 0].max(), 20), np.linspace(p[:, 1].min(), p[:, 1].max(), 20)
    a, b, d = 60.0, -12.0, 8.0
    x, y = gx[None, None, :] - p[:, 0, None, None], gy[None, :, None] - p[:, 1, None, None]
    want = np.exp(-0.5 * (a * x * x + 2 * b * x * y + d * y * y)).sum(0)
    got = A.kernel_sums(p[:, 0], p[:, 1], gx, gy, a, b, d)
    assert np.allclose(got, want, rtol=1e-10, atol=1e-150)
    assert (A.kernel_sums(p[:0, 0], p[:0, 1], gx, gy, a, b, d) == 0).all()
