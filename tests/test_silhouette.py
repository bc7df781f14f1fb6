import numpy as np
import pytest

from custlens.operators import silhouette as S


def slow(x, g):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        n = (g == g[i]).sum()
        others = [d[i, g == k].mean() for k in set(g.tolist()) if k != g[i]]
        a, b = d[i, g == g[i]].sum() / max(n - 1, 1), min(others, default=None)
        out.append(0.0 if n == 1 or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


def points(n, spread=6.0, seed=1):
    r = np.random.default_rng(seed)
    g = r.integers(0, 4, n)
    return r.normal(size=(n, 3)) + np.array([[0, 0, 0], [spread, 0, 0], [0, spread, 0], [spread, spread, spread]])[g], g


def frame(spark, x, g, parts=4):
    return spark.createDataFrame([(int(c), *map(float, p)) for c, p in zip(g, x)], "cluster long, a double, b double, c double").repartition(parts)


@pytest.mark.parametrize("eps", [0.0, 0.02, 0.3])
def test_bounds_hold(spark, monkeypatch, eps):
    monkeypatch.setattr(S, "CELL_ROWS", 20)
    monkeypatch.setattr(S, "FAN_OUT", 5)
    x, g = points(700)
    g[5] = 9  # alone in its cluster
    r = S.silhouette_bounds(frame(spark, x, g), ["a", "b", "c"], eps=eps).first()
    want = slow(x, g)
    assert r["low"] - 1e-9 <= want <= r["high"] + 1e-9 and r["rows"] == 700
    if eps == 0:
        assert r["high"] - r["low"] < 1e-8
    else:
        assert r["pair_share"] < 1 and r["high"] - r["low"] < 3 * eps


def test_fewer_pairs_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(S, "CELL_ROWS", 25)
    share = []
    for n in (400, 6000):
        x, g = points(n, 40.0)
        r = S.silhouette_bounds(frame(spark, x, g), ["a", "b", "c"], eps=0.3).first()
        share.append(r["pair_share"])
        assert r["high"] - r["low"] < 0.05
    assert share[1] < 0.7 * share[0] < 0.4


def test_odd_rows(spark):
    schema = "cluster long, a double"
    none = S.silhouette_bounds(spark.createDataFrame([], schema), ["a"]).first()
    assert none["silhouette"] is None and none["rows"] == 0
    rows = [(1, 0.0), (1, 0.0), (2, 0.0), (None, 5.0), (2, None)]
    assert S.silhouette_bounds(spark.createDataFrame(rows, schema), ["a"]).first()["silhouette"] == 0
    one = S.silhouette_bounds(spark.createDataFrame([(1, 0.0), (1, 4.0)], schema), ["a"]).first()
    assert one["silhouette"] == 0 and one["rows"] == 2


def test_query_on_all_clustering_features(spark):
    from custlens.operators import clustering as C
    from custlens.plans import q_models as Q
    from custlens.plans.catalog import QUERIES, scaled_cached
    sf = "/root/testdata/sf0.001"
    r = QUERIES["c05c_silhouette_bounds"](spark, sf).first()
    pdf = C.assign(scaled_cached(spark, sf), C.FIXED_CENTROIDS, C.FIXED_CENTROID_COLS).toPandas()
    want = slow(pdf[Q.CF].to_numpy(), pdf["cluster"].to_numpy())
    assert r["low"] - 1e-9 <= want <= r["high"] + 1e-9 and r["rows"] == len(pdf)


def test_nothing_is_written_per_row_and_cell(spark, monkeypatch):
    """Also where nearly every cell is opened, a row is copied once per block."""
    monkeypatch.setattr(S, "CELL_ROWS", 20)
    monkeypatch.setattr(S, "FAN_OUT", 5)
    written, real = [], S.materialise_table

    def counted(df, name):
        out = real(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(S, "materialise_table", counted)
    x, g = points(700)
    r = S.silhouette_bounds(frame(spark, x, g), ["a", "b", "c"], eps=0.001).first()
    assert r["pair_share"] > 0.9 and sum(written) <= 2 * 700
    assert r["low"] - 1e-9 <= slow(x, g) <= r["high"] + 1e-9


def test_exact_silhouette_over_blocks(spark):
    """Every two blocks meet once; equal rows, a lone row and points far from 0."""
    from pyspark.sql import functions as F
    from custlens.operators.clustering import silhouette_exact
    from custlens.operators.knn_wide import grouped_distance_sums, pair_blocks
    x, g = points(600)
    x, g = np.concatenate([x, x[:40]]) + 1e6, np.concatenate([g, g[:40]])
    g[5] = 9
    df = frame(spark, x, g).withColumn("k", F.monotonically_increasing_id())
    assert abs(silhouette_exact(df, ["a", "b", "c"], "k").first()[0] - slow(x, g)) < 1e-8
    got = grouped_distance_sums(df, "k", "cluster", ["a", "b", "c"], blocks=5).groupBy("_qg", "_dg").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for r in got:
        here, there = g == r["_qg"], g == r["_dg"]
        assert abs(r["s"] - d[np.ix_(here, there)].sum()) < 1e-6 * max(1, r["s"])
        assert r["n"] == here.sum() * there.sum() - (here & there).sum()
    assert len(got) == 25
    # copies of a row grow with the blocks of a bounded size only
    assert [pair_blocks(n, 8) for n in (0, 100, 10**8)] == [1, 1, 541]


def test_distances_of_near_and_odd_rows():
    from custlens.operators.knn_wide import distances
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(50, 9)), r.normal(size=(50, 9)) * 1e-7 + 40])
    x[7] = x[8]
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert (distances(x, x)[want == 0] == 0).all()
    assert np.allclose(distances(x, x), want, rtol=1e-10, atol=0)
    x[3, 2], x[4, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert np.allclose(distances(x, x), np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), rtol=1e-10, atol=0, equal_nan=True)
