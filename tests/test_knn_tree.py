import numpy as np

from custlens.operators import features as M
from custlens.operators import knn_wide


def test_knn_visits_few_cells_where_one_feature_spreads_most(spark, monkeypatch):
    """A feature in the hundred thousands beside small ones, a third of a small one missing:
    the cells follow the distance, and the fill stays that of plain search."""
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 160)
    rnd = np.random.default_rng(3)
    x = np.column_stack([rnd.uniform(0, 1e6, 2000), rnd.integers(0, 60, 2000), rnd.integers(0, 16, 2000), rnd.integers(0, 5, 2000), rnd.uniform(0, 300, 2000)])
    gone = rnd.random(2000) < 0.33
    cols = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(i, *(None if j == 1 and gone[i] else float(v) for j, v in enumerate(r))) for i, r in enumerate(x)],
                               "k long, " + ", ".join(f"{c} double" for c in cols))
    recv = df.where("b IS NULL")
    assert knn_wide.visit_share(recv, df, "k", "k", cols, 5, per_feature=True) < 0.15
    got = {r["k"]: r["b"] for r in M.knn_impute_apply(M.knn_impute_fit(df, cols, "k"), recv).collect()}
    donors, others = np.flatnonzero(~gone), [0, 2, 3, 4]
    for i in np.flatnonzero(gone)[:100]:
        d = ((x[donors][:, others] - x[i, others]) ** 2).sum(1)
        near = donors[np.argsort(d, kind="stable")[:5]]
        assert np.isclose(got[i], x[near, 1].mean(), rtol=0, atol=1e-9)


def test_knn_equal_donors_keep_the_smallest_keys(spark, monkeypatch):
    """Most donors are equal: they cannot be parted, and are not all met by every receiver."""
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 40)
    donors = spark.createDataFrame([(i, 1.0, 1.0) if i >= 100 else (i, float(i), 50.0) for i in range(900)], "k long, a double, b double")
    recv = spark.createDataFrame([(2000 + i, 1.0, 2.0) for i in range(5)], "k long, a double, b double")
    cand = knn_wide.wide_candidates(recv, donors, "k", "k", ["a", "b"], 3, per_feature=False).collect()
    assert {(r._qk, r._dk, r._dist) for r in cand if r._dist <= 1} == {(2000 + i, k, 1.0) for i in range(5) for k in (100, 101, 102)}
    assert knn_wide.visit_share(recv, donors, "k", "k", ["a", "b"], 3) < 0.15


def test_pca_leaves_out_rows_without_a_value(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(50, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]])
    rows = [(float(a), float(b)) for a, b in x]
    df = spark.createDataFrame([*rows, (None, None), (5.0, None)], "a double, b double")
    got = [r[1] for r in M.pca_fit(df, ["a", "b"]).explained(spark).collect()]
    value = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(got, value / value.sum())


def test_knn_distance_of_a_pair_is_computed_once_for_all_missing_features(monkeypatch):
    """Four features missing at once: their donors come from one list of pairs, and are those
    of plain search, also for a feature that few donors have."""
    import pandas as pd
    rnd, met = np.random.default_rng(5), []
    plain = knn_wide._pairs
    monkeypatch.setattr(knn_wide, "_pairs", lambda Q, D, r, c: met.append(len(r)) or plain(Q, D, r, c))
    q, d = rnd.normal(size=(40, 9)), rnd.normal(size=(300, 9))
    q[:, :4] = np.nan
    d[rnd.random(300) < 0.98, 3] = np.nan
    fcols, wanted, k = [f"c{i}" for i in range(9)], [0, 1, 2, 3], 5
    frame = lambda x, key: pd.DataFrame(x, columns=fcols).assign(**{key: np.arange(len(x))})
    got = list(knn_wide._best(frame(q, "_qk"), frame(d, "_dk"), fcols, k, wanted, np.full((40, 4), np.inf), False))
    assert len(met) == 1 and [g[2] for g in got] == wanted
    dist = np.sqrt(((q[:, None, 4:] - d[None, :, 4:]) ** 2).sum(2))
    for _, _, f, r, dk, _, v in got:
        has = np.flatnonzero(~np.isnan(d[:, f]))
        for i in range(40):
            want = has[np.argsort(dist[i, has], kind="stable")[:k]]
            assert dk[r == i].tolist() == want.tolist() and np.array_equal(v[r == i], d[want, f])


def test_leaf_without_the_feature_is_bounded_by_sampled_donors(spark):
    """Rows whose neighbours all lack a feature too visit few cells, with the same result."""
    import numpy as np
    import pandas as pd
    from custlens.operators import knn_wide as K
    rng = np.random.default_rng(5)
    place = np.repeat(np.arange(60), 100)
    age = np.where(place % 5 == 2, np.nan, rng.integers(18, 80, len(place)).astype(float))
    pdf = pd.DataFrame({"id": np.arange(len(place)), "x": place * 1000.0 + rng.integers(0, 3, len(place)), "age": age})
    df = spark.createDataFrame(pdf)
    df = df.select("id", "x", K.F.nullif("age", K.F.lit(float("nan"))).alias("age"))
    lost = df.where("age IS NULL")
    cells, go, *_ = K._index(lost, df, "id", "id", ["x", "age"], 5, True, False, 64, 64)
    most = go.selectExpr("max(size(_spots))").first()[0]
    assert most <= cells.select("_spot").distinct().count() // 4
    w = K.Window.partitionBy("_qk").orderBy("_dist", "_dk")
    got = K.wide_candidates(lost, df, "id", "id", ["x", "age"], 5, True, receiver_block_rows=64, donor_block_rows=64)
    got = got.withColumn("n", K.F.row_number().over(w)).where("n <= 5").toPandas()
    have = pdf[~np.isnan(pdf.age)]
    for q in pdf.id[np.isnan(pdf.age)][::97]:
        d = np.sqrt((have.x - pdf.x[q]) ** 2 * 2 / 1)
        want = have.id.to_numpy()[np.lexsort((have.id, d))[:5]]
        assert got[got._qk == q].sort_values("n")._dk.tolist() == want.tolist()


def test_bounds_of_squares_hold_with_and_without_absent_coordinates():
    """Only coordinates that some row lacks need their presence; none in common is infinite."""
    rnd = np.random.default_rng(3)
    for lacking in (0, 2, 5):
        q, d = rnd.normal(5, 3, (40, 5)), rnd.normal(5, 3, (70, 5))
        for x in (q, d):
            x[:, :lacking][rnd.random((len(x), lacking)) < 0.5] = np.nan
        square, off, free = knn_wide._squares(q, ~np.isnan(q), d, ~np.isnan(d), 5)
        exact = knn_wide._dist_block(q, ~np.isnan(q), d, ~np.isnan(d), 5) ** 2
        assert (free is None) == (lacking < 5) and (free is None or (free == ~np.isnan(exact)).all())
        none = np.isnan(exact)
        assert np.isinf(square[none]).all() and (np.abs(square - exact) <= off[:, None])[~none].all() and off.max() < 1e-9


def test_receivers_are_copied_once_per_group_of_cells(spark, monkeypatch):
    import pandas as pd
    rnd = np.random.default_rng(4)
    pdf = pd.DataFrame(rnd.normal(size=(600, 6)), columns=list("abcdef")).assign(k=np.arange(600))
    df = spark.createDataFrame(pdf)

    def found(cells):
        monkeypatch.setattr(knn_wide, "GROUP_CELLS", cells)
        met = knn_wide.wide_candidates(df, df, "k", "k", list("abcdef"), 3, False, True, donor_block_rows=20)
        got = met.toPandas().sort_values(["_qk", "_dist", "_dk"]).groupby("_qk").head(3)
        return got.reset_index(drop=True)

    a, b = found(1), found(16)
    assert a.equals(b) and len(a) == 1_800
    x = pdf[list("abcdef")].to_numpy()
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(dist, np.inf)
    assert (a._dk.to_numpy().reshape(600, 3) == np.argsort(dist, axis=1)[:, :3]).all()
