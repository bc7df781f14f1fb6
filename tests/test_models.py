import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import clustering as C
from custlens.operators import features as M
from custlens.operators import joins as J
from custlens.operators import sampling as R


def _brute_impute(rows, k):
    """Reference semantics of NaN-aware KNN imputation, written plainly."""
    n = len(rows[0]) - 1
    out = {}
    means = [np.nanmean([r[1 + f] if r[1 + f] is not None else np.nan for r in rows]) for f in range(n)]
    for r in rows:
        vals = list(r[1:])
        for f in range(n):
            if r[1 + f] is not None:
                continue
            cands = []
            for d in rows:
                if d[1 + f] is None:
                    continue
                both = [i for i in range(n) if r[1 + i] is not None and d[1 + i] is not None]
                if not both:
                    continue
                ss = 0.0
                for i in both:
                    ss = ss + (r[1 + i] - d[1 + i]) * (r[1 + i] - d[1 + i])
                cands.append((math.sqrt(ss * float(n) / len(both)), d[0], d[1 + f]))
            cands.sort()
            vals[f] = float(np.mean([c[2] for c in cands[:k]])) if cands else means[f]
        out[r[0]] = vals
    return out


def test_knn_impute_bruteforce_and_wide_path(spark):
    random.seed(11)
    n = 14
    rows = []
    for key in range(60):
        rows.append(tuple([key] + [None if random.random() < 0.2 else float(random.randint(0, 5)) for _ in range(n)]))
    rows.append(tuple([99] + [None] * n))                    # no comparable donor -> column means
    cols = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols))
    exp = _brute_impute(rows, 5)
    fit = M.knn_impute_fit(df, cols, "k")
    got = {r["k"]: [r[c] for c in cols] for r in M.knn_impute_apply(fit, df).collect()}   # wide path (14 > 12)
    for key, vals in exp.items():
        assert np.allclose(got[key], vals, rtol=0, atol=1e-12), key
    narrow = cols[:4]
    fit4 = M.knn_impute_fit(df.select("k", *narrow), narrow, "k")
    got4 = {r["k"]: [r[c] for c in narrow] for r in M.knn_impute_apply(fit4, df.select("k", *narrow)).collect()}
    exp4 = _brute_impute([r[:5] for r in rows], 5)
    for key, vals in exp4.items():
        assert np.allclose(got4[key], vals, rtol=0, atol=1e-12), key


def test_knn_many_blocks_match_bruteforce(spark, monkeypatch):
    """Tiny block bounds: rows spread over many (receiver, donor) block pairs
    must give the same neighbours, imputations and silhouette as one block."""
    from custlens.operators import knn_wide
    monkeypatch.setattr(knn_wide, "RECEIVER_BLOCK_ROWS", 7)
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 11)
    random.seed(5)
    n = 5
    rows = [tuple([key] + [None if random.random() < 0.25 else float(random.randint(0, 4)) for _ in range(n)])
            for key in range(70)]
    cols = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols))
    exp = _brute_impute(rows, 3)
    got = {r["k"]: [r[c] for c in cols] for r in M.knn_impute_apply(M.knn_impute_fit(df, cols, "k", k=3), df).collect()}
    for key, vals in exp.items():
        assert np.allclose(got[key], vals, rtol=0, atol=1e-12), key
    full = [r for r in rows if None not in r]
    X = {r[0]: np.array(r[1:]) for r in full}
    dfull = df.dropna()
    nn = J.knn_join(dfull, dfull, "k", "k", cols, 3, exclude_self=True).collect()
    got_nn = {}
    for r in nn:
        got_nn.setdefault(r.k, []).append((r["rank"], r.nn_k, r.distance))
    for q, x in X.items():
        want = sorted((float(np.sqrt(((x - y) ** 2).sum())), d) for d, y in X.items() if d != q)[:3]
        have = sorted(got_nn[q])
        assert [h[1] for h in have] == [w[1] for w in want], q
        assert np.allclose([h[2] for h in have], [w[0] for w in want], rtol=0, atol=1e-12)
    a = C.assign(dfull, [[0.0] * n, [4.0] * n], cols)
    lab = {r.k: r.cluster for r in a.collect()}
    keys = sorted(X)
    P = np.array([X[q] for q in keys])
    L = np.array([lab[q] for q in keys])
    s = []
    for i in range(len(P)):
        d = np.sqrt(((P - P[i]) ** 2).sum(1))
        own = L == L[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        ai = d[own & (np.arange(len(P)) != i)].mean()
        bi = min(d[L == c].mean() for c in set(L) if c != L[i])
        s.append((bi - ai) / max(ai, bi))
    assert abs(C.silhouette_exact(a, cols, "k").first()[0] - np.mean(s)) < 1e-9


def test_knn_join_ties_by_key(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(6)], "k long, x double")
    nn = J.knn_join(df, df, "k", "k", ["x"], 2, exclude_self=True).where("k = 0").orderBy("rank").collect()
    assert [r.nn_k for r in nn] == [1, 2]


def test_stratified_split_golden_counts(spark):
    rows = [(i, 1 if i < 1454 else 0) for i in range(4372)]
    df = spark.createDataFrame(rows, "CustomerID long, Churn long")
    s = R.stratified_split(df, "Churn", 0.2, 42)
    got = {(r.Churn, r.split): r["count"] for r in s.groupBy("Churn", "split").count().collect()}
    assert got[(0, "test")] == 584 and got[(1, "test")] == 291 and got[(0, "train")] == 2334
    # the small buckets of the two-level rank give the same positions
    p1 = R.stratum_positions(df, "CustomerID", 42, ["Churn"]).select("CustomerID", "_pos")
    p2 = R.stratum_positions(df, "CustomerID", 42, ["Churn"], bucket_rows=3).select("CustomerID", F.col("_pos").alias("p2"))
    assert p1.join(p2, "CustomerID").where("_pos <> p2").count() == 0


def test_smote_parity_and_segments(spark):
    random.seed(2)
    rows = [(i, 1 if i % 4 == 0 else 0, random.random(), random.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "CustomerID long, y long, a double, b double")
    out = R.smote(df, "y", ["a", "b"], "CustomerID", k=5, seed=42)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 150
    mino = np.array([(a, b) for _, y, a, b in rows if y == 1])
    for r in out.where("synthetic = 1").collect():
        p = np.array([r.a, r.b])
        # on a segment between two minority points: collinear with some pair
        ok = False
        for x in mino:
            d = p - x
            for z in mino:
                v = z - x
                if np.linalg.norm(v) == 0:
                    continue
                t = np.dot(d, v) / np.dot(v, v)
                if -1e-12 <= t <= 1 and np.linalg.norm(d - t * v) < 1e-9:
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_cluster_metrics_bruteforce(spark):
    random.seed(4)
    pts = [(i, random.gauss(i % 3, 0.3), random.gauss(0, 1)) for i in range(60)]
    df = spark.createDataFrame(pts, "k long, x double, y double")
    a = C.assign(df, [[0, 0], [1, 0], [2, 0]], ["x", "y"])
    lab = {r.k: r.cluster for r in a.collect()}
    X = np.array([(x, y) for _, x, y in pts])
    L = np.array([lab[k] for k, _, _ in pts])
    s = []
    for i in range(len(X)):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        own = L == L[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        ai = d[own & (np.arange(len(X)) != i)].mean()
        bi = min(d[L == c].mean() for c in set(L) if c != L[i])
        s.append((bi - ai) / max(ai, bi))
    assert abs(C.silhouette_exact(a, ["x", "y"], "k").first()[0] - np.mean(s)) < 1e-9
    cents = {c: X[L == c].mean(0) for c in set(L)}
    n, k = len(X), len(cents)
    g = X.mean(0)
    b = sum((L == c).sum() * ((cents[c] - g) ** 2).sum() for c in cents)
    w = sum(((X[L == c] - cents[c]) ** 2).sum() for c in cents)
    assert abs(C.calinski_harabasz(a, ["x", "y"]).first()[0] - b * (n - k) / (w * (k - 1))) < 1e-6
    sc = {c: np.sqrt(((X[L == c] - cents[c]) ** 2).sum(1)).mean() for c in cents}
    db = np.mean([max((sc[i] + sc[j]) / np.linalg.norm(cents[i] - cents[j]) for j in cents if j != i) for i in cents])
    assert abs(C.davies_bouldin(a, ["x", "y"]).first()[0] - db) < 1e-9


def test_segment_report_empty_cluster(spark):
    seg = spark.createDataFrame([(1, 0, 2.0, 10.0, 5.0, 3.0, 1)], "CustomerID long, cluster long, Frequency double, "
                                "MonetaryTotal double, CustomerTenureDays double, SatisfactionScore double, Churn long")
    labels = spark.createDataFrame([(0, "VIP"), (1, "A Risque")], "cluster long, label string")
    rep = {r.label: r for r in C.segment_report(seg, labels).collect()}
    assert rep["A Risque"].n_clients == 0 and rep["A Risque"].monetary == 0.0
    assert rep["VIP"].size_text == "1 clients (100.0%)" and rep["VIP"].satisfaction_text == "3.00/5"
    assert (rep["VIP"].frequency_text, rep["VIP"].monetary_text, rep["VIP"].tenure_text) == ("2.0 achats", "10 €", "5 jours")
    assert rep["A Risque"].badge == "Priorité : A Risque" and rep["A Risque"].churn_level == "Élevé"


def test_pca_ratios_and_artefact_roundtrip(spark, tmp_path):
    from custlens.sources import io
    random.seed(9)
    rows = [(random.gauss(0, 3), random.gauss(0, 1), random.gauss(0, 0.2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    fit = M.pca_fit(df, ["a", "b", "c"])
    ev = [r.explained_variance_ratio for r in fit.explained(spark).collect()]
    assert abs(sum(ev) - 1.0) < 1e-9 and ev == sorted(ev, reverse=True)
    sc = M.standard_fit(df, ["a", "b", "c"])
    d = str(tmp_path / "art")
    io.save_artefacts(spark, d, {"scaler": sc.to_frame(spark)})
    back = M.ColumnAffine.from_frame(io.load_artefacts(spark, d, ["scaler"])[0]["scaler"])
    assert back.center == sc.center and back.scale == sc.scale


def test_artefact_store_is_committed(spark, tmp_path):
    """A save that breaks in the middle leaves the last whole state; a version stays readable."""
    from custlens.sources import io
    d = str(tmp_path / "store")

    def state(v):
        return {"a": spark.createDataFrame([(v,)], "v long"), "b": spark.createDataFrame([(v + 1,)], "v long")}

    def read(version=None):
        p, _, meta = io.load_artefacts(spark, d, ["a", "b"], version=version)
        return p["a"].first()[0], p["b"].first()[0], meta["v"]

    with pytest.raises(FileNotFoundError):
        read()
    first = io.save_artefacts(spark, d, state(1), meta={"v": 1})
    assert read() == (1, 2, 1)
    broken = state(7)
    broken["b"] = broken["b"].select(F.raise_error(F.lit("disk is gone")).cast("long").alias("v"))
    with pytest.raises(Exception, match="disk is gone"):
        io.save_artefacts(spark, d, broken, meta={"v": 7})
    assert read() == (1, 2, 1)
    io.save_artefacts(spark, d, state(3), meta={"v": 3})
    assert read() == (3, 4, 3) and read(first) == (1, 2, 1)


def test_block_counts_bounds():
    from custlens.operators.knn_wide import SUB_BLOCK, _block_counts
    for groups in (16, 16_000):                               # local, and a very large cluster
        for nq, nd in [(0, 0), (1, 1), (15_000, 15_000), (10**9, 10**8), (5, 10**6)]:
            nqb, ndb = _block_counts(nq, nd, groups, 4096, 16384)
            assert nqb >= 1 and ndb >= 1
            assert nd / ndb <= 16384 and nq / nqb <= 4096      # no block above its bound
            # enough groups, unless the receivers would fall below one sub-block per block
            assert nqb * ndb >= groups or nqb >= math.ceil(max(nq, 1) / SUB_BLOCK)
            # small inputs are not copied once per receiver
            assert nqb <= max(math.ceil(max(nq, 1) / SUB_BLOCK), math.ceil(nq / 4096), 1)


def test_knn_candidates_bounded_under_ties(spark, monkeypatch):
    """All donors at the same distance: each block emits exactly k candidates
    per receiver (smallest keys), and the join returns the k smallest keys."""
    from custlens.operators import knn_wide
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 50)
    donors = spark.createDataFrame([(i, 1.0, 1.0) for i in range(300)], "k long, a double, b double")
    recv = spark.createDataFrame([(1000 + i, 0.0, 0.0) for i in range(5)], "k long, a double, b double")
    cand = knn_wide.wide_candidates(recv, donors, "k", "k", ["a", "b"], 3, per_feature=False)
    per = {r._qk: r.n for r in cand.groupBy("_qk").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per) == {1000 + i for i in range(5)} and max(per.values()) <= 3 * 6
    nn = J.knn_join(recv, donors, "k", "k", ["a", "b"], 3).collect()
    for q in range(1000, 1005):
        assert sorted((r["rank"], r.nn_k) for r in nn if r.k == q) == [(1, 0), (2, 1), (3, 2)]


def test_knn_cells_prune(spark, monkeypatch):
    """Clustered rows: few cells are visited, and the neighbours are still exact."""
    from custlens.operators import knn_wide
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 40)
    rnd = np.random.default_rng(8)
    centres = rnd.normal(0, 50, (12, 3))
    X = centres[rnd.integers(0, 12, 900)] + rnd.normal(0, 1, (900, 3))
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    cols = ["a", "b", "c"]
    assert knn_wide.visit_share(df, df, "k", "k", cols, 4) < 0.35
    got = {}
    for r in J.knn_join(df, df, "k", "k", cols, 3, exclude_self=True).collect():
        got.setdefault(r.k, []).append((r["rank"], r.nn_k))
    for i in range(900):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [k for _, k in sorted(got[i])] == np.argsort(d, kind="stable")[:3].tolist()


def test_knn_cells_span_presence_patterns(spark, monkeypatch):
    """Nearly every row has a presence pattern of its own: cells stay as few as rows / cell
    size, several regions are bounded in two steps, and everything stays exact."""
    from custlens.operators import knn_wide
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 12)
    monkeypatch.setattr(knn_wide, "FAN_OUT", 3)
    random.seed(21)
    n = 9
    rows = [tuple([key] + [None if random.random() < 0.4 else float(random.randint(0, 9)) for _ in range(n)]) for key in range(180)]
    rows += [tuple([500] + [None] * n), tuple([501] + [None] * (n - 1) + [3.0])]
    cols = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    assert len({tuple(v is None for v in r[1:]) for r in rows}) > 100
    _, d, fcols = knn_wide._sides(df, df, "k", "k", cols)
    boxes = knn_wide._cell_boxes(knn_wide._donor_cells(d, fcols, 12), fcols).select("_spot", "_region", "n").collect()
    assert sum(b["n"] for b in boxes) == len(rows) and len(boxes) <= -(-len(rows) // 12) and len({b["_region"] for b in boxes}) > 3
    got = {r["k"]: [r[c] for c in cols] for r in M.knn_impute_apply(M.knn_impute_fit(df, cols, "k", k=4), df).collect()}
    for key, vals in _brute_impute(rows, 4).items():
        assert np.allclose(got[key], vals, rtol=0, atol=1e-12), key
    near = {}
    for r in J.knn_join(df, df, "k", "k", cols, 3, exclude_self=True).collect():
        near.setdefault(r.k, []).append((r["rank"], r.nn_k))
    for q in rows:
        want = []
        for o in rows:
            both = [(a - b) ** 2 for a, b in zip(q[1:], o[1:]) if a is not None and b is not None]
            if both and o[0] != q[0]:
                want.append(((sum(both) * n / len(both)) ** 0.5, o[0]))
        assert [k for _, k in sorted(near.get(q[0], []))] == [k for _, k in sorted(want)[:3]], q[0]


def test_knn_regions_prune(spark, monkeypatch):
    """With several regions the clustered rows of ``test_knn_cells_prune`` still visit few cells."""
    from custlens.operators import knn_wide
    monkeypatch.setattr(knn_wide, "DONOR_BLOCK_ROWS", 40)
    monkeypatch.setattr(knn_wide, "FAN_OUT", 4)
    rnd = np.random.default_rng(8)
    centres = rnd.normal(0, 50, (12, 3))
    X = centres[rnd.integers(0, 12, 900)] + rnd.normal(0, 1, (900, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "k long, a double, b double, c double")
    assert knn_wide.visit_share(df, df, "k", "k", ["a", "b", "c"], 4) < 0.35
