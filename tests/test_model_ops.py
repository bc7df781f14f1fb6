"""Model operators without a closed SQL form: invariants on the sf0.001 tables."""
import numpy as np
import pytest

from custlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def go(name):
        if name not in done:
            done[name] = QUERIES[name](spark, SF).toPandas()
        return done[name]
    return go


@pytest.fixture(scope="module")
def ids(spark):
    return sorted(r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect())


def test_churn_model(run, ids):
    b1, b2 = run("b01_train_churn"), run("b02_predict_churn")
    assert b2.churn_proba.between(0, 1).all() and sorted(b2.CustomerID) == ids
    assert ((b1.churn_proba >= 0.5) == (b1.churn_pred == 1))[(b1.churn_proba - 0.5).abs() > 1e-3].all()
    pos, neg = b1[b1.Churn == 1].churn_proba.to_numpy(), b1[b1.Churn == 0].churn_proba.to_numpy()
    assert (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean() > 0.55
    w6 = run("w06_importance_rank")
    assert len(w6) == 15 and w6.importance.is_monotonic_decreasing and 0 < w6.importance.sum() <= 1 + 1e-6


def test_grid_search_and_cross_validation(run):
    g = run("b07_grid_search")
    assert len(g) == 12 and len(g.drop_duplicates(["num_trees", "max_depth", "min_instances"])) == 12
    assert g.mean_f1.between(0, 1).all() and g.best.sum() == 1 and g[g.best].mean_f1.iloc[0] == g.mean_f1.max()
    c = run("b08_cross_val").set_index("fold")
    folds = c.loc[range(5)]
    assert np.isclose(c.loc[-1].f1, folds.f1.mean()) and np.isclose(c.loc[-2].auc, folds.auc.std(ddof=0)) and folds.auc.between(0, 1).all()


def test_clusters(run):
    c1 = run("c01_kmeans_fit")
    assert len(c1) == 4 and (c1.training_cost > 0).all()
    c2 = run("c02_k_sweep")
    assert list(c2.k) == list(range(2, 9)) and c2.silhouette_sq.between(-1, 1).all()
    assert c2.inertia.is_monotonic_decreasing
    rep = run("c11b_fitted_report")
    assert len(rep) == 4 and set(rep.label) == {"VIP", "Fidele", "Occasionnel", "A Risque"} and abs(rep.share_pct.sum() - 100) < 0.5
    assert rep.set_index("label").monetary.reindex(["VIP", "Fidele", "Occasionnel", "A Risque"]).is_monotonic_decreasing


def test_pca(run):
    p = run("m07_pca_project")
    train = p[p.split == "train"]
    comps = [c for c in p.columns if c.startswith("PC")]
    assert train[comps].mean().abs().max() < 1e-6                       # centred on the rows it was fitted on
    var = train[comps].var()
    assert (var.to_numpy()[:-1] >= var.to_numpy()[1:] - 1e-9).all()
    cov = np.cov(train[comps].to_numpy().T)
    assert np.abs(cov - np.diag(np.diag(cov))).max() < 1e-6 * var.max()
    assert set(p.split) == {"train", "test"}
    w = run("w02_components_for").iloc[0]
    assert w.n_components_70 <= w.n_components_80 <= w.n_components_90 == len(comps) <= w.n_components_95
    ld = run("m09_pca_loadings")
    assert (ld.groupby("component").size() == [20, 8, 8, 8, 5, 5, 5]).all()
    d = run("m08_pca_display").merge(p, on="CustomerID")
    assert np.allclose(d.PC1_x, d.PC1_y) and np.allclose(d.PC3_x, d.PC3_y)


def test_spend_model(run, ids):
    g = run("g01_train_spend")
    r2 = 1 - ((g.MonetaryTotal - g.predicted) ** 2).sum() / ((g.MonetaryTotal - g.MonetaryTotal.mean()) ** 2).sum()
    assert r2 > 0.3
    assert len(run("g05_cross_val_r2")) == 5 and (run("g05_cross_val_r2").r2 <= 1).all()
    o2 = run("o02_score_spend")
    assert sorted(o2.CustomerID) == ids and np.isfinite(o2.predicted_monetary).all()


def test_scoring_and_reload(run, ids):
    o1, o4, o5 = run("o01_score_churn"), run("o04_score_all"), run("o05_score_batch")
    for o in (o1, o4, o5):
        assert sorted(o.CustomerID) == ids and o.churn_proba.between(0, 1).all()
    a, b = (x.sort_values("CustomerID").reset_index(drop=True) for x in (o4, o5[o4.columns]))
    assert a.equals(b)                                                   # scores from the loaded store are the same
    both = o1.merge(o4, on="CustomerID")
    assert (both.churn_proba_x == both.churn_proba_y).all() and set(o4.cluster_label) <= {"VIP", "Fidele", "Occasionnel", "A Risque"}
    assert (o4.risk == np.where(o4.churn_proba >= 0.5, "Élevé", "Faible")).all()


def test_balanced_training_rows_are_made_once(spark, tmp_path, monkeypatch):
    """The synthetic rows feed the class counts, the weights and the forest: they are not
    found again for each."""
    from custlens.operators import classify as B
    rnd = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(i % 4 == 0), float(a), float(b)) for i, (a, b) in enumerate(rnd.normal(size=(80, 2)))],
                               "CustomerID long, Churn long, a double, b double")

    def made(xs, *args, **kw):
        def mark(batches):
            (tmp_path / f"{np.random.default_rng().integers(1 << 60)}").touch()
            yield from batches
        return xs.coalesce(1).mapInArrow(mark, xs.schema)

    monkeypatch.setattr(B, "smote", made)
    model = B.train_churn(df, num_trees=3, max_depth=3, min_leaf=2)
    assert len(list(tmp_path.iterdir())) == 1
    assert model.forest.getNumTrees == 3 and model.forest.getCacheNodeIds()


def test_grid_forests_keep_the_rows_nodes(spark):
    from custlens.operators import classify as B
    assert B._forest("Churn", 42, 3, 30, 1).getCacheNodeIds()
