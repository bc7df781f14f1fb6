import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.operators import gram as K
from custlens.operators import profile as A
from custlens.operators import regress as G
from custlens.operators.sampling import assign_folds


def frame(spark, pdf, schema, parts=5):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema).repartition(parts)


def test_correlations_equal_pandas(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 6)) * [1, 1e3, 1e-4, 1, 5, 1] + [1e5, -5, 0, 0, 3, 0]
    x[:, 4], x[:, 5] = 7.1, x[:, 0] * 2 + 1
    x[r.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcdef"))
    pdf["z z"] = np.nan
    df = frame(spark, pdf, "a double, b double, c double, d double, e double, f double, `z z` double", 7)
    got = A.corr_matrix(df, list(pdf.columns)).toPandas()
    assert len(got) == 49
    wide = got.pivot(index="feature_1", columns="feature_2", values="corr").loc[list(pdf.columns), list(pdf.columns)]
    want = pdf.corr()
    assert (wide.isna() == want.isna()).all().all() and np.nanmax(np.abs(wide.values - want.values)) < 1e-9
    high = A.high_corr_pairs(df, list(pdf.columns), 0.9).collect()
    assert [(h["feature_1"], h["feature_2"]) for h in high] == [("a", "f")]


def test_correlations_of_odd_tables(spark):
    df = spark.createDataFrame([], "a double, b bigint")
    assert A.corr_matrix(df, ["a", "b"]).collect() == []
    one = spark.createDataFrame([(1.0, 2), (None, 3)], "a double, b bigint")
    got = {(r["feature_1"], r["feature_2"]): r["corr"] for r in A.corr_matrix(one, ["a", "b"]).collect()}
    assert got[("a", "a")] is None and got[("a", "b")] is None and abs(got[("b", "b")] - 1) < 1e-12


def test_moments_add_up(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 3)) + [100, 0, -7]
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["g"] = r.integers(0, 4, 500)
    m = K.group_moments(frame(spark, pdf, "a double, b double, c double, g long"), list("abc"), "g")
    assert set(m) == set("0123")
    for g, own in m.items():
        part = pdf[pdf.g == int(g)][list("abc")].to_numpy()
        assert own.n == len(part) and np.allclose(own.mean, part.mean(0)) and np.allclose(own.co, np.cov(part.T) * (len(part) - 1))
    total = m["0"] + m["1"] + m["2"] + m["3"]
    assert total.n == 500 and np.allclose(total.mean, x.mean(0)) and np.allclose(total.co, np.cov(x.T) * 499)


def singular(rows=400):
    """Two one-hot groups without a dropped level, a constant, and a column in other units."""
    r = np.random.default_rng(3)
    a, b = np.eye(3)[r.integers(0, 3, rows)], np.eye(2)[r.integers(0, 2, rows)]
    x = np.column_stack([a, b, np.full(rows, 4.0), r.normal(size=rows) * 1e4, r.normal(size=rows)])
    y = a @ [1, 5, -2] + b @ [0, 3] + x[:, 6] * 1e-3 + r.normal(size=rows) + 50
    return x, y


def least_norm(x, y):
    b = np.linalg.pinv(x - x.mean(0), rcond=1e-9) @ (y - y.mean())
    return b, y.mean() - b @ x.mean(0)


def test_least_norm_equals_the_pseudo_inverse(spark):
    x, y = singular()
    names = [f"x{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])
    pdf.loc[[3, 9], "y"] = np.nan
    pdf["gone"] = np.nan
    line = G.fit_line(frame(spark, pdf, ", ".join(f"{c} double" for c in pdf.columns)), [*names, "gone"], "y")
    whole = pdf.dropna(subset=["y"])
    b, b0 = least_norm(whole[names].to_numpy(), whole["y"].to_numpy())
    assert np.allclose([line.coefficients[c] for c in names], b, atol=1e-7, rtol=1e-6) and abs(line.intercept - b0) < 1e-6
    assert (line.n_rows, line.n_dropped, line.coefficients["gone"]) == (398, 2, 0.0)


def test_cross_validation_equals_a_fit_per_fold(spark):
    x, y = singular(300)
    names = [f"x{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(np.column_stack([x, y]), columns=[*names, "y"])
    pdf["CustomerID"] = np.arange(300)
    pdf.loc[[5, 77], "y"] = np.nan
    df = frame(spark, pdf, ", ".join(f"{c} {'long' if c == 'CustomerID' else 'double'}" for c in pdf.columns))
    folds = assign_folds(df.where(F.col("y").isNotNull()).select("CustomerID"), 5, None, 42).toPandas()
    whole = pdf.merge(folds, on="CustomerID")
    got = {r["fold"]: r["r2"] for r in G.cross_val_r2(spark, df, names, "y").collect()}
    for f in range(5):
        tr, te = whole[whole.fold != f], whole[whole.fold == f]
        b, b0 = least_norm(tr[names].to_numpy(), tr["y"].to_numpy())
        e = te["y"] - te[names].to_numpy() @ b - b0
        assert abs(got[f] - (1 - (e**2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum())) < 1e-8


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_few_rows(spark, rows):
    df = spark.createDataFrame([(k, 1.0 * k, 2.0 * k) for k in range(rows)], "CustomerID long, x double, y double")
    got = G.cross_val_r2(spark, df, ["x"], "y").collect()
    assert len(got) == 5 and all(r["r2"] is None or r["r2"] <= 1 for r in got)
    line = G.fit_line(df, ["x"], "y")
    assert line.n_rows == rows and (rows < 3 or abs(line.coefficients["x"] - 2) < 1e-9)


def test_spend_model_without_a_target(spark):
    """A customer without orders has a null target: left out of the fit, counted, and scored."""
    rows = [(k, float(3 * k) if k % 7 else None, float(k), float(k % 5) if k % 4 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "CustomerID long, MonetaryTotal double, x double, z double")
    m = G.train_spend(df)
    assert (m.line.n_rows, m.line.n_dropped) == (51, 9)
    got = G.predict_spend(m, df, keep=["MonetaryTotal"]).toPandas()
    assert len(got) == 60 and np.allclose(got.predicted, 3 * got.CustomerID, atol=1e-6)
    none = G.train_spend(df.where("MonetaryTotal IS NULL"))
    assert (none.line.n_rows, none.line.n_dropped) == (0, 9)
