"""Rows and tables that an operator must not lose or trip over."""
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from custlens.operators import profile as A
from custlens.operators import ranking as W
from custlens.operators import sampling as R
from custlens.operators import schema as P
from custlens.sources import io

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_in_a_plain_session():
    """No option set: a fresh process, as any user's."""
    code = ("from pyspark.sql import SparkSession; import __spark_entry__ as e; "
            "s = SparkSession.builder.master('local[4]').getOrCreate(); df = e.entry(s); print('ROWS', len(df.collect()), e.queries().keys() >= e.oracle_sql().keys())")
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "ROWS 4 True" in got.stdout, got.stderr[-2000:]


def test_splits_keep_null_labels_and_keys(spark):
    rows = [(k, k % 2) for k in range(20)] + [(100, None), (None, 1), (None, None), (None, 1), (2**60, 0), (-5, 1)]
    df = spark.createDataFrame(rows, "CustomerID long, Churn long")
    s = R.stratified_split(df, "Churn").collect()
    assert sorted(map(str, ((r.CustomerID, r.Churn) for r in s))) == sorted(map(str, rows))
    for y in (0, 1, None):
        own = [r for r in s if r.Churn == y]
        assert sum(r.split == "test" for r in own) == math.ceil(0.2 * len(own))
    assert len(R.random_split(df.select("CustomerID")).collect()) == len(rows)
    f = R.assign_folds(df, 5, "Churn").collect()
    assert len(f) == len(rows) and {r.fold for r in f} == set(range(5))
    assert len(P.sample_n(df, 5, 42, "CustomerID").collect()) == 5
    assert R.stratified_split(df.limit(0), "Churn").collect() == []


def test_hash_is_the_plain_one(spark):
    keys = [0, 1, 7, 10**9, 12345]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select(R.key_hash("k", 42)).collect()
    assert [r[0] for r in got] == [(k * 7919 + 42) % 10007 for k in keys]


def test_box_stats_many_groups(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.gauss(0, 1) * 10 ** rnd.randrange(3)) for g in range(1500) for _ in range(6)] + [(5000, None), (None, 1.0)]
    got = {r.grp: r for r in A.box_stats(spark.createDataFrame(rows, "g long, x double"), "x", "g").collect()}
    assert len(got) == 1501 and got["5000"].q1 is None and got["5000"].n_fliers == 0
    for g in (0, 77, 1499):
        v = np.array([x for k, x in rows if k == g])
        q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got[str(g)]
        assert np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, m, q3, v[v >= lo].min(), v[v <= hi].max()], rtol=1e-12)
        assert r.n_fliers == ((v < lo) | (v > hi)).sum()


def test_all_null_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "k int, e double, x double")
    r = {x.feature: x for x in A.iqr_outliers(df, ["e", "x"]).collect()}
    assert r["e"].q1 is None and r["e"].n_outliers == 0 and r["x"].q1 == 2.25
    n = {x.column_name: x for x in A.near_constant(df).collect()}
    assert n["e"].n_unique == 0 and n["e"].top_value is None
    b = A.box_stats(df, "e").first()
    assert b.q1 is None and b.n_fliers == 0


def test_one_class_and_equal_scores(spark):
    for rows in ([(1, 0.2), (1, 0.7)], [(0, 0.2), (0, 0.2)]):
        df = spark.createDataFrame(rows, "y int, p double")
        assert W.roc_auc(df, "y", "p").first()[0] is None
        assert len(W.roc_curve(df, "y", "p").collect()) == 1 + len({p for _, p in rows})
        W.average_precision(df, "y", "p").collect()
        W.pr_curve(df, "y", "p").collect()
    same = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, p double")
    assert W.roc_auc(same, "y", "p").first()[0] == 0.5


def test_running_sums_over_crowded_scores(spark):
    rnd = random.Random(9)
    vals = sorted({round(rnd.random() ** 12, 9) for _ in range(3000)})
    g = spark.createDataFrame([(v, 1) for v in vals], "score double, c long")
    for down in (False, True):
        r = W.running_sums(g, "score", ["c"], descending=down, n_buckets=40).orderBy("score").collect()
        want = range(1, len(vals) + 1)
        assert [x.cum_c for x in r] == (list(want) if not down else list(want)[::-1])
        sizes = W.running_sums(g, "score", ["c"], descending=down, n_buckets=40)
    assert sizes.count() == len(vals)


def test_load_or_build_refuses_a_missing_column(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        io.load_or_build_features(spark, str(tmp_path / "f"), lambda: df, ["a", "z"])


def test_nan_becomes_null_at_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, k int")
    df.write.parquet(str(tmp_path / "n"))
    assert [r.x for r in io.read_table(spark, str(tmp_path / "n")).orderBy("k").collect()] == [1.0, None, None]


def test_crosstab_long_equals_wide(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 1), (None, 1)], "r string, c int")
    wide = {r.r: (r.c_1, r.c_2) for r in A.crosstab(df, "r", "c").collect()}
    long = {(r.r, r.c): r.n_rows for r in A.crosstab_long(df, "r", "c").collect()}
    assert wide == {"a": (2, 1), "b": (1, 0)} and long == {("a", 1): 2, ("a", 2): 1, ("b", 1): 1}


def test_reassign_keeps_ids_and_handles_empty_frames(spark):
    from custlens.operators import clustering as C
    rows = [(1, 0.0, 0.0, 5), (2, 0.1, 0.0, 5), (3, 4.0, 4.0, 9), (4, 3.9, 4.0, 5), (5, 4.1, 4.2, 9), (6, 4.0, 4.1, None), (7, 0.0, 0.2, 5)]
    df = spark.createDataFrame(rows, "id int, x double, y double, cluster long")
    got = {r["id"]: r for r in C.reassign(df, ["x", "y"]).collect()}
    assert {k: r["cluster"] for k, r in got.items()} == {1: 5, 2: 5, 3: 9, 4: 9, 5: 9, 6: 9, 7: 5}
    assert abs(got[1]["dist2"] - (1.0**2 + 1.05**2)) < 1e-9 and set(got[1].asDict()) == {"id", "x", "y", "cluster", "dist2"}
    none = C.reassign(df.limit(0), ["x", "y"])
    assert none.collect() == [] and none.columns == ["id", "x", "y", "cluster", "dist2"]
