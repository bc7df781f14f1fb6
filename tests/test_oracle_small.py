"""The oracle gate on the smallest tables: Spark result == DuckDB result
(row count, column names, order-insensitive values) for fast queries."""

import math

import duckdb
import pytest

from conftest import SMALL

FAST = ["s07_records_to_df", "p02_categorical_profile", "p11_null_sentinels", "p20_schema_profile",
        "f01_parse_mixed_date", "f05_ip_is_private", "f11_one_hot", "f14_round_even", "j06_knn_join",
        "a08_describe", "a10_iqr_outliers", "a11_missing_report", "a21_near_constant", "a23_histogram",
        "r01_stratified_split", "r03_assign_folds", "w03_roc_curve", "b06_classification_report",
        "m10_preprocess", "m01_knn_impute", "c11_segment_report", "c05_silhouette", "c03b_assign_nine", "c05d_silhouette_nine", "c05e_silhouette_sq_nine", "c06b_davies_bouldin_nine",
        "c07b_calinski_harabasz_nine", "c08b_centroids_nine", "o03_score_segment"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(srows, sdf.columns) == _rows(res.fetchall(), dcols)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 4 and "size_text" in df.columns


def test_every_query_registered_with_callable():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 140 and set(o) <= set(q)
