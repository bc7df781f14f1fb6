import datetime

from custlens.plans import fixture


def test_join_of_lines_and_orders_follows_their_number(spark, tmp_path, monkeypatch):
    """Many lines are dealt to more tasks, with the same customers."""
    day = datetime.date(2024, 1, 1)
    tables = {
        "region": ([(0, "EUROPE")], "r_regionkey long, r_name string"),
        "nation": ([(0, "FRANCE", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, 0, "BUILDING") for i in range(10)], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "orders": ([(i, i % 9, 10.0 * i, day + datetime.timedelta(i)) for i in range(40)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date"),
        "lineitem": ([(i % 40, i % 7, float(i % 5), "RN"[i % 2]) for i in range(200)] + [(None, 1, 1.0, "N")], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = fixture.customer_fixture(spark, str(tmp_path)).orderBy("CustomerID").collect()
    monkeypatch.setattr(fixture, "JOIN_ROWS", 30)
    many = fixture.customer_fixture(spark, str(tmp_path))
    assert "RepartitionByExpression [l_orderkey" in many._jdf.queryExecution().optimizedPlan().toString()
    assert many.orderBy("CustomerID").collect() == want and len(want) == 10
    # and so are the sums by customer and part, by both, so that no task holds more of them
    monkeypatch.setattr(fixture, "PAIR_ROWS", 20)
    many = fixture.customer_fixture(spark, str(tmp_path))
    assert "RepartitionByExpression [k#" in (plan := many._jdf.queryExecution().optimizedPlan().toString()) and ", 11" in plan
    assert many.orderBy("CustomerID").collect() == want


def test_join_of_customers_and_their_sums_follows_their_number(spark, tmp_path, monkeypatch):
    """Many customers, some repeated, unknown to the orders or without any, are dealt to
    more tasks, with the same rows."""
    day = datetime.date(2024, 1, 1)
    tables = {
        "region": ([(0, "EUROPE")], "r_regionkey long, r_name string"),
        "nation": ([(0, "FRANCE", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i % 10, 0, "BUILDING") for i in range(12)] + [(None, 0, "BUILDING")], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "orders": ([(i, None if i == 7 else i % 14, 10.0 * i, day + datetime.timedelta(i)) for i in range(40) if i % 14 != 3], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date"),
        "lineitem": ([(i % 40, i % 7, float(i % 5), "RN"[i % 2]) for i in range(200)], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = fixture.customer_fixture(spark, str(tmp_path)).orderBy("CustomerID").collect()
    monkeypatch.setattr(fixture, "CUSTOMER_ROWS", 4)
    many = fixture.customer_fixture(spark, str(tmp_path))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [k#") == 3 and ", 4" in plan
    assert many.orderBy("CustomerID").collect() == want and len(want) == 13
