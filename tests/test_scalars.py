import ipaddress
import random

from pyspark.sql import functions as F

from custlens.functions import scalars as S


def _py_private(v):
    try:
        return int(ipaddress.ip_address(str(v)).is_private)
    except ValueError:
        return None


def test_ip_private_matches_stdlib(spark):
    random.seed(7)
    vals = ["10.0.0.1", "172.16.5.4", "172.32.0.1", "192.168.1.1", "192.0.0.9", "192.0.0.10", "192.0.0.11",
            "192.0.2.5", "198.18.3.3", "198.51.100.7", "203.0.113.9", "127.0.0.1", "0.1.2.3", "169.254.1.1",
            "240.0.0.1", "255.255.255.255", "8.8.8.8", "999.1.1.1", "01.2.3.4", "unknown", None, "fe80::1",
            "::1", "2001:db8::1", "fc00::5", "2606:4700::1111", " 10.0.0.1", "1.2.3"]
    vals += [".".join(str(random.randint(0, 255)) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "ip string")
    got = [r[0] for r in df.select(S.ip_is_private("ip")).collect()]
    assert got == [_py_private(v) for v in vals]


def test_first_octet(spark):
    df = spark.createDataFrame([("999.1.1.1",), ("fe80::1",), ("10.2.3.4",), (None,), ("unknown",)], "ip string")
    assert [r[0] for r in df.select(S.ip_first_octet("ip")).collect()] == [999, None, 10, None, None]


def test_mixed_dates(spark):
    df = spark.createDataFrame([("25/03/19",), ("2019-03-25",), ("03/25/2019",), ("05/03/2019",),
                                ("not a date",), (None,), ("31/02/2019",)], "d string")
    got = [str(r[0]) if r[0] else None for r in df.select(S.parse_mixed_date("d")).collect()]
    assert got == ["2019-03-25", "2019-03-25", "2019-03-25", "2019-03-05", None, None, None]
    parts = S.date_parts(df.limit(1), "d").first()
    assert (parts.RegYear, parts.RegMonth, parts.RegDay, parts.RegWeekday) == (2019, 3, 25, 0)


def test_round_even_numpy_semantics(spark):
    import numpy as np
    xs = [237778.855, 0.125, 2.5, -1.005, 1.015, 12345.675]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(S.round_even("x", 2)).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


def test_ordinal_unknown_and_onehot_replay(spark):
    df = spark.createDataFrame([(1, "Low", "F"), (2, "Weird", None), (3, None, "M")], "k int, SpendingCategory string, Gender string")
    enc = S.ordinal_encode(df, {"SpendingCategory": S.ORDINAL_MAPS_LIBRARY["SpendingCategory"]})
    assert [r[0] for r in enc.orderBy("k").select("SpendingCategory").collect()] == [0, -1, -1]
    oh, vocab = S.one_hot(df, ["Gender"])
    assert vocab == [("Gender", "F"), ("Gender", "M")]
    rows = oh.orderBy("k").select("Gender_F", "Gender_M").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0), (0, 1)]
    unseen = spark.createDataFrame([(4, "X")], "k int, Gender string")
    o2, _ = S.one_hot(unseen, ["Gender"], vocab=vocab)
    assert tuple(o2.select("Gender_F", "Gender_M").first()) == (0, 0)


def test_log_and_clip_null_safe(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (3.0,)], "x double")
    c = S.clip(df, {"x": (0.0, 2.0)})
    assert [r[0] for r in c.collect()] == [0.0, None, 2.0]
    lg = S.log1p_cols(df, ["x"])
    assert [r[0] for r in lg.collect()][0] is None
    lf = S.log1p_cols(df, ["x"], floor=True)
    assert [r[0] for r in lf.collect()][0] == 0.0


def test_ipv6_matches_stdlib(spark):
    rnd = random.Random(3)
    vals = ["::", "::1", "::2", "1::", "fe80::1%eth0", "fe80::1%", "%x", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::10.0.0.1", "64:ff9b:1::5", "64:ff9b::1", "100::1", "100:0:0:1::",
            "2001::1", "2001:1::1", "2001:1::2", "2001:1::3", "2001:3::9", "2001:4:112::1", "2001:4:113::1", "2001:20::1", "2001:2f:1::", "2001:3f::", "2001:40::", "2001:1ff::",
            "2001:200::", "2001:db8:9::", "2002::5", "3fff::1", "fc00::", "fdff::1", "fe00::", "febf::1", "fec0::", "ff02::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
            "1::2::3", ":::", ":1::2", "1::2:", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "::1:2:3:4:5:6:7:8", "12345::", "g::", "", ":", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "::256.1.1.1",
            "::01.2.3.4", "fe80::1/64", "a:b", "::ffff:0:1", "0:0:0:0:0:ffff:c0a8:1"]
    for _ in range(400):
        parts = [f"{rnd.choice([0, 1, 0x2001, 0xfe80, 0xfc00, rnd.randrange(65536)]):x}" for _ in range(rnd.choice([8, 8, 7, 5, 3, 9]))]
        if rnd.random() < 0.6:
            parts.insert(rnd.randrange(len(parts) + 1), "")
            if parts[0] == "" or parts[-1] == "":
                parts.insert(0 if parts[0] == "" else len(parts), "")
        vals.append(":".join(parts))
    df = spark.createDataFrame([(v,) for v in vals], "ip string")
    out = df.select("ip", S.ip_is_private("ip").alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["ip"], r["p"]) for r in out.collect()] == [(v, _py_private(v)) for v in vals]


def test_one_hot_vector_and_advice(spark):
    df = spark.createDataFrame([(1, "F"), (2, None), (3, "M")], "k int, Gender string")
    out, model = S.one_hot_vector(df, ["Gender"])
    assert [r.Gender_onehot.toArray().tolist() for r in out.orderBy("k").collect()] == [[1, 0], [0, 0], [0, 1]]
    again, _ = S.one_hot_vector(spark.createDataFrame([(4, "X"), (5, "M")], "k int, Gender string"), ["Gender"], model)
    assert [r.Gender_onehot.toArray().tolist() for r in again.orderBy("k").collect()] == [[0, 0], [0, 1]]
    advice = [r[0] for r in spark.createDataFrame([(1,), (0,), (None,)], "p int").select(S.churn_advice("p")).collect()]
    assert advice == [S.CHURN_ADVICE[1], S.CHURN_ADVICE[0], None]
