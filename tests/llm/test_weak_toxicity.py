import zlib

import numpy as np
import pyarrow as pa

from custlens.llm import weak_toxicity as W


def test_label_model_finds_the_rates():
    rnd = np.random.default_rng(4)
    y = rnd.random(8000) < 0.2
    rates = [(0.05, 0.7), (0.02, 0.5), (0.3, 0.32), (0.01, 0.6)]
    votes = np.stack([rnd.random(8000) < np.where(y, b, a) for a, b in rates], 1)
    votes = np.concatenate([votes, votes[:, :1]], 1)  # a voter that copies another
    known = np.where(rnd.random(8000) < 0.1, ~y, y).astype(int)
    post, rate, corr = W.label_model(votes, known)
    assert ((post >= 0.5) == y).mean() > 0.94
    assert all(abs(rate[0][k] - a) < 0.05 and abs(rate[1][k] - b) < 0.12 for k, (a, b) in enumerate(rates))
    assert corr[0, 4] > 0.99 and abs(corr[0, 2]) < 0.1


def test_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in W.score(docs.select("doc_id", "text"), W.fit(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(t == r["predicted"] for t, r in held) / len(held) > 0.97
    pos, neg = ([r["score"] for t, r in held if t == k] for k in (1, 0))
    assert (np.array(pos)[:, None] > np.array(neg)).mean() > 0.93


def test_score_sees_the_text_alone(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = W.fit(docs, labels)
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end"))
    other = W.fit(docs, flipped)
    assert (model.hashes == other.hashes).all() and np.allclose(model.weights, other.weights)
    texts = pa.array(["You idiot, you pathetic loser.", "A calm text.", None, ""])
    s = model.scores(texts)
    assert s[0] > 0.5 > s[1] and s[2] == s[3] < 0.5


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "idiot", 1.0), (3, "word " * 100_000, 1.0), (3, "x", 1.0), (3, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = W.fit(df, none)
    got = W.score(df, model).collect()
    assert sorted(r["predicted"] for r in got) == [0, 0, 0, 0, 0, 1]
    assert W.score(df.limit(0), W.fit(df.limit(0), none)).collect() == []
    tiny = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, None)], "doc_id long, toxic int")
    assert len(W.score(df, W.fit(df, tiny)).collect()) == 6


def test_one_doc_id_on_a_third_of_all_rows(spark):
    rows = [(d, "calm words here " * 3 + f"w{d}", 0) for d in range(1, 400)] + [(d, f"you idiot loser scum w{d}", 1) for d in range(400, 600)]
    once = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = once.select("doc_id", "text"), once.select("doc_id", "toxic")
    hot = spark.range(300).selectExpr("cast(401 as long) as doc_id", "concat('you idiot loser scum w401', if(id = 0, '', ' z')) as text")
    a = W.fit(docs, labels)
    b = W.fit(docs.filter("doc_id <> 401").unionByName(hot), labels.unionByName(labels.filter("doc_id = 401")))
    assert (a.hashes == b.hashes).all() and np.allclose(a.weights, b.weights) and a.bias == b.bias
    assert len(a.voter_weights) >= 40
