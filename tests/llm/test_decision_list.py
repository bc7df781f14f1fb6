import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from custlens.llm import decision_list as D


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(text), len(lines)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab# \n\té|☃", max_size=40)), max_size=6))
def test_statistics(texts):
    got = D.text_statistics(pa.array(texts, pa.string()))
    assert [[int(c[i]) for c in got[:7]] for i in range(len(texts))] == [brute(t) for t in texts]


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = D.fit_rules(docs, labels)
    got = {r["doc_id"]: r for r in D.judge(docs, rules).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text)
    for d, t in text.items():
        want = brute(t)
        assert [got[d][c] for c in D.BASE] == want[:5]
        assert got[d]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[d]["base_failed"] and got[d]["kept"])
    # the list on its own: rules from one half of the labels, judged on the other
    half = D.fit_rules(docs, labels.filter("doc_id % 2 = 0"))
    other = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 2 = 1").collect()}
    kept = {r["doc_id"]: r["list"] for r in D.quality_statistics(docs).withColumn("list", D.verdict(half)).collect()}
    bad = [d for d, q in other.items() if q == 0]
    good = [d for d, q in other.items() if q == 1]
    assert sum(not kept[d] for d in bad) >= 0.85 * len(bad)
    assert sum(kept[d] for d in good) >= 0.98 * len(good)


def test_learns_a_conjunction():
    rnd = np.random.default_rng(2)
    x = {"a": rnd.random(4000), "b": rnd.random(4000), "c": rnd.random(4000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = D.learn_rules(x, bad)
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= r.holds(x)
    assert (hit == bad).mean() > 0.98 and {n for n, _, _ in rules[0].conditions} == {"a", "b"}
    assert D.learn_rules({"a": rnd.random(200)}, rnd.random(200) < 0.5) == []


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(100_000))
    rows = [(1, None, 1), (2, "", 1), (None, long, 1), (3, "a b c d e f g h i j", 1), (3, "a b c d e f g h i j", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert D.fit_rules(df, labels) == [] and D.fit_rules(df.limit(0), labels) == []
    got = D.judge(df, []).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in got) == [(0, 100_000, True), (1, 0, False), (2, 0, False), (3, 10, True), (3, 10, True)]
    assert D.judge(df.limit(0), []).collect() == []


def test_one_doc_id_on_a_third_of_all_rows(spark):
    rows = [(d, " ".join(f"word{(d * 7 + k) % 97}" for k in range(40)), 1) for d in range(300)]
    rows += [(d, " ".join(f"a{(d * 5 + k) % 89}# $" for k in range(40)), 0) for d in range(300, 500)]
    once = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = once.select("doc_id", "text"), once.select("doc_id", "quality")
    hot = docs.filter("doc_id = 7").selectExpr("doc_id", "text", "explode(sequence(1, 250)) as n").drop("n")
    rules = D.fit_rules(docs, labels)
    assert rules and rules == D.fit_rules(docs.unionByName(hot), labels.unionByName(labels.filter("doc_id = 7")))
