import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from custlens.llm import oph_minhash as O


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(rows):
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        out[d] = (t, t[:len(t) - k] + nxt[:k], nxt)
    return out


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = O.compare_with_edits(docs)
    got = {r["doc_id"]: r for r in df.collect()}
    want = edits([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert set(got) == set(want)
    off, by_text = [], {}
    for d, (t, e, nxt) in want.items():
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        for near, other in ((r["near_edited"], e), (r["near_next"], nxt)):
            j = jaccard(t, other)
            off.append(near - j)
            assert abs(near - j) < 5 * math.sqrt(max(j * (1 - j), 0.02) / 60) and 0 <= near <= 1
    assert abs(np.mean(off)) < 0.02
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_bins_and_densification(spark):
    """Against a slow version over the same hashes."""
    texts = ["a b c d e f g h", "", "x", " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(2000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(O.shingle_hashes(F.col("text")).alias("h"), O.fingerprint_bins(F.col("text")).alias("b")).collect()
    for r in rows:
        bins = [None] * O.BINS
        for h in r["h"]:
            v = (h & (2**64 - 1)) >> 1
            k, low = v >> O._SHIFT, v & O._MOST
            bins[k] = low if bins[k] is None else min(bins[k], low)
        full = []
        for i in range(O.BINS):
            at, step = O._scatter(2 * i) % O.BINS, O._scatter(2 * i + 1) % O.BINS | 1
            walk = [bins[i]] + [bins[(at + t * step) % O.BINS] for t in range(O.BINS)]
            full.append(next((x for x in walk if x is not None), 0) & 255)
        assert r["b"] == full


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two", "c"), (3, "w " * 100_000, "d"), (3, "w " * 100_000, "d"), (3, "other", "e"), (5, "é\U0001F600x", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = O.compare_with_edits(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 7), (1, 0), (2, 0), (3, 5), (3, 200_000), (3, 200_000), (5, 3)]
    assert {r["near_edited"] for r in got if r["n_chars"] == 0} == {1.0}
    one = O.compare_with_edits(df.filter("doc_id = 5")).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256("é\U0001F600é".encode()).hexdigest()
    assert O.compare_with_edits(df.limit(0)).collect() == []
