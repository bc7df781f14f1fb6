import re

import numpy as np
import pytest

from custlens.llm import lsh_forest as L


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """doc_id -> smallest doc_id reachable by similarity 0.75 and more."""
    sets = {d: shingles(t) for d, t in rows}
    index, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        counts = {}
        for s in sets[d]:
            for other in index.setdefault(s, []):
                counts[other] = counts.get(other, 0) + 1
            index[s].append(d)
        for other, n in counts.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[other]) - n):
                x, y = sorted((find(d), find(other)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = L.near_duplicates(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_large_group_of_near_copies(spark):
    rnd = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(400):
        own = list(base)
        for k in rnd.integers(0, 120, 2):
            own[k] = f"x{d}"
        rows.append((d, " ".join(own)))
    # a boilerplate half that many unlike texts share
    rows += [(1000 + d, " ".join(base[:60] + [f"y{d}_{k}" for k in range(70)])) for d in range(100)]
    got = result(L.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    assert got == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one", "d"), (5, "ONE ", "e"), (6, "a b c d e f", "f"),
            (6, "a b c d e f", "f"), (7, long, "g"), (8, long + " end", "h"), (None, "one", "i"), (9, "a b c d e f", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in L.near_duplicates(df).collect()))
    assert got == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True),
                   (7, 59_996, 7, True), (8, 59_997, 7, False), (9, 2, 6, False)]
    assert L.near_duplicates(df.limit(0)).collect() == []


def test_run_heads():
    new = np.zeros(9000, bool)
    new[[0, 10]] = True
    head = L.run_heads(new)
    assert head[9] == 0 and head[10] == 10 and head[10 + 65] == 74 and head[74] == 10 and head[10 + 4096 + 64] == 10 + 4096
    at = np.arange(9000)
    for _ in range(4):
        at = head[at]
    assert set(at.tolist()) == {0, 10}
    assert np.bincount(head).max() < 64 * 3


def edited(rnd, base, places, own):
    out = list(base)
    for k in rnd.choice(len(base) // 5, places, replace=False):
        out[5 * k + 2] = f"{own}_{k}"
    return " ".join(out)


@pytest.mark.parametrize("parts", [1, 9])
def test_star_of_copies(spark, parts):
    """Copies like the original, at 0.76, but unlike one another, at 0.6; a second star in the same template."""
    rnd = np.random.default_rng(7)
    base = [f"w{k}" for k in range(1500)]
    other = base[:1100] + [f"v{k}" for k in range(400)]
    rows = [(5000, " ".join(base)), (5001, " ".join(other))]
    rows += [(d, edited(rnd, base, 40, f"x{d}")) for d in range(400)]
    rows += [(1000 + d, edited(rnd, other, 40, f"z{d}")) for d in range(90)]
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 2
    assert result(L.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))) == want


def test_near_copies_within_a_template(spark):
    """Texts of one template, at 0.6 to one another; some have a near copy of their own at 0.76 and more."""
    rnd = np.random.default_rng(8)
    template = [f"w{k}" for k in range(225)]
    rows = []
    for d in range(500):
        own = template + [f"y{d}_{k}" for k in range(75)]
        rows.append((d, " ".join(own)))
        if d % 4 == 0:
            rows.append((1000 + d, edited(rnd, own, 8, f"x{d}")))
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 500
    assert result(L.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


def test_exact_pairs_of_a_long_list(spark):
    """More classes of one shingle than a block holds."""
    import pyarrow as pa

    from custlens.llm.wordhash import shingle_sets
    rnd = np.random.default_rng(9)
    base = [f"w{k}" for k in range(400)]
    rows = [(d, edited(rnd, base, 5 if d % 2 else 12, f"x{d}")) for d in range(700)]
    sets = spark.createDataFrame([(d, d, s.tobytes()) for (d, _), s in zip(rows, shingle_sets(pa.array([t for _, t in rows])))], "id long, component long, shingles binary")
    got = {(r["a"], r["b"]) for r in L.exact_pairs(sets).collect()}
    own = [shingles(t) for _, t in rows]
    true = {(i, j) for i in range(0, 700, 7) for j in range(i + 1, 700) if 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j])}
    assert true and true <= got and all(a < b for a, b in got)
