import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from custlens.llm import spelling_groups as S
from custlens.llm import sql
from custlens.llm.catalog import QUERIES


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_groups(counts):
    """word -> (form, root, n, n_near, form_n), every word against every other."""
    form, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [n, len(near), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def slow_counts(rows):
    total = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{' ' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def grouped(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("parts", ["1", "2", "7"])
def test_equals_every_pair(spark, parts):
    rnd = random.Random(1)
    words = {"".join(rnd.choices("abß", k=rnd.randint(1, 6))): 0 for _ in range(350)}
    words = {w: rnd.choice([2, 3, 25, 30, 400, 5000, 60000]) for w in words}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert grouped(S.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long"))) == slow_groups(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nodes_number_prefixes(spark):
    rnd = random.Random(2)
    keys = sorted({"".join(rnd.choices("abc", k=rnd.randint(1, 7))) for _ in range(300)})
    import numpy as np
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(3)
    prefix, deepest = {}, {}
    for r in S.number_nodes(df, [], "test-nodes").collect():
        assert keys[r["rank"]] == r["key"] and r["size"] == len(r["key"])
        nodes = np.frombuffer(r["nodes"], np.int64).tolist()
        deepest[r["key"]] = len(nodes) - 1
        for d, node in enumerate(nodes):
            assert prefix.setdefault(node, r["key"][:d]) == r["key"][:d]
    # a prefix has one number, and every shared prefix has one
    assert len(set(prefix.values())) == len(prefix)
    for a, b in zip(keys, keys[1:]):
        assert min(deepest[a], deepest[b]) >= S.common(a, b)


def test_chain_of_forms(spark):
    words = {"aaaaaaa": 100_000, "aaaaaab": 10_000, "aaaaabb": 1000, "aaaabbb": 100, "aaabbbb": 10, "zzzzzzz": 5, "zzzzzzzz": 49}
    got = grouped(S.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == slow_groups(words) and got["aaabbbb"][1] == "aaaaaaa" and got["zzzzzzz"] == (None, "zzzzzzz", 5, 1, None)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql.OP13})").fetchall()
    got = [tuple(r) for r in QUERIES["op13_trie_pairs"](spark, f"/root/testdata/{sf}").select(*cols).collect()]
    assert got and sorted(got, key=repr) == sorted(want, key=repr)


def test_texts(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = ["Straßenbahn", "Strassenbahn", "ÉCOLIÈRES", "écolières", "overall×÷x", "wonderful", "wonderfull", "abcdefg", "short", "naïveté"]
    rows = [(d if d else None, " ".join(rnd.choices(vocabulary, k=30)) + "\n3x!") for d in range(120)] + [(5, None), (5, ""), (6, "wonderful")] * 2
    # a third of all rows are one document's, and one text is very long
    rows += [(7, "wonderful,abcdefg")] * 60 + [(8, "abcdefg " * 20_000 + "q" * 200_000 + " " + "q" * 200_000)]
    df = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], "doc_id long, text string, word string, n int, form int").repartition(5)
    want = slow_counts(rows)
    monkeypatch.setattr(S, "HELD", 4)
    assert {r["word"]: r["n"] for r in S.count_words(df, S.misspell).collect()} == want
    got = grouped(S.spelling_variants(df, S.misspell))
    assert got == slow_groups(want) and "q" * 200_000 in got
    plain = {r["word"]: r["n"] for r in S.count_words(df).collect()}
    assert "écolières" in plain and "École" not in plain and plain["wonderful"] > want["wonderful"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(docs).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None), (2, "too few")], "doc_id long, text string")).collect() == []
