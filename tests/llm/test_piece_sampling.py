from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from custlens.llm import piece_sampling as P

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lat():
    return P.Lattices(FILE)


def every(lat, word):
    """All segmentations with their weights."""
    if not word:
        yield (), 1.0
    for j in range(1, len(word) + 1):
        k = lat.pieces.get(word[:j])
        if k is not None:
            for ids, w in every(lat, word[j:]):
                yield (k, *ids), w * float(np.exp(lat.weight[k]))


def test_samples_follow_the_lattice(lat):
    n = 30_000
    got = Counter(tuple(x.tolist()) for x in lat.sample(["them"] * n, np.arange(n, dtype=np.uint64), 3))
    ways = list(every(lat, " them"))
    total = sum(w for _, w in ways)
    assert len(ways) == 15 and all(abs(got[ids] / n - w / total) < 0.012 for ids, w in ways)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é☃▁ \n\x00\U0001F600", max_size=25), max_size=4))
def test_lossless(lat, texts):
    keys = np.arange(len(texts), dtype=np.uint64)
    got = lat.sample(texts, keys, 6)
    assert [lat.decode(x) for x in got] == [t if t else "" for t in texts]
    # alone and in company alike
    assert all((lat.sample([t], keys[k:k + 1], 6)[0] == got[k]).all() for k, t in enumerate(texts))


def test_seed_and_key(lat):
    t, key = "some words to cut in many ways", np.array([5], np.uint64)
    one = lat.sample([t], key, 1)[0].tolist()
    assert one == P.Lattices(FILE).sample([t], key, 1)[0].tolist()
    assert len({tuple(lat.sample([t], key + np.uint64(k), 1)[0].tolist()) for k in range(20)}) > 5


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = P.encode_documents(docs, FILE)
    again = {r["doc_id"]: r["ids"] for r in P.encode_documents(docs.repartition(5), FILE).collect()}
    assert {r["doc_id"]: r["ids"] for r in enc.collect()} == again
    back = {r["doc_id"]: r["text"] for r in P.decode_documents(enc, FILE).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x y", 1), (3, "q" * 3000 + " é" * 50_000, 1), (3, "a", 1), (3, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = P.decode_documents(P.encode_documents(df, FILE), FILE).collect()
    assert sorted(r["text"] for r in got) == sorted(t or "" for _, t, _ in rows)
    assert P.encode_documents(df.limit(0), FILE).collect() == []
