import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from custlens.llm import hilbert_pack as H

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_is_a_curve():
    """Every cell once, and neighbours on the curve are neighbours in the grid."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = H.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(key)]
        assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def check(rows, pieces, length):
    tok = Tokenizer.from_file(FILE)
    tok.encode_special_tokens = True
    want = {d: tok.encode(t or "", add_special_tokens=False).ids + [2] for d, t in rows}
    parts, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        parts[p["doc_id"]].append(p)
        seqs[p["sequence_id"]].append(p)
    assert set(parts) == set(want)
    for d, own in parts.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            ids = np.array(want[d][at:at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(want[d]), zlib.crc32(ids))
            assert np.frombuffer(p["ids"], "<u2").astype("<u4").tobytes() == ids
            at += p["length"]
        assert at == len(want[d])
    full = 0
    for s in sorted(seqs):
        at = 0
        for p in sorted(seqs[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
        full += at == length
    assert full >= len(seqs) - 1


def test_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, H.pack(docs, FILE).collect(), 4096)


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Word  \n0 word 0 x0", 1), (4, "long text 7 " * 9000, 2), (5, "é́ Σ́ <|endoftext|>", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    check([r[:2] for r in rows], H.pack(df, FILE, 64).collect(), 64)
    assert H.pack(df.limit(0), FILE).collect() == []
    twice = H.pack(spark.createDataFrame([(None, "a"), (7, "a b"), (7, "a b")], "doc_id long, text string"), FILE).collect()
    assert sorted((p["doc_id"] or 0, p["length"]) for p in twice) == [(0, 2), (7, 3), (7, 3)]


def test_copies_are_neighbours(spark):
    texts = [(k, f"alpha beta gamma {k % 5} delta epsilon " * 20) for k in range(50)]
    got = H.pack(spark.createDataFrame(texts, "doc_id long, text string"), FILE).collect()
    order = [p["doc_id"] % 5 for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 4
