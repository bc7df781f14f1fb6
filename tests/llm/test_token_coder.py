import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from custlens.llm import token_coder as C
from custlens.llm.common import WordMemo

FILE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 9)), max_size=600), st.sampled_from([0, 1, 7, 64]))
def test_round_trip(ids, block):
    assert C.decode_record(C.encode_record(np.array(ids, np.int64), block)).tolist() == ids


def test_predictable_ids_are_small_and_damage_is_seen():
    rnd = np.random.default_rng(1)
    phrase = rnd.integers(0, 50_000, 40)
    ids = np.concatenate([phrase] * 200)
    data = C.encode_record(ids, len(ids))
    assert len(data) < 1000 and (C.decode_record(data) == ids).all()
    flat = rnd.integers(0, 65536, 20_000)
    assert len(C.encode_record(flat)) < 2 * len(flat) * 1.15
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 4
    with pytest.raises(ValueError):
        C.decode_record(bytes(bad))
    with pytest.raises(ValueError):
        C.encode_record(np.array([70_000]))


def test_letters_that_become_marks():
    for memo in MEMOS:
        for t in ["DERGİSİ.", "KEDİ,", "a İ. b", "e\u0301.", "é.", "i\u0307,", "\u0958.", "\ufb2a,", "ß.", "ǰ."]:
            assert memo.encode([t])[0] == np.array(memo.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab'sAéİI\u0301\u0307\u0327\u0958\ufb2aß0 5.,\n\t  \x1c\x85<|>☃", max_size=30), max_size=5))
def test_words_one_by_one_equal_the_whole_text(texts):
    for memo in MEMOS:
        for t, got in zip(texts, memo.encode(texts)):
            assert got == np.array(memo.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


MEMOS = [WordMemo(FILE, True, cap=50), WordMemo(public_tokenizers.path("word_bpe_49k.json"), False, cap=50)]


def check(rows, got):
    tok = Tokenizer.from_file(FILE)
    tok.encode_special_tokens = True
    start = 0
    for (d, t), r in zip(rows, got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (d, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    C.write_token_files(docs, str(tmp_path / "t"), FILE)
    got = C.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    check([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()], got)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "x # y"), (1, None), (2, ""), (3, "a  b \n c" * 3), (3, "a  b \n c" * 3), (4, "long words 0 again " * 40_000)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, start int")
    C.write_token_files(df, str(tmp_path / "t"), FILE)
    check(rows, C.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect())
    C.write_token_files(df.limit(0), str(tmp_path / "e"), FILE)
    assert C.read_token_files(spark, str(tmp_path / "e")).collect() == []
