import zlib
from collections import Counter

import pytest

from custlens.llm import rank_profiles as R
from custlens.llm.catalog import QUERIES


def plain_grams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    count = Counter()
    for k, w in enumerate(words):
        # a space between two words is both words', its pairs are counted once each
        padded = f" {w} "
        count.update(w)
        count.update(padded[i:i + 2] for i in range(len(w) + 1))
        count.update(padded[i:i + 3] for i in range(len(w)))
    return count


def plain_ranks(count):
    out = {}
    for n in sorted(set(count.values()), reverse=True):
        ahead, own = sum(m > n for m in count.values()), [g for g, m in count.items() if m == n]
        if ahead < R.PROFILE:
            out |= {g: ahead + (len(own) - 1) / 2 for g in own}
    return out


def spelled(key):
    out = ""
    while key:
        out, key = chr(key & 0x1FFFFF) + out, key >> 21
    return out


def folded(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def plain_predictions(rows):
    totals, docs = {}, Counter()
    for d, text, lang in rows:
        if d is not None and text is not None and lang is not None and not folded(d):
            totals.setdefault(lang, Counter()).update(plain_grams(text))
            docs[lang] += 1
    profiles = {}
    for lang in sorted(docs, key=lambda x: (-docs[x], x)):
        top = sorted(totals[lang].items(), key=lambda p: (-p[1], [0] * (3 - len(p[0])) + [ord(c) for c in p[0]]))[:R.PROFILE]
        profiles[lang] = plain_ranks(dict(top))
    out = {}
    for d, text, _ in rows:
        own = plain_ranks(plain_grams(text or ""))
        if not own or not profiles:
            out[d] = ("und", 0.0)
            continue
        dist = {x: sum(min(abs(p[g] - r), R.PROFILE) if g in p else R.PROFILE for g, r in own.items()) for x, p in profiles.items()}
        first, *rest = sorted(profiles, key=lambda x: dist[x])
        out[d] = (first, (dist[rest[0]] - dist[first]) / dist[rest[0]] if rest else 1 - dist[first] / (R.PROFILE * len(own)))
    return out


@pytest.mark.parametrize("text", ["", "12 34", "Ab", "aa bb  aa!", "Éá ß straße İstanbul 日本語 x1y", "a" * 50, " q ", "one\ntwo\tthree"])
def test_grams(text, monkeypatch):
    for chunk in (1 << 20, 3):
        monkeypatch.setattr(R, "CHUNK", chunk)
        keys, n = R.grams(text)
        assert dict(zip(map(spelled, keys.tolist()), n.tolist())) == dict(plain_grams(text))


def test_equals_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    want = plain_predictions([tuple(r) for r in df.collect()])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in R.identify(df.select("doc_id", "text"), R.learn(df)).collect()}
    assert {d: p for d, (p, _) in got.items()} == {d: p for d, (p, _) in want.items()}
    assert all(abs(got[d][1] - want[d][1]) < 1e-9 for d in want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_rank_profiles"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert len(rows) == len(lang) and all(r["held_out"] == folded(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_sample_bounds_what_is_learned(spark):
    rows = [(d, "the cat sat on the mat and then some" if d % 2 else "der hund lief über die straße und dann", "en" if d % 2 else "de") for d in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = R.learn(df, sample=50)
    assert set(got.langs) == {"en", "de"}
    assert {r["lang_pred"] for r in R.identify(df.filter("doc_id % 2 = 1"), got).collect()} == {"en"}


def test_held_out_rows_teach_nothing(spark):
    ids = [d for d in range(40) if folded(d)]
    df = spark.createDataFrame([(d, "un texte secret", "fr") for d in ids], "doc_id long, text string, lang string")
    got = R.learn(df)
    assert got.langs == [] and {r["lang_pred"] for r in R.identify(df, got).collect()} == {"und"}


def test_odd_rows(spark):
    rows = [(0, "the cat and the dog", "en", 1.0), (1, "le chat et le chien", "fr", None), (None, "the dog", "en", 2.0), (5, None, "en", None), (6, "", "fr", None), (6, "", "fr", None),
            (7, "12 % 34", None, None), (8, "日本語", None, None), (9, "the dog " * 400_000, None, None), (10, "the and", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = R.identify(df, R.learn(df))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "held_out"]
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["lang_pred"], r["held_out"]) for r in got.collect()))
    assert [(d, p) for d, p, _ in found] == [(-1, "en"), (0, "en"), (1, "fr"), (5, "und"), (6, "und"), (6, "und"), (7, "und"), (8, found[7][1]), (9, "en"), (10, "en")]
    assert found[7][1] in ("en", "fr") and not found[0][2] and all(r["score"] == 0 for r in got.filter("lang_pred = 'und' OR doc_id = 8").collect())
    assert R.identify(df.limit(0), R.learn(df.limit(0))).collect() == []
