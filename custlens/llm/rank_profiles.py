"""Language identification by rank-order n-gram profiles.

A language's profile is its PROFILE most frequent 1-, 2- and 3-grams in order of
frequency, learned from labelled documents.  A document's n-grams are ranked in the
same way; its distance to a profile is the sum, over its n-grams, of how far each is
out of place there, PROFILE where it is not in the profile.  The nearest language is
the prediction.  n-grams are of lower-cased letters, with one space at a word's ends;
equally frequent n-grams share their mean rank.  An n-gram is an exact integer, its
code points of 21 bits each, so nothing collides.

Learning counts the documents of each language, takes all of a language of SAMPLE
documents or fewer and else those of lowest hash, about SAMPLE of them (the sample's
bound), sums n-gram counts with a combine in each task, and ranks them in Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow

#: n-grams of a profile; documents of each language to learn from, about; code points
#: whose n-grams are counted at a time.
PROFILE, SAMPLE, CHUNK = 400, 3000, 1 << 20
UNKNOWN = "und"
_SPACE = 32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def _sum_equal(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams, ascending, and how often each occurs; none without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    # one space for each run of others, one at either end
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    x = np.concatenate([[_SPACE], np.where(letter, code, _SPACE)[kept], [_SPACE]]).astype(np.int64)
    if len(x) > 2 and x[1] == _SPACE:
        x = x[1:]
    if len(x) > 2 and x[-2] == _SPACE:
        x = x[:-1]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for i in range(0, len(x) - 1, CHUNK):
        own = x[i:i + CHUNK + 2]
        a, b, c = own[:-2], own[1:-1], own[2:]
        two = own[:CHUNK + 1]
        one = own[:CHUNK]
        keys = np.concatenate([one[one != _SPACE], (two[:-1] << 21) | two[1:], ((a << 42) | (b << 21) | c)[b != _SPACE]])
        parts.append(np.unique(keys, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return _sum_equal(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def ranked(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams whose run of equals begins before PROFILE, and their mean ranks."""
    falling = np.sort(-n)
    ahead = np.searchsorted(falling, -n, "left")
    behind = np.searchsorted(falling, -n, "right")
    own = ahead < PROFILE
    return keys[own], ((ahead + behind - 1) / 2)[own]


@dataclass
class Profiles:
    """Languages, sorted n-grams of all, and each one's rank in each language (-1: none)."""
    langs: list[str]
    keys: np.ndarray
    ranks: np.ndarray

    def distances(self, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """To each language, from 0 (same order) to 1 (nothing in common)."""
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        theirs = self.ranks[:, at[hit]]
        out_of_place = np.where(theirs < 0, PROFILE, np.minimum(np.abs(theirs - rank[hit]), PROFILE))
        return (out_of_place.sum(1) + PROFILE * (len(keys) - hit.sum())) / (PROFILE * len(keys))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first of equals) and how much nearer it is than the
        next, as a share of that one's distance."""
        keys, rank = ranked(*grams(text or ""))
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        d = self.distances(keys, rank)
        best = int(d.argmin())
        if len(d) == 1:
            return self.langs[0], float(1 - d[0])
        second = np.partition(d, 1)[1]
        return self.langs[best], float((second - d[best]) / second) if second else 0.0


def held_out(doc_id: Column | str = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from the documents (doc_id, text, lang) outside the held-out fold.

    Rows with a null doc_id, text or lang teach nothing.  The profiles (PROFILE
    n-grams a language) pass through the driver to the tasks.  Languages come in the
    order of their number of documents, then by name.  No labelled document: no
    language.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(total, key=lambda x: (-total[x], x))
    number = {x: i for i, x in enumerate(langs)}
    large = {x: sample / n for x, n in total.items() if n > sample}
    if large:
        share = F.create_map(*[F.lit(v) for pair in large.items() for v in pair])[F.col("lang")]
        rows = rows.filter(share.isNull() | (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30)))
    types = arrow_types("lang int, gram long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def summed():
            for i, parts in held.items():
                k, n = _sum_equal(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
                yield as_batch([np.full(len(k), i, np.int32), k, n], types)
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k, n = grams(text)
                held.setdefault(number[lang], []).append((k, n))
                size += len(k)
            if size > 8 * CHUNK:
                yield from summed()
                size = 0
        yield from summed()

    found = map_arrow(rows.select("lang", "text"), count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= PROFILE).select("lang", "gram", "n").toArrow()
    lang, gram, n = (top.column(k).to_numpy() for k in range(3))
    keys = np.unique(gram)
    ranks = np.full((len(langs), len(keys)), -1.0)
    for i in range(len(langs)):
        k, r = ranked(gram[lang == i], n[lang == i])
        ranks[i, np.searchsorted(keys, k)] = r
    return Profiles(langs, keys, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Every column of ``docs`` but held_out, lang_pred and score, then those: the
    learned language, and 0 to 1.

    A null text, or one without a letter, is ``und`` at 0, as is every text when
    nothing was learned.  A text whose n-grams are in no profile gets the language of
    most documents, at 0.  Only ``text`` decides.  A null doc_id is not held out;
    repeated rows are judged each; whole texts count, however long; an empty table
    gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructType
    docs = docs.drop("held_out", "lang_pred", "score")
    text = docs.columns.index("text")
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = [profiles.predict(t) for t in b.column(text).to_pylist()]
                yield as_batch([*b.columns, [g for g, _ in got], [s for _, s in got]], types)

    return map_arrow(docs, run, schema).withColumn("held_out", held_out())
