"""Toxicity by weak supervision.

Voters are lexicons and patterns: a fixed list of insults per language in slices,
lists mined from labelled rows (whole words and word heads that toxic texts hold
far more often), split by hash into many voters, and shouting patterns: 50 in all.
The given labels are one more voter.  A generative label model with two coins per
voter, the labels' too, gets by expectation maximisation each voter's rate of votes
on toxic and on clean texts; voters that still agree beyond that are correlated, and
their evidence is shared out.  The labels start it and so say which class is toxic;
nothing about their accuracy is given.
Its posterior labels train a linear classifier over voters and mined features.

Labels are learned only from rows whose crc32 of doc_id mod 5 is not 0.  A score
sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow
from custlens.llm.wordhash import find_words, hash_words, text_bytes
from custlens.session import materialise_table

#: Common insults, by language.
LEXICON = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile jerk fool filth garbage vermin",
    "de": "idiot dummkopf trottel abschaum arschloch versager widerlich erbärmlich wertlos blödmann drecksack schwachkopf",
    "fr": "idiot imbécile crétin abruti ordure connard débile minable pathétique stupide dégoûtant salaud",
    "es": "idiota imbécil estúpido basura escoria patético inútil asqueroso payaso tonto cretino cabrón",
}
#: Labelled rows to learn from, at most; mined features, at most; voters that share those of a kind.
SAMPLE, MINED, SPLIT = 12_000, 4_000, 12
#: Slices of each language's lexicon, and patterns.
SLICES, PATTERNS = 3, 2
#: Bytes of the word heads that are features beside whole words.
HEADS = (4, 5)
_WORD_BREAK = np.ones(256, bool)
_WORD_BREAK[128:] = False
for _a, _b in ((65, 91), (97, 123)):
    _WORD_BREAK[_a:_b] = False


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind (0 word, 1.. head) and text of every word's features."""
    data, offsets = text_bytes(texts)
    starts, ends, first = find_words(data, offsets, _WORD_BREAK)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h, kind, doc = [hash_words(data, starts, ends)], [np.zeros(len(starts), np.int8)], [of]
    for k, n in enumerate(HEADS, 1):
        long = ends - starts > n
        h.append(hash_words(data, starts[long], starts[long] + n, k))
        kind.append(np.full(int(long.sum()), k, np.int8))
        doc.append(of[long])
    return np.concatenate(h), np.concatenate(kind), np.concatenate(doc)


def _lexicon_hashes() -> list[np.ndarray]:
    """Word hashes of each slice of each language's lexicon."""
    out = []
    for words in LEXICON.values():
        data, offsets = text_bytes(pa.array([words]))
        starts, ends, _ = find_words(data, offsets)
        h = hash_words(data, starts, ends)
        out += [np.sort(h[k::SLICES]) for k in range(SLICES)]
    return out


def _patterns(texts: pa.Array) -> np.ndarray:
    """Votes of the patterns: shouting (mostly capitals) and many exclamation marks."""
    data, offsets = text_bytes(texts)

    def count(flags):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    upper, lower, mark = count((data >= 65) & (data < 91)), count((data >= 97) & (data < 123)), count(data == 33)
    size = np.maximum(1, np.diff(offsets))
    return np.stack([(upper > lower) & (upper > 10), mark * 40 > size], 1)


@dataclass
class Model:
    """Sorted hashes of the mined features, the voter and weight of each, and the classifier."""
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    voter: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    voter_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None

    def inputs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Votes (texts x voters), and the text and number of each mined feature found."""
        h, _, doc = _features(texts)
        n = len(texts)
        lex = _lexicon_hashes()
        mined = SPLIT * (1 + len(HEADS)) if len(self.voter) else 0
        votes = np.zeros((n, len(lex) + PATTERNS + mined), bool)
        every = np.concatenate([*lex, self.hashes])
        table = np.zeros(1 << 16, bool)
        table[(every >> np.uint64(48)).astype(np.int64)] = True
        near = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
        h, doc = h[near], doc[near]
        for k, own in enumerate(lex):
            votes[doc[np.isin(h, own)], k] = True
        votes[:, len(lex):len(lex) + PATTERNS] = _patterns(texts)
        at = np.searchsorted(self.hashes, h)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == h[hit]
        if not len(self.hashes):
            return votes, np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.unique(doc[hit] * len(self.hashes) + at[hit])
        doc, at = code // len(self.hashes), code % len(self.hashes)
        votes[doc, len(lex) + PATTERNS + self.voter[at]] = True
        return votes, doc, at

    def scores(self, texts: pa.Array) -> np.ndarray:
        votes, doc, at = self.inputs(texts)
        z = self.bias + votes @ self.voter_weights + np.bincount(doc, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic per row, votes' rates (2 x voters: on clean, on toxic) and
    the correlations left between voters.  ``known``: labels (0, 1); they start it and
    are a voter whose two rates are estimated like all others'."""
    v = np.column_stack([votes, known == 1]).astype(float)
    q = np.where(known == 1, 0.9, 0.1)
    corr = np.eye(v.shape[1])
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
        rate = np.stack([((1 - q) @ v + 0.1) / ((1 - q).sum() + 20), (q @ v + 0.1) / (q.sum() + 1)])
        rate = np.clip(rate, 1e-5, 1 - 1e-5)
        left = v - ((1 - q)[:, None] * rate[0] + q[:, None] * rate[1])
        cov = left.T @ left / len(v)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / sd[:, None] / sd, -1, 1)
        strong = np.where(np.abs(corr) > 0.1, np.abs(corr), 0.0)
        strong[:, -1] = 0.0
        share = 1 / np.maximum(1.0, strong.sum(1))
        share[-1] = 1.0  # people's labels do not come from the text's words
        pro = np.log(rate[1] / rate[0]) * share
        con = np.log((1 - rate[1]) / (1 - rate[0])) * share
        z = np.log(prior / (1 - prior)) + v @ pro + (1 - v) @ con
        now = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(now - q).max() < 1e-4:
            q = now
            break
        q = now
    return q, rate[:, :-1], corr[:-1, :-1]


def _classifier(votes: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int, target: np.ndarray, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps scaled per input.
    Weights are not below 0: no vote for toxic speaks against it."""
    v = votes.astype(float)
    wv, w, bias = np.zeros(v.shape[1]), np.zeros(n), float(np.log(max(target.mean(), 1e-4)))
    gv, g, gb = np.full(len(wv), 1e-6), np.full(n, 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + v @ wv + np.bincount(doc, w[at], len(v)), -30, 30)))
        e = (p - target) / len(v)
        dv, d, db = v.T @ e + l2 * wv / 10, np.bincount(at, e[doc], n) + l2 * w / 10, e.sum()
        gv, g, gb = gv + dv**2, g + d**2, gb + db**2
        wv, w, bias = np.maximum(0, wv - 0.5 * dv / np.sqrt(gv)), np.maximum(0, w - 0.5 * d / np.sqrt(g)), bias - 0.5 * db / np.sqrt(gb)
    return wv, w, bias


def held_out(doc_id: Column | str = "doc_id") -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels (doc_id, toxic 0 or 1) outside the held-out fold, of which
    the ``sample`` doc_ids of lowest hash are taken.  A doc_id that repeats counts
    once, with its highest label and its first text in string order.  Without rows of
    both labels the fixed lists alone decide."""
    n_fixed = len(LEXICON) * SLICES
    plain = Model(voter_weights=np.array([4.0] * n_fixed + [0.0] * PATTERNS), bias=-2.0)
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = some.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialise_table(rows.select("doc_id", "toxic", "text"), "toxic-sample")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return plain

    types = arrow_types("h long, kind int, toxic int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                toxic = b.column(0).to_numpy()
                h, kind, doc = _features(b.column(1))
                order = np.lexsort([h, doc])
                h, kind, doc = h[order], kind[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                h, kind, lab = h[new], kind[new], toxic[doc[new]]
                order = np.lexsort([h, lab])
                h, kind, lab = h[order], kind[order], lab[order]
                at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lab[1:] != lab[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([at, [len(h)]]))
                yield as_batch([h[at].view(np.int64), kind[at].astype(np.int32), lab[at].astype(np.int32), n], types)

    c = map_arrow(rows.select("toxic", "text"), count, "h long, kind int, toxic int, n long")
    c = c.groupBy("h", "kind").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    lift = (F.col("n1") / float(total[1])) / ((F.col("n0") + 0.5) / float(total[0]))
    top = c.filter(F.col("n1") >= max(4, total[1] // 200)).withColumn("lift", lift).filter("lift >= 8").orderBy(F.desc(F.col("n1") * F.log("lift")), "h").limit(MINED).toPandas()
    top = top.assign(u=top["h"].to_numpy().view(np.uint64)).sort_values("u")
    hashes = top["u"].to_numpy(np.uint64)
    model = Model(hashes=hashes, voter=(top["kind"].to_numpy(np.int64) * SPLIT + (hashes % np.uint64(SPLIT)).astype(np.int64)))
    types2 = arrow_types("doc_id long, toxic int, votes binary, at binary")

    def inputs(batches):
        for b in batches:
            if b.num_rows:
                votes, doc, at = model.inputs(b.column(2))
                cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
                yield as_batch([b.column(0), b.column(1), [v.astype(np.uint8).tobytes() for v in votes], [at[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])]], types2)

    got = map_arrow(rows.select("doc_id", "toxic", "text"), inputs, "doc_id long, toxic int, votes binary, at binary").orderBy("doc_id").toPandas()
    votes = np.stack([np.frombuffer(v, np.uint8) for v in got["votes"]]).astype(bool)
    at = [np.frombuffer(a, np.int32) for a in got["at"]]
    doc = np.repeat(np.arange(len(at)), [len(a) for a in at])
    at = np.concatenate(at).astype(np.int64)
    post, model.accuracies, model.correlations = label_model(votes, got["toxic"].to_numpy())
    model.voter_weights, model.weights, model.bias = _classifier(votes, doc, at, len(hashes), post)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of ``docs`` but score, predicted and held_out, then held_out,
    score (0 to 1) and predicted (1 from 0.5).  A null or empty text gets the score
    of a text without a vote; a null doc_id is not held out; repeated rows are
    scored each; an empty table gives an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType
    docs = docs.drop("score", "predicted", "held_out")
    text = docs.columns.index("text")
    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield as_batch([*b.columns, model.scores(b.column(text))], types)

    out = map_arrow(docs, run, schema)
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
