"""Quality rules: a learned decision list.

Statistics of every text are counted in numpy over whole Arrow batches.  From
labelled statistics, sequential covering learns rules for low quality: a rule
grows by the threshold condition of highest information gain until it is pure,
then drops its last conditions while that helps on rows kept aside; the rows it
covers go and the next rule is learned.  The list becomes one ordered
``when(...).when(...).otherwise(...)`` expression, so applying it is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow
from custlens.llm.wordhash import find_words, hash_runs, hash_words, mix, text_bytes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_bars"]
#: Ratios that rules are made of: name -> (above, below).
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "n_chars"), "digit_share": ("n_digits", "n_chars"),
    "marks_per_word": ("n_marks", "n_words"), "bars_per_word": ("n_bars", "n_words"), "words": ("n_words", None),
}
#: Labelled rows that a list is learned from, at most.
SAMPLE = 20_000


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK, _BAR, _LINE = (_lut(c) for c in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?", b"|", b"\n"))
_SPACE = _lut(b" \t\n\x0b\x0c\r")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which have an equal one before them."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same
    more[order] = same | np.concatenate([same[1:], [False]])
    return more, later


def text_statistics(texts: pa.Array) -> list[np.ndarray]:
    """BASE and MORE of each text (null: none)."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = find_words(data, offsets)
    space = _SPACE[data]
    heads = (data & 0xC0) != 0x80
    count = lambda flags: _per_text(flags, offsets)
    # lines that hold a word; equal ones by hash
    line_starts, line_ends, _ = find_words(data, offsets, _LINE)
    words_before = np.searchsorted(starts, line_starts)
    worded = np.searchsorted(starts, line_ends) > words_before
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    of_line = np.searchsorted(offsets, line_starts, "right") - 1
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))
    _, later = _twice(hash_words(data, line_starts, line_ends, 1, lower=False) ^ salt[of_line])
    # five-word windows that a text holds twice or more
    runs = hash_runs(hash_words(data, starts, ends, 0, lower=False), 5)
    of_word = np.repeat(np.arange(n), np.diff(first))
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(runs):
        own = np.flatnonzero(of_word[:-4] == of_word[4:])
        more, _ = _twice(runs[own] ^ salt[of_word[own]])
        np.add.at(cover, own[more], 1)
        np.add.at(cover, own[more] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return [np.diff(first), count(heads & ~space), count(_SYMBOL[data]), np.bincount(of_line[later], minlength=n), covered[first[1:]] - covered[first[:-1]],
            count(heads), np.bincount(of_line, minlength=n), *(count(f[data]) for f in (_UPPER, _DIGIT, _MARK, _BAR))]


def quality_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id), then the statistics of column text."""
    keep = keep or ["doc_id"]
    kept = docs.select(*keep).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType
    schema = reduce(lambda s, c: s.add(c, LongType()), BASE + MORE, StructType([*kept.fields]))
    types, n = to_arrow_schema(schema), len(keep)
    text = keep.index("text") if "text" in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield as_batch([*b.columns[:n], *text_statistics(b.column(text))], types)

    extra = [] if "text" in keep else [F.col("text").cast("string").alias("__text")]
    return map_arrow(docs.select(*keep, *extra), run, schema)


def ratio(name: str) -> Column:
    above, below = RATIOS[name]
    top = F.col(above).cast("double")
    return top if below is None else F.when(F.col(below) > 0, top / F.col(below)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """Conditions (ratio, more, threshold): all hold -> low quality."""
    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, more, t in self.conditions:
            out &= x[name] > t if more else x[name] <= t
        return out

    def expression(self) -> Column:
        return reduce(lambda a, b: a & b, [ratio(n) > F.lit(t) if more else ratio(n) <= F.lit(t) for n, more, t in self.conditions])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < 4 and (~bad & inside).any():
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        best = (0.0, None, inside)
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, 33)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(v[inside], np.linspace(0, 1, 33))]))
            for t in ((cuts[1:] + cuts[:-1]) / 2).tolist():
                for more in (True, False):
                    now = inside & (v > t if more else v <= t)
                    p1, n1 = int((bad & now).sum()), int((~bad & now).sum())
                    if p1 >= 3 and p1 + n1 < p + n:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best[0] + 1e-9:
                            best = (gain, (name, more, float(t)), now)
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = best[2]
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The shortest head of the rule with the best (p - n) / (p + n) on rows kept aside."""
    best = None
    for k in range(1, len(rule.conditions) + 1):
        head = Rule(rule.conditions[:k])
        hit = head.holds(x)
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth > best[0] + 1e-9:
            best = (worth, head, p, n)
    return best[1:]


def by_chance(p: int, n: int, share: float) -> float:
    """Probability of p or more bad rows among p + n where ``share`` of all are bad."""
    if not 0 < share < 1:
        return share
    log = lambda k: math.lgamma(p + n + 1) - math.lgamma(k + 1) - math.lgamma(p + n - k + 1) + k * math.log(share) + (p + n - k) * math.log(1 - share)
    return sum(math.exp(log(k)) for k in range(p, p + n + 1))


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, sure: float = 0.9, most: int = 12, seed: int = 5) -> list[Rule]:
    """Rules for the rows marked bad.  Ends where a new rule is right for less than
    ``sure`` of the rows kept aside that it covers, or where it could be so by chance."""
    aside = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most:
        g, k = left & ~aside, left & aside
        if (bad & g).sum() < 3 or not (bad & k).any():
            break
        rule = _grow({c: v[g] for c, v in x.items()}, bad[g])
        if not rule.conditions:
            break
        rule, p, n = _prune(rule, {c: v[k] for c, v in x.items()}, bad[k])
        if p < sure * (p + n) or not p or by_chance(p, n, float(bad[k].mean())) > 0.01:
            break
        rules.append(rule)
        left &= ~rule.holds(x)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from labels (doc_id, quality 0 or 1), of which the ``sample`` doc_ids of
    lowest hash are taken.  A doc_id that repeats counts once, with its lowest label
    and its first text in string order.  No rule without rows of both labels."""
    some = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    some = some.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taken = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = quality_statistics(taken, ["doc_id", "quality"]).select("quality", "doc_id", *[ratio(r).alias(r) for r in RATIOS])
    t = rows.orderBy("doc_id").toPandas()
    if not len(t) or t["quality"].nunique() < 2:
        return []
    return learn_rules({r: t[r].to_numpy() for r in RATIOS}, (t["quality"] == 0).to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """True: kept."""
    out = None
    for r in rules:
        out = F.when(r.expression(), F.lit(False)) if out is None else out.when(r.expression(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id), the statistics, base_failed and kept.  A null or
    empty text has no words and fails; a null doc_id stays; rows that repeat are
    judged each; other columns than text and ``keep`` are not read; an empty table
    gives an empty one."""
    rows = quality_statistics(docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
