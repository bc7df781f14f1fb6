"""Spelling variants by a dictionary of trie-node pairs.

The words' prefixes are the nodes of a forward trie, their suffixes the nodes of a
reversed one, and every node has a number.  A word with its letter i skipped is the
pair (node of its first i letters, node of the letters after), two integers whatever
the length.  Words that share such a pair differ in that letter alone; a word whose
own halves at i are the same pair is the other with that letter gone.  So equality
of pairs finds all words one inserted, deleted or replaced letter apart, and nothing
else.

Spark sorts the words by range; in sorted order a node's number is the place of the
first word below it, with its depth, so a task numbers its words from its neighbours
alone.  What a partition shares with the one before is settled from one word of each.
Nodes with one word below them pair with nothing and go no further.  A pair has one
word for each letter of the alphabet at most, so pairs are grouped, not joined: a
group gives its size and its word of largest count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow, shuffle_partitions
from custlens.session import materialise_table

# The letters of a word, its least length and number, and how many times
# more frequent its form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, MORE = 7, 2, 10
#: Different words that a task holds while it counts; words of a partition.
HELD, EACH = 400_000, 1_000_000


def runs(text: str) -> Counter:
    """The text's maximal runs of SHORTEST letters and more, A-Z lower-cased, and their numbers."""
    found = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return Counter(found.findall(text) if len(text) < 1 << 22 else (m[0] for m in found.finditer(text)))


def misspell(doc_id: str, run: str) -> str:
    """The run, one letter less where 31 divides the crc32 of ``doc_id:run``."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 31:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def count_words(docs: DataFrame, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """word, n of the runs of all whole texts (doc_id, text), SHORTEST letters and LEAST
    occurrences at least.  ``change``: what becomes of a run of a document.  Tasks add
    up before the shuffle, so a frequent word is a row a task.  A null text has no
    words, a null doc_id is one space."""
    types = arrow_types("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for word, n in runs(text).items():
                    if change:
                        word = change(doc_id, word)
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) > HELD:
                    yield as_batch([list(held), list(held.values())], types)
                    held.clear()
        if held:
            yield as_batch([list(held), list(held.values())], types)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")).alias("id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def common(a: str, b: str) -> int:
    """Letters that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def _scan(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` sorted by their different ``key``, with part, place (in the part), size
    (letters), share (letters that a word beside it begins with too; all at a part's
    ends) and firsts: for each depth from 1 to share the place of the part's first word
    with that prefix, -1 where the part's first word has it, which may not be the first
    of all."""
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "key string, part int, place long, size int, share int, firsts binary"])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, place, firsts, before, held, keys = TaskContext.get().partitionId(), 0, [], None, None, []
        for b in chain((b for b in batches if b.num_rows), [None]):
            following = b.column(len(keep)).to_pylist() if b else []
            if held:
                lead = [common(x, y) for x, y in zip(keys, [*keys[1:], *following[:1]])]
                made = []
                for i, key in enumerate(keys):
                    size = len(key)
                    if place == 0:
                        firsts, share = [-1] * size, size
                    else:
                        firsts = firsts[:before] + [place] * (size - before)
                        share = max(before, lead[i]) if i < len(lead) else size
                    before = lead[i] if i < len(lead) else 0
                    made.append((part, place, size, share, np.array(firsts[:share], np.int64).tobytes()))
                    place += 1
                yield as_batch([*held.columns, *zip(*made)], types)
            held, keys = b, following

    n = max(shuffle_partitions(rows.sparkSession), rows.count() // EACH)
    return map_arrow(rows.select(*keep, "key").repartitionByRange(n, "key").sortWithinPartitions("key"), run, schema)


def number_nodes(rows: DataFrame, keep: list[str], name: str) -> DataFrame:
    """``keep``, key, size, rank (the key's place in the order of all) and nodes: the
    numbers of the trie nodes from the root to the deepest that another key shares, a
    few more at parts' ends.  ``rows``: keep and different ``key``.  One key of each part passes
    through the driver, with its nodes."""
    scanned = materialise_table(_scan(rows, keep), name)
    ends = scanned.groupBy("part").agg(F.count("*").alias("n"), F.max("size").alias("longest"), F.min_by("key", "place").alias("head"), F.max_by(F.struct("key", "firsts"), "place").alias("tail"))
    offsets, heads, last, before, total, longest = {}, {}, np.zeros(0, np.int64), "", 0, 0
    for part, n, size, head, (tail, firsts) in ends.orderBy("part").collect():
        shared = common(before, head)
        own = np.concatenate([last[:shared], np.full(len(head) - shared, total)])
        offsets[part], heads[part] = total, own
        firsts = np.frombuffer(firsts, np.int64)
        known = np.flatnonzero(firsts < 0)
        last = firsts + total
        last[known] = own[known]
        before, total, longest = tail, total + n, max(longest, size)
    width = longest + 1
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "key string, size int, rank long, nodes binary"])
    types, m = arrow_types(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part, place, share = (b.column(k).to_numpy() for k in (m + 1, m + 2, m + 4))
            offset = np.array([offsets[p] for p in part.tolist()])
            firsts = np.frombuffer(b"".join(b.column(m + 5).to_pylist()), np.int64)
            begin = np.cumsum(share) - share
            depth = np.arange(len(firsts)) - np.repeat(begin, share)
            number = firsts + np.repeat(offset, share)
            inherited = np.flatnonzero(firsts < 0)
            owner = np.repeat(part, share)[inherited]
            for p in np.unique(owner).tolist():
                at = inherited[owner == p]
                number[at] = heads[p][depth[at]]
            number = number * width + depth + 1
            nodes = [b"\0" * 8 + number[i:i + k].tobytes() for i, k in zip(begin.tolist(), share.tolist())]
            yield as_batch([*b.columns[:m + 1], b.column(m + 3), offset + place, nodes], types)

    return map_arrow(scanned, run, schema)


def _pair_rows(words: DataFrame) -> DataFrame:
    """p, s (node numbers), word_id, n and kind: 0 a word with a letter skipped, 1 the same
    where the next letter is another (the one place of its run that counts as deleted),
    2 a word's own halves."""
    schema = "p long, s long, word_id long, n long, kind int"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for b in batches:
            for word_id, n, head, key, tail in zip(*(c.to_pylist() for c in b.columns)):
                head, tail, word, size = np.frombuffer(head, np.int64).tolist(), np.frombuffer(tail, np.int64).tolist(), key[::-1], len(key)
                for i in range(max(0, size - len(tail)), min(len(head), size)):
                    made.append((head[i], tail[size - 1 - i], word_id, n, int(i == size - 1 or word[i] != word[i + 1])))
                for i in range(max(0, size + 1 - len(tail)), min(len(head), size + 1)):
                    made.append((head[i], tail[size - i], word_id, n, 2))
                if len(made) > 50_000:
                    yield as_batch(list(zip(*made)), types)
                    made = []
        if made:
            yield as_batch(list(zip(*made)), types)

    return map_arrow(words.select("word_id", "n", "head", "key", "nodes"), run, schema)


def neighbours(words: DataFrame) -> DataFrame:
    """word_id, word, n, n_near, best_n and best_id for each of the different ``words``
    (word, n).  word_id is the word's place in code-point order; best: of the near words
    and itself, the one of largest n, then smallest."""
    head = number_nodes(words.select(F.col("word").alias("key"), "n"), ["n"], "spelling-heads")
    head = head.select("n", F.col("rank").alias("word_id"), F.col("nodes").alias("head"), F.reverse("key").alias("key"))
    both = materialise_table(number_nodes(head, ["n", "word_id", "head"], "spelling-tails"), "spelling-nodes")
    one = F.struct("n", (-F.col("word_id")).alias("neg"))
    skipped, deleted, own = F.col("kind") < 2, F.col("kind") == 1, F.col("kind") == 2
    # a pair has one word for each letter, and its own word, at most
    pairs = _pair_rows(both).groupBy("p", "s").agg(
        F.collect_list(F.struct("word_id", "kind")).alias("members"), F.count_if(skipped).alias("skipped"), F.count_if(deleted).alias("deleted"),
        F.max(F.when(skipped, one)).alias("of_skipped"), F.max(F.when(deleted, one)).alias("of_deleted"), F.max(F.when(own, one)).alias("of_own"))
    pairs = pairs.filter(F.size("members") > 1).select(F.explode("members").alias("m"), "*")
    kind = F.col("m.kind")
    near = F.when(kind == 2, F.col("deleted")).otherwise(F.col("skipped") - 1 + ((kind == 1) & F.col("of_own").isNotNull()).cast("long"))
    best = F.when(kind == 2, F.col("of_deleted")).otherwise(F.greatest("of_skipped", F.when(kind == 1, F.col("of_own"))))
    found = pairs.select(F.col("m.word_id").alias("word_id"), near.alias("near"), best.alias("best")).groupBy("word_id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    out = both.select("word_id", F.reverse("key").alias("word"), "n").join(found, "word_id", "left")
    return out.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.n").alias("best_n"), (-F.col("best.neg")).alias("best_id"))


def group_spellings(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each of the different ``words`` (word, n).

    form is the near word of largest n (ties: the smallest) if that is MORE times the
    word's n or more, else null; root is the last word that forms lead to.  Forms have
    ever larger n, so the chains are short and end; they are followed by doubling.  An
    empty table gives an empty one.
    """
    known = materialise_table(neighbours(words), "spelling-near")
    steps = known.filter(F.col("best_n") >= MORE * F.col("n")).select("word_id", F.col("best_id").alias("form_id"), F.col("best_id").alias("root_id"))
    steps = materialise_table(steps, "spelling-forms")
    while True:
        ahead = steps.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("further"))
        steps = materialise_table(steps.join(ahead, "root_id", "left").select("word_id", "form_id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")), "spelling-forms")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    name = known.select(F.col("word_id").alias("id"), "word", "n")
    forms = name.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = name.select(F.col("id").alias("root_id"), F.col("word").alias("last"))
    ends = steps.join(forms, "form_id").join(roots, "root_id").select("word_id", "form", "form_n", "last")
    out = known.join(ends, "word_id", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """group_spellings of the words of ``docs``; only doc_id and text are read.  Null,
    empty and repeated rows are as in count_words."""
    return group_spellings(materialise_table(count_words(docs, change), "spelling-words"))
