"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every five-word shingle is hashed once.  The hash's high bits name one of BINS
bins, the rest is its value, and a bin keeps its smallest value.  An empty bin
takes the value of the first filled bin on a walk of its own (optimal
densification: the walk's start and odd step come from a hash of the bin, so it
visits every bin).  The low BITS bits of each bin are packed to the fingerprint.
Two fingerprints agree by chance in 2^-BITS of the bins; likeness takes that off.

A text is handled inside its row, without an explode or a shuffle: its hashes are
sorted together with one largest value per bin, and the first of each bin stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.llm.common import SPACES, shuffle_partitions

#: Bins (a power of two up to 2^15) and bits kept of each (4 or 8).
BINS, BITS, SHINGLE = 128, 8, 5
_SHIFT = 63 - (BINS.bit_length() - 1)
_MOST = (1 << _SHIFT) - 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scatter(i: int) -> int:
    """A 32-bit hash of a bin's number (the finalizer of MurmurHash3)."""
    i = (i + 0x9E3779B9) & 0xFFFFFFFF
    i = ((i ^ (i >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
    i = ((i ^ (i >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
    return i ^ (i >> 16)


def shingle_hashes(text: Column) -> Column:
    """One hash per shingle; all words as one where there are fewer; none without words."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def runs(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[at(i, F.lit(k)) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def bin_values(hashes: Column) -> Column:
    """The smallest value of each bin, null where the bin is empty."""
    last = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.shiftleft(i.cast("bigint"), _SHIFT) + F.lit(_MOST).cast("bigint"))
    values = F.sort_array(F.concat(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1)), last))

    def firsts(s: Column) -> Column:
        first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))
        return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_MOST)) != _MOST, x.bitwiseAND(F.lit(_MOST))))

    return let(values, firsts)


def densified(values: Column) -> Column:
    """Empty bins filled; all 0 where every bin is empty."""
    starts = F.array(*[F.lit(_scatter(2 * i) % BINS) for i in range(BINS)])
    steps = F.array(*[F.lit(_scatter(2 * i + 1) % BINS | 1) for i in range(BINS)])

    def fill(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            walk = [F.get(v, (F.get(starts, i) + F.get(steps, i) * t).bitwiseAND(F.lit(BINS - 1))) for t in range(BINS)]
            return F.coalesce(x, *walk, F.lit(0).cast("bigint"))

        return F.transform(v, one)

    return let(values, fill)


def fingerprint_bins(text: Column) -> Column:
    """The low bits of each bin, as array<int>."""
    return F.transform(densified(bin_values(shingle_hashes(text))), lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))


def packed(bins: Column) -> Column:
    """Fingerprint as lowercase hex, BITS bits per bin in order."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets, chance agreement taken off, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 2.0 ** -BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and bins of each text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_bins(text).alias("bins"))
    return rows.select("doc_id", packed(F.col("bins")).alias("fingerprint"), "bins")


#: Key of a row: doc_id, whether it is null, and the text's hash.
KEY = ["id", "none", "mark"]


def _keyed(docs: DataFrame) -> DataFrame:
    """KEY and text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc, F.lit(0).cast("long")).alias("id"), doc.isNull().alias("none"), text.alias("text")).withColumn("mark", F.xxhash64("text"))


def followers(docs: DataFrame) -> DataFrame:
    """KEY, need (a third of the text, rounded down) and next_id, next_none, next_mark
    of the next document by descending doc_id; the first follows the last.

    Keys alone are sorted by range; the partitions' first rows, one each, close the
    gaps between partitions.
    """
    n = shuffle_partitions(docs.sparkSession)
    keys = _keyed(docs).select(*KEY, F.floor(F.length("text") / 3).cast("int").alias("need"))
    keys = keys.groupBy(*KEY).agg(F.max("need").alias("need"))
    order = [F.col("none").asc(), F.col("id").desc(), F.col("mark").asc()]
    keys = keys.repartitionByRange(n, *order).withColumn("spot", F.spark_partition_id())
    w = Window.partitionBy("spot").orderBy(*order)
    rows = keys.select("*", F.lead(F.struct(*KEY)).over(w).alias("next"), F.row_number().over(w).alias("at"))
    heads = rows.filter("at = 1").select("spot", F.struct(*KEY).alias("head"))
    every = Window.orderBy("spot")
    ahead = heads.select("spot", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("ahead"))
    rows = rows.join(F.broadcast(ahead), "spot").withColumn("next", F.coalesce("next", "ahead"))
    return rows.select(*KEY, "need", *[F.col(f"next.{k}").alias(f"next_{k}") for k in KEY])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many of the next document by descending doc_id (after the last: the
    first; a single document follows itself).  A null text counts as empty; equal
    texts, empty ones too, are alike to 1.  A null doc_id comes last.  Rows that
    repeat doc_id and text have one place in the order and are returned each.
    Only doc_id and text are read; an empty table gives an empty one.
    """
    # both joins take the same columns by the same key, so the texts are shuffled
    # once; each fingerprint is made where its text is
    rows = _keyed(docs)
    n, a, r = followers(docs).alias("n"), rows.alias("a"), rows.alias("r")
    tails = a.join(n, reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"n.next_{k}") for k in KEY]))
    tails = tails.select(*[F.col(f"n.{k}").alias(k) for k in KEY],
                         F.struct(F.left(F.col("a.text"), F.col("n.need")).alias("tail"), fingerprint_bins(F.col("a.text")).alias("next_bins")).alias("t"))
    tails = tails.groupBy(*KEY).agg(F.first("t").alias("t")).alias("t")
    both = r.join(tails, reduce(lambda x, y: x & y, [F.col(f"r.{k}") == F.col(f"t.{k}") for k in KEY]))
    size = F.length("r.text")
    edited = F.concat(F.left(F.col("r.text"), size - F.floor(size / 3).cast("int")), F.col("t.t.tail"))
    out = both.select(F.when(~F.col("r.none"), F.col("r.id")).alias("doc_id"), size.cast("long").alias("n_chars"), fingerprint_bins(F.col("r.text")).alias("bins"), F.col("t.t.next_bins").alias("next_bins"),
                      let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint_bins(e).alias("bins"))).alias("e"))
    return out.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("e.bins")).alias("edited_fingerprint"),
                      likeness(F.col("bins"), F.col("e.bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
