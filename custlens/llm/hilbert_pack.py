"""Packing along a space-filling curve.

A document's token ids are hashed into a vector and projected to DIMS random
directions in one step (every id has a sign per direction); the mean signs,
squashed to 0..1, are cut into BITS bits each, and the Hilbert curve through
that grid gives the document's key.  Documents are range-sorted by key and laid
end to end; the line is cut every ``length`` tokens.  So a sequence holds
neighbours on the curve, only the last one is padded, and a document is cut only
where a sequence ends.

Only (key, doc_id, row, n_tokens) is sorted by range, ties on the key by doc_id,
so copies without number spread over tasks; ids move once, to meet their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow, shuffle_partitions, word_memo
from custlens.llm.wordhash import mix
from custlens.session import materialise_table

DIMS, BITS = 4, 10
#: Squash of a mean sign m: 1 / (1 + e^(-STEEP m)).
STEEP = 20.0


def directions(n: int, dims: int = DIMS, seed: int = 9) -> np.ndarray:
    """Signs of the ids below n in each direction."""
    h = mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32))
    return (((h[:, None] >> np.arange(dims, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of ``cells`` (n x dims, below 2^bits) on the Hilbert
    curve.  The axes are taken from the highest bit down; below a set bit the
    first axis is mirrored, below a clear one it changes places with that axis.
    Then the bits are read across the axes and undone from Gray code."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for d in range(dims):
            mirrored = (x[d] >> b) & 1 == 1
            swap = np.where(mirrored, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(mirrored, below, swap)
            if d:
                x[d] ^= swap
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    shift = 1
    while shift < dims * bits:
        key ^= key >> shift
        shift *= 2
    return key


def document_keys(ids: np.ndarray, ends: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Keys of documents whose ids end at ``ends``; each has one id at least."""
    starts = np.concatenate([[0], ends[:-1]])
    mean = np.stack([np.add.reduceat(s.take(ids), starts, dtype=np.int64) for s in signs.T], 1) / (ends - starts)[:, None]
    cells = (1 / (1 + np.exp(-STEEP * mean)) * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1))


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    schema = "doc_id long, key long, n_tokens long, ids binary"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = word_memo(tokenizer, False), np.array([end_id], "<u4").tobytes()
        size = memo.tok.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        signs = np.ascontiguousarray(directions(size).T).T
        for b in batches:
            if b.num_rows:
                raw = [x + end for x in memo.encode([t or "" for t in b.column(1).to_pylist()])]
                ids = np.frombuffer(b"".join(raw), "<u4").astype("<u2")
                ends = np.cumsum([len(x) // 4 for x in raw])
                starts = np.concatenate([[0], ends[:-1]])
                cut = [ids[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist())]
                yield as_batch([b.column(0), document_keys(ids, ends, signs), ends - starts, cut], types)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, schema).withColumn("row", F.monotonically_increasing_id())


def _places(rows: DataFrame) -> DataFrame:
    """row -> place (tokens before it on the line)."""
    spark = rows.sparkSession
    schema = "row long, n_tokens long, first long, spot int"
    types = arrow_types(schema)

    def run(batches):
        from pyspark import TaskContext
        at, spot = 0, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                n = b.column(1).to_numpy()
                ends = at + np.cumsum(n)
                yield as_batch([b.column(0), b.column(1), ends - n, [spot] * len(n)], types)
                at = int(ends[-1])

    n = shuffle_partitions(spark)
    line = rows.select("key", "doc_id", "row", "n_tokens").repartitionByRange(n, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    line = materialise_table(map_arrow(line.select("row", "n_tokens"), run, schema), "line")
    # one row per partition
    before, at = [], 0
    for r in line.groupBy("spot").agg(F.sum("n_tokens").alias("n")).orderBy("spot").collect():
        before.append((r["spot"], at))
        at += r["n"]
    spots = spark.createDataFrame(before, "spot int, before long")
    return line.join(F.broadcast(spots), "spot").select("row", (F.col("before") + F.col("first")).alias("place"))


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """A row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset and ids (little-endian unsigned
    16-bit).

    Only doc_id and text are read.  A null or empty text is its end id alone.
    Rows of one doc_id are packed each; a null doc_id stays null.  A document
    longer than a sequence gets several pieces.  An empty table gives no piece.
    """
    rows = materialise_table(_encoded(docs, tokenizer, end_id), "encoded")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, raw, place in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(raw, "<u2")
                wide, n, at = ids.astype("<u4").tobytes(), len(ids), 0
                while at < n:
                    seq, off = divmod(place + at, length)
                    size = min(length - off, n - at)
                    out.append((doc, at, size, zlib.crc32(wide[4 * at:4 * (at + size)]), n, seq, off, raw[2 * at:2 * (at + size)]))
                    at += size
                    if len(out) >= 2000:
                        yield as_batch(list(zip(*out)), types)
                        out = []
            if out:
                yield as_batch(list(zip(*out)), types)

    placed = rows.select("row", "doc_id", "ids").join(_places(rows).hint("shuffle_hash"), "row")
    return map_arrow(placed.select("doc_id", "ids", "place"), run, schema)
