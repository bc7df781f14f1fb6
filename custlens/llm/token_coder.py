"""Token-id files: an adaptive context-mixing range coder over blocks of ids.

Ids are cut into blocks.  Each block is coded on its own: its model starts
empty, its coded words stand alone, and a CRC-32 of its ids is kept beside it.
All blocks of a record are coded at the same time, one numpy lane per block, so
a step of Python codes one id of every block.

Model of a block, integers only (the same on every machine):

* order 2 and order 1 predict an id: the one that followed the same hash of the
  last two ids, or the last id, at its latest visit.  The prediction with the
  better record is put up.
* whether the id is the one put up is coded with a probability mixed in the
  logistic domain from three adaptive probabilities: order 0 (how often the
  last three guesses were right), order 1 and order 2 (how often the slot was
  right so far).  The mixing weights learn after each id.
* an id that was not predicted is coded by the order-0 model: its high byte,
  then its low byte, by adaptive counts whose cumulative sums are renewed after
  16, 64, then every 256 ids.

Range coder: 64-bit low and range without carries, 16-bit words out.

A table of records is written by Spark's Parquet writer, so it lands on any file
system that Spark writes, a lost executor's tasks are run again, and no part of
a failed attempt stays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow, shuffle_partitions, word_memo

MAGIC = b"CMX1"
#: Slots of each block's order-1 and order-2 tables (a power of two).
SLOTS = 1024
#: Ids of one record at most, but for a longer document, and of one block.
RECORD_IDS, BLOCK_IDS, LANES = 8_000_000, 8192, 2048
_U = np.uint64
_TOP, _LEAST = _U(1 << 48), _U(1 << 44)
_REST, _ONE, _12, _15, _16, _48 = (_U(x) for x in ((1 << 44) - 1, 1, 12, 15, 16, 48))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Squash: 4095 / (1 + e^(-x / 256)) for x in -2047..2047; stretch: its inverse."""
    x = np.arange(-2047, 2048)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x / 256))), 1, 4095).astype(np.int32)
    p = np.arange(4096).clip(1) / 4096
    return squash, np.clip(np.rint(256 * np.log(p / (1 - p))), -2047, 2047).astype(np.int32)


SQUASH, STRETCH = _tables()
_ALL, _STEP = np.int32(4095), np.int32(24)


class _Bytes:
    """Adaptive counts of one byte in each lane."""

    def __init__(self, lanes: int):
        self.n = np.ones((lanes, 256), np.int32)
        self.flat = self.n.ravel()
        self.cum = np.zeros((lanes, 257), np.int32)
        self.cflat = self.cum.ravel()
        self.row, self.crow = np.arange(lanes) * 256, np.arange(lanes) * 257
        self.renew()

    def renew(self) -> None:
        """Cumulative shares of 2^15, each share at least 1."""
        c = np.cumsum(self.n, 1, dtype=np.int32)
        if int(c[0, -1]) > 30_000:
            self.n -= self.n >> 1
            c = np.cumsum(self.n, 1, dtype=np.int32)
        each = ((32768 - 256) << 16) // c[:, -1].astype(np.int64)
        self.cum[:, 1:] = (c * each[:, None] >> 16) + np.arange(1, 257)
        self.cum[:, 256] = 32768

    def find(self, v: np.ndarray) -> np.ndarray:
        at = self.crow[:len(v)].copy()
        for step in (128, 64, 32, 16, 8, 4, 2, 1):
            at += step * (self.cflat.take(at + step, mode="clip") <= v)
        return at - self.crow[:len(v)]

    def span(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.crow[:len(sym)] + sym
        low = self.cflat.take(at, mode="clip")
        return low.astype(_U), (self.cflat.take(at + 1, mode="clip") - low).astype(_U)

    def seen(self, sym: np.ndarray, miss: np.ndarray) -> None:
        self.flat[self.row[:len(sym)] + sym] += _STEP * miss


class _Model:
    """The three orders' state in each lane; the first ``n`` lanes are used.
    A slot holds its record (0 to 7 right guesses in a row) above its id."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) * SLOTS
        self.t1, self.t2 = (np.zeros(lanes * SLOTS, np.int32) for _ in range(2))
        self.p0 = np.full(lanes * 8, 600, np.int32)
        self.p1, self.p2 = (np.tile(np.array([200, 1200, 2000, 2600, 3000, 3300, 3500, 3700], np.int32), lanes) for _ in range(2))
        self.eight = np.arange(lanes, dtype=np.int64) * 8
        self.w = np.full((3, lanes), 22_000, np.int32)
        self.hist, self.a, self.b = (np.zeros(lanes, np.int64) for _ in range(3))
        self.hi, self.lo = _Bytes(lanes), _Bytes(lanes)

    def predict(self, n: int) -> None:
        a, b = self.a[:n] * 40503, self.b[:n] * 30011
        self.s1 = self.base[:n] + ((a >> 4) & (SLOTS - 1))
        self.s2 = self.base[:n] + (((a + b) >> 5) & (SLOTS - 1))
        v1, v2 = self.t1.take(self.s1, mode="clip"), self.t2.take(self.s2, mode="clip")
        self.g1, self.g2, self.k1, self.k2 = v1 & 65535, v2 & 65535, v1 >> 16, v2 >> 16
        self.i0, self.i1, self.i2 = self.eight[:n] + self.hist[:n], self.eight[:n] + self.k1, self.eight[:n] + self.k2
        self.q0, self.q1, self.q2 = (p.take(i, mode="clip") for p, i in ((self.p0, self.i0), (self.p1, self.i1), (self.p2, self.i2)))
        self.guess = np.where(self.q2 * (self.k2 > 0) >= self.q1, self.g2, self.g1)
        self.x = [STRETCH.take(q, mode="clip") for q in (self.q0, self.q1, self.q2)]
        dot = self.w[0, :n] * self.x[0]
        dot += self.w[1, :n] * self.x[1]
        dot += self.w[2, :n] * self.x[2]
        self.p = SQUASH.take((dot >> 16) + 2047, mode="clip")

    def learn(self, n: int, ids: np.ndarray, hit: np.ndarray) -> None:
        err = hit * _ALL - self.p
        for w, x in zip(self.w[:, :n], self.x):  # the leak keeps every weight below 2^18
            w += ((err * x) >> 13) - (w >> 8)
        r1, r2 = self.g1 == ids, self.g2 == ids
        for p, i, q, right in ((self.p0, self.i0, self.q0, hit), (self.p1, self.i1, self.q1, r1), (self.p2, self.i2, self.q2, r2)):
            p[i] = q + ((right * _ALL - q) >> 5)
        for t, s, k, right in ((self.t1, self.s1, self.k1, r1), (self.t2, self.s2, self.k2, r2)):
            t[s] = (np.minimum(k * right + 1, 7) << 16) | ids
        self.hist[:n] = ((self.hist[:n] << 1) | hit) & 7
        self.b[:n], self.a[:n] = self.a[:n], ids

    def renew(self, step: int) -> None:
        if step in (16, 64) or step and step % 256 == 0:
            self.hi.renew()
            self.lo.renew()


def _lane_sizes(total: int, block: int) -> np.ndarray:
    lanes = max(1, -(-total // block))
    return np.full(lanes, total // lanes) + (np.arange(lanes) < total % lanes)


def encode_record(ids: np.ndarray, block: int = 0) -> bytes:
    """Code ids below 2^16.  ``block``: ids of a block at most; 0: as many as
    give about LANES blocks, 1024 at least and BLOCK_IDS at most."""
    ids = np.asarray(ids)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids must be below 65536")
    block = block or min(BLOCK_IDS, max(1024, -(-len(ids) // LANES)))
    sizes = _lane_sizes(len(ids), block)
    lanes, most = len(sizes), int(sizes.max())
    starts = np.cumsum(sizes) - sizes
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    out, put = np.zeros((lanes, most + most // 4 + 64), np.uint16), np.zeros(lanes, np.int64)
    model = _Model(lanes)

    def emit(at: np.ndarray) -> None:
        nonlocal out
        if int(put.max()) + 8 >= out.shape[1]:
            out = np.concatenate([out, np.zeros_like(out)], 1)
        out[at, put[at]] = (low[at] >> _48).astype(np.uint16)
        put[at] += 1
        low[at] <<= _16
        rng[at] <<= _16

    for step in range(most):
        n = lanes if step < int(sizes[-1]) else int((sizes > step).sum())
        now = ids[starts[:n] + step].astype(np.int64)
        model.renew(step)
        model.predict(n)
        hit = model.guess == now
        miss = ~hit
        l, r = low[:n], rng[:n]
        part = (r >> _12) * model.p.astype(_U)
        l += part * miss
        r[:] = np.where(hit, part, r - part)
        for m, sym in ((model.hi, now >> 8), (model.lo, now & 255)):
            cum, freq = m.span(sym)
            part = r >> _15
            l += part * (cum * miss)
            r[:] = np.where(hit, r, part * freq)
            m.seen(sym, miss)
        model.learn(n, now, hit)
        at = np.flatnonzero(((l ^ (l + r)) < _TOP) | (r < _LEAST))
        while len(at):
            cut = at[(low[at] ^ (low[at] + rng[at])) >= _TOP]
            if len(cut):
                rng[cut] = (~low[cut] + _ONE) & _REST
            emit(at)
            x, y = low[at], rng[at]
            at = at[((x ^ (x + y)) < _TOP) | (y < _LEAST)]
    for _ in range(4):
        emit(np.arange(lanes))
    head = np.empty((lanes, 3), "<u4")
    for k in range(lanes):
        head[k] = sizes[k], put[k], zlib.crc32(ids[starts[k]:starts[k] + sizes[k]].astype("<u4").tobytes())
    words = out[np.arange(out.shape[1]) < put[:, None]]
    return MAGIC + struct.pack("<I", lanes) + head.tobytes() + words.astype("<u2").tobytes()


def decode_record(data: bytes) -> np.ndarray:
    """The ids of a record; raises ValueError where a block's checksum differs."""
    if data[:4] != MAGIC:
        raise ValueError("not a token record")
    (lanes,) = struct.unpack_from("<I", data, 4)
    head = np.frombuffer(data, "<u4", lanes * 3, 8).reshape(lanes, 3).astype(np.int64)
    sizes, most = head[:, 0], int(head[:, 0].max())
    words = np.concatenate([np.frombuffer(data, "<u2", -1, 8 + 12 * lanes), np.zeros(8, np.uint16)]).astype(_U)
    put = np.cumsum(head[:, 1]) - head[:, 1]
    low, rng, code = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U), np.zeros(lanes, _U)
    for _ in range(4):
        code = (code << _16) | words[put]
        put += 1
    ids, starts = np.zeros(int(sizes.sum()), np.uint16), np.cumsum(sizes) - sizes
    model = _Model(lanes)
    for step in range(most):
        n = lanes if step < int(sizes[-1]) else int((sizes > step).sum())
        model.renew(step)
        model.predict(n)
        l, r = low[:n], rng[:n]
        part = (r >> _12) * model.p.astype(_U)
        hit = code[:n] - l < part
        miss = ~hit
        l += part * miss
        r[:] = np.where(hit, part, r - part)
        now = []
        for m in (model.hi, model.lo):
            part = r >> _15
            sym = m.find(np.minimum((code[:n] - l) // part, _U(32767)).astype(np.int32))
            cum, freq = m.span(sym)
            l += part * (cum * miss)
            r[:] = np.where(hit, r, part * freq)
            now.append(sym)
        now = np.where(hit, model.guess, now[0] << 8 | now[1])
        model.hi.seen(now >> 8, miss)
        model.lo.seen(now & 255, miss)
        ids[starts[:n] + step] = now
        model.learn(n, now, hit)
        at = np.flatnonzero(((l ^ (l + r)) < _TOP) | (r < _LEAST))
        while len(at):
            x, y = low[at], rng[at]
            y = np.where((x ^ (x + y)) >= _TOP, (~x + _ONE) & _REST, y)
            x, y = x << _16, y << _16
            low[at], rng[at] = x, y
            code[at] = (code[at] << _16) | words.take(put[at], mode="clip")
            put[at] += 1
            at = at[((x ^ (x + y)) < _TOP) | (y < _LEAST)]
    for k in range(lanes):
        if zlib.crc32(ids[starts[k]:starts[k] + sizes[k]].astype("<u4").tobytes()) != head[k, 2]:
            raise ValueError(f"block {k}: checksum differs")
    return ids


FILE_SCHEMA = "shard int, record int, first long, doc_ids array<long>, sizes array<long>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text and write the ids as record files in ascending doc_id order.

    ``docs``: doc_id and text; other columns are left alone.  A null text counts
    as empty; a null doc_id comes first.  Rows of one doc_id, repeats too, are
    written each, ordered by text.  ``first``: ids of the shard before the
    record.  An empty table gives an empty file.
    """
    n = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, memo = TaskContext.get().partitionId(), word_memo(tokenizer, True)
        end = np.array([end_id], "<u4").tobytes()
        first = record = held = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            row = [[shard], [record], [first], [names], [[len(x) // 4 for x in ids]], [encode_record(np.frombuffer(b"".join(ids), "<u4"))]]
            return as_batch(row, types)

        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), memo.encode([t or "" for t in b.column(1).to_pylist()])):
                ids.append(x + end)
                names.append(name)
                held += len(ids[-1]) // 4
                if held >= RECORD_IDS:
                    yield flush()
                    first, record, held, ids, names = first + held, record + 1, 0, [], []
        if ids:
            yield flush()

    types = arrow_types(FILE_SCHEMA)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(rows, run, FILE_SCHEMA).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit)."""
    table = spark.read.parquet(path)
    # one row per shard; there are as many shards as the writer had partitions
    sums = table.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, at = {}, 0
    for r in sums.orderBy("shard").collect():
        before[r["shard"]], at = at, at + r["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, first, names, sizes, data = (b.column(c)[k].as_py() for c in range(5))
                raw = memoryview(decode_record(data).astype("<u4").tobytes())
                ends = np.cumsum(np.array(sizes, np.int64))
                starts = ends - np.array(sizes, np.int64)
                parts = [raw[4 * i:4 * j] for i, j in zip(starts.tolist(), ends.tolist())]
                for i in range(0, len(names), 1000):
                    cols = [names[i:i + 1000], (starts[i:i + 1000] + first + before[shard]).tolist(), sizes[i:i + 1000], [zlib.crc32(p) for p in parts[i:i + 1000]]]
                    yield as_batch(cols + [[bytes(p) for p in parts[i:i + 1000]]] * with_ids, types)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return table.select("shard", "first", "doc_ids", "sizes", "payload").mapInArrow(run, schema)
