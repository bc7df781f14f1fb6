"""Two-pass external shuffle into shards.

Pass 1 scatters the records into buckets by a seeded hash of doc_id and text; a
bucket is of a size that one task can hold.  Records equal in both that together
would crowd a bucket get a seeded random salt besides, as many values as their
bytes need, and are written once so that every later job sees the same salts.
Pass 2 takes one bucket per task, shuffles it by Fisher-Yates, seeded by the
bucket, and numbers its records.  The shuffled buckets one after the other are
the shuffled corpus; it is cut into shards whose counts differ by one at most
(the law ``rows``).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from custlens.llm.common import ARROW_ROWS, map_arrow, shuffle_partitions
from custlens.session import materialise_table


def fisher_yates(n: int, seed: str) -> list[int]:
    order, rnd = list(range(n)), random.Random(seed).random
    for i in range(n - 1, 0, -1):
        j = int(rnd() * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def _scattered(docs: DataFrame, name: str, buckets: int, seed: int, bucket_bytes: int) -> DataFrame:
    """``docs`` and the bucket of each record as last column ``name``; no equal
    records of more than half a bucket share one."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    key = F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id").cast("long"), F.col("text"))
    plain = docs.withColumn(name, F.pmod(key, F.lit(buckets)).cast("int"))
    fullest = plain.groupBy(name).agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
    if fullest <= 2 * bucket_bytes:
        return plain
    hash_, pieces = _unused(docs, "hash"), _unused(docs, "pieces")
    hot = docs.groupBy(key.alias(hash_)).agg(F.sum(size).alias("size")).filter(F.col("size") * 2 > bucket_bytes)
    hot = hot.select(hash_, F.ceil(F.col("size") * 4 / bucket_bytes).alias(pieces))
    keyed = docs.withColumn(hash_, key)
    salted = keyed.join(hot, hash_).withColumn(name, F.pmod(F.xxhash64(hash_, F.floor(F.rand(seed) * F.col(pieces))), F.lit(buckets)).cast("int"))
    salted = materialise_table(salted.select(*docs.columns, name), "shards-equal")
    rest = keyed.join(hot, hash_, "left_anti").withColumn(name, F.pmod(hash_, F.lit(buckets)).cast("int"))
    return rest.select(*docs.columns, name).unionByName(salted)


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = 20, bucket_bytes: int = 64 << 20) -> DataFrame:
    """All columns of ``docs``, then shard (0 to shards - 1) and slot (from 0, gapless).

    The order of a bucket starts from doc_ids (null last) and texts.  Records of one
    doc_id, null too, are scattered by their texts, and equal records beyond half a
    bucket by a salt.  Null texts stay null.  Columns of the input named shard or
    slot are replaced, others stay whatever their name.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(64))
    total = docs.agg(size.cast("long")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // bucket_bytes))
    bucket = _unused(docs, "bucket")
    scattered = _scattered(docs, bucket, buckets, seed, bucket_bytes)
    # one row per bucket
    counts = np.zeros(buckets + 1, np.int64)
    for b, n in scattered.groupBy(bucket).count().collect():
        counts[b + 1] = n
    before = np.cumsum(counts)
    rows = int(before[-1])
    schema = StructType([*docs.schema.fields]).add("shard", IntegerType()).add("slot", LongType())
    types, at = to_arrow_schema(schema), docs.columns.index("doc_id")
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        where = table.column(table.num_columns - 1).to_numpy()
        for b in np.unique(where).tolist():
            own = table.filter(pc.equal(table.column(table.num_columns - 1), b)) if where[0] != where[-1] or (where != b).any() else table
            keys = pa.table({"id": own.column(at), "text": own.column(text)})
            first = np.asarray(pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")]))
            order = first[fisher_yates(own.num_rows, f"{seed}:{b}")]
            place = before[b] + np.arange(own.num_rows)
            shard = place * shards // rows
            slot = place - -(-shard * rows // shards)
            for i in range(0, len(order), ARROW_ROWS):
                part = own.take(pa.array(order[i:i + ARROW_ROWS])).combine_chunks()
                columns = [c.combine_chunks() for c in part.columns[:-1]]
                columns += [pa.array(shard[i:i + ARROW_ROWS], pa.int32()), pa.array(slot[i:i + ARROW_ROWS])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types)], schema=types)

    return map_arrow(scattered.repartitionById(buckets, F.col(bucket)), run, schema)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards as Parquet folders shard=0, shard=1, ... and read them."""
    shuffled_shards(docs, **options).write.mode("overwrite").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(StructType([*docs.drop("shard", "slot").schema.fields]).add("slot", LongType()).add("shard", IntegerType())).parquet(path)
