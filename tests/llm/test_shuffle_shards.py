from collections import Counter

from custlens.llm import shuffle_shards as S


def check(df, got, shards=16):
    assert Counter(tuple(r)[:len(df.columns)] for r in got) == Counter(tuple(r) for r in df.collect())
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))


def test_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = S.write_shards(docs, str(tmp_path / "s"), bucket_bytes=200_000).collect()
    order = ["doc_id", "text", "lang", "source", "n_chars"]
    check(docs, got)
    again = S.shuffled_shards(docs.repartition(5), bucket_bytes=200_000).collect()
    place = lambda rows: {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    assert place(got) == place(again) and list(docs.columns) == order
    assert place(got) != place(S.shuffled_shards(docs, seed=21, bucket_bytes=200_000).collect())
    # neighbours are parted
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert 0.03 < sum(shard[d] == shard[d + 1] for d in range(999)) / 999 < 0.1


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(S.fisher_yates(3, str(k))) for k in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850 and S.fisher_yates(0, "a") == []


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (None, "x", 7), (None, "x", 7), (3, "é" * 300_000, 7), (3, "b", 7), (3, "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    check(df.drop("slot"), S.shuffled_shards(df, shards=3).collect(), 3)
    assert S.shuffled_shards(df.limit(0)).collect() == []


def test_one_doc_id_on_a_third_of_all_rows(spark):
    from pyspark.sql import functions as F
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same " * 40).alias("text"), F.lit(1).alias("bucket"), F.col("id").alias("hash"))
    null = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(2).alias("bucket"), F.col("id").alias("hash"))
    rest = spark.range(1000).select((F.col("id") + 10).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(3).alias("bucket"), F.col("id").alias("hash"))
    df = hot.unionByName(null).unionByName(rest)
    buckets = S._scattered(df, "own", 64, 20, 8_000).groupBy("own").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).collect()
    assert max(r["n"] for r in buckets) < 24_000
    check(df, S.shuffled_shards(df, bucket_bytes=8_000).collect())
