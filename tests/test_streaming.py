import os

from pyspark.sql import functions as F

from custlens.streaming.scoring import score_stream


def test_stream_scores_every_file(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(0, 100).select(F.col("id").alias("k"), (F.col("id") * 2.5).alias("x"))
    df.where("k < 50").write.parquet(src + "/a")
    df.where("k >= 50").write.parquet(src + "/b")
    files_dir = str(tmp_path / "flat")
    df.repartition(3).write.parquet(files_dir)
    q = score_stream(spark, files_dir, df.schema, lambda b: b.withColumn("score", F.col("x") / 10),
                     str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 100 and out.agg(F.sum("score")).first()[0] == sum(i * 0.25 for i in range(100))
    assert os.path.exists(str(tmp_path / "ckpt"))
    # a replayed micro-batch replaces its own partition: no duplicates
    first = out.agg(F.min("batch_id")).first()[0]
    df.where("k < 10").withColumn("score", F.col("x") / 10).write.mode("overwrite") \
        .parquet(str(tmp_path / "out" / f"batch_id={first}"))
    assert spark.read.parquet(str(tmp_path / "out")).where(f"batch_id = {first}").count() == 10
