from pyspark.sql import functions as F

from custlens.functions import scalars as S
from custlens.operators import classify as B


def test_more_than_ten_thousand_categories_reach_the_forest(spark):
    # the value decides the label only through its few frequent values
    df = spark.range(36_000).select("id", (F.col("id") % 7).cast("double").alias("num"), F.concat(F.lit("v"), (F.col("id") / 3).cast("int")).alias("wide"),
                                    F.when(F.col("id") % 2 == 0, "yes").when(F.col("id") % 4 == 1, "no").alias("few"), (1 - F.col("id") % 2).alias("Churn"))
    model = B.train_wide_forest(df, ["num"], ["wide", "few"], num_trees=4, max_depth=3)
    assert [len(x) for x in model.encoder.stages[0].labelsArray] == [12_000, 2]
    assert model.forest.numFeatures == 12_003
    new = spark.createDataFrame([(1, 0.0, "unseen", "yes"), (2, 0.0, None, None)], "id long, num double, wide string, few string")
    got = B.predict_wide_forest(model, new, ["id"]).collect()
    assert sorted(r["id"] for r in got) == [1, 2] and all(0 <= r["churn_proba"] <= 1 for r in got)


def test_hot_place(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "a")], "id int, x string")
    coded, model = S.one_hot_vector(df, ["x"])
    assert {r["id"]: r["p"] for r in coded.select("id", S.hot_place("x_onehot").alias("p")).collect()} == {1: 1, 2: 0, 3: None, 4: 0}
    other, _ = S.one_hot_vector(df.select("id", F.lit("z").alias("x")), ["x"], model)
    assert {r["p"] for r in other.select(S.hot_place("x_onehot").alias("p")).collect()} == {None}
