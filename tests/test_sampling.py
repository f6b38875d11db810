"""Weighted draws where weights are small against a millionth, or lie far apart."""

from pyspark.sql import functions as F

from annolake.operators import sampling


def test_rows_of_large_classes_are_drawn(spark):
    """1/count weights: classes of 2.2 million, 700,000 and 10 rows are drawn equally often."""
    label = F.when(F.col("id") < 2_200_000, "a").when(F.col("id") < 2_900_000, "b").otherwise("c")
    df = sampling.inverse_frequency_weights(spark.range(2_900_010).withColumn("label", label), "label")
    for part, classes in ((df, 3), (df.where("label = 'a'"), 1)):
        drawn = sampling.weighted_sample(part, 6000, 3, "id").groupBy("label").count().collect()
        assert len(drawn) == classes and sum(r["count"] for r in drawn) == 6000
        assert all(abs(r["count"] / 6000 - 1 / classes) < 0.03 for r in drawn)


def test_far_apart_weights(spark):
    rows = [(i, w) for i, w in enumerate([1e-12, 3e12, 1e12, 0.0, -1.0, float("nan"), None])]
    df = spark.createDataFrame(rows, "k int, weight double")
    share = {r["k"]: r["count"] / 4000 for r in sampling.weighted_sample(df, 4000, 3, "k").groupBy("k").count().collect()}
    assert set(share) == {1, 2} and abs(share[1] - 0.75) < 0.03
    tiny = spark.createDataFrame([(1, 1e-300), (2, 3e-300)], "k int, weight double")
    share = {r["k"]: r["count"] / 4000 for r in sampling.weighted_sample(tiny, 4000, 3, "k").groupBy("k").count().collect()}
    assert abs(share[2] - 0.75) < 0.03
    mixed = spark.createDataFrame([(1, 1e-300), (2, 3e200), (3, 1e200)], "k int, weight double")
    share = {r["k"]: r["count"] / 4000 for r in sampling.weighted_sample(mixed, 4000, 3, "k").groupBy("k").count().collect()}
    assert set(share) == {2, 3} and abs(share[2] - 0.75) < 0.03
