"""Rows that models are fitted on: all of them, dealt evenly, held once and let go."""

from pyspark.sql import functions as F

from tapeloom.operators import ml


def test_rows_to_train_on_are_dealt_evenly_and_let_go(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(None).cast("double").alias("z")).coalesce(1)
    with ml.held_for_training(df, ["x", "z", "x", "y"]) as rows:
        assert rows.columns == ["x", "z", "y"] and rows.storageLevel.useMemory
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and sum(sizes) == 3000 and max(sizes) < 2 * min(sizes)
        assert sorted(map(tuple, rows.select("x", "y").collect())) == sorted((float(i % 7), float(i % 3)) for i in range(3000))
    assert not rows.storageLevel.useMemory


def test_elimination_finds_the_columns_that_tell(spark):
    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 31 % 11).cast("double").alias("n")).coalesce(1)
    d = df.withColumn("y", F.when(F.col("x") > 3, 5.0).otherwise(F.col("x")))
    found = ml.recursive_elimination(d, ["n", "x"], "y", F.expr("id % 3"), trees=3, depth=3).collect()
    assert {r.feature: r.kept for r in found}["x"] and sorted(r["rank"] for r in found) in ([1, 1], [1, 2])
