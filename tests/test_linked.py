"""Counts of linked ids are those of the pairs, and many ids under one key never make their pairs."""

from pyspark.sql import functions as F

from tracemill.operators import relational as R


def test_linked_counts(spark):
    left = [(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, None), (3, None), (4, "z"), (None, "b"), (5, "d")]
    right = [(9, "a"), (9, "b"), (8, "b"), (8, "b"), (7, "c"), (7, None), (6, "a"), (None, "d")]
    got = R.linked_counts(spark.createDataFrame(left, "id int, k string"), spark.createDataFrame(right, "r int, k string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 3, 6), (2, 2, 6), (None, 2, 8), (5, 0, None)], key=str)
    many = spark.range(200_000)  # 4 * 10**10 pairs
    got = R.linked_counts(many.select("id", F.lit("one").alias("k")), many.select(F.col("id").alias("r"), F.lit("one").alias("k")))
    assert got.agg(F.min("linked"), F.max("linked"), F.max("first"), F.count("id")).first() == (200_000, 200_000, 0, 200_000)
