"""Clusters of more links than a small table has."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import components as C


def test_links_are_told_apart_without_overflow(spark):
    """The sum of the hashes of 2^25 links, of 2^39 each on average, passes 64 bits."""
    links = spark.range(1 << 25).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    whole, less = C.mark(links), C.mark(links.where("b <> 77"))
    other = C.mark(links.withColumn("b", F.when(F.col("b") == 77, 78).otherwise(F.col("b"))))
    assert whole[0] == other[0] == less[0] + 1 == 1 << 25 and len({whole, less, other}) == 3
    assert C.mark(links) == whole
