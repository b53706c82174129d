"""Connected components of an edge table by alternating large and small stars.

Each round replaces a node's links by links to the smallest id it sees, so that the number of rounds grows with the
logarithm of a component's size and no group of rows is ever gathered in one task: the minimum is a partial aggregate,
and it reaches the edges by an equi-join, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rollbook.session import drop_folder, new_folder, table_of


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def mark(e: DataFrame) -> Row:
    """What tells whether a round changed a table of different links, of any size: their number and the sum of their hashes,
    bit by bit and without carrying, so that nothing overflows."""
    return e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; component is the least node id of its component.

    Nulls and self-links are ignored, repeated links count once, an empty table gives an empty one. Raises if the
    rounds do not come to rest, which takes more nodes than any table holds.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = new_folder(spark, "edges")
    e = table_of(e, "edges", path)
    before = mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        new_path = new_folder(spark, "edges")
        e = table_of(_small_star(_large_star(e).where("a <> b").distinct()).distinct(), "edges", new_path)
        drop_folder(spark, path)
        path = new_path
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
