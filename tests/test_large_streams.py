"""Streams keep little beside their states, and read a batch once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rollbook.operators import results as R
from rollbook.streaming import incremental

ENTRY = "student string, subject string, season_ord int, source string, file_order long, document_date string, value double, status string, n long, removed boolean"
COLS = ("student", "subject", "season_ord", "value", "status", "source")


def entry(student, source, n, value, removed=False):
    return (student, None if removed else "X", None if removed else 0, source, 1, None, value, None, n, removed)


def folded(spark, at, batches):
    for batch in batches:
        spark.createDataFrame(batch, ENTRY).coalesce(1).write.mode("append").parquet(f"{at}/in")
        q = incremental.start(spark.readStream.schema(ENTRY).parquet(f"{at}/in"), f"{at}/out", ["n"])
        q.awaitTermination(300)
        assert q.exception() is None
    return sorted(map(str, incremental.current(spark, f"{at}/out").select(*COLS).collect()))


def test_students_of_one_state_are_kept_apart(spark, tmp_path, monkeypatch):
    """Odd names, no source, a source that is called None; a batch touches some students of a state only."""
    monkeypatch.setattr(incremental, "BUCKETS", 1)
    names = ["a", "a\tb", "a\nb", 'a"', ""]
    first = [entry(s, "f1", i, float(i)) for i, s in enumerate(names)] + [entry("a", None, 8, 19.0), entry("", "None", 9, 18.0)]
    second = [entry("a", "f1", None, None, True), entry("a\tb", "f1", None, None, True), entry("", None, None, None, True), entry("a\nb", "f2", 10, 4.0), entry("a\nb", "f1", None, None, True)]
    left = [entry("a", None, 8, 19.0), entry("", "None", 9, 18.0), entry('a"', "f1", 3, 3.0), entry("", "f1", 4, 4.0), entry("a\nb", "f2", 10, 4.0)]
    got = folded(spark, tmp_path, [first, second])
    assert got == sorted(map(str, R.season_results(spark.createDataFrame(left, ENTRY).drop("removed"), ["n"]).select(*COLS).collect()))


def test_a_batch_is_not_held_beside_its_results(spark, tmp_path, monkeypatch):
    kept = []
    persist = type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: kept.append(df) or persist(df, *a))
    rows = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 50).alias("student"), F.lit("X").alias("subject"), F.lit(0).alias("season_ord"), F.concat(F.lit("f"), F.col("id") % 3).alias("source"), F.lit(1).cast("long").alias("file_order"), F.lit(None).cast("string").alias("document_date"), (F.col("id") % 21).cast("double").alias("value"), F.lit(None).cast("string").alias("status"), F.col("id").alias("n"), F.lit(False).alias("removed"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    incremental.start(spark.readStream.schema(ENTRY).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["n"]).awaitTermination(300)
    size = lambda at: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(at) for f in fs)
    assert incremental.current(spark, f"{tmp_path}/out").count() == 50 and not kept
    assert size(f"{tmp_path}/out/checkpoint/state") < 4000 * 40
