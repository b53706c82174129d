"""Pivots, long lists, bands, selections and orders: the shapes of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.text import sort_key

#: Bands of rounded finals, low and high end.
BANDS = [("<10", None, 9), ("10-13", 10, 13), ("14-15", 14, 15), ("16-17", 16, 17), ("18-20", 18, 20)]


def summary(results: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """B2: a row for each student, a column for each of the given subjects, and mean, passed and counted over them.

    The subjects are given, so that the pivot takes one aggregation and no scan to find them.
    """
    wide = results.where(F.col("subject").isin(list(subjects)))
    one = lambda s: F.max(F.when(F.col("subject") == s, F.col("final"))).alias(s)
    return wide.groupBy("student").agg(*map(one, subjects), F.round(F.avg("final"), 2).alias("mean"), F.count_if(F.expr("final >= pass_mark")).alias("passed"), F.count("final").alias("graded"))


def seasons_side_by_side(results: DataFrame) -> DataFrame:
    """A row for each student and subject, the three seasons as columns, the best of them and its season (first of equals)."""
    one = lambda k: F.max(F.when(F.col("season_ord") == k, F.col("value"))).alias(f"season{k + 1}")
    out = results.groupBy("student", "subject").agg(*map(one, range(3)))
    best = F.greatest("season1", "season2", "season3")
    where = F.when(F.col("season1") == best, 1).when(F.col("season2") == best, 2).when(F.col("season3") == best, 3)
    return out.withColumns({"best": best, "best_season": where})


def grade_bands(results: DataFrame) -> DataFrame:
    """Students in each band of rounded finals, by subject."""
    f = F.col("final")
    band = None
    for name, low, high in BANDS:
        hit = (f <= high) if low is None else f.between(low, high)
        band = F.when(hit, name) if band is None else band.when(hit, name)
    return results.where("final is not null").groupBy("subject", band.alias("band")).agg(F.count(F.lit(1)).alias("n")).where("band is not null")


def subject_footer(results: DataFrame) -> DataFrame:
    """Mean, and how many of those with a number passed, under each subject."""
    return results.groupBy("subject").agg(F.round(F.avg("final"), 2).alias("mean"), F.count_if(F.expr("final >= pass_mark")).alias("passed"), F.count("final").alias("graded"))


def credit_means(results: DataFrame, curriculum: DataFrame) -> DataFrame:
    """Means as the averages sheet has them: a missing credit counts as one."""
    rows = results.where("approved and final is not null").join(curriculum, "subject", "left")
    w = F.coalesce(F.col("ects").cast("double"), F.lit(1.0))
    return rows.groupBy("student").agg(F.round(F.sum(F.col("final") * w) / F.sum(w), 2).alias("mean"), F.sum(w).alias("weight"))


def detail(results: DataFrame) -> DataFrame:
    """One row for each student, subject and season."""
    return results.select("student", "subject", "season_ord", "value", "status", "source")


def notices(*parts: DataFrame) -> DataFrame:
    """Conflicts and warnings in one list; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def select_students(students: DataFrame, selection: DataFrame) -> DataFrame:
    """Students named by key or by name in selection (pos, pick), in its order; each once, at its first position."""
    by_key = students.join(selection, students["student"].cast("string") == selection["pick"]).select(students["*"], "pos")
    by_name = students.join(selection, students["name"] == selection["pick"]).select(students["*"], "pos")
    return by_key.unionByName(by_name).groupBy(*students.columns).agg(F.min("pos").alias("pos"))


def search(students: DataFrame, needle: str) -> DataFrame:
    """E5: a needle in name, number or any other spelling, whatever the case."""
    n = F.lower(F.lit(needle))
    hit = F.contains(F.lower("name"), n) | F.contains(F.lower(F.col("student").cast("string")), n)
    if "all_names" in students.columns:
        hit = hit | F.exists("all_names", lambda x: F.contains(F.lower(x), n))
    return students.where(hit)


def visible_mean(results: DataFrame, subjects: Sequence[str]) -> DataFrame:
    """The plain mean of rounded finals over the visible subjects, failing ones included."""
    return results.where(F.col("subject").isin(list(subjects))).groupBy("student").agg(F.round(F.avg("final"), 2).alias("mean"), F.count("final").alias("n"))


def pinned_order(students: DataFrame, pinned: DataFrame, k: int) -> DataFrame:
    """H3, I4: the first k students: pinned ones by position, then by name. A top-k, not a global sort."""
    out = students.join(pinned, "student", "left")
    return out.orderBy(F.col("pos").asc_nulls_last(), sort_key("name"), "student").limit(k)


def subject_order(curriculum: DataFrame) -> DataFrame:
    """Subjects by year, semester and name, unknown ones last: with place. A row for each subject, so one window."""
    w = Window.orderBy(F.col("year").asc_nulls_last(), F.col("semester").asc_nulls_last(), sort_key("subject"), "subject")
    return curriculum.withColumn("place", F.row_number().over(w).cast("bigint"))


def subject_groups(curriculum: DataFrame) -> DataFrame:
    """H4: runs of subjects of one year and semester in that order: gaps and islands over the subjects."""
    o = subject_order(curriculum)
    w = Window.orderBy("place")
    changed = ~(F.lag("year").over(w).eqNullSafe(F.col("year")) & F.lag("semester").over(w).eqNullSafe(F.col("semester"))) | (F.col("place") == 1)
    o = o.withColumn("starts", changed.cast("int")).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return o.groupBy("run").agg(F.first("year").alias("year"), F.first("semester").alias("semester"), F.count(F.lit(1)).alias("subjects"), F.min("place").alias("first_place"))


def sheet_name(name: Column, limit: int = 31) -> Column:
    """A sheet's name without what is forbidden, of limited length."""
    return F.substring(F.regexp_replace(F.trim(name), r"[\[\]:*?/\\]", "-"), 1, limit)
