"""From grade entries to one result for each student and subject.

An entry has: student, subject, season_ord (0 to 2), source, file_order, document_date, value, status, and `order_cols`,
which say which of two equal entries comes first. Every operator is one shuffle on (student, subject, ...) at most, and
later ones reuse its partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.grades import approved, is_empty, rank_of, round_grade

#: Common subjects that go to a student together.
PLAN_BLOCK = 5000
#: Subjects are broadcast up to so many.
BROADCAST_ROWS = 100_000
GROUP = ("student", "subject", "season_ord")


def ranked(entries: DataFrame) -> DataFrame:
    """C14: with tier and score."""
    r = rank_of(F.col("value"), F.col("status"))
    return entries.withColumns({"tier": r["tier"], "score": r["score"]})


def dealt(entries: DataFrame) -> DataFrame:
    """Entries dealt by student and subject, which every later window and aggregate over more keys can use as it is. To be
    done before cells are parsed: what is shuffled is then the least."""
    return entries.repartition("student", "subject")


def best_per_source(entries: DataFrame, order_cols: Sequence[str], are_dealt: bool = False) -> DataFrame:
    """With pick, 1 for the best entry of each source, the first of equals. Entries are dealt unless they are already."""
    w = Window.partitionBy(*GROUP, "source").orderBy(F.desc("tier"), F.desc("score"), *order_cols)
    return ranked(entries if are_dealt else dealt(entries)).withColumn("pick", F.row_number().over(w))


def version_rank(picked: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """H1, H2: with version (1 is the one that counts), by_date and reason, over the best entries of all sources.

    If all versions of a group have a date the newest wins, then the later file; else the later file, then the date.
    """
    g = Window.partitionBy(*GROUP)
    out = picked.withColumn("by_date", F.bool_and(F.coalesce(F.col("document_date"), F.lit("")) != "").over(g))
    date = F.coalesce("document_date", F.lit(""))
    first, second = F.when(F.col("by_date"), date).otherwise(""), F.when(F.col("by_date"), "").otherwise(date)
    w = g.orderBy(first.desc(), F.desc("file_order"), second.desc(), *order_cols)
    reason = F.when(F.col("by_date"), "reason.newest_document").otherwise("reason.latest_file")
    return out.withColumns({"version": F.row_number().over(w).cast("bigint"), "reason": reason})


def season_results(entries: DataFrame, order_cols: Sequence[str], are_dealt: bool = False) -> DataFrame:
    """The entry that counts for each student, subject and season."""
    return version_rank(best_per_source(entries, order_cols, are_dealt).where("pick = 1"), order_cols).where("version = 1")


def version_conflicts(entries: DataFrame, order_cols: Sequence[str], are_dealt: bool = False) -> DataFrame:
    """Groups whose sources do not agree: versions and distinct (value, status)."""
    picked = best_per_source(entries, order_cols, are_dealt).where("pick = 1")
    return picked.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("versions"), F.countDistinct(F.struct("value", "status")).alias("distinct_grades")).where("distinct_grades > 1")


def repeated_rows(entries: DataFrame, column: str) -> DataFrame:
    """Several grades in one column of one source for one student."""
    return entries.groupBy(*GROUP, "source", column).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct("value", "status")).alias("distinct_grades")).where("distinct_grades > 1")


def other_versions(entries: DataFrame, order_cols: Sequence[str], are_dealt: bool = False) -> DataFrame:
    """Entries that lost, with the reason: `route` within their source, `version` between sources; empty ones left out."""
    picked = best_per_source(entries, order_cols, are_dealt)
    routes = picked.where("pick > 1").withColumns({"lost_as": F.lit("route"), "reason": F.lit(None).cast("string")})
    versions = version_rank(picked.where("pick = 1"), order_cols).where("version > 1").withColumn("lost_as", F.lit("version"))
    both = routes.unionByName(versions.select(*routes.columns))
    return both.where(~is_empty(F.col("value"), F.col("status")))


def best_season(results: DataFrame) -> DataFrame:
    """The best season of each student and subject, the earliest of equals; subjects with empty results only have none.

    results: one row for each student, subject and season with tier, score, value, status.
    """
    full = ~is_empty(F.col("value"), F.col("status"))
    order = F.struct("tier", "score", -F.col("season_ord"))
    best = F.max_by(F.struct("season_ord", "value", "status"), F.when(full, order)).alias("b")
    return results.groupBy("student", "subject").agg(best).select("student", "subject", F.col("b.season_ord").alias("best_season"), F.col("b.value").alias("value"), F.col("b.status").alias("status"))


def with_marks(best: DataFrame, pass_marks: DataFrame, default: float) -> DataFrame:
    """With pass_mark, final (the rounded value) and approved. pass_marks: (subject, pass_mark), one per subject."""
    out = best.join(pass_marks.select("subject", "pass_mark"), "subject", "left").withColumn("pass_mark", F.coalesce("pass_mark", F.lit(float(default))))
    return out.withColumns({"final": round_grade(F.col("value")), "approved": approved(F.col("value"), F.col("status"), F.col("pass_mark"))})


def apply_edits(best: DataFrame, edits: DataFrame) -> DataFrame:
    """typed grades (student, subject, edit) laid over the computed ones; what was computed stays as original_*.

    An edit may create a subject. Other columns of best come through.
    """
    out = best.join(edits.select("student", "subject", "edit"), ["student", "subject"], "full_outer")
    edited = F.col("edit").isNotNull()
    return out.withColumns(
        {
            "original_value": F.when(edited, F.col("value")), "original_status": F.when(edited, F.col("status")), "edited": edited,
            "value": F.coalesce("edit", "value"), "status": F.when(~edited, F.col("status")),
        }
    ).drop("edit")


def seen_subjects(listed: DataFrame, best: DataFrame) -> DataFrame:
    """F8: distinct (student, subject) of the sheets that list a student, and of the results."""
    return listed.select("student", "subject").unionByName(best.select("student", "subject")).distinct()


# ---------------------------------------------------------------- averages, coverage and counts


def _mean(value: Column, credits: Column) -> tuple[Column, Column]:
    """(mean, weighted): weighted by credits if every one has some, else plain."""
    weighted = F.count_if(F.coalesce(credits, F.lit(0)) == 0) == 0
    by_credit = F.try_divide(F.sum(value * credits).cast("double"), F.sum(credits).cast("double"))
    return F.round(F.when(weighted, by_credit).otherwise(F.avg(value)), 2), weighted


def student_averages(results: DataFrame, curriculum: DataFrame) -> DataFrame:
    """Student, level (semester, year, final), year, semester, mean, count, weighted, rounded.

    Counts approved subjects with a number. A subject without year or semester is in the final mean only. curriculum:
    (subject, year, semester, ects), one row per subject. One pass of grouping sets.
    """
    rows = results.where("approved and final is not null").join(curriculum, "subject", "left").select("student", "final", "ects", "year", "semester")
    rows = rows.withColumn("placed", F.expr("year is not null and semester is not null"))
    # the final mean takes every row, the others only placed ones: unplaced rows stand under a null year that is dropped
    rows = rows.withColumns({"y": F.when(F.col("placed"), F.col("year")), "s": F.when(F.col("placed"), F.col("semester"))})
    mean, weighted = _mean(F.col("final"), F.col("ects"))
    sets = rows.groupingSets([["student", "y", "s"], ["student", "y"], ["student"]], "student", "y", "s")
    out = sets.agg(F.grouping_id().alias("gid"), mean.alias("mean"), F.count(F.lit(1)).alias("count"), weighted.alias("weighted"))
    out = out.where("gid = 3 or y is not null")
    level = F.when(F.col("gid") == 0, "semester").when(F.col("gid") == 1, "year").otherwise("final")
    return out.select("student", level.alias("level"), F.col("y").alias("year"), F.col("s").alias("semester"), "mean", "count", "weighted", round_grade(F.col("mean")).alias("rounded"))


def missing_curriculum(results: DataFrame, curriculum: DataFrame) -> DataFrame:
    """Approved subjects with a number whose year or semester is not known."""
    rows = results.where("approved and final is not null").join(curriculum, "subject", "left")
    return rows.where("year is null or semester is null").select("student", "subject")


def plan_coverage(results: DataFrame, known: DataFrame) -> DataFrame:
    """student, course, n_courses, have, total: how much of a student's plan has a result.

    known: (subject, course or null). The plan is the common subjects and those of the student's courses; only the common
    ones for a student of unknown course if any subject names one. Counted without listing plans: sums over subjects by
    course, and the student's own, are enough.
    """
    # one look at the subjects before the plan is made: how many there are, and how many are everybody's
    n_known, everywhere = known.agg(F.count(F.lit(1)), F.count_if(F.col("course").isNull())).first()
    # each subject brings the size of its course along, so that one aggregate by student has all
    sized = known.join(known.where("course is not null").groupBy("course").agg(F.count(F.lit(1)).alias("size")), "course", "left").withColumn("known", F.lit(True))
    own = results.select("student", "subject").distinct().join(F.broadcast(sized) if n_known <= BROADCAST_ROWS else sized, "subject", "left")
    of = own.groupBy("student").agg(F.collect_set(F.when(F.col("course").isNotNull(), F.struct("course", "size"))).alias("courses"), F.count("known").alias("have"))
    n = F.size("courses")
    total = F.lit(everywhere) + F.aggregate("courses", F.lit(0).cast("bigint"), lambda s, c: s + c["size"])
    return of.select("student", F.when(n == 1, F.get("courses", F.lit(0))["course"]).alias("course"), n.cast("bigint").alias("n_courses"), "have", total.alias("total"))


def plan_missing(results: DataFrame, known: DataFrame) -> DataFrame:
    """(student, subject) of the plan without a result: a left anti join of plan and results."""
    students = results.select("student").distinct()
    own = results.select("student", "subject").distinct()
    mine = own.join(known.where("course is not null"), "subject").select("student", "course").distinct()
    plan = mine.join(known.where("course is not null"), "course").select("student", "subject")
    # common subjects are every student's: blocks of them meet every student by their numbers
    numbered = known.where("course is null").select("subject", F.pmod(F.xxhash64("subject"), F.lit(1 << 30)).alias("h"))
    blocks = numbered.agg((F.count(F.lit(1)) / PLAN_BLOCK).cast("int") + 1).first()[0]
    lists = numbered.groupBy((F.col("h") % blocks).alias("block")).agg(F.collect_list("subject").alias("of"))
    common = students.select("student", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block")).join(lists, "block").select("student", F.explode("of").alias("subject"))
    return plan.unionByName(common).join(own, ["student", "subject"], "left_anti")


def subject_stats(subjects: DataFrame, results: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Subject, students, approved, failed, pending, average, pass_rate; listed students without a result are pending."""
    of = results.groupBy("subject").agg(
        F.count_if(F.col("approved")).alias("approved"), F.count_if(~F.col("approved")).alias("failed"), F.count_if(F.col("approved").isNull()).alias("undecided"),
        F.round(F.avg("final"), 2).alias("average"),
    )
    out = subjects.select("subject").join(of, "subject", "left")
    if seen is not None:
        idle = seen.join(results.select("student", "subject"), ["student", "subject"], "left_anti").groupBy("subject").agg(F.count(F.lit(1)).alias("idle"))
        out = out.join(idle, "subject", "left")
    else:
        out = out.withColumn("idle", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = out.select("subject", zero("approved").alias("approved"), zero("failed").alias("failed"), (zero("undecided") + zero("idle")).alias("pending"), "average")
    rate = F.round(F.try_divide("approved", F.col("approved") + F.col("failed")), 3)
    return out.select("subject", F.expr("approved + failed + pending").alias("students"), "approved", "failed", "pending", "average", rate.alias("pass_rate"))


def global_stats(results: DataFrame) -> DataFrame:
    """One row over all students and subjects."""
    return results.agg(
        F.countDistinct("student").alias("students"), F.countDistinct("subject").alias("subjects"), F.count_if(F.col("approved")).alias("approved"),
        F.count_if(~F.col("approved")).alias("failed"), F.count_if(F.col("approved").isNull()).alias("pending"), F.round(F.avg("final"), 2).alias("average"),
    )
