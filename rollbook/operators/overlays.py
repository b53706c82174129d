"""Decisions of users laid over what was inferred, without changing it: every overlay is a table, and may be taken back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import vocabulary as V
from rollbook.operators.inference import refresh_columns


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """K3: keys, value: new rows replace old ones of the same keys, a new null deletes. Keys are unique on either side."""
    n = new.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_given"))
    both = old.select(*keys, value).join(n, list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(value)).alias(value)).where(F.col(value).isNotNull())


def forget(overlay: DataFrame, sources: DataFrame, column: str = "source_id") -> DataFrame:
    """K2: an overlay without what was said about removed sources."""
    return overlay.join(sources.select(column).distinct(), column, "left_anti")


def apply_overrides(columns: DataFrame, cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """columns with what a user fixed about them, then routes and finals again.

    overrides: (source_id, col, role, kind, season, scale), null where nothing was said; the season '' takes one away.
    """
    o = overrides.select("source_id", "col", *[F.col(c).alias(f"_{c}") for c in ("role", "kind", "season", "scale")], F.lit(True).alias("_set"))
    out = columns.join(o, ["source_id", "col"], "left")
    touched = F.coalesce("_set", F.lit(False))
    season = F.when(F.col("_season") == "", None).otherwise(F.coalesce("_season", "season"))
    out = out.withColumns(
        {
            "role": F.coalesce("_role", "role"), "kind": F.coalesce("_kind", "kind"), "season": season, "scale": F.coalesce("_scale", "scale"), "locked": touched | F.col("locked"),
            "confidence": F.when(touched, 1.0).otherwise(F.col("confidence")), "reason": F.when(touched, "reason.user_defined").otherwise(F.col("reason")),
        }
    )
    return refresh_columns(out.select(*columns.columns), cells)


def apply_answers(columns: DataFrame, cells: DataFrame, answers: DataFrame) -> DataFrame:
    """columns after answers (source_id, question, arg, value) to season, moment, final and scale questions.

    A season answer fixes finals without one (`component` makes them components); a moment answer sets season and route of
    the columns of that moment without fixing them; a final answer makes one column the season's final grade; a scale
    answer sets a column's scale. Answers without a value change nothing.
    """
    said = answers.where("coalesce(value, '') <> ''")
    pick = lambda q, *c: said.where(F.col("question") == q).select("source_id", *c)
    season = pick("epoca", F.col("value").alias("_season"))
    moment = pick("moment", F.col("arg").try_cast("int").alias("moment"), F.col("value").alias("_moment"))
    final = pick("final", F.col("value").try_cast("int").alias("_final"))
    scale = pick("scale", F.col("arg").try_cast("int").alias("col"), F.col("value").try_cast("double").alias("_scale"))
    out = columns.join(season, "source_id", "left").join(moment, ["source_id", "moment"], "left").join(scale, ["source_id", "col"], "left")
    chosen = columns.join(final, (columns["source_id"] == final["source_id"]) & (columns["col"] == final["_final"])).select(columns["source_id"], F.col("_final"), F.col("season").alias("_of"))
    out = out.join(chosen, "source_id", "left")
    open_final = (F.col("role") == "grade") & (F.col("kind") == "final") & F.col("season").isNull() & F.col("_season").isNotNull()
    is_chosen = F.coalesce(F.col("col") == F.col("_final"), F.lit(False))
    rival = (F.col("role") == "grade") & F.col("_final").isNotNull() & F.col("season").eqNullSafe(F.col("_of")) & ~is_chosen
    by_moment = F.col("_moment").isNotNull() & (F.col("role") == "grade")
    kind = F.when(is_chosen, "final").when(rival | (open_final & (F.col("_season") == "component")), "component").otherwise(F.col("kind"))
    new_season = F.when(open_final & (F.col("_season") != "component"), F.col("_season")).when(by_moment, F.col("_moment")).otherwise(F.col("season"))
    route = F.when(by_moment, F.when(F.col("_moment").isin(V.SEASONS[1:]), "exame").otherwise("continua")).otherwise(F.col("route"))
    sure = is_chosen | open_final
    out = out.withColumns(
        {
            "_k": kind, "_s": new_season, "_r": route, "_l": F.col("locked") | sure | rival, "_c": F.when(sure | by_moment, 1.0).otherwise(F.col("confidence")),
            "_o": F.when(is_chosen, "grade").otherwise(F.col("role")), "_x": F.coalesce("_scale", "scale"),
        }
    )
    out = out.withColumns({"kind": F.col("_k"), "season": F.col("_s"), "route": F.col("_r"), "locked": F.col("_l"), "confidence": F.col("_c"), "role": F.col("_o"), "scale": F.col("_x")})
    return refresh_columns(out.select(*columns.columns), cells)


def merge_questions(sheets: DataFrame) -> DataFrame:
    """One question for each group of sheets whose names differ and which nobody confirmed; sheets (source_id, group_key,
    canonical, names, confirmed). The default is the name that the group has now."""
    groups = sheets.where("size(names) > 1 and not confirmed").groupBy("group_key").agg(F.min("source_id").alias("source_id"), F.min("canonical").alias("default"))
    return groups.select(F.concat(F.lit("merge:"), F.col("group_key")).alias("id"), F.lit("merge").alias("type"), "source_id", F.lit("info").alias("severity"), "default")


def questions(sources: DataFrame, columns: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Id, type, source_id, severity, default: what is still undecided; answered ids are left out.

    sources: (source_id, subject, subject_confidence). Six projections in one list.
    """
    grades = columns.where("role = 'grade'")
    counts = grades.groupBy("source_id").agg(F.count(F.lit(1)).alias("grades"), F.count_if(F.col("kind") == "final").alias("finals"), F.max("col").alias("last"))
    one = lambda df, kind, key, default, severity: df.select(key.alias("id"), F.lit(kind).alias("type"), "source_id", severity.alias("severity"), default.cast("string").alias("default"))
    info, warning = F.lit("info"), F.lit("warning")
    sid = F.col("source_id").cast("string")
    final = grades.where("kind = 'final'").join(counts.select("source_id", "grades"), "source_id")
    parts = [
        one(sources.where("subject is null or subject_confidence < 0.6"), "subject", F.concat(sid, F.lit(":subject")), F.col("subject"), F.when(F.col("subject").isNull(), "warning").otherwise("info")),
        one(counts.where("finals = 0"), "final_column", F.concat(sid, F.lit(":final")), F.col("last"), warning),
        one(final.where("confidence < 0.6 and grades > 1"), "final_column", F.concat(sid, F.lit(":final:"), F.coalesce("season", F.lit("na"))), F.col("col"), info),
        one(final.where("moment > 1").groupBy("source_id", "moment").agg(F.min_by("season", "col").alias("season")), "moment", F.concat(sid, F.lit(":moment:"), F.col("moment").cast("string")), F.coalesce("season", F.lit(V.SEASONS[0])), warning),
        one(final.where("season is null").select("source_id").distinct(), "epoca", F.concat(sid, F.lit(":epoca")), F.lit(V.SEASONS[0]), warning),
        one(final.where("max_value <= 10 and scale = 20"), "scale", F.concat(sid, F.lit(":scale:"), F.col("col").cast("string")), F.lit("20"), info),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(answered.select("id"), "id", "left_anti") if answered is not None else out
