"""Who is who: rows of one person, their best name and number, and the subject that a sheet belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.text import name_tokens
from rollbook.operators.components import connected_components
from rollbook.session import table_of


def _star(records: DataFrame, key: str) -> DataFrame:
    """A link from each row to the first of its key; the minimum is a partial aggregate, so a common key stays cheap."""
    first = records.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("row_id").alias("b"))
    return records.join(first, key).select(F.col("row_id").alias("a"), "b")


def cluster_records(records: DataFrame, merge_by_name: bool = True) -> DataFrame:
    """records (row_id, student_id, name_key, ...) with cluster, the least row_id of the same person.

    Rows are linked by equal numbers, and by equal names if merge_by_name. Rows without both stand alone; row_id is unique.
    """
    edges = _star(records, "student_id")
    if merge_by_name:
        edges = edges.unionByName(_star(records, "name_key"))
    found = connected_components(edges)
    return records.join(found.withColumnsRenamed({"node": "row_id", "component": "cluster"}), "row_id", "left").withColumn("cluster", F.coalesce("cluster", "row_id"))


def recluster(kept: DataFrame, added: DataFrame, removed: DataFrame, merge_by_name: bool = True) -> DataFrame:
    """F1, K2: clusters after rows came and went, from those before: as `cluster_records` over all rows that are left.

    kept: records with cluster, as they were; added: new records of the same columns without cluster; removed: (row_id). Only
    clusters that lose a row are solved again. A new row joins what has its number or name: a row of each such cluster stands
    for all, and what new rows connect are clusters, so the work grows with the change and not with the table. A row that
    changed is removed and added.
    """
    keys = ["student_id"] + ["name_key"] * merge_by_name
    gone = removed.select("row_id").distinct()
    torn = kept.join(gone, "row_id", "left_semi").select("cluster").distinct()
    left = kept.join(torn, "cluster", "left_semi").join(gone, "row_id", "left_anti").drop("cluster")
    columns = added.columns
    again = cluster_records(left, merge_by_name).select(*columns, "cluster")
    known = table_of(kept.join(torn, "cluster", "left_anti").select(*columns, "cluster").unionByName(again), "known")
    links = None
    for key in keys:
        new = added.where(F.col(key).isNotNull() & (F.col(key) != ""))
        first = new.groupBy(key).agg(F.min("row_id").alias("least"))
        # rows of one number, or one name, are of one cluster already
        held = known.join(first.select(key), key, "left_semi").groupBy(key).agg(F.min("cluster").alias("held"))
        meets = first.join(held, key, "left")
        own = new.select(key, "row_id").join(meets, key).select(F.col("row_id").alias("a"), F.coalesce("held", "least").alias("b"))
        links = own if links is None else links.unionByName(own)
    found = table_of(connected_components(links), "joined")
    moved = known.join(found.withColumnsRenamed({"node": "cluster", "component": "_to"}), "cluster", "left").withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to")
    fresh = added.join(found.withColumnsRenamed({"node": "row_id", "component": "cluster"}), "row_id", "left").withColumn("cluster", F.coalesce("cluster", "row_id"))
    return moved.select(*columns, "cluster").unionByName(fresh.select(*columns, "cluster"))


def best_names(records: DataFrame, key: str = "cluster") -> DataFrame:
    """G1: the name of most words, then the longest, then the first."""
    order = F.struct(F.size(name_tokens("name")), F.length("name"), -F.col("row_id"))
    return records.where("coalesce(name, '') <> ''").groupBy(key).agg(F.max_by("name", order).alias("best_name"))


def best_ids(records: DataFrame, key: str = "cluster") -> DataFrame:
    """The most frequent number, then the shortest, then the least."""
    counts = records.where("student_id is not null").groupBy(key, "student_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by("student_id", F.struct(-F.col("n"), F.length("student_id"), "student_id")).alias("best_id"))


def spellings(records: DataFrame, key: str = "cluster") -> DataFrame:
    """Distinct names and numbers of each person, in order."""
    one = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return records.groupBy(key).agg(one("student_id").alias("all_ids"), one("name").alias("all_names"))


def described(records: DataFrame, key: str = "cluster") -> DataFrame:
    """best_name, best_id, all_ids and all_names of each person, of one table of counted spellings.

    Rows are first brought down to the different (name, number) of a person, so that each name is looked at once.
    """
    seen = records.groupBy(key, "name", "student_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    named = F.coalesce("name", F.lit("")) != ""
    order = F.struct(F.size(name_tokens("name")), F.length("name"), -F.col("first"))
    seen = seen.withColumn("order", F.when(named, order))
    numbers = seen.where("student_id is not null").groupBy(key, "student_id").agg(F.sum("n").alias("n"))
    best_id = numbers.groupBy(key).agg(F.min_by("student_id", F.struct(-F.col("n"), F.length("student_id"), "student_id")).alias("best_id"))
    one = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    found = seen.groupBy(key).agg(F.max_by("name", "order").alias("best_name"), one("student_id").alias("all_ids"), one("name").alias("all_names"))
    return found.join(best_id, key, "left")


def identity_notices(spelled: DataFrame, key: str = "cluster") -> DataFrame:
    """(key, type, severity, detail): several numbers are a conflict, several spellings a remark."""
    ids = spelled.where(F.size("all_ids") > 1).select(key, F.lit("numero").alias("type"), F.lit("warning").alias("severity"), F.array_join("all_ids", ", ").alias("detail"))
    return ids.unionByName(spelled.where(F.size("all_names") > 1).select(key, F.lit("nome").alias("type"), F.lit("info").alias("severity"), F.array_join("all_names", "; ").alias("detail")))


def subject_group_key(code: Column, code_confidence: Column, name_key: Column, source: Column) -> Column:
    """by code where it is sure enough, else by name, else the sheet alone."""
    by_code = F.when((F.coalesce(code, F.lit("")) != "") & (code_confidence >= 0.5), F.concat(F.lit("codigo:"), code))
    return F.coalesce(by_code, F.when(F.coalesce(name_key, F.lit("")) != "", F.concat(F.lit("nome:"), name_key)), F.concat(F.lit("ficheiro:"), source))


SPLIT = "__split__"


def resolve_subjects(sheets: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Sheets (source_id, group_key, subject, label) with canonical, and names: the distinct names of the group.

    canonical is the alias of the group; else its longest name, then the first in order; a split group, and one without
    any name, keeps what each sheet says. aliases: (group_key, alias).
    """
    named = sheets.where("coalesce(subject, '') <> ''").groupBy("group_key").agg(
        F.min_by("subject", F.struct(-F.length("subject"), "subject")).alias("longest"), F.array_sort(F.collect_set("subject")).alias("names")
    )
    out = sheets.join(named, "group_key", "left")
    out = out.join(aliases, "group_key", "left") if aliases is not None else out.withColumn("alias", F.lit(None).cast("string"))
    own = F.coalesce(F.when(F.col("subject") != "", F.col("subject")), F.col("label"))
    canonical = F.when(F.col("alias") == SPLIT, own).otherwise(F.coalesce("alias", "longest", own))
    return out.select(*sheets.columns, canonical.alias("canonical"), F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.col("alias").isNotNull().alias("confirmed"))
