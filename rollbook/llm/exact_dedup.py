"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries, one per partition, name the digests that may be frequent; an exact partial count verifies which of
them hold over 1/counters of the rows. These winners (fewer than `counters`, whatever the input) are broadcast, so that rows of the largest groups
are settled where they lie and never meet in one task. All other digests take an ordinary shuffle, in which no group
can hold more than about 1/counters of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import ascii_lower, free_name, read
from rollbook.session import table_of

#: Counters of a Misra-Gries summary, and the bound on the rows broadcast.
COUNTERS = 512


class MisraGries:
    """Every key with more than n / (k + 1) of n added rows is among `counts` afterwards."""

    def __init__(self, k: int):
        self.k, self.counts = k, {}

    def add(self, key, n: int = 1) -> None:
        c = self.counts
        if key in c:
            c[key] += n
            return
        c[key] = n
        if len(c) > self.k:
            low = min(c.values())
            self.counts = {x: v - low for x, v in c.items() if v > low}


def frequent_candidates(digests: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """(digest, at_least) from the summaries of all partitions: at most k rows, all that hold over 2/k of the rows."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg = MisraGries(k)
        for b in batches:
            vc = b.column(0).value_counts()
            for key, n in zip(vc.field(0).to_pylist(), vc.field(1).to_pylist(), strict=True):
                mg.add(key, n)
        if mg.counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(mg.counts), pa.binary()), pa.array(list(mg.counts.values()), pa.int64())],
                names=["digest", "n"],
            )

    part = digests.select(F.col(column).alias("digest")).mapInArrow(summary, "digest binary, n long")
    return part.groupBy("digest").agg(F.sum("n").alias("at_least")).orderBy(F.desc("at_least"), "digest").limit(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id stays; of
    repeated rows with that id exactly one stays, and a null id is less than any other. A very long text is digested whole.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty one.
    """
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    digests = docs.select(F.col(id_col).alias("_id"), F.unhex(sha).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    digests = table_of(digests, "digests")

    candidates = frequent_candidates(digests, "_sha", counters).select(F.col("digest").alias("_sha"))
    best = F.max(F.struct(F.col("_id"), F.col("_row"))).alias("_best")
    size = F.count(F.lit(1)).alias("group_size")
    # limit() bounds the candidates at `counters` rows, and so the winners: both broadcasts have a proven size
    counted = digests.join(F.broadcast(candidates), "_sha", "left_semi").groupBy("_sha").agg(best, size)
    heavy = table_of(counted.where(F.col("group_size") * counters > digests.count()), "heavy").withColumn("_heavy", F.lit(True))

    marked = digests.join(F.broadcast(heavy), "_sha", "left")
    settled = marked.where(F.col("_heavy")).select("_id", "_sha", "_row", "_best", "group_size")
    rest = digests.join(F.broadcast(heavy.select("_sha")), "_sha", "left_anti")
    w = Window.partitionBy("_sha")
    rest = rest.select("_id", "_sha", "_row", F.max(F.struct("_id", "_row")).over(w).alias("_best"), F.count(F.lit(1)).over(w).alias("group_size"))
    return settled.unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_best._id").alias("keep_id"),
        "group_size",
        (F.col("_best._row") == F.col("_row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id, with its own columns, whatever their names.

    Of rows repeated with id and text one stays; a null id is less than any other. A null text counts as empty; a very
    long one is digested whole; an empty table gives an empty one.
    """
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kid"), F.col("text_sha256").alias("_ksha"))
    # the digest is computed again where the row lies; ids grow with the documents and are not broadcast; (id, digest) meets its kept row, and its repetitions
    sha = free_name("_sha", docs.columns)
    rows = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    rows = rows.join(stay.hint("merge"), rows["doc_id"].eqNullSafe(stay["_kid"]) & (rows[sha] == stay["_ksha"]), "left_semi")
    return rows.dropDuplicates(["doc_id", sha]).select(*docs.columns)


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{_UP}', '{_LOW}')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from d"""
}
