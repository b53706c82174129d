"""Mixing sources to target weights, with DataFrame functions alone.

Sizes are summed by source; a source's target is its weighted share of the whole, held to a multiple of what it has, with
what that leaves over shared again by weight. A source's rate is its target over its size; a document is taken
floor(rate) times, and once more if a draw from its hash lies below the fraction.

Sources may be as many as hosts: they are ranked by a sort over all partitions and prefix sums of partition counts, and
each round of sharing is one aggregate. Documents meet their source's rate where they lie if the source holds over 1/HOT
of the rows (fewer than HOT sources can), so the largest sources are never gathered; all others take a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import read
from rollbook.session import table_of

#: Weights of the sources in order of their names, repeating; the share of all words that the mix has; the most that a
#: source is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = 11
#: Sources that hold over 1/HOT of the rows are broadcast: there are fewer than HOT.
HOT = 512
WORD = r"[^\x20\x09-\x0D]+"


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """(_id, _source, size, draw) and more of each row; draws are even over [0, 1)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).alias("draw"),
        *more,
    )


def ranked(names: DataFrame, column: str) -> DataFrame:
    """names with _rank from 0 in order of column, null last; no partition but the prefix sums' (a row for each) is alone."""
    ordered = table_of(names.orderBy(F.asc_nulls_last(column)).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # a row for each partition of the sort
    joined = ordered.withColumn("_part", part).join(F.broadcast(base), "_part")
    return joined.withColumn("_rank", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_at")


def source_targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_source, documents, source_size, weight, target, rate) of the sources of rows (_source, size)."""
    sources = table_of(rows.groupBy("_source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size")), "sources")
    place = (F.col("_rank") % len(weights) + 1).cast("int")
    known = ranked(sources, "_source").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).drop("_rank")
    known = table_of(known.withColumn("_cap", F.lit(most) * F.col("source_size")), "weighted")

    budget = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # a source that is full stays so, as the level of the others rises with each that is
        is_full = F.col("_cap") <= F.lit(level) * F.col("weight")
        n, held, open_weight = known.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))).first()
        if n <= full or not open_weight:
            break
        full, level = n, (budget - held) / open_weight
    level = float("inf") if full < 0 or not open_weight else level
    target = F.least("_cap", F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return known.withColumn("target", target).withColumn("rate", rate).drop("_cap")


def _copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with documents, source_size, weight, target, rate of their source, and copies."""
    targets = table_of(targets.withColumnRenamed("_source", "_of"), "targets")
    n = targets.agg(F.sum("documents")).first()[0] or 0
    hot = F.broadcast(targets.where(F.col("documents") * HOT > n).limit(HOT))
    same = F.col("_source").eqNullSafe(F.col("_of"))
    settled = rows.join(hot, same)
    rest = rows.join(hot.select("_of"), same, "left_anti").join(targets.hint("merge"), same)
    whole = F.floor("rate")
    return settled.unionByName(rest).withColumn("copies", whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, size, source_size, target, copies, taken (words that the mix has of it).

    Sources take the weights in order of their names by code point, a null source last, and share `share` of all words; none
    has more than `most` times its own. A null text has no words; a source without words has target and copies 0. A very
    long text is a document like any other and comes whole. Draws hang on seed, id and text alone: reruns agree, and rows
    repeated with id and text are drawn alike. A null id is drawn as an empty one. Other columns are ignored, whatever their
    names; an empty table gives an empty one.
    """
    rows = table_of(_rows(docs, id_col, text_col, source_col, seed), "mix-sizes")
    done = _copies(rows, source_targets(rows, weights, share, most))
    return done.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: the rows of docs, each as often as `mix_plan` says, with their own columns. Texts are read twice, not kept."""
    rows = _rows(docs, id_col, text_col, source_col, seed, F.struct(*docs.columns).alias("_doc"))
    done = _copies(rows, source_targets(rows.select("_source", "size"), weights, share, most))
    return done.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_doc.*")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', '11', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM w
), l AS (
  SELECT max((b.budget - b.held) / b.open) AS level FROM (
    SELECT 1.5::DOUBLE * sum(source_size) OVER () AS budget,
      coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
      sum(weight) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM c) b
), t AS (
  SELECT source, source_size, least(cap, level * weight) AS target,
    CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0 END AS rate
  FROM c, l
), m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT *, copies * size AS taken FROM m
"""

QUERIES = {"op11_mixing": op11_mixing}
ORACLES = {"op11_mixing": ORACLE}
