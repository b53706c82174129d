"""Grades: struct (value, status, raw, scale), read, ranked, rescaled, rounded and written as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import vocabulary as V
from rollbook.functions.numbers import number_of, parse_number, plain_number
from rollbook.functions.text import clean_text, norm_text

GRADE = "struct<value:double,status:string,raw:string,scale:double>"
PASS_MARK, SCALE = 9.5, 20.0


def _grade(value: Column, status: Column, raw: Column, scale: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), status.cast("string").alias("status"), raw.alias("raw"), scale.cast("double").alias("scale"))


def _read(raw: Column, number: Column, key: Column, compact: Column, scale: Column) -> Column:
    null, words = F.lit(None), F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in V.STATUS_WORDS.items()))
    status = F.coalesce(F.try_element_at(words, compact), F.try_element_at(words, F.replace(compact, F.lit(" "), F.lit(""))))
    order = F.array(*map(F.lit, V.STATUSES))
    ranks = F.transform(F.filter(F.split(compact, " "), lambda w: w != ""), lambda w: F.array_position(order, F.try_element_at(words, w)))
    best = F.when(F.size(ranks).between(2, 3) & F.forall(ranks, lambda r: r.isNotNull() & (r > 0)), F.try_element_at(order, F.array_min(ranks).cast("int")))
    inner = F.regexp_extract(raw, r"([0-9]+(?:[.,][0-9]+)?)", 1)
    beside = F.get(F.filter(F.array(*map(F.lit, V.STATUS_WORDS)), lambda w: F.startswith(compact, F.concat(w, F.lit(" "))) | F.endswith(compact, F.concat(F.lit(" "), w))), F.lit(0))
    found = F.when(number.isNotNull(), _grade(number, null, raw, scale))
    found = found.when(key.isin(V.EMPTY_WORDS), _grade(null, F.lit(V.NO_GRADE), raw, scale))
    found = found.when(status.isNotNull(), _grade(null, status, raw, scale)).when(best.isNotNull(), _grade(null, best, raw, scale))
    value = F.translate(inner, ",", ".").try_cast("double")
    return found.when((inner != "") & (F.length(raw) <= 24), _grade(value, F.try_element_at(words, beside), raw, scale)).otherwise(_grade(null, F.lit(V.NO_GRADE), raw, scale))


def parse_grade(c: Column | str, scale: Column | float = SCALE) -> Column:
    """A number; else an empty cell; else a status; else statuses, of which the best counts; else a number beside text."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    key = norm_text(c)
    return _read(clean_text(c), parse_number(c), key, F.trim(F.regexp_replace(key, "[^a-z0-9]+", " ")), scale)


def with_grade(df: DataFrame, text: str, scale: Column | float = SCALE, name: str = "grade") -> DataFrame:
    """C13 as a column of df, in steps: what several rules look at is computed once for each row.

    Most cells are plain decimals: these are told before anything is cleaned, and are clean already.
    """
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    df = df.withColumns({"_plain": plain_number(text), "_scale": scale})
    df = df.withColumn("_raw", F.when(F.col("_plain").isNull(), clean_text(text)).otherwise(F.col(text)))
    df = df.withColumn("_number", F.when(F.col("_plain").isNull(), number_of(F.col("_raw"))).otherwise(F.col("_plain")))
    df = df.withColumn("_key", F.when(F.col("_number").isNull(), norm_text("_raw")))  # most cells are numbers
    df = df.withColumn("_compact", F.trim(F.regexp_replace("_key", "[^a-z0-9]+", " ")))
    return df.withColumn(name, _read(F.col("_raw"), F.col("_number"), F.col("_key"), F.col("_compact"), F.col("_scale"))).drop("_plain", "_raw", "_number", "_key", "_compact", "_scale")


def rank_of(value: Column, status: Column) -> Column:
    """C14: struct (tier, score) that orders grades: numbers, then statuses, then nothing."""
    at = F.array_position(F.array(*map(F.lit, V.STATUSES)), status)
    tier = F.when(value.isNotNull(), 2).when(at > 0, 1).otherwise(0)
    score = F.when(value.isNotNull(), value).when(at > 0, F.lit(len(V.STATUSES) + 1) - at).otherwise(0.0)
    return F.struct(tier.alias("tier"), score.cast("double").alias("score"))


def is_empty(value: Column, status: Column) -> Column:
    """C15"""
    return value.isNull() & (status.isNull() | (status == V.NO_GRADE))


def round_grade(value: Column) -> Column:
    """C17: halves go up."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def to_scale(value: Column, scale: Column, target: float = SCALE) -> Column:
    """The value on the scale of work."""
    same = F.coalesce(scale, F.lit(0.0)) == 0
    return F.when(same | (F.abs(scale - target) < 1e-9), value).otherwise(F.try_divide(value * F.lit(float(target)), scale))


def rescale(grade: Column, target: float = SCALE) -> Column:
    """A grade on the scale of work, with a note of what was written."""
    v = to_scale(grade["value"], grade["scale"], target)
    kept = v.isNull() | (F.abs(v - F.coalesce(grade["value"], F.lit(0.0))) < 1e-9)
    short = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    note = F.concat(grade["raw"], F.lit(" (de "), short(grade["value"]), F.lit(" em 0-"), short(grade["scale"]), F.lit(")"))
    return F.when(kept, grade).otherwise(_grade(F.round(v, 4), grade["status"], note, F.lit(float(target))))


def format_grade(value: Column) -> Column:
    """Whole numbers bare, others with up to two decimals and a comma."""
    text = F.translate(F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", ""), ".", ",")
    return F.when(value.isNull(), "—").when(F.abs(value - F.rint(value)) < 1e-9, F.rint(value).cast("bigint").cast("string")).otherwise(text)


def approved(value20: Column, status: Column, pass_mark: Column) -> Column:
    """By the rounded number if there is one; else by status; else unknown."""
    return F.when(value20.isNotNull(), round_grade(value20) >= pass_mark - 1e-9).when(status == V.STATUSES[0], True).when(status.isin(V.FAILING), False)


def guess_scale(top: Column) -> Column:
    """C22"""
    return F.when(top > 100, top).when(top > 20, 100.0).otherwise(20.0)
