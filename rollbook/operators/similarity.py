"""Names that look alike: every pair that can pass shares a word, so pairs are found by an equi-join on words.

A word of very many names is not looked up alone: pairs that need two common words are found by pairs of words, of which
the rarer leads. Names of one word, and names whose words are a subset of another's, meet at their rarest word.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rollbook.functions.text import name_tokens, norm_name

THRESHOLD = 0.90
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789 "


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two keys, which no built-in function gives."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def letters(key: Column) -> Column:
    """How often each sign of a normalised name occurs in it."""
    return F.transform(F.split(F.lit(_SIGNS), ""), lambda x: F.length(key) - F.length(F.replace(key, x, F.lit(""))))


def ratio_bound(left: str, right: str) -> Column:
    """No sequence ratio is larger: matching blocks have at most the signs that both keys hold."""
    common = F.aggregate(F.zip_with(f"{left}_letters", f"{right}_letters", lambda x, y: F.least(x, y)), F.lit(0), lambda s, n: s + n)
    return common * 2 / (F.length(f"{left}_key") + F.length(f"{right}_key"))


def candidate_pairs(people: DataFrame) -> DataFrame:
    """(left, right, subset) with two common words, or one's words within the other's; people (person, tokens)."""
    words = people.select("person", F.explode(F.array_distinct("tokens")).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = words.join(counts, "word").groupBy("person").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    by_rarity = by_rarity.select("person", F.transform("w", lambda x: x["word"]).alias("w"))
    # two common words: pairs of a person's words, in order
    pair = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.concat(F.least(x, y), F.lit(" "), F.greatest(x, y)))))
    pairs = by_rarity.select("person", F.explode(pair).alias("k"))
    two = pairs.alias("a").join(pairs.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.person") < F.col("b.person"))).select(F.col("a.person").alias("left"), F.col("b.person").alias("right"))
    # one name of a single word within another: only these need a lone word
    lone = by_rarity.where("size(w) = 1").select(F.col("person").alias("p"), F.get("w", F.lit(0)).alias("word"))
    one = lone.join(words, "word").where("p <> person").select(F.least("p", "person").alias("left"), F.greatest("p", "person").alias("right"))
    return two.unionByName(one).distinct()


def similar_names(people: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left, right, left_name, right_name, similarity of different people whose names look alike.

    people: (person, name, ids). Kept: a ratio of threshold or more, or one's words within the other's unless both have
    numbers without a common one. Equal keys are left out: they are one person already.
    """
    p = people.select("person", "name", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), norm_name("name").alias("key"), name_tokens("name").alias("tokens")).where(F.size("tokens") > 0)
    p = p.withColumn("letters", letters(F.col("key")))
    pairs = candidate_pairs(p)
    left = p.select(*[F.col(c).alias(f"left_{c}") for c in p.columns])
    right = p.select(*[F.col(c).alias(f"right_{c}") for c in p.columns])
    both = pairs.join(left, F.col("left") == F.col("left_person")).join(right, F.col("right") == F.col("right_person")).where("left_key <> right_key")
    subset = (F.size(F.array_except("left_tokens", "right_tokens")) == 0) | (F.size(F.array_except("right_tokens", "left_tokens")) == 0)
    apart = (F.size("left_ids") > 0) & (F.size("right_ids") > 0) & ~F.arrays_overlap("left_ids", "right_ids")
    # what cannot pass is left out before any pair goes to Python
    both = both.withColumns({"subset": subset, "apart": apart}).where((F.col("subset") & ~F.col("apart")) | (ratio_bound("left", "right") >= threshold))
    both = both.withColumn("ratio", sequence_ratio("left_key", "right_key"))
    kept = (F.col("ratio") >= threshold) | (F.col("subset") & ~F.col("apart"))
    return both.where(kept).select("left", "right", "left_name", "right_name", F.round("ratio", 3).alias("similarity"))
