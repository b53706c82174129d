"""Text functions as Column expressions: everything stays inside code generation.

strip_accents covers every code point below U+2000 whose compatibility decomposition is one ASCII letter plus marks; the
table is made from Unicode data when the module loads. strip_accents_exact decomposes anything, in an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rollbook.functions import vocabulary as V


def _accent_table() -> tuple[str, str]:
    source, plain = [], []
    for i in range(0x00A0, 0x2000):
        kept = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(kept) == 1 and kept.isascii() and kept.isalnum() and kept != chr(i):
            source.append(chr(i))
            plain.append(kept)
    return "".join(source), "".join(plain)


ACCENTED, PLAIN = _accent_table()
DASHES = "‐‑‒–—−"
_LOWER, _UPPER = "a-zà-ÿ", "A-ZÀ-Þ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_accents(c: Column | str) -> Column:
    """Letters without their marks."""
    return F.regexp_replace(F.translate(_col(c), ACCENTED, PLAIN), r"\p{M}+", "")


@F.pandas_udf(StringType())
def strip_accents_exact(s: pd.Series) -> pd.Series:
    """C1 for any code point, ligatures included."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def clean_text(c: Column | str) -> Column:
    """Null is empty, dashes are hyphens, white space is one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(_col(c).cast("string"), F.lit("")), DASHES, "-" * len(DASHES)), r"(?U)\s+", " "))


def norm_text(c: Column | str) -> Column:
    """Comparable text, without ordinal signs and accents, inner capitals as word starts, lower-case."""
    t = F.regexp_replace(F.translate(clean_text(c), "ºª°", ""), f"(?<=[{_LOWER}])(?=[{_UPPER}])", " ")
    return F.trim(F.regexp_replace(F.lower(strip_accents(t)), r"(?U)\s+", " "))


def norm_header(c: Column | str) -> Column:
    """C4: words of letters and digits, a space between them."""
    return header_of(norm_text(c))


def header_of(norm: Column) -> Column:
    """C4 from a text that is normalised already."""
    return F.trim(F.regexp_replace(norm, "[^a-z0-9]+", " "))


def split_glued(c: Column | str) -> Column:
    """Letters and digits apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(c), "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " "), r"\s+", " "))


def header_variants(c: Column | str) -> Column:
    """The one or two forms of a header."""
    h = norm_header(c)
    return F.array_distinct(F.array(h, split_glued(h)))


def norm_name(c: Column | str) -> Column:
    """The identity key of a name."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm_text(c), "[^a-z0-9 ]+", " "), r"\s+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def name_tokens(c: Column | str) -> Column:
    """The words of a name that count; repetitions stay."""
    skip = F.array(*map(F.lit, V.NAME_PARTICLES))
    return F.filter(_words(norm_name(c)), lambda w: ~F.array_contains(skip, w) & (F.length(w) > 1))


def title_name(c: Column | str) -> Column:
    """Names in one case only are written with capitals; particles stay small."""
    t = clean_text(c)
    skip = F.array(*map(F.lit, V.NAME_PARTICLES))
    word = lambda w: F.when(F.array_contains(skip, F.lower(strip_accents(w))), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    one_case = (F.upper(t) != F.lower(t)) & ((t == F.upper(t)) | (t == F.lower(t)))
    return F.when(one_case, F.array_join(F.transform(F.split(t, " "), word), " ")).otherwise(t)


def looks_like_person_name(c: Column | str) -> Column:
    """Two words or more, no digit, letters for the most part."""
    t = clean_text(c)
    letters = F.regexp_count(strip_accents(t), F.lit(r"\p{L}"))
    dense = F.greatest(F.lit(4), F.floor(F.length(F.regexp_replace(t, " ", "")) * F.lit(0.8)).cast("int"))
    return (t != "") & ~t.rlike(r"\p{Nd}") & (F.size(_words(norm_name(t))) >= 2) & (letters >= dense)


def sort_key(c: Column | str) -> Column:
    """Order without accents."""
    return strip_accents(F.lower(F.coalesce(_col(c), F.lit(""))))


def has_word(header: Column, words: Sequence[str]) -> Column:
    """The longest word of the list that a normalised header holds whole, or null; then the glued form is tried."""
    listed = F.array(*map(F.lit, sorted(words, key=len, reverse=True)))
    first = lambda h: F.get(F.filter(listed, lambda w: F.contains(F.concat(F.lit(" "), h, F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))), F.lit(0))
    return F.coalesce(first(header), first(split_glued(header)))


def padded(header: Column) -> Column:
    """A normalised header between spaces, as it is and with letters and digits apart: what vocabularies are looked up in."""
    return F.concat(F.lit(" "), header, F.lit(" | "), split_glued(header), F.lit(" "))


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Whether a padded header holds any of the words whole; one regular expression for the list."""
    return text.rlike(f" (?:{'|'.join(words)}) ")


def season_of(text: Column, strong_only: bool = False) -> Column:
    """C24 for a padded header."""
    tried = [(s, "strong", w) for s, w in V.STRONG_SEASON] + ([] if strong_only else [(s, "weak", w) for s, w in V.WEAK_SEASON])
    out = None
    for season, strength, words in tried:
        value = F.struct(F.lit(season).alias("season"), F.lit(strength).alias("strength"))
        out = F.when(mentions(text, words), value) if out is None else out.when(mentions(text, words), value)
    return F.coalesce(out, F.struct(F.lit(None).cast("string").alias("season"), F.lit(None).cast("string").alias("strength")))


def season_from_text(c: Column | str, strong_only: bool = False) -> Column:
    """Struct (season, strength), both null where nothing is said."""
    return season_of(padded(norm_header(c)), strong_only)


def moment_index(c: Column | str) -> Column:
    """2 or 3 next to a word of assessment, else null."""
    tokens = F.split(split_glued(norm_header(c)), " ")
    return F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, V.MOMENT_WORDS))), F.get(F.filter(tokens, lambda t: t.isin("2", "3")), F.lit(0)).cast("int"))


def route_in(text: Column) -> Column:
    """C26 for a padded header."""
    return F.when(mentions(text, V.EXAM_WORDS), "exame").when(mentions(text, V.CONTINUOUS_WORDS), "continua")


def route_of(c: Column | str) -> Column:
    """Exame, continua or null."""
    return route_in(padded(norm_header(c)))


def priority_in(text: Column) -> Column:
    """C27 for a padded header."""
    listed = F.array(*[F.struct(F.lit(f" {w} ").alias("word"), F.lit(p).alias("priority")) for w, p in V.FINAL_PRIORITY.items()])
    return F.coalesce(F.array_max(F.transform(F.filter(listed, lambda x: F.contains(text, x["word"])), lambda x: x["priority"])), F.lit(0))


def final_priority(c: Column | str) -> Column:
    """The highest priority among the words of a header that name a final grade."""
    return priority_in(padded(norm_header(c)))
