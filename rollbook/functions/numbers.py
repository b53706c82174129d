"""Numbers, student numbers, and numbers written together with a name; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import clean_text, looks_like_person_name

# What counts as a number, and as a number glued to a name; the JVM's \d and ^...$ ask for classes and anchors.
NUMBER = r"^(?:[+-]?[0-9]{1,3}(?:[ .][0-9]{3})*(?:[.,][0-9]+)?|[+-]?[0-9]+(?:[.,][0-9]+)?)$"
FRACTION = r"^([0-9]+(?:[.,][0-9]+)?)\s*/\s*([0-9]+(?:[.,][0-9]+)?)$"
ID_PREFIX = r"(?i)^(ist|n\.?|no|nº)"
SEPARATOR = r"(?:\s*[-–—.:|/]\s*|\s+)"
BEFORE_ID = r"(?:n\.?[ºo°]?\s*)?"
ID_THEN_NAME = rf"(?iu)^{BEFORE_ID}([0-9]{{4,12}})(?:{SEPARATOR}|(?=(?-i:[A-ZÀ-ÖØ-Þ])))([^0-9].+)$"
NAME_THEN_ID = rf"(?iu)^(.+?[^0-9]){SEPARATOR}{BEFORE_ID}([0-9]{{4,12}})$"
# End of fixed values.
PLAIN = r"^[0-9]+(?:[.,][0-9]+)?$"


def _decimal(text: Column) -> Column:
    """A gated number: the last of two different separators is the decimal one."""
    both = F.contains(text, F.lit(",")) & F.contains(text, F.lit("."))
    last_comma = F.locate(",", F.reverse(text)) < F.locate(".", F.reverse(text))
    plain = F.when(both & last_comma, F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")).when(both, F.replace(text, F.lit(","), F.lit(""))).otherwise(F.translate(text, ",", "."))
    # spaces are gone; of thousands dots only a lone one can stay, as a decimal point
    return F.when(text.rlike(NUMBER), plain.try_cast("double"))


def plain_number(text: Column | str) -> Column:
    """The value of a text that is a plain decimal as it stands; null for any other."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(PLAIN), F.translate(c, ",", ".").try_cast("double"))


def number_of(cleaned: Column) -> Column:
    """C10 for a cleaned text: plain decimals are told by one cheap pattern, the rest by the full rules."""
    t = F.trim(F.replace(cleaned, F.lit("%"), F.lit("")))
    num, den = F.regexp_extract(t, FRACTION, 1), F.regexp_extract(t, FRACTION, 2)
    full = F.when(t.rlike(FRACTION), F.when(_decimal(den) != 0, _decimal(num))).otherwise(_decimal(F.replace(t, F.lit(" "), F.lit(""))))
    return F.when(cleaned.rlike(PLAIN), F.translate(cleaned, ",", ".").try_cast("double")).otherwise(full)


def parse_number(c: Column | str) -> Column:
    """A number in either convention, or null. Of a fraction the numerator, if the denominator is not zero."""
    plain = plain_number(c)
    return F.when(plain.isNull(), number_of(clean_text(c))).otherwise(plain)


def parse_student_id(c: Column | str) -> Column:
    """C11: 4 to 12 digits once a prefix and all else is gone, without leading zeros; or null."""
    t = F.regexp_replace(F.regexp_replace(F.replace(clean_text(c), F.lit(" "), F.lit("")), ID_PREFIX, ""), "[^0-9]", "")
    bare = F.regexp_replace(t, "^0+", "")
    return F.when(F.length(t).between(4, 12), F.when(bare == "", "0").otherwise(bare))


def split_id_from_name(c: Column | str) -> Column:
    """Struct (student_id, name); the id is null where a cell holds none, or what is left is no name."""
    t = clean_text(c)
    whole = F.struct(F.lit(None).cast("string").alias("student_id"), t.alias("name"))

    def cut(pattern: str, id_group: int, name_group: int) -> tuple[Column, Column]:
        name = clean_text(F.regexp_extract(t, pattern, name_group))
        return t.rlike(pattern) & looks_like_person_name(name), F.struct(parse_student_id(F.regexp_extract(t, pattern, id_group)).alias("student_id"), name.alias("name"))

    first, second = cut(ID_THEN_NAME, 1, 2), cut(NAME_THEN_ID, 2, 1)
    return F.when(first[0], first[1]).when(second[0], second[1]).otherwise(whole)


def looks_like_id_and_name(c: Column | str) -> Column:
    s = split_id_from_name(c)
    return s["student_id"].isNotNull() & (s["name"] != "")


def student_key(student_id: Column, name_key: Column) -> Column:
    """C20"""
    return F.coalesce(F.concat(F.lit("id:"), student_id), F.concat(F.lit("nome:"), name_key))
