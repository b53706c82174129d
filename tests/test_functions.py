"""Scalar functions against tables of cases, and properties that hold for any text."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rollbook.functions import text as T
from rollbook.functions import vocabulary as V
from rollbook.functions.grades import approved, format_grade, guess_scale, parse_grade, rank_of, rescale, round_grade, with_grade
from rollbook.functions.messages import CATALOGUE, render
from rollbook.functions.numbers import looks_like_id_and_name, parse_number, parse_student_id, split_id_from_name


def table(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def column(df, *cols):
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in df.select("i", *cols).orderBy("i").collect()]


def test_numbers(spark):
    cases = {"13,25": 13.25, "13.5": 13.5, "1 234,5": 1234.5, "1.234,5": 1234.5, "1.234": 1.234, "1,234.5": None, "85%": 85.0, "15/20": 15.0, "15/0": None, "abc": None, "-": None, "": None, "12f": None, "1e3": None, "NaN": None, "+5": 5.0, " 7 ": 7.0}
    assert column(table(spark, [*cases, None]), parse_number("v")) == [*cases.values(), None]


def test_student_ids(spark):
    cases = {"000123": "123", "ist112233": "112233", "n.º 123456": "123456", "12": None, "0000": "0", "1234567890123": None, "": None, "13,25": "1325"}
    assert column(table(spark, [*cases]), parse_student_id("v")) == [*cases.values()]


def test_id_and_name(spark):
    cases = {
        "112233 Ana Maria Silva": ("112233", "Ana Maria Silva"), "110641Afonso da Silva Maia": ("110641", "Afonso da Silva Maia"), "112233 - Ana Silva": ("112233", "Ana Silva"),
        "Ana Silva | 112233": ("112233", "Ana Silva"), "n.º 12345: Ana Costa": ("12345", "Ana Costa"), "2024 15": (None, "2024 15"), "12345abc": (None, "12345abc"), "Ana Silva": (None, "Ana Silva"), "": (None, ""),
    }
    s = split_id_from_name("v")
    assert column(table(spark, [*cases]), s["student_id"], s["name"]) == [*cases.values()]
    assert column(table(spark, [*cases]), looks_like_id_and_name("v")) == [v[0] is not None for v in cases.values()]


GRADES = {
    "15,5": (15.5, None), "RE": (None, "REPROVADO"), "re m": (None, "REPROVADO"), "Não Avaliado": (None, "NAO_ADMITIDO"), "N A": (None, "NAO_ADMITIDO"), "x": (None, "SEM_NOTA"), "": (None, "SEM_NOTA"), "n/d": (None, "SEM_NOTA"),
    "RE (12,5)": (12.5, "REPROVADO"), "Aprovado 14": (14.0, "APROVADO"), "faltou": (None, "FALTOU"), "what is this": (None, "SEM_NOTA"), "passed": (None, "APROVADO"), "a very long text with 1 number inside": (None, "SEM_NOTA"),
}


def test_grades(spark):
    df = table(spark, [*GRADES, None])
    g = parse_grade("v")
    want = [*GRADES.values(), (None, "SEM_NOTA")]
    assert column(df, g["value"], g["status"]) == want
    assert column(with_grade(df, "v"), F.col("grade.value"), F.col("grade.status")) == want


def test_ranking_numbers_then_statuses(spark):
    df = with_grade(table(spark, ["2", "Aprovado", "RE", "NA", "-", "20"]), "v")
    r = rank_of(F.col("grade.value"), F.col("grade.status"))
    got = [tuple(x) for x in column(df, r)]
    assert sorted(range(6), key=lambda i: got[i]) == [4, 3, 2, 1, 0, 5]


def test_rounding_and_labels(spark):
    values = [13.0, 13.25, 13.5, 9.499, 9.5, None, 0.0, 10.0, 0.005, 100.0]
    df = table(spark, values, "double")
    assert column(df, round_grade(F.col("v"))) == [None if v is None else math.floor(v + 0.5) for v in values]
    assert column(df, format_grade(F.col("v")))[:4] == ["13", "13,25", "13,5", "9,5"] and column(df, format_grade(F.col("v")))[5] == "—"
    assert column(df, guess_scale(F.col("v"))) == [20.0] * 9 + [100.0]
    a = approved(F.col("v"), F.lit(None).cast("string"), F.lit(10.0))
    assert column(df, a) == [True, True, True, False, True, None, False, True, False, True]


def test_rescaling_keeps_what_was_written(spark):
    g = rescale(parse_grade("v", 100.0))
    assert column(table(spark, ["85", "RE"]), g["value"], g["raw"]) == [(17.0, "85 (de 85 em 0-100)"), (None, "RE")]


def test_headers(spark):
    cases = {"Nota Final 2": (None, 2, None, 90), "2.ª Época": ("epoca2", 2, None, 0), "Teste1": ("epoca1", None, "continua", 0), "Época Especial": ("especial", None, None, 0), "Recurso": ("epoca2", None, "exame", 0), "Ex 2": (None, None, None, 0), "semester 1st season": ("epoca1", None, None, 0), "": (None, None, None, 0)}
    df = table(spark, [*cases])
    assert column(df, T.season_from_text("v")["season"], T.moment_index("v"), T.route_of("v"), T.final_priority("v")) == [*cases.values()]
    assert column(df, T.season_from_text("v", strong_only=True)["season"])[2] is None
    assert column(table(spark, ["nota final", "max1", "class final"]), T.has_word(F.col("v"), V.FINAL_WORDS + V.COMPONENT_WORDS)) == ["nota final", "max", "class final"]


def test_names(spark):
    cases = {"JOÃO DA SILVA": ("João da Silva", "joao da silva", True), "ana e zé": ("Ana e Zé", "ana e ze", True), "Ana  Silva": ("Ana Silva", "ana silva", True), "Zé": ("Zé", "ze", False), "Ana 2 Silva": ("Ana 2 Silva", "ana 2 silva", False), "": ("", "", False)}
    df = table(spark, [*cases])
    assert column(df, T.title_name("v"), T.norm_name("v"), T.looks_like_person_name("v")) == [*cases.values()]
    assert column(df, T.name_tokens("v"))[0] == ["joao", "silva"]


TEXTS = ["Olá  Mundo", "SemestreTeste", "2.ª Época", "ﬁm — già–fatto", "é ç ñ Å", " x y\n", "Max1a2", "", "ĞİŞ ß Ø"]


@pytest.mark.parametrize("f", [T.clean_text, T.norm_text, T.norm_header, T.norm_name, T.split_glued, T.strip_accents], ids=lambda f: f.__name__)
def test_idempotent(spark, f):
    df = table(spark, TEXTS)
    once = df.withColumn("v", f("v"))
    assert column(once, "v") == column(once.withColumn("v", f("v")), "v")


def test_accents_agree_with_the_exact_form(spark):
    df = table(spark, [t for t in TEXTS if "ﬁ" not in t and t.isprintable()])
    assert column(df, T.strip_accents("v")) == column(df, T.strip_accents_exact("v"))
    assert column(table(spark, ["ﬁm"]), T.strip_accents_exact("v")) == ["fim"]


def test_messages_have_both_languages(spark):
    for pt, en in CATALOGUE.values():
        assert set(__import__("re").findall(r"{\w+}", pt)) == set(__import__("re").findall(r"{\w+}", en))
    df = table(spark, ["notice.nota", "no.such.key"])
    m = F.create_map(F.lit("n"), F.lit("3"))
    assert column(df, render(F.col("v"), m, F.lit("en"))) == ["Grades differ: 3", "no.such.key"]
    assert column(df, render(F.col("v"), m, F.lit("??")))[0] == "Notas diferentes: 3"
