"""Operators on small invented tables: order of rows never matters, ties are settled by what the operator says."""

from __future__ import annotations

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from rollbook.operators import identity as I
from rollbook.operators import inference as N
from rollbook.operators import layout as Y
from rollbook.operators import overlays as O
from rollbook.operators import reports as P
from rollbook.operators import results as R
from rollbook.operators.components import connected_components
from rollbook.operators.similarity import similar_names
from rollbook.settings import Settings
from rollbook.sources.metadata import subject_score, with_metadata
from rollbook.streaming import incremental

ENTRY = "student string, subject string, season_ord int, source string, file_order long, document_date string, value double, status string, n int"


def entries(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ENTRY).repartition(4)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_dates_count_only_if_all_versions_have_one(spark):
    dated = [("a", "X", 0, "f1", 1, "2024-02-01", 10.0, None), ("a", "X", 0, "f2", 2, "2024-01-01", 12.0, None)]
    mixed = [("b", "X", 0, "f1", 1, "2024-02-01", 10.0, None), ("b", "X", 0, "f2", 2, None, 12.0, None)]
    got = R.season_results(entries(spark, dated + mixed), ["n"])
    assert rows(got, "student", "value", "by_date") == [("a", 10.0, True), ("b", 12.0, False)]


def test_routes_versions_and_conflicts(spark):
    e = entries(spark, [("a", "X", 0, "f1", 1, None, 9.0, None), ("a", "X", 0, "f1", 1, None, 14.0, None), ("a", "X", 0, "f2", 2, None, None, "REPROVADO"), ("a", "X", 1, "f2", 2, None, 11.0, None)])
    assert rows(R.season_results(e, ["n"]), "season_ord", "value", "status") == [(0, None, "REPROVADO"), (1, 11.0, None)]
    assert rows(R.other_versions(e, ["n"]), "value", "lost_as") == [(14.0, "version"), (9.0, "route")]
    assert rows(R.version_conflicts(e, ["n"]), "season_ord", "versions", "distinct_grades") == [(0, 2, 2)]
    assert rows(R.repeated_rows(e.withColumn("column", F.lit("c")), "column"), "season_ord", "rows") == [(0, 2)]
    best = R.best_season(R.season_results(e, ["n"]))
    assert rows(best, "best_season", "value") == [(1, 11.0)]


def test_earliest_season_of_equals_and_empty_results(spark):
    e = entries(spark, [("a", "X", 2, "f", 1, None, 12.0, None), ("a", "X", 0, "f", 1, None, 12.0, None), ("b", "X", 0, "f", 1, None, None, "SEM_NOTA"), ("c", "X", 0, "f", 1, None, None, "FALTOU")])
    assert rows(R.best_season(R.season_results(e, ["n"])), "student", "best_season", "status") == [("a", 0, None), ("b", None, None), ("c", 0, "FALTOU")]


def results(spark, data):
    return spark.createDataFrame(data, "student string, subject string, value double, status string, final long, approved boolean, pass_mark double")


def test_averages_weigh_only_if_all_have_credits(spark):
    r = results(spark, [("a", "X", 12.0, None, 12, True, 9.5), ("a", "Y", 18.0, None, 18, True, 9.5), ("b", "X", 12.0, None, 12, True, 9.5), ("b", "Z", 18.0, None, 18, True, 9.5), ("b", "W", 8.0, None, 8, False, 9.5)])
    c = spark.createDataFrame([("X", 1, 1, 6, "A"), ("Y", 1, 2, 3, None), ("Z", None, 1, 0, "B"), ("W", 1, 1, 6, None)], "subject string, year long, semester long, ects long, course string")
    got = {(x.student, x.level, x.year, x.semester): (x.mean, x.weighted, x.rounded) for x in R.student_averages(r, c).collect()}
    assert got["a", "final", None, None] == (14.0, True, 14) and got["b", "final", None, None] == (15.0, False, 15)
    assert got["a", "year", 1, None][0] == 14.0 and got["a", "semester", 1, 2][0] == 18.0 and ("b", "year", 1, None) in got
    assert rows(R.missing_curriculum(r, c), "student", "subject") == [("b", "Z")]
    assert rows(R.plan_coverage(r, c), "student", "course", "have", "total") == [("a", "A", 2, 3), ("b", None, 3, 4)]
    assert rows(R.plan_missing(r, c), "student", "subject") == [("a", "W"), ("b", "Y")]
    assert rows(P.credit_means(r, c), "student", "mean", "weight") == [("a", 14.0, 9.0), ("b", 12.0, 6.0)]


def test_subject_stats_count_listed_students_and_empty_subjects(spark):
    r = results(spark, [("a", "X", 12.0, None, 12, True, 9.5), ("b", "X", None, "REPROVADO", None, False, 9.5)])
    s = spark.createDataFrame([("X",), ("Y",)], "subject string")
    seen = spark.createDataFrame([("a", "X"), ("c", "X")], "student string, subject string")
    assert rows(R.subject_stats(s, r, seen), "subject", "students", "pending", "average", "pass_rate") == [("X", 3, 1, 12.0, 0.5), ("Y", 0, 0, None, None)]


def test_edits_keep_the_original(spark):
    b = spark.createDataFrame([("a", "X", 9.0, None), ("b", "X", None, "REPROVADO")], "student string, subject string, value double, status string")
    e = spark.createDataFrame([("b", "X", 11.0), ("a", "New", 13.0)], "student string, subject string, edit double")
    assert rows(R.apply_edits(b, e), "student", "subject", "value", "status", "edited", "original_status") == [("a", "New", 13.0, None, True, None), ("a", "X", 9.0, None, False, None), ("b", "X", 11.0, None, True, "REPROVADO")]


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_chains_stars_and_noise(spark, n):
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, n + 1)]
    df = spark.createDataFrame([*chain, *star, *chain, (5, 5), (None, 3)], "a long, b long")
    got = {(r.node, r.component) for r in connected_components(df).collect()}
    assert got == {(i, 0) for i in range(n + 1)} | {(1000 + i, 1000) for i in range(n + 1)}
    assert connected_components(df.limit(0)).count() == 0


def test_identity_is_independent_of_order(spark):
    data = [(1, "7", "ana silva", "Ana Silva"), (2, "8", "ana silva", "ANA SILVA"), (3, "8", "", ""), (4, None, "rui costa", "Rui Costa"), (5, None, "", ""), (6, "7", "ana s", "Ana Sofia Silva")]
    schema = "row_id long, student_id string, name_key string, name string"
    seen = []
    for order in (data, data[::-1]):
        r = I.cluster_records(spark.createDataFrame(order, schema))
        seen.append(rows(r, "row_id", "cluster"))
        assert rows(I.best_names(r), "cluster", "best_name")[0] == (1, "Ana Sofia Silva")
        assert rows(I.best_ids(r), "cluster", "best_id") == [(1, "7")]
    assert seen[0] == seen[1] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 1)]
    apart = I.cluster_records(spark.createDataFrame(data, schema), merge_by_name=False)
    assert rows(apart, "row_id", "cluster") == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 1)]


def test_similar_names_against_all_pairs(spark):
    names = ["Ana Maria Silva", "Ana Maria Silvo", "Ana Silva", "Silva", "Rui Costa Lima", "Rui Costa Lina", "Rui Lima", "Joana Rita Reis", "Joana Rito Reis", "Ana de Silva", "Costa", "Zé"]
    ids = [[str(i)] if i % 3 else [] for i in range(len(names))]
    got = {(r.left, r.right) for r in similar_names(spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(zip(names, ids, strict=True))], "person long, name string, ids array<string>")).collect()}
    words = [[w for w in __import__("unicodedata").normalize("NFKD", n).encode("ascii", "ignore").decode().lower().split()] for n in names]
    tok = [{w for w in x if w != "de" and len(w) > 1} for x in words]
    want = set()
    for i, j in itertools.combinations(range(len(names)), 2):
        sub = tok[i] <= tok[j] or tok[j] <= tok[i]
        if " ".join(words[i]) == " ".join(words[j]) or (len(tok[i] & tok[j]) < 2 and not sub):
            continue
        ratio = difflib.SequenceMatcher(None, " ".join(words[i]), " ".join(words[j])).ratio()
        if ratio >= 0.9 or (sub and not (ids[i] and ids[j] and not set(ids[i]) & set(ids[j]))):
            want.add((i, j))
    assert got == want


def words(lines):
    """Word boxes from (top, [(x0, text), ...]); a character is three points wide."""
    return [("d", 1, t, float(x), float(x) + 3 * len(t), float(top), top + 5.85) for top, ws in lines for x, t in ws]


BOXES = "doc string, page int, text string, x0 double, x1 double, top double, bottom double"


def test_table_from_word_boxes(spark):
    people = [("900001", "Ana", "Silva", "12"), ("900002", "Rui", "Costa", "9,5"), ("900003", "Eva", "Lima", "RE"), ("900004", "Gil", "Reis", "17")]
    lines = [(10, [(50, "Pauta"), (68, "de"), (76, "Redes")]), (40, [(40, "Numero"), (100, "Nome"), (200, "Nota")])]
    lines += [(60 + 10 * i, [(40, p[0]), (100, p[1]), (112, p[2]), (200, p[3])]) for i, p in enumerate(people)] + [(140, [(50, "Lisboa,")])]
    got = {(r.row, r.col): r.text for r in Y.tables(spark.createDataFrame(words(lines), BOXES)).collect()}
    assert [got[0, c] for c in range(3)] == ["Numero", "Nome", "Nota"]
    assert [got[i + 1, 1] for i in range(4)] == ["Ana Silva", "Rui Costa", "Eva Lima", "Gil Reis"] and got[2, 2] == "9,5"


def test_lines_segments_and_pages(spark):
    lined = Y.lines(spark.createDataFrame(words([(10, [(0, "a"), (60, "b")]), (11, [(20, "c")]), (30, [(0, "d")])]), BOXES))
    assert rows(lined, "text", "line") == [("a", 0), ("b", 0), ("c", 0), ("d", 1)]
    assert rows(Y.segments(lined), "line", "text") == [(0, "a c"), (0, "b"), (1, "d")]
    cells = [("d", 1, 0, 0, "Nome"), ("d", 1, 0, 1, "Nota"), ("d", 1, 1, 0, "Ana"), ("d", 1, 1, 1, "12"), ("d", 2, 0, 0, "Nome"), ("d", 2, 0, 1, "Extra"), ("d", 2, 0, 2, "nota"), ("d", 2, 1, 0, "Rui"), ("d", 2, 1, 1, "x"), ("d", 2, 1, 2, "14")]
    got = {(r.page, r.row, r.col): r.text for r in Y.stitch(spark.createDataFrame(cells, "doc string, page int, row int, col int, text string")).collect()}
    assert got[2, 1, 1] == "14" and got[2, 1, 2] == "x" and got[2, 1, 0] == "Rui"


def test_upsert_deletes_and_forgets(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string")
    new = spark.createDataFrame([("b", None), ("c", "4"), ("d", "5")], "k string, v string")
    assert rows(O.upsert(old, new, ["k"], "v"), "k", "v") == [("a", "1"), ("c", "4"), ("d", "5")]
    gone = spark.createDataFrame([("a",)], "k string")
    assert rows(O.forget(old, gone, "k"), "k") == [("b",), ("c",)]


def test_selection_and_bands(spark):
    s = spark.createDataFrame([("1", "Ana"), ("2", "Rui"), ("3", "Eva")], "student string, name string")
    pick = spark.createDataFrame([(0, "Rui"), (1, "1"), (2, "2")], "pos long, pick string")
    assert [tuple(r) for r in P.select_students(s, pick).orderBy("pos").collect()] == [("2", "Rui", 0), ("1", "Ana", 1)]
    r = results(spark, [("a", "X", float(v), None, v, v > 9, 9.5) for v in (9, 10, 13, 14, 16, 18, 20)])
    assert dict(rows(P.grade_bands(r), "band", "n")) == {"<10": 1, "10-13": 2, "14-15": 1, "16-17": 1, "18-20": 2}


def test_stream_equals_batch(spark, tmp_path):
    data = [("a", "X", 0, "f1", 1, None, 9.0, None), ("b", "X", 0, "f1", 1, None, 14.0, None), ("a", "X", 0, "f2", 2, None, 12.0, None), ("c", "X", 1, "f2", 2, None, None, "FALTOU")]
    for i, part in enumerate((data[:2], data[2:])):
        entries(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = incremental.start(spark.readStream.schema(ENTRY).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["n"])
        q.awaitTermination(120)
        assert q.exception() is None, i
    cols = ("student", "season_ord", "value", "status")
    assert rows(incremental.current(spark, f"{tmp_path}/out"), *cols) == rows(R.season_results(entries(spark, data), ["n"]), *cols)


def test_settings_are_read_leniently():
    s = Settings.of({"pass_mark": "10,5", "scale": 0, "subject_curriculum": {"X": {"year": "1", "semester": "", "ects": 6.5, "course": " A "}, "Y": {"year": None}}, "grade_overrides": {"a": {"X": "x", "Y": "9,5"}}, "language": "xx", "removed_subjects": ["b", "a", "a"]})
    assert (s.pass_mark, s.scale, s.language, s.removed_subjects) == (10.5, 20.0, "pt", ["a", "b"])
    assert s.subject_curriculum == {"X": {"year": 1, "ects": 6, "course": "A"}} and s.grade_overrides == {"a": {"Y": 9.5}}
    t = s.merged({"grade_overrides": {"a": {"Y": ""}}, "pass_mark": 12})
    assert t.grade_overrides == {} and t.pass_mark == 12.0 and Settings.of(t.to_dict()) == t


TABLE = "k int, filename string, sheet_name string, title_lines array<string>, footer_lines array<string>"


def test_metadata(spark):
    tables = [
        (0, "a/Pauta_SGR_2024_2025_1E.xlsx", None, ["03713 - SGR - Segurança e Gestão de Redes", "2º Semestre 2024/25"], ["Lisboa, 3/2/2025"]),
        (1, "SGR202425.csv", None, [], []),
        (2, "x.csv", None, ["Teste 1 (30%)"], None),
        (3, "x.csv", None, ["Exame (100%)"], []),
        (4, "notas_de_Mecanica_Quantica_final.csv", None, ["Universidade Nova", "Pauta | Física Aplicada às Ondas 2023/2024 | 1st semester"], ["12.01.2024", "2024-02-05", "nada"]),
        (5, "x.xlsx", "Notação Musical", None, []),
        (6, None, None, ["LEI - 12", "Redes Dados"], []),
        (7, "pauta.xlsx", "Sheet1", ["ALG - Álgebra Linear"], []),
        (8, "ist_REDES2.xlsx", None, ["abc"], []),
    ]
    m = {r.k: r for r in with_metadata(spark.createDataFrame(tables, TABLE)).collect()}
    assert (m[0].subject, m[0].subject_confidence, m[0].subject_code, m[0].subject_code_confidence) == ("Segurança e Gestão de Redes", 0.9, "03713", 0.9)
    assert (m[0].semester, m[0].academic_year, m[0].document_date, m[0].file_season) == ("2", "2024/2025", "2025-02-03", "epoca1")
    assert (m[1].subject, m[1].subject_code, m[1].document_date) == ("SGR", "SGR", None)
    assert (m[2].component_label, m[2].component_weight) == ("Teste 1", 30) and (m[3].component_label, m[3].component_weight) == (None, None)
    assert (m[4].subject, m[4].subject_confidence, m[4].semester, m[4].academic_year, m[4].document_date) == ("Física Aplicada às Ondas", 0.85, "1", "2023/2024", "2024-02-05")
    assert (m[5].subject, m[5].subject_confidence) == ("Notação Musical", 0.35)
    assert (m[6].subject, m[6].subject_confidence, m[6].subject_code) == ("Redes Dados", 0.4, None)
    assert (m[7].subject, m[7].subject_code, m[7].subject_code_confidence) == ("Álgebra Linear", "ALG", 0.7)
    assert (m[8].subject, m[8].subject_confidence) == ("REDES", 0.5)
    assert with_metadata(spark.createDataFrame([], TABLE)).count() == 0


def test_scores_of_subjects(spark):
    d = spark.createDataFrame([("Gestão de Redes",), ("Redes",), ("2024",), ("",), ("Universidade de Lisboa",), ("Peso 30% X",)], "t string")
    got = [r[0] for r in d.select(subject_score(F.col("t"))).collect()]
    assert got == [7.5, -2.5, -99.0, -99.0, -4.5, -6.0]


def column_rows(spark, rows):
    """Columns from (col, header, kind or None for no grade, locked, numeric_ratio)."""
    full = [("s", c, h, "grade" if k else "ignore", k, lock, num, 20.0, 0.8, "r") for c, h, k, lock, num in rows]
    return spark.createDataFrame(full, "source_id string, col int, header string, role string, kind string, locked boolean, numeric_ratio double, scale double, confidence double, reason string")


PAIR = "source_id string, a int, b int, n long, n_a long, n_b long, n_both long, failed_first long"


def test_blocks_of_seasons(spark):
    c = column_rows(spark, [(0, "Nome", None, False, 0.0), (1, "Teste 1", "component", False, 0.9), (2, "Nota Final", "final", False, 0.9), (3, "Teste 2", "component", False, 0.9), (4, "Nota Final 2", "final", False, 0.9), (5, "Nota 3", "final", False, 0.9), (6, "Época Especial", "final", False, 0.9), (7, "Final", "final", False, 0.9)])
    pairs = [("s", 2, 4, 10, 10, 3, 3, 3), ("s", 4, 2, 10, 3, 10, 3, 0), ("s", 4, 5, 10, 3, 9, 3, 0)]
    got = {r.col: (r.season, r.route, r.moment) for r in N.assign_seasons(c, spark.createDataFrame(pairs, PAIR)).collect()}
    assert got == {
        0: (None, None, None), 1: ("epoca1", "continua", 1), 2: ("epoca1", None, 1), 3: ("epoca2", "exame", 2), 4: ("epoca2", "exame", 2),
        5: ("epoca2", "exame", 3), 6: ("especial", "exame", None), 7: ("especial", "exame", None),
    }
    whole = spark.createDataFrame([("s", "epoca2")], "source_id string, file_season string")
    got = {r.col: r.season for r in N.assign_seasons(c, spark.createDataFrame(pairs, PAIR), whole).collect()}
    assert got[1] == got[5] == "epoca2" and got[6] == "especial"


def test_shared_columns_and_an_empty_first_block(spark):
    c = column_rows(spark, [(0, "Projeto", "component", False, 0.9), (1, "1.ª Época", "final", False, 0.9), (2, "2.ª Época", "final", False, 0.9)])
    none = spark.createDataFrame([], PAIR)
    assert [r.season for r in N.assign_seasons(c, none).orderBy("col").collect()] == [None, "epoca1", "epoca2"]
    c = column_rows(spark, [(0, "Nota 2", "component", False, 0.9), (1, "Nota 3", "component", False, 0.9)])
    got = N.assign_seasons(c, spark.createDataFrame([("s", 1, 0, 10, 9, 9, 9, 0), ("s", 0, 1, 10, 9, 2, 2, 0)], PAIR)).orderBy("col").collect()
    assert [(r.season, r.route) for r in got] == [("epoca1", "continua"), ("epoca1", "continua")]


def test_choice_of_finals(spark):
    c = column_rows(spark, [(0, "Nota", "final", False, 0.9), (1, "Nota Final", "final", False, 0.9), (2, "Média", "final", False, 0.9), (3, "Exame", "final", False, 0.9), (4, "Teste", "component", False, 0.9), (5, "Obs", None, False, 0.0)])
    c = c.withColumn("season", F.lit("epoca1"))
    pairs = [("s", 0, 2, 9, 9, 9, 9, 0), ("s", 1, 2, 9, 9, 9, 9, 0), ("s", 1, 3, 9, 9, 9, 1, 0)]
    got = {r.col: (r.kind, r.reason, r.cluster) for r in N.pick_finals(c, spark.createDataFrame(pairs, PAIR)).collect()}
    assert got == {0: ("component", "reason.other_final_chosen", 0), 1: ("final", "reason.alt_route", 0), 2: ("component", "reason.other_final_chosen", 0), 3: ("final", "reason.alt_route", 3), 4: ("component", "r", 4), 5: (None, "r", None)}
    locked = c.withColumn("locked", F.col("col") == 2)
    got = {r.col: r.kind for r in N.pick_finals(locked, spark.createDataFrame(pairs, PAIR)).collect()}
    assert [got[i] for i in range(4)] == ["component", "component", "final", "final"]
    few = column_rows(spark, [(0, "Teste 1", "component", False, 0.9), (1, "Teste 2", "component", False, 0.1)]).withColumn("season", F.lit(None).cast("string"))
    got = {r.col: (r.kind, r.confidence) for r in N.pick_finals(few, spark.createDataFrame([], PAIR)).collect()}
    assert got == {0: ("final", 0.35), 1: ("component", 0.8)}
    mixed = few.withColumns({"kind": F.lit("final"), "season": F.when(F.col("col") == 1, "epoca2")})
    assert {r.col: r.reason for r in N.pick_finals(mixed, spark.createDataFrame([], PAIR)).collect()}[0] == "reason.shared_component"


def test_samples_are_the_first_filled_cells(spark):
    cells = [("s", i, 0, "" if i < 300 else f"v{i % 7}") for i in range(400)] + [("s", i, 1, "12") for i in range(3)]
    p = {r.col: r for r in N.profiles(spark.createDataFrame(cells, "source_id string, row long, col int, text string").repartition(5)).collect()}
    assert p[0].samples == [f"v{i % 7}" for i in range(300, 305)] and p[1].samples == ["12"] * 3
    assert (p[0].rows, p[0].filled, p[0].distinct, p[1].numbers, p[1].max_value) == (400, 100, 7, 3, 12.0)


def test_best_of_two_readings_of_a_page(spark):
    good, poor = [["Nome", "Nota"], ["Ana Silva", "12"], ["Rui Costa", "9"]], [["Nome", ""], ["Ana", ""], ["", ""]]
    cells = [("d", 1, k, r, c, t) for k, table in enumerate((poor, good)) for r, row in enumerate(table) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc string, page int, candidate int, row int, col int, text string")
    assert {r.candidate for r in Y.best_tables(df, ["doc", "page"], "candidate").collect()} == {1}


def test_functions_in_sql_text(spark):
    from rollbook.functions.sql import register

    register(spark)
    assert spark.sql("select strip_accents_exact('ﬁm é') a, round(sequence_ratio('abcd', 'abce'), 2) b").first() == ("fim e", 0.75)
    got = spark.sql("select * from sheet_cells('Nome;Nota\nAna;12')").collect()
    assert [tuple(r) for r in got] == [(0, 0, "Nome"), (0, 1, "Nota"), (1, 0, "Ana"), (1, 1, "12")]
