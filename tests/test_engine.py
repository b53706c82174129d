"""Files in, results out: invented people only."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rollbook.engine import Engine
from rollbook.sinks.report import Selection, sheets_of
from rollbook.sinks.workbook import Chart, Sheet, workbook
from rollbook.sources.files import decode, fixed_width, parse, separator_of, sheets, text_rows
from rollbook.statelog import StateLog


def put(folder, name, text, encoding="utf-8"):
    p = folder / name
    p.write_bytes(text.encode(encoding))
    return str(p)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "state"))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


SHEET = "Nome;Nº Aluno;Teste 1;Nota Final;Teste 2;Nota Final 2\nPessoa Alfa Um;900001;13,25;15,5;-;-\nPessoa Beta Dois;900002;5,1;RE;11,75;14\nPessoa Gama Três;900003;0;NA;-;-\nTotal;3;;;;\n"


@pytest.fixture(scope="module")
def school(spark, tmp_path_factory):
    """One engine over sheets of several shapes, with its result; nothing here changes it."""
    at = tmp_path_factory.mktemp("school")
    put(at, "Calculo.csv", "Nome;Teste 1;Teste 2;Nota Contínua;Obs;Nota Exame\n" + "".join(f"Aluno {a} Um;10;11;{'12' if i < 4 else ''};;{'' if i < 4 else '13'}\n" for i, a in enumerate(["Alfa", "Beta", "Gama", "Delta", "Zeta", "Eta", "Teta"])))
    put(at, "Fisica.csv", SHEET)
    put(at, "Notas_XYZ.csv", "Nome;Nota Final\nPessoa Rho Um;85\nPessoa Tau Dois;42\n")
    put(at, "Redes.csv", "Nome;Nota final;Exame\n" + "".join(f"Colega {a} Um;{'12' if i < 3 else ''};{'' if i < 3 else '14'}\n" for i, a in enumerate(["Alfa", "Beta", "Gama", "Delta", "Zeta"])))
    put(at, "a1.csv", "Nome;Nº Aluno;Nota Final\nPessoa Lambda Um;900011;15\nPessoa Mi;900012;10\n")
    put(at, "a2.csv", "Nome;Nota Final\nPESSOA LAMBDA UM;12\nPessoa Ni;17\n")
    engine = Engine(spark, str(at / "state"))
    engine.ingest(str(at / "*.csv"))
    engine.update(answers={"f5s0:subject": "Química", "f6s0:subject": "Química"})
    return engine, engine.result()


def of(r, name, subject, *cols):
    return rows(r[name].where(F.col("subject") == subject), *cols)


def test_resit_sheet(school):
    engine, r = school
    columns, data = engine.columns()
    got = {x["header"]: (x["role"], x["kind"], x["season"], x["route"]) for x in columns.where("source_id = 'f2s0'").collect()}
    assert got["Nome"][0] == "name" and got["Nº Aluno"][0] == "id"
    assert got["Nota Final"] == ("grade", "final", "epoca1", None)
    assert got["Nota Final 2"] == ("grade", "final", "epoca2", "exame")
    assert got["Teste 1"][1] == "component"
    assert data.where("source_id = 'f2s0'").select("row").distinct().count() == 3  # the row of totals is no student
    assert of(r, "results", "Fisica", "student", "value", "status", "final", "approved") == [("id:900001", 15.5, None, 16, True), ("id:900002", 14.0, None, 14, True), ("id:900003", None, "NAO_ADMITIDO", None, False)]
    assert of(r, "subject_stats", "Fisica", "students", "approved", "failed", "pass_rate") == [(3, 2, 1, 0.667)]


def test_versions_and_identity(school):
    _, r = school
    # the later file counts, although its grade is lower
    assert of(r, "results", "Química", "student", "value") == [("id:900011", 12.0), ("id:900012", 10.0), ("nome:pessoa ni", 17.0)]
    assert of(r, "conflicts", "Química", "student", "type") == [("id:900011", "nota")]
    assert of(r, "other_versions", "Química", "student", "value", "lost_as") == [("id:900011", 15.0, "version")]
    assert {tuple(x["all_names"]) for x in r["students"].where("student = 'id:900011'").collect()} == {("Pessoa Lambda Um",)}


def test_scale_of_a_hundred(school):
    _, r = school
    assert of(r, "results", "XYZ", "student", "value", "final", "approved") == [("nome:pessoa rho um", 17.0, 17, True), ("nome:pessoa tau dois", 8.4, 8, False)]


def test_two_routes(school):
    engine, r = school
    finals = {x["header"]: x["route"] for x in engine.columns()[0].where("source_id = 'f1s0' and kind = 'final'").collect()}
    assert finals == {"Nota Contínua": "continua", "Nota Exame": "exame"}
    assert {x[0] for x in of(r, "results", "Calculo", "value")} == {12.0, 13.0}


def test_exam_filled_only_without_final(school):
    engine, _ = school
    assert {x["header"] for x in engine.columns()[0].where("source_id = 'f4s0' and kind = 'final'").collect()} == {"Nota final", "Exame"}


def test_document_is_the_whole_file(school):
    tables, rows_ = school[0].document("f4s0")
    assert [r["filename"] for r in tables.collect()] == ["Redes.csv"]
    assert [list(r["cells"]) for r in rows_.orderBy("row").collect()][:2] == [["Nome", "Nota final", "Exame"], ["Colega Alfa Um", "12", ""]]


def test_edits_removals_and_restart(spark, engine, tmp_path):
    put(tmp_path, "Fisica.csv", "Nome;Nº Aluno;Nota Final\nPessoa Alfa;900001;12\nPessoa Beta;900002;8\n")
    engine.ingest(str(tmp_path / "*.csv"))
    engine.edit_grade("id:900002", "Fisica", "11,5")
    engine.edit_grade("id:900001", "Outra", 9)
    r = engine.result()
    assert rows(r["results"], "student", "subject", "value", "original_value", "edited", "approved") == [
        ("id:900001", "Fisica", 12.0, None, False, True), ("id:900001", "Outra", 9.0, None, True, False), ("id:900002", "Fisica", 11.5, 8.0, True, True)
    ]
    again = Engine(spark, engine.folder)
    assert again.settings.grade_overrides == {"id:900002": {"Fisica": 11.5}, "id:900001": {"Outra": 9.0}}
    again.edit_grade("id:900002", "Fisica", "")
    again.remove_student("id:900001")
    assert rows(again.result()["results"], "student", "value") == [("id:900002", 8.0)]
    again.remove_subject("Fisica")
    assert again.result()["results"].count() == 0
    again.remove_file("Fisica.csv")
    assert again.tables().count() == 0


def test_answers_and_overrides_are_taken_back(engine, tmp_path):
    put(tmp_path, "Fisica.csv", SHEET)
    engine.ingest(str(tmp_path / "*.csv"))
    engine.update(overrides={"f1s0": {"3": {"kind": "component"}}})
    kind = lambda: {r["header"]: r["kind"] for r in engine.columns()[0].collect()}["Nota Final"]
    assert kind() == "component"
    engine.update(overrides={"f1s0": {"3": {}}})
    assert kind() == "final"
    q = {r["type"] for r in engine.review()["questions"].collect()}
    assert "moment" in q
    engine.update(answers={"f1s0:moment:2": "epoca1"})
    assert {r["header"]: r["season"] for r in engine.columns()[0].collect()}["Nota Final 2"] == "epoca1"
    assert "moment" not in {r["type"] for r in engine.review()["questions"].collect()}


def formulas(data, sheet):
    """Cell -> formula of a sheet by number."""
    import io
    import re
    import zipfile

    xml = zipfile.ZipFile(io.BytesIO(data)).read(f"xl/worksheets/sheet{sheet}.xml").decode()
    return dict(re.findall(r'<c r="([A-Z]+[0-9]+)"[^>]*><f>([^<]*)</f>', xml))


def test_report_sheets():
    people = [{"student": "id:2", "student_id": "2", "name": "Beta"}, {"student": "id:1", "student_id": "01", "name": "Alfa"}]
    one = lambda v, s, a, k, e=False: {"value": v, "status": s, "final": None if v is None else round(v), "approved": a, "edited": e, "pass_mark": 9.5, "best_season": k}
    results = {("id:2", "Fisica"): one(14.0, None, True, 1), ("id:1", "Fisica"): one(15.5, None, True, None, True), ("id:1", "Redes"): one(None, "NAO_ADMITIDO", False, 0)}
    seasons = {("id:2", "Fisica", 1): {"value": 14.0, "status": None, "source": "f1s0"}, ("id:1", "Redes", 0): {"value": None, "status": "NAO_ADMITIDO", "source": "f2s0"}}
    curriculum = {"Fisica": {"year": 1, "semester": 2, "ects": 6}, "Redes": {"year": None, "semester": None, "ects": None}}
    said = {
        "pt": (["Resumo", "Fisica", "Redes", "Médias", "Detalhe", "Avisos"], "Não admitido", "Fisica\n1.º ano · 2.º sem.", "Reprovado", "1.ª Época", "escrita à mão"),
        "en": (["Summary", "Fisica", "Redes", "Averages", "Detail", "Notices"], "Not admitted", "Fisica\nYear 1 · sem. 2", "Failed", "1st season", "typed"),
    }
    for lang, (names, state, heading, failed, season, typed) in said.items():
        data = workbook(sheets_of(Selection(people, ["Fisica", "Redes"], results, seasons, [], curriculum, [], 9.5, lang, labels={"f1s0": "a.csv text"}, files={"Fisica": ["a.csv"]})))
        got = dict(sheets(data))
        assert list(got) == names
        assert [r[1] for r in got[names[0]][4:6]] == ["Beta", "Alfa"] and got[names[0]][5][3] == state and got[names[0]][3][2] == " ".join(heading.split())
        assert [r[0] for r in got[names[0]][4:6]] == ["2", "01"]
        first, second, fourth = (formulas(data, i) for i in (1, 2, 4))
        assert first["C5"] == "'Fisica'!$G$6" and first["C3"] == "'Fisica'!$B$3" and "AVERAGE(C5:C6)" in first["C7"] and '&amp;"/"&amp;COUNT(C5:C6)' in first["C8"]
        assert first["B13"] == "COUNTIFS('Fisica'!$G$6:$G$7,\"&gt;=10\",'Fisica'!$G$6:$G$7,\"&lt;=13\")"
        # the state compares the best as it is; its season is where the best stands
        assert second["I6"].startswith('IF(NOT(ISNUMBER(F6)),"—",IF(F6&gt;=$B$3,') and "MATCH(MAX(C6:E6),C6:E6,0)" in second["H6"] and "$C$5:$E$5" in second["H6"]
        assert "F6" in second and "F7" not in second and "H7" not in second  # a typed grade stands as it is
        fisica, redes = got["Fisica"], got["Redes"]
        assert fisica[4][9] == "a.csv text" and fisica[5][5:] == ["15.5", "", "-", "", typed] and fisica[4][2] == "-"
        assert redes[4][2:] == [state, "-", "-", state, "-", season, failed, "f2s0"]
        assert "B4*B$2" in fourth["D4"] and "C$2" in fourth["F4"] and "C$2" not in fourth["D4"]
        assert any(state in r for r in got[names[4]])
    assert got["Averages"][1][:3] == ["ECTS", "6", "1"]


def test_charts_and_their_relations():
    import io
    import zipfile
    from xml.etree import ElementTree

    sheet = Sheet("A & B")
    sheet.add("x", 1)
    sheet.charts.append(Chart("t <1>", "x", "y", "'A & B'!$A$1:$A$1", [("'A & B'!$B$1", "'A & B'!$B$1:$B$1")], (3, 0)))
    z = zipfile.ZipFile(io.BytesIO(workbook([Sheet("Empty"), sheet])))
    for name in z.namelist():
        ElementTree.fromstring(z.read(name))
    assert {"xl/charts/chart1.xml", "xl/drawings/drawing2.xml", "xl/worksheets/_rels/sheet2.xml.rels"} <= set(z.namelist())
    assert b"../charts/chart1.xml" in z.read("xl/drawings/_rels/drawing2.xml.rels") and b"drawingml.chart+xml" in z.read("[Content_Types].xml")


def test_workbook_round_trip(school, tmp_path):
    engine, _ = school
    out = tmp_path / "out.xlsx"
    engine.export_xlsx(f"file://{out}", students=["Pessoa Beta Dois", "id:900001"])
    got = dict(sheets(out.read_bytes()))
    assert list(got) == ["Resumo", "Fisica", "Médias", "Detalhe", "Avisos"]
    assert [r[1] for r in got["Resumo"][4:6]] == ["Pessoa Beta Dois", "Pessoa Alfa Um"]
    assert [r[9] for r in got["Fisica"][4:6]] == ["Fisica.csv text"] * 2
    assert parse("out.xlsx", out.read_bytes())[0][0] == "sheet:Resumo"


def test_result_is_one_json_document(school, tmp_path):
    import json

    engine, r = school
    engine.write_json(f"file://{tmp_path}/doc", "en")
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert {"students", "conflicts", "warnings", "subjects", "subject_stats", "stats", "settings"} <= doc.keys()
    of = {s["key"]: s for s in doc["students"]}
    assert len(of) == len(doc["students"]) == r["students"].count()
    fisica = of["id:900002"]["subjects"]["Fisica"]
    assert (fisica["best_epoca_label"], fisica["best"]["value"], fisica["best_rounded"], fisica["edited"], fisica["original"]) == ("2nd season", 14.0, 14, False, None)
    assert fisica["epocas"]["epoca1"]["grade"] == {"value": None, "status": "REPROVADO", "label": "Failed"} and fisica["epocas"]["epoca2"]["route_label"] == "Exam"
    assert [v["value"] for v in of["id:900011"]["subjects"]["Química"]["epocas"]["epoca1"]["other_versions"]] == [15.0]
    assert [c["type"] for c in doc["conflicts"]] == ["nota"] and doc["conflicts"][0]["message"].startswith("Grades differ")
    assert len(doc["stats"]) == 1


def test_log_takes_each_number_once(spark, tmp_path):
    logs = [StateLog(spark, str(tmp_path / "log")) for _ in range(4)]
    assert logs[0].latest() == (0, None)
    with ThreadPoolExecutor(4) as pool:  # all change the same state at once
        list(pool.map(lambda i: logs[i % 4].change(lambda s: {"said": [*(s or {"said": []})["said"], i]}), range(24)))
    number, state = logs[0].latest()
    assert number == 24 and sorted(state["said"]) == list(range(24)) and state["previous"] == 23
    assert [len(logs[1].read(n)["said"]) for n in logs[1].numbers()] == list(range(1, 25))
    assert not logs[0].append(3, {}) and logs[0].latest()[0] == 24
    assert logs[0].change(lambda s: {k: v for k, v in s.items() if k != "previous"})[0] == 24  # no change, no state
    assert not [p for p in (tmp_path / "log").iterdir() if p.suffix != ".json"]


def test_engines_on_one_folder_lose_nothing(spark, tmp_path):
    put(tmp_path, "a1.csv", "Nome;Nota Final\nPessoa Alfa Um;12\n")
    put(tmp_path, "b1.csv", "Nome;Nota Final\nPessoa Beta Um;13\n")
    one, two = (Engine(spark, str(tmp_path / "state")) for _ in range(2))
    one.ingest(str(tmp_path / "a1.csv"))
    two.update(answers={"f1s0:subject": "X"}, overrides={"f1s0": {"1": {"scale": 20}}})  # two was opened before
    two.ingest(str(tmp_path / "b1.csv"))
    one.edit_grade("id:1", "X", 11)
    two.edit_grade("id:2", "X", 12)
    one.confirm("f1s0")
    two.confirm("f2s0")
    two.remove_student("id:3")
    one.remove_student("id:4")
    one.create_subject("Y")
    assert sorted(r[0] for r in two.tables().select("source_id").collect()) == ["f1s0", "f2s0"]
    last = Engine(spark, one.folder)
    assert last.answers == {"f1s0:subject": "X"} and last.overrides == {"f1s0": {"1": {"scale": 20}}} and last.next_order == 3
    s = last.settings
    assert (s.grade_overrides, s.confirmed_sources, s.removed_students, s.manual_subjects) == ({"id:1": {"X": 11.0}, "id:2": {"X": 12.0}}, ["f1s0", "f2s0"], ["id:3", "id:4"], ["Y"])
    two.remove_file("a1.csv")
    one.update(answers={"f2s0:subject": "Z"})
    last.refresh()
    assert last.answers == {"f2s0:subject": "Z"} and last.overrides == {} and last.settings.confirmed_sources == ["f2s0"]
    # a state that cannot be read, or is of another version, is an empty one; what comes next builds on that
    (tmp_path / "state" / "state" / f"{one.log.latest()[0] + 1:012d}.json").write_text("{not json")
    assert Engine(spark, one.folder).answers == {}
    one.update(answers={"f2s0:subject": "W"})
    assert Engine(spark, one.folder).answers == {"f2s0:subject": "W"}


def test_only_changed_sheets_are_inferred_again(spark, tmp_path):
    for i in range(4):
        put(tmp_path, f"s{i}.csv", f"Nome;Nº Aluno;Teste;Nota Final\nPessoa Alfa;900001;5;{10 + i}\nPessoa Beta;900002;6;8\nPessoa {'ABCD'[i]} Um;;7;{12 + i}\n")
    engine = Engine(spark, str(tmp_path / "state"))
    engine.ingest(str(tmp_path / "s[012].csv"))
    parts = ("results", "seasons", "subject_stats", "students")
    values = lambda r: {p: rows(r[p].drop("best_season"), *[c for c in r[p].columns if c != "best_season"]) for p in parts}
    engine.result()
    assert engine.views.made == 3
    engine.edit_grade("id:900001", "S0", 18)
    engine.remove_student("id:900002")
    engine.update(answers={"f1s0:subject": "S2"}, settings={"pass_mark": 11})  # names are laid over
    engine.result()
    assert engine.views.made == 3
    engine.update(overrides={"f2s0": {"2": {"kind": "final"}, "3": {"kind": "component"}}})
    engine.ingest(str(tmp_path / "s3.csv"))
    got = values(engine.result())
    assert engine.views.made == 5  # the sheet that was decided about, and the new one
    other = Engine(spark, engine.folder)
    assert values(other.result()) == got and other.views.made == 0
    engine.remove_file("s0.csv")
    engine.update(overrides={"f2s0": {"2": {}, "3": {}}})
    kept = values(engine.result())
    assert engine.views.made == 5  # as it was before, so known
    whole = Engine(spark, str(tmp_path / "again"))
    whole.ingest([str(tmp_path / f"s{i}.csv") for i in (1, 2, 3)])
    whole.edit_grade("id:900001", "S0", 18)
    whole.remove_student("id:900002")
    whole.update(settings={"pass_mark": 11})
    fresh = values(whole.result())
    assert [r for r in kept["results"]] == [r for r in fresh["results"]] and kept["subject_stats"] == fresh["subject_stats"]


def test_merge_questions(engine, tmp_path):
    put(tmp_path, "a1.csv", "Nome;Nota Final\nPessoa Alfa Um;12\n")
    put(tmp_path, "a2.csv", "Nome;Nota Final\nPessoa Beta Dois;13\n")
    engine.ingest(str(tmp_path / "*.csv"))
    engine.update(answers={"f1s0:subject": "Redes", "f2s0:subject": "REDES"})
    asked = {r["id"]: r["default"] for r in engine.review()["questions"].where("type = 'merge'").collect()}
    assert list(asked) == ["merge:nome:redes"]
    engine.update(answers={"merge:nome:redes": "Redes"})
    assert engine.review()["questions"].where("type = 'merge'").count() == 0


def test_empty_engine(engine):
    r = engine.result()
    assert r["results"].count() == 0 and r["stats"].first()["students"] == 0


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "utf-16"])
def test_encodings(encoding):
    assert "Três" in decode("Pessoa Três;12".encode(encoding))


def test_text_layouts():
    assert separator_of(["a;b", "c;d", "e;f"]) == ";"
    assert separator_of(["a,b;c", "d,e;f,g", "h;i"]) == ";"
    assert separator_of(["no separator", "here"]) is None
    assert fixed_width(["Nome        Nota", "Alfa Um     12", "Beta        9"]) == [["Nome", "Nota"], ["Alfa Um", "12"], ["Beta", "9"]]
    assert text_rows("\n \n") == [] and text_rows("one line\n") == []
    assert text_rows("a;b\nc\nd;e;f\ng;h\ni;j") == [["a", "b", ""], ["c", "", ""], ["d", "e", "f"], ["g", "h", ""], ["i", "j", ""]]


def test_unknown_files_are_reported(engine, tmp_path):
    put(tmp_path, "x.doc", "a")
    put(tmp_path, "y.csv", "only one line")
    put(tmp_path, "z.xlsx", "no zip")
    found = engine.ingest([str(tmp_path / n) for n in ("x.doc", "y.csv", "z.xlsx")])
    assert found.where("error is not null").count() == 3
    assert engine.tables().select(F.count("*")).first()[0] == 0
