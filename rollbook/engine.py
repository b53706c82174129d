"""The engine: files in, decisions laid over them, results out as a bundle of DataFrames.

Tables of files are written once under the state folder. What a sheet says is inferred sheet by sheet and kept (`views`):
only sheets that came in, or whose decisions changed, are read again. Decisions are numbered states (`statelog`) beside
the tables, in any store that Spark reaches; several engines may work on one folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import vocabulary as V
from rollbook.functions.grades import format_grade, rescale, with_grade
from rollbook.functions.messages import render, template
from rollbook.functions.numbers import parse_student_id, split_id_from_name, student_key
from rollbook.functions.text import clean_text, norm_name, norm_text, sort_key, title_name
from rollbook.operators import identity as I
from rollbook.operators import inference as N
from rollbook.operators import order_keys as K
from rollbook.operators import overlays as O
from rollbook.operators import reports as P
from rollbook.operators import results as R
from rollbook.operators.similarity import similar_names
from rollbook.session import drop_folder, new_folder, table_of
from rollbook.settings import Settings
from rollbook.sinks.report import Selection, sheets_of
from rollbook.sinks.workbook import rows_of, workbook
from rollbook.sources.files import ROWS, TABLES, cells, read_sheets
from rollbook.sources.metadata import with_metadata
from rollbook.statelog import StateLog
from rollbook.views import Views

VERSION = 2
OVERRIDES = "source_id string, col int, role string, kind string, season string, scale double"
ANSWERS = "source_id string, question string, arg string, value string"
ORDER = ["row", "col"]
#: Files whose tables are read by name of folder; of more, all folders are listed.
FEW_FILES = 1000


@dataclass(frozen=True)
class State:
    """What users decided, the next file's number, and how often files came or went. Never changed in place."""

    answers: dict = field(default_factory=dict)
    overrides: dict = field(default_factory=dict)
    settings: Settings = field(default_factory=Settings)
    next_order: int = 1
    files: int = 0
    #: Students picked for the top of lists and for reports, by keys of their order.
    picks: dict = field(default_factory=dict)

    @classmethod
    def of(cls, held: dict | None) -> State:
        """A state of another version, or one that cannot be read, is an empty one."""
        if not held or held.get("version") != VERSION:
            return cls()
        return cls(held["answers"], held["overrides"], Settings.of(held["settings"]), held["next_order"], held["files"], held["picks"])

    def to_dict(self) -> dict:
        return {"version": VERSION, "answers": self.answers, "overrides": self.overrides, "settings": self.settings.to_dict(), "next_order": self.next_order, "files": self.files, "picks": self.picks}

    def keys(self) -> dict[str, str]:
        """Of each sheet that something was decided about, a digest of that; a sheet's name is laid over it later."""
        said: dict[str, list] = {}
        for k, v in sorted(self.answers.items()):
            if not k.endswith(":subject"):
                said.setdefault(k.split(":")[0], []).append([k, v])
        for source, columns in sorted(self.overrides.items()):
            if columns:
                said.setdefault(source, []).append(columns)
        return {s: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:32] for s, x in said.items()}


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = StateLog(spark, f"{self.folder}/state")
        self.views = Views(spark, f"{self.folder}/views")
        self._memo: dict[str, list[tuple[str, str, DataFrame]]] = {}
        self.state = State()
        self.refresh()

    # ------------------------------------------------------------ state

    answers = property(lambda self: self.state.answers)
    overrides = property(lambda self: self.state.overrides)
    settings = property(lambda self: self.state.settings)
    picks = property(lambda self: self.state.picks)
    next_order = property(lambda self: self.state.next_order)

    def refresh(self) -> None:
        """Takes up what other engines on this folder have decided since."""
        self.state = State.of(self.log.latest()[1])

    def _change(self, change: Callable[[State], State]) -> State:
        """Makes one change to the newest state, whoever wrote that, and gives back the state it was made to."""
        before = State()

        def apply(held: dict | None) -> dict:
            nonlocal before
            before = State.of(held)
            return change(before).to_dict()

        self.state = State.of(self.log.change(apply)[1])
        return before

    def _set(self, change: Callable[[Settings], dict]) -> None:
        """Merges change(newest settings) into them."""
        self._change(lambda s: replace(s, settings=s.settings.merged(change(s.settings))))

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ files

    def ingest(self, paths: str | list[str]) -> DataFrame:
        """K1: reads files into the state; (filename, source_id, error) of every table and of files without one.

        Numbers are taken from the state before files are read, so engines that ingest at once never give one twice.
        """
        n = self.spark.read.format("binaryFile").load(paths).select("path").count()
        first = self._change(lambda s: replace(s, next_order=s.next_order + n)).next_order
        found, rows = read_sheets(self.spark, paths, first)
        found = table_of(found, "ingest")
        # rows first: a table that is there has all of them
        rows.write.mode("append").partitionBy("file_order").parquet(f"{self.folder}/rows")
        found.where("error is null").write.mode("append").partitionBy("file_order").parquet(f"{self.folder}/tables")
        self._change(lambda s: replace(s, files=s.files + 1))
        return found.select("filename", "source_id", "error")

    def _stored(self, name: str, schema: str) -> DataFrame:
        at, fs = self._fs(f"{self.folder}/{name}")
        if not fs.exists(at) or not any(s.isDirectory() for s in fs.listStatus(at)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def tables(self) -> DataFrame:
        """The tables of all files, as written when they came in."""
        return self._stored("tables", TABLES)

    def rows(self) -> DataFrame:
        """The rows of all tables: source_id, file_order, row, cells."""
        return self._stored("rows", ROWS)

    def remove_file(self, filename: str) -> None:
        """K2: a file goes, with what was decided about its sheets."""
        gone = {r[0] for r in self.tables().where(F.col("filename") == filename).select("source_id").collect()}

        def without(s: State) -> State:
            settings = s.settings.merged({"confirmed_sources": [x for x in s.settings.confirmed_sources if x not in gone]})
            return replace(s, answers={k: v for k, v in s.answers.items() if k.split(":")[0] not in gone}, overrides={k: v for k, v in s.overrides.items() if k not in gone}, settings=settings, files=s.files + 1)

        for order in {s[1:].split("s")[0] for s in gone}:
            for name in ("tables", "rows"):
                drop_folder(self.spark, f"{self.folder}/{name}/file_order={order}")
        self._change(without)

    def document(self, source_id: str) -> tuple[DataFrame, DataFrame]:
        """K9: (tables, rows) of the file that a sheet came from; no other file is read."""
        own = F.col("file_order") == int(source_id[1:].split("s")[0])
        return self.tables().where(own), self.rows().where(own)

    def reset(self) -> None:
        """Everything goes but the count of files: numbers are not given again, as sheets are known by them."""
        for name in ("tables", "rows"):
            drop_folder(self.spark, f"{self.folder}/{name}")
        self._change(lambda s: State(next_order=s.next_order, files=s.files + 1))
        self.views.drop()

    # ------------------------------------------------------------ decisions

    def update(self, answers: dict | None = None, overrides: dict | None = None, settings: dict | None = None) -> None:
        """K3: an empty value takes a decision back. `merge:<group>` answers are names of subjects."""

        def change(s: State) -> State:
            said, fixed, held = dict(s.answers), {k: dict(v) for k, v in s.overrides.items()}, s.settings
            for key, value in (answers or {}).items():
                if key.startswith("merge:"):
                    held = held.merged({"subject_aliases": {key[len("merge:") :]: value}})
                elif value in (None, ""):
                    said.pop(key, None)
                else:
                    said[key] = str(value)
            for source, columns in (overrides or {}).items():
                kept = fixed.setdefault(source, {})
                for col, spec in columns.items():
                    kept[str(col)] = spec
                    if not spec:
                        kept.pop(str(col))
            return replace(s, answers=said, overrides=fixed, settings=held.merged(settings) if settings else held)

        self._change(change)

    def confirm(self, source_id: str, yes: bool = True) -> None:
        """K7"""
        self._set(lambda s: {"confirmed_sources": sorted(_toggled(s.confirmed_sources, source_id, yes))})

    def rename_subject(self, group_key: str, name: str) -> None:
        """K5: the name of every sheet of a group; an empty one takes the name back."""
        self._set(lambda s: {"subject_aliases": {group_key: name}})

    def create_subject(self, name: str) -> None:
        self._set(lambda s: {"manual_subjects": [*s.manual_subjects, clean_name(name)]})

    def assign_subject(self, source_id: str, name: str) -> None:
        self.update(answers={f"{source_id}:subject": name})

    def remove_subject(self, name: str, yes: bool = True) -> None:
        self._set(lambda s: {"removed_subjects": sorted(_toggled(s.removed_subjects, name, yes))})

    def edit_grade(self, student: str, subject: str, value: object) -> None:
        """K6: a typed grade; blank takes it back."""
        self._set(lambda s: {"grade_overrides": {student: {subject: value}}})

    def remove_student(self, student: str, yes: bool = True) -> None:
        self._set(lambda s: {"removed_students": _toggled(s.removed_students, student, yes)})

    def pick(self, student: str, yes: bool = True) -> None:
        """H3: a student comes last among the picked ones, or is not picked any more."""
        self._change(lambda s: replace(s, picks=K.placed(s.picks, student) if yes else {k: v for k, v in s.picks.items() if k != student}))

    def move(self, student: str, target: str, after: bool = False) -> None:
        """H3: a picked student goes right before or after another one."""
        self._change(lambda s: replace(s, picks=K.moved(s.picks, student, target, after)))

    def nudge(self, student: str, step: int, needle: str | None = None) -> None:
        """H3: a picked student goes up or down among the picked ones; with a needle, among those that the search shows."""
        seen = None
        if needle:
            picked = self._frame([(k,) for k in self.picks], "student string")
            seen = {r[0] for r in P.search(self.result()["students"].join(F.broadcast(picked), "student"), needle).select("student").collect()}
        self._change(lambda s: replace(s, picks=K.nudged(s.picks, student, step, seen)))

    def listed(self, most: int) -> DataFrame:
        """H3, I4: the first students of a list: picked ones in their order, then by name."""
        pinned = self._frame(list(self.picks.items()), "student string, pos string")
        return P.pinned_order(self.result()["students"], pinned, most)

    # ------------------------------------------------------------ sheets

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _kept(self, name: str, made: Callable[[], DataFrame], *parts: object) -> DataFrame:
        """K8: what made() gives, written once for as long as `parts`, which it depends on, stay as they are. The one before
        stays for frames that were given out; older ones go."""
        key = json.dumps(parts, sort_keys=True, default=str)
        held = self._memo.setdefault(name, [])
        if not held or held[-1][0] != key:
            path = new_folder(self.spark, name)
            held.append((key, path, table_of(made(), name, path)))
            for _, old, _ in held[:-2]:
                drop_folder(self.spark, old)
            del held[:-2]
        return held[-1][2]

    def _of(self, stored: DataFrame, missing: DataFrame) -> DataFrame:
        """What is stored of the given sheets (source_id); of few files only their folders are read."""
        orders = missing.select(F.regexp_extract("source_id", r"^f(\d+)s", 1).cast("long").alias("o")).distinct().limit(FEW_FILES + 1).collect()
        if len(orders) <= FEW_FILES:
            stored = stored.where(F.col("file_order").isin([r[0] for r in orders]))
        return stored.join(missing.select("source_id"), "source_id", "left_semi")

    def _infer(self, missing: DataFrame) -> dict[str, DataFrame]:
        """What the given sheets say: about themselves, their columns, their rows of people and final grades."""
        sheets = table_of(with_metadata(self._of(self.tables(), missing)).drop("title_lines", "footer_lines", "error"), "sheets")
        raw = table_of(cells(self._of(self.rows(), missing)), "cells")
        headers = table_of(N.header_rows(raw), "headers")
        data = table_of(N.data_cells(raw, headers), "data")
        columns = table_of(self._columns(sheets, raw, headers, data), "inferred")
        people, grades = self._rows(sheets, columns, data)
        return {"sheets": sheets, "headers": headers, "columns": columns, "people": people, "grades": grades}

    def _sheet_views(self) -> dict[str, DataFrame]:
        """K1, K2, K8: of all sheets there are; those with new files or decisions are inferred, others are as they were."""
        parts = json.dumps([self.state.files, sorted(self.state.keys().items())])
        held = self._memo.setdefault("views", [])
        if not held or held[-1][0] != parts:
            keys = self._frame(list(self.state.keys().items()), "source_id string, key string")
            wanted = self.tables().select("source_id").join(keys, "source_id", "left").select("source_id", F.coalesce("key", F.lit("-")).alias("key"))
            held[:] = [(parts, "", self.views.refresh(wanted, self._infer))]
        return held[-1][2]

    def _inferred(self) -> tuple:
        """What all results of sheets depend on."""
        return self.state.files, self.state.keys()

    def _named(self) -> tuple:
        """What the subjects of sheets depend on."""
        return {k: v for k, v in self.answers.items() if k.endswith(":subject")}, self.settings.subject_aliases

    def sheets(self) -> DataFrame:
        """Tables with what they say about themselves, and what users say about them."""
        return self._kept("sheets", self._sheets, self._inferred(), self._named())

    def _sheets(self) -> DataFrame:
        said = [(k.split(":")[0], v) for k, v in self.answers.items() if k.endswith(":subject")]
        s = self._sheet_views()["sheets"].join(self._frame(said, "source_id string, _said string"), "source_id", "left")
        s = s.withColumns({"subject": F.coalesce(clean_text_or_null("_said"), "subject"), "subject_confidence": F.when(F.col("_said").isNotNull(), 1.0).otherwise(F.col("subject_confidence"))}).drop("_said")
        key = I.subject_group_key(norm_text("subject_code"), F.col("subject_code_confidence"), norm_name("subject"), F.col("source_id"))
        s = table_of(s.withColumns({"group_key": key, "label": F.concat_ws(" ", "filename", "location")}), "keyed-sheets")
        aliases = self._frame(list(self.settings.subject_aliases.items()), "group_key string, alias string")
        resolved = I.resolve_subjects(s.select("source_id", "group_key", "subject", "label"), aliases)
        return s.join(resolved.select("source_id", "canonical", "names", "confirmed"), "source_id")

    def columns(self) -> tuple[DataFrame, DataFrame]:
        """(columns, data cells) with answers and overrides applied."""
        views = self._sheet_views()
        return views["columns"], N.data_cells(cells(self.rows()), views["headers"])

    def _columns(self, sheets: DataFrame, raw: DataFrame, headers: DataFrame, data: DataFrame) -> DataFrame:
        columns = table_of(N.classified(raw, headers, data, sheets.select("source_id", "file_season")), "classified")
        component = sheets.where("component_label is not null").select("source_id", F.lit(True).alias("_part"))
        finals = columns.where("role = 'grade' and kind = 'final'").groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
        only = component.join(finals.where("_n = 1"), "source_id").select("source_id", "_part")
        columns = columns.join(only, "source_id", "left")
        part = F.coalesce("_part", F.lit(False)) & (F.col("role") == "grade") & (F.col("kind") == "final")
        columns = columns.withColumns({"locked": F.col("locked") | part, "confidence": F.when(part, 0.8).otherwise(F.col("confidence")), "reason": F.when(part, "reason.component_pauta").otherwise(F.col("reason")), "kind": F.when(part, "component").otherwise(F.col("kind"))}).drop("_part")
        answers = [(*(k.split(":") + [""])[:3], v) for k, v in self.answers.items() if not k.endswith(":subject") and k.count(":")]
        if answers:
            columns = O.apply_answers(columns, data, self._frame(answers, ANSWERS))
        spec = [(s, int(c), x.get("role"), x.get("kind"), x.get("epoca", x.get("season")), None if x.get("scale") is None else float(x["scale"])) for s, cs in self.overrides.items() for c, x in cs.items()]
        if spec:
            columns = O.apply_overrides(columns, data, self._frame(spec, OVERRIDES))
        return columns

    def review(self) -> dict[str, DataFrame]:
        """Sheets, columns and open questions."""
        self.refresh()
        sheets, columns = self.sheets(), self._sheet_views()["columns"]
        answered = self._frame([(k,) for k in self.answers], "id string")
        asked = O.questions(sheets.select("source_id", "subject", "subject_confidence"), columns, answered).unionByName(O.merge_questions(sheets))
        return {"sheets": sheets, "columns": columns, "questions": asked}

    def _rows(self, sheets: DataFrame, columns: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of people, their final grades in long form, as written) of sheets."""
        of = data.join(columns.select("source_id", "col", "role", "kind", "season", "route", "header", "scale"), ["source_id", "col"]).join(sheets.select("source_id", "file_order", "document_date"), "source_id")
        who = of.where("role in ('name', 'id')").groupBy("source_id", "file_order", "row").agg(
            F.max(F.when(F.col("role") == "name", F.col("text"))).alias("_name"), F.max(F.when(F.col("role") == "id", F.col("text"))).alias("_id")
        )
        who = table_of(who.withColumn("_name", title_name(F.coalesce("_name", F.lit("")))), "named")
        who = table_of(who.withColumn("_s", split_id_from_name("_name")).withColumn("_own", parse_student_id("_id")), "numbered")
        again = F.when(F.col("_s.student_id").isNotNull(), title_name("_s.name")).otherwise(F.col("_name"))
        who = table_of(who.withColumns({"student_id": F.coalesce("_own", "_s.student_id"), "name": again}), "people")
        table = F.regexp_extract("source_id", r"s(\d+)$", 1).cast("long")
        row_id = F.shiftleft(F.col("file_order").cast("long"), 44) + F.shiftleft(table, 32) + F.col("row").cast("long")
        people = who.where("name <> '' or student_id is not null").select(row_id.alias("row_id"), "source_id", "row", "name", "student_id", norm_name("name").alias("name_key"))
        graded = with_grade(of.where("role = 'grade' and kind = 'final'"), "text", F.col("scale"), "g")
        grades = graded.select("source_id", "row", "col", F.coalesce("season", F.lit(V.SEASONS[0])).alias("season"), "route", F.col("header").alias("column"), "document_date", "file_order", "g")
        return people, grades.where("g.value is not null or g.status <> 'SEM_NOTA'")

    # ------------------------------------------------------------ result

    def _subjects_of(self) -> DataFrame:
        """(source_id, subject) of the sheets whose subject is not removed."""
        gone = self._frame([(s,) for s in self.settings.removed_subjects], "canonical string")
        return self.sheets().join(gone, "canonical", "left_anti").select("source_id", F.col("canonical").alias("subject"))

    def records(self) -> tuple[DataFrame, DataFrame]:
        """(rows of people, their grades in long form) of the sheets whose subject is not removed."""
        views, subjects = self._sheet_views(), self._subjects_of()
        grades = views["grades"].withColumn("g", rescale(F.col("g"), self.settings.scale)).join(subjects, "source_id")
        grades = grades.select("source_id", "row", "col", "subject", "season", "route", "column", "document_date", "file_order", "g.value", "g.status", "g.raw")
        return views["people"].join(subjects, "source_id"), grades.withColumn("season_ord", F.array_position(F.array(*map(F.lit, V.SEASONS)), F.col("season")).cast("int") - 1)

    def _clustered(self) -> DataFrame:
        """F1, K2: rows with the person they belong to; of the rows known before, only clusters that change are solved again."""
        rows, by_name = self.records()[0], self.settings.merge_by_name
        held = self._memo.get("people")
        if not held or json.loads(held[-1][0])[-1] != by_name:
            return I.cluster_records(rows, by_name)
        before = held[-1][2]
        same = ["row_id", "name", "student_id", "name_key"]
        new = rows.alias("new").join(before.select(*[F.col(c).alias(f"_{c}") for c in same]), [F.col(f"new.{c}").eqNullSafe(F.col(f"_{c}")) for c in same], "left_anti")
        old = before.alias("old").join(rows.select(*[F.col(c).alias(f"_{c}") for c in same]), [F.col(f"old.{c}").eqNullSafe(F.col(f"_{c}")) for c in same], "left_anti")
        new, old = table_of(new, "new-rows"), table_of(old.select("row_id"), "old-rows")
        done = I.recluster(before.select(*same, "cluster"), new.select(*same), old, by_name)
        # subjects of rows may have changed; who they are has not
        return rows.join(done.select("row_id", "cluster"), "row_id")

    def _people(self) -> DataFrame:
        """People of rows: cluster, student, names and numbers; typed grades and marks leave them as they are."""
        st = self.settings
        depends = self._inferred(), self._named(), st.removed_subjects, st.merge_by_name
        people = self._kept("people", self._clustered, *depends)

        def spelled() -> DataFrame:
            s = I.described(people)
            name = F.coalesce("best_name", F.lit(""))
            keyed = student_key(F.col("best_id"), norm_name(name)).alias("student")
            return s.select("cluster", keyed, F.when(name != "", name).otherwise(F.concat_ws(" ", F.lit("(sem nome)"), "best_id")).alias("name"), "best_name", F.col("best_id").alias("student_id"), "all_ids", "all_names")

        return self._kept("students", spelled, *depends), people, depends

    def result(self) -> dict[str, DataFrame]:
        """Students, results, seasons, conflicts, warnings, subjects, averages, coverage and counts."""
        self.refresh()
        st, spark = self.settings, self.spark
        spelled, people, depends = self._people()
        gone = self._frame([(s,) for s in st.removed_students], "student string")
        students = spelled.drop("best_name").join(gone, "student", "left_anti")
        depends = (*depends, st.removed_students)
        keyed = self._kept("keyed", lambda: people.join(students.select("cluster", "student"), "cluster"), *depends)
        of_rows = lambda: self.records()[1].join(keyed.select("source_id", "row", "student"), ["source_id", "row"]).withColumn("source", F.col("source_id"))
        entries = self._kept("entries", of_rows, *depends, st.scale)
        seasons = self._kept("seasons", lambda: R.season_results(entries, ORDER), *depends, st.scale)
        marks = self._frame([(k, float(v)) for k, v in st.subject_pass_marks.items()], "subject string, pass_mark double")
        edits = [(k, s, float(v)) for k, g in st.grade_overrides.items() for s, v in g.items() if s not in st.removed_subjects]

        def marked() -> DataFrame:
            best = R.apply_edits(R.best_season(seasons), self._frame(edits, "student string, subject string, edit double").join(students.select("student"), "student", "left_semi"))
            return R.with_marks(best, marks, st.pass_mark)

        results = self._kept("results", marked, *depends, st.scale, edits, st.subject_pass_marks, st.pass_mark)
        sheets = self.sheets().join(self._frame([(s,) for s in st.removed_subjects], "canonical string"), "canonical", "left_anti")
        known = sheets.select(F.col("canonical").alias("subject")).unionByName(self._frame([(s,) for s in st.manual_subjects if s not in st.removed_subjects], "subject string")).distinct()
        stated = sheets.where("semester is not null").groupBy(F.col("canonical").alias("subject")).agg(F.min_by(F.col("semester").try_cast("long"), "file_order").alias("_semester"))
        meta = [(s, m.get("year"), m.get("semester"), m.get("ects"), m.get("course")) for s, m in st.subject_curriculum.items()]
        typed = self._frame(meta, "subject string, year long, semester long, ects long, course string")
        subjects = known.unionByName(results.select("subject").distinct()).distinct()
        curriculum = subjects.join(typed, "subject", "left").join(stated, "subject", "left").withColumn("semester", F.coalesce("semester", "_semester")).drop("_semester")
        seen = R.seen_subjects(keyed, results)
        kind = lambda df, t, s, detail: df.withColumns({"type": F.lit(t), "severity": F.lit(s), "detail": detail})
        conflicts = P.notices(
            kind(R.version_conflicts(entries, ORDER).select("student", "subject", "season_ord", "distinct_grades"), "nota", "warning", F.col("distinct_grades").cast("string")).drop("distinct_grades"),
            kind(R.repeated_rows(entries, "column").select("student", "subject", "season_ord", "distinct_grades", "source"), "linha repetida", "warning", F.col("source")).drop("distinct_grades", "source"),
        )
        who = I.identity_notices(students, "student").select("student", "type", "severity", "detail")
        alike = similar_names(spelled.where("best_name is not null").select(F.col("cluster").alias("person"), F.col("best_name").alias("name"), F.col("all_ids").alias("ids")))
        alike = kind(alike.select(F.col("left_name").alias("student"), "right_name", "similarity"), "possivel_duplicado", "info", F.concat_ws(" ", "right_name", F.col("similarity").cast("string"))).drop("right_name", "similarity")
        merged = sheets.where("size(names) > 1 and not confirmed").groupBy(F.col("canonical").alias("subject")).agg(F.array_join(F.first("names"), "; ").alias("n"))
        merged = kind(merged, "cadeiras juntadas", "info", F.col("n")).drop("n")
        columns = self._sheet_views()["columns"]
        finals = columns.where("role = 'grade' and kind = 'final'").select("source_id").distinct()
        without = kind(sheets.join(finals, "source_id", "left_anti").select(F.col("canonical").alias("subject"), "label"), "pauta sem nota final", "warning", F.col("label")).drop("label")
        own = results.select("student", "subject", "value", "status", "approved", "final")
        return {
            "students": students.drop("cluster"), "results": results, "seasons": seasons, "other_versions": R.other_versions(entries, ORDER), "conflicts": P.notices(conflicts, who.where("severity = 'warning'")),
            "warnings": P.notices(who.where("severity = 'info'"), alike, merged, without), "subjects": P.subject_order(curriculum), "subject_groups": P.subject_groups(curriculum.select("subject", "year", "semester")),
            "subject_files": sheets.groupBy(F.col("canonical").alias("subject")).agg(F.array_sort(F.collect_set("filename")).alias("files")), "seen": seen,
            "averages": R.student_averages(own, curriculum), "missing_curriculum": R.missing_curriculum(own, curriculum),
            "coverage": R.plan_coverage(own, known.join(typed.select("subject", "course"), "subject", "left")), "missing": R.plan_missing(own, known.join(typed.select("subject", "course"), "subject", "left")),
            "subject_stats": R.subject_stats(subjects, own, seen), "stats": R.global_stats(own), "settings": spark.createDataFrame([(json.dumps(st.to_dict(), ensure_ascii=False),)], "settings string"),
        }

    def messages(self, notices: DataFrame, lang: str | None = None) -> DataFrame:
        """Notices with their text in a language."""
        key = F.concat(F.lit("notice."), F.col("type"))
        params = F.create_map(F.lit("n"), "detail", F.lit("source"), "detail", F.lit("chosen"), F.coalesce("subject", F.lit("")), F.lit("left"), F.coalesce("student", F.lit("")), F.lit("right"), "detail")
        return notices.withColumn("message", render(key, params, F.lit(lang or self.settings.language)))

    def result_json(self) -> DataFrame:
        """The whole result as lines of JSON: (part, json) for every row of every part of the bundle."""
        out = None
        for part, rows in self.result().items():
            lines = rows.select(F.lit(part).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
            out = lines if out is None else out.unionByName(lines)
        return out

    def to_json(self, lang: str | None = None) -> DataFrame:
        """(student, json): one text for each student, seasons and averages nested, with labels in a language."""
        r, lang = self.result(), F.lit(lang or self.settings.language)
        said = lambda kind, c: F.when(c.isNotNull(), template(F.concat(F.lit(f"{kind}."), c), lang))
        grade = lambda v, s: F.struct(v.alias("value"), s.alias("status"), F.when(v.isNotNull(), format_grade(v)).otherwise(said("status", s)).alias("label"))
        sheets = self.sheets().select(F.col("source_id").alias("source"), "label")
        lost = r["other_versions"].join(sheets, "source", "left").groupBy("student", "subject", "season_ord").agg(
            *[F.array_sort(F.collect_list(F.when(F.col("lost_as") == kind, F.struct("source", "label", "value", "status", said("route", F.col("route")).alias("route"))))).alias(f"other_{kind}s") for kind in ("version", "route")]
        )
        none = lambda c: F.coalesce(c, F.array().cast("array<struct<source:string,label:string,value:double,status:string,route:string>>"))
        seasons = r["seasons"].join(sheets, "source", "left").join(lost, ["student", "subject", "season_ord"], "left")
        season = F.struct(
            F.col("season").alias("epoca"), said("season", F.col("season")).alias("label"), grade(F.col("value"), F.col("status")).alias("grade"), F.col("label").alias("source_label"), "column", "route",
            said("route", F.col("route")).alias("route_label"), none("other_versions").alias("other_versions"), none("other_routes").alias("other_routes"),
        )
        nested = seasons.groupBy("student", "subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("season", season)))).alias("epocas"))
        key = F.element_at(F.array(*map(F.lit, V.SEASONS)), F.col("best_season") + 1)
        best = F.when(F.col("value").isNotNull() | F.col("status").isNotNull(), grade(F.col("value"), F.col("status")))
        before = F.when(F.col("edited") & (F.col("original_value").isNotNull() | F.col("original_status").isNotNull()), grade(F.col("original_value"), F.col("original_status")))
        subject = F.struct("subject", "epocas", "pass_mark", key.alias("best_epoca"), F.coalesce(said("season", key), F.lit("—")).alias("best_epoca_label"), best.alias("best"), F.col("final").alias("best_rounded"), "approved", "edited", before.alias("original"))
        by_subject = lambda a, b: F.when(a["subject"] < b["subject"], -1).otherwise(1)
        of = r["results"].join(nested, ["student", "subject"], "left").groupBy("student").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subject", subject)), by_subject)).alias("subjects"))
        means = r["averages"].groupBy("student").agg(F.array_sort(F.collect_list(F.struct("level", "year", "semester", "mean", "count", "weighted", "rounded"))).alias("averages"))
        rows = r["students"].join(of, "student", "left").join(means, "student", "left")
        return rows.select("student", F.to_json(F.struct(F.col("student").alias("key"), "name", "student_id", "all_ids", "all_names", "averages", "subjects"), {"ignoreNullFields": "false"}).alias("json"))

    def write_json(self, path: str, lang: str | None = None) -> None:
        """The whole result as one JSON document, in a language: its parts, one after the other in the order of their
        names, are the text. Tasks write the lines; no row comes to the driver."""
        r = self.result()
        parts = [("students", self.to_json(lang).select("student", "json"))]
        for name in ("conflicts", "warnings"):
            parts.append((name, self.messages(r[name], lang).select(F.to_json(F.struct("*")).alias("json"))))
        for name in ("subjects", "subject_stats", "subject_files", "subject_groups", "missing_curriculum", "coverage", "stats", "settings"):
            parts.append((name, r[name].select(F.to_json(F.struct("*")).alias("json"))))
        lines = None
        for at, (name, rows) in enumerate(parts):
            rows = table_of(rows.select("json"), f"json-{name}")
            last = rows.agg(F.max("json")).first()[0]  # the last in order has no comma
            counts = rows.groupBy("json").agg(F.count(F.lit(1)).alias("n"))
            own = counts.select(F.lit(at).alias("part"), F.lit(1).alias("place"), "json", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("nth"))
            comma = F.when((F.col("json") == F.lit(last)) & (F.col("nth") == F.col("n")), "").otherwise(",")
            own = own.select("part", "place", F.concat("json", comma).alias("text"), F.col("json").alias("line"), "nth")
            ends = [(at, 0, ("{" if at == 0 else "") + f'"{name}":[', "", 0), (at, 2, "]}" if at == len(parts) - 1 else "],", "", 0)]
            own = own.unionByName(self._frame(ends, "part int, place int, text string, line string, nth long"))
            lines = own if lines is None else lines.unionByName(own)
        lines.orderBy("part", "place", "line", "nth").select("text").write.text(path)

    def export_xlsx(self, path: str, students: list[str] | None = None, subjects: list[str] | None = None) -> None:
        """A workbook of a selection, in its order: summary, a sheet for each subject, averages, detail and notices."""
        r = self.result()
        people, results = r["students"], r["results"]
        students = K.ordered(self.picks) if students is None and self.picks else students
        if students is not None:
            picked = P.select_students(people, self._frame(list(enumerate(students)), "pos long, pick string"))
        else:
            picked = people.withColumn("pos", F.lit(0).cast("long"))
        people = rows_of(picked.orderBy("pos", sort_key("name"), "student"))
        keys = self._frame([(p["student"],) for p in people], "student string")
        results = results.join(F.broadcast(keys), "student", "left_semi")  # as many as the report has, which is bounded
        final = {(x["student"], x["subject"]): x for x in rows_of(results)}
        used = {subject for _, subject in final}
        order = [x for x in rows_of(r["subjects"].orderBy("place")) if x["subject"] in used and (subjects is None or x["subject"] in subjects)]
        of_keys = lambda name: rows_of(r[name].join(F.broadcast(keys), "student", "left_semi"))
        seasons = of_keys("seasons")
        sources = self._frame([(x,) for x in sorted({r["source"] for r in seasons})], "source_id string")
        labels = {x["source_id"]: x["label"] for x in rows_of(self.sheets().join(F.broadcast(sources), "source_id").select("source_id", "label"))}
        files = {x["subject"]: x["files"] for x in rows_of(r["subject_files"])}
        selection = Selection(
            people=people, subjects=[x["subject"] for x in order], results=final, seasons={(x["student"], x["subject"], x["season_ord"]): x for x in seasons}, averages=of_keys("averages"),
            curriculum={x["subject"]: x for x in order}, notices=rows_of(self.messages(P.notices(r["conflicts"], r["warnings"]))), pass_mark=self.settings.pass_mark, language=self.settings.language, labels=labels, files=files,
        )
        at, fs = self._fs(path)
        stream = fs.create(at, True)
        stream.write(bytearray(workbook(sheets_of(selection))))
        stream.close()


def _toggled(held: list[str], value: str, yes: bool) -> list[str]:
    return [*(x for x in held if x != value), *([value] if yes else [])]


def clean_name(name: str) -> str:
    return " ".join(name.split())


def clean_text_or_null(c: str):
    return F.when(F.col(c).isNotNull(), clean_text(c))
