"""Queries that write sheets from the driver's tables into the shared folder, read them in and consolidate them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.engine import Engine
from rollbook.functions import text as T
from rollbook.operators import inference as N
from rollbook.operators import layout as Y
from rollbook.operators import overlays as O
from rollbook.plans.catalog import Catalog
from rollbook.plans.lens import table
from rollbook.session import new_folder, table_of
from rollbook.sinks.workbook import Sheet, workbook
from rollbook.sources.files import cells, read_sheets, sheets_in
from rollbook.sources.metadata import with_metadata

CATALOG = Catalog()
query = CATALOG.query
HEAD = ("Nome", "Nº Aluno", "Nota Final")
#: Customers of one page, workbook or text at most.
PAGE_ROWS, BOOK_ROWS, BLOCK_ROWS = 40, 10_000, 5_000
#: Bytes of a file beyond which it is read in pieces.
SPLIT = 1024

# ---------------------------------------------------------------- sheets of customers

#: Grades by nation: numbers, failures and blanks; by segment: halves, absences and blanks.
_GRADE1 = "case when c_custkey % 11 = 0 then 'RE' when c_custkey % 13 = 0 then '' else cast(c_custkey * 7 % 21 as varchar) end"
_GRADE2 = "case when c_custkey % 5 = 0 then '' when c_custkey % 7 = 0 then 'Faltou' else cast(c_custkey * 3 % 20 as varchar) || ',5' end"
#: Files are counted in the order of their paths.
_FILES = """nations as (select c_nationkey, row_number() over (order by cast(c_nationkey as varchar)) as k from (select distinct c_nationkey from customer)),
segments as (select c_mktsegment, row_number() over (order by c_mktsegment) as k from (select distinct c_mktsegment from customer))"""


def _grade1() -> Column:
    k = F.col("c_custkey")
    return F.when(k % 11 == 0, "RE").when(k % 13 == 0, "").otherwise((k * 7 % 21).cast("string"))


def _grade2() -> Column:
    k = F.col("c_custkey")
    return F.when(k % 5 == 0, "").when(k % 7 == 0, "Faltou").otherwise(F.concat((k * 3 % 20).cast("string"), F.lit(",5")))


def _sheets(spark: SparkSession, sf_dir: str, by: Column, grade: Column) -> DataFrame:
    """(g, o, a, b, c): a header and a row for each customer, in order o within a sheet g."""
    c = table(spark, sf_dir, "customer")
    head = c.select(by.alias("g")).distinct().select("g", F.lit(-1).cast("bigint").alias("o"), *[F.lit(h).alias(x) for h, x in zip(HEAD, "abc", strict=True)])
    rows = c.select(by.alias("g"), F.col("c_custkey").cast("bigint").alias("o"), F.col("c_name").alias("a"), (F.col("c_custkey") + 900000).cast("string").alias("b"), grade.alias("c"))
    return head.unionByName(rows)


def _written(sheets: DataFrame, kind: str, **options: str) -> str:
    """A file for each sheet, its rows in order; the folder of the files."""
    folder = new_folder(sheets.sparkSession, f"sheets-{kind}")
    rows = sheets.repartition("g").sortWithinPartitions("g", "o")
    if kind == "csv":
        rows.select("g", "a", "b", "c").write.partitionBy("g").options(**({"sep": ";"} | options)).csv(folder)
    else:
        line = F.concat(F.rpad("a", 24, " "), F.rpad("b", 12, " "), F.col("c"))
        rows.select("g", line.alias("line")).write.partitionBy("g").text(folder)
    return folder


#: Separators and encodings of files, by nation.
_FORMS = ({"sep": ";", "encoding": "UTF-8"}, {"sep": ",", "encoding": "ISO-8859-1"}, {"sep": "|", "encoding": "UTF-16"}, {"sep": "\t", "encoding": "UTF-8"})
#: A block of customers of a nation is a sheet.
_BLOCK = f"concat_ws('-', cast(c_nationkey % {len(_FORMS)} as {{text}}), cast(c_nationkey as {{text}}), cast(c_custkey {{by}} {BLOCK_ROWS} as {{text}}))"
_BLOCKS = f"blocks as (select *, {_BLOCK.format(text='varchar', by='//')} as g from customer), files as (select g, row_number() over (order by g) as k from (select distinct g from blocks))"
_CELLS = f"""with {_BLOCKS}, rows as (select k, 0 as row, 'Nome' as a, 'Nº Aluno' as b, 'Nota Final' as c from files
 union all select k, row_number() over (partition by k order by c_custkey), c_name, cast(900000 + c_custkey as varchar), {_GRADE1} from blocks join files using (g))
select 'f' || k || 's0' as source_id, row, unnest([0, 1, 2]) as col, unnest([a, b, c]) as text from rows"""


def _block() -> Column:
    return F.expr(_BLOCK.format(text="string", by="div"))


@query(_CELLS)
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separated files of blocks of customers, of four separators and encodings, read back to cells; those of
    more than SPLIT bytes in pieces."""
    sheets = _sheets(spark, sf_dir, _block(), _grade1())
    at = new_folder(spark, "sheets-csv")
    for i, form in enumerate(_FORMS):
        own = sheets.where(F.substring_index("g", "-", 1) == str(i)).repartition("g").sortWithinPartitions("g", "o")
        own.select("g", "a", "b", "c").write.partitionBy("g").options(**form).csv(f"{at}/{i}")
    return cells(read_sheets(spark, f"{at}/*/*/*.csv", split_bytes=SPLIT)[1])


@query(_CELLS)
def txt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the same in columns of a fixed width."""
    return cells(read_sheets(spark, f"{_written(_sheets(spark, sf_dir, _block(), _grade1()), 'txt')}/*/*.txt")[1])


@query(f"""with rows as (select c_nationkey, c_custkey // {BOOK_ROWS} as part, 0 as row, 'Nome' as a, 'Nº Aluno' as b, 'Nota Final' as c, '' as sheet from customer group by 1, 2
 union all select c_nationkey, c_custkey // {BOOK_ROWS}, row_number() over (partition by c_nationkey, c_custkey // {BOOK_ROWS} order by c_custkey), c_name, cast(900000 + c_custkey as varchar), {_GRADE1}, '' from customer),
files as (select c_nationkey, part, row_number() over (order by c_nationkey || '-' || part || '.xlsx') as k from (select distinct c_nationkey, part from rows))
select 'f' || k || 's0' as source_id, 'sheet:N ' || c_nationkey || '-' || part as location, row, unnest([0, 1, 2]) as col, unnest([a, b, c]) as text from rows join files using (c_nationkey, part)""")
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of up to BOOK_ROWS customers of a nation, made by tasks and read by the source as files in rows."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") / BOOK_ROWS).cast("bigint").alias("part"), "c_custkey", "c_name", (F.col("c_custkey") + 900000).cast("string").alias("id"), _grade1().alias("grade"))

    def book(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sheet = Sheet(f"N {key[0]}/{key[1]}")  # a sign that names of sheets may not have
        sheet.add("")
        sheet.add(*HEAD)
        for r in pdf.sort_values("c_custkey").itertuples():
            sheet.add(r.c_name, r.id, int(r.grade) if r.grade.isdigit() else r.grade)
        return pd.DataFrame([(f"{key[0]}-{key[1]}.xlsx", workbook([sheet]))], columns=["path", "content"])

    tables, rows = sheets_in(table_of(c.groupBy("c_nationkey", "part").applyInPandas(book, "path string, content binary"), "books"))
    return cells(rows).join(tables.select("source_id", "location"), "source_id")


# ---------------------------------------------------------------- the engine, from files to results


def _called(spark: SparkSession, folder: str) -> str:
    """The folder, with each of its few files called after its sheet: a name given by a writer is chance, and names say things."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for sheet in fs.listStatus(at):
        for file in fs.listStatus(sheet.getPath()) if sheet.isDirectory() else []:
            if file.getPath().getName().endswith(".csv"):
                fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(at, f"folha_{sheet.getPath().getName()[2:]}.csv"))
    return folder


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Sheets by nation, then by market segment; their subjects are named by answers. There are few files of each kind."""
    e = Engine(spark, new_folder(spark, "engine"))
    c = table(spark, sf_dir, "customer")
    nations = sorted(str(r[0]) for r in c.select("c_nationkey").distinct().collect())
    segments = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())
    for by, grade in ((F.col("c_nationkey").cast("string"), _grade1()), (F.col("c_mktsegment"), _grade2())):
        e.ingest(f"{_called(spark, _written(_sheets(spark, sf_dir, by, grade), 'csv'))}/*.csv")
    said = {f"f{k}s0:subject": f"Subject {int(n) % 5}" for k, n in enumerate(nations, 1)}
    said |= {f"f{k}s0:subject": f"Subject {i}" for i, k in enumerate(range(len(nations) + 1, len(nations) + 1 + len(segments)))}
    e.update(answers=said)
    return e


_ENTRIES = f"""{_FILES}, entries as (select c_custkey, 'Subject ' || c_nationkey % 5 as subject, k, {_GRADE1} as raw from customer join nations using (c_nationkey)
 union all select c_custkey, 'Subject ' || (k - 1), k + (select count(*) from nations), {_GRADE2} from customer join segments using (c_mktsegment)),
best as (select c_custkey, subject, arg_max(raw, k) as raw, count(distinct raw) as different from entries where raw <> '' {{where}} group by 1, 2)"""
_VALUE = "try_cast(replace(raw, ',', '.') as double)"
_STATUS = "case raw when 'RE' then 'REPROVADO' when 'Faltou' then 'FALTOU' end"


@query(f"""with {_ENTRIES.format(where="")}, seen as (select distinct c_custkey, subject from entries), r as (select s.subject, b.raw from seen s left join best b using (c_custkey, subject))
select 'result' as part, 'id:' || (900000 + c_custkey) as student, subject, {_STATUS} as status, {_VALUE} as value, case when raw in ('RE', 'Faltou') or floor({_VALUE} + 0.5) < 9.5 then 0 else 1 end as approved, cast(null as bigint) as failed, cast(null as bigint) as pending from best
union all select 'conflict', 'id:' || (900000 + c_custkey), subject, 'nota', cast(different as double), null, null, null from best where different > 1
union all select 'subject', null, subject, null, round(avg(floor({_VALUE} + 0.5)), 2), count(*) filter (where floor({_VALUE} + 0.5) >= 9.5), count(*) filter (where raw in ('RE', 'Faltou') or floor({_VALUE} + 0.5) < 9.5), count(*) filter (where raw is null) from r group by subject""")
def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all ingested sheets (of two grades the later file's counts), what
    differs between files, and counts by subject with listed students who have no grade."""
    r = _engine(spark, sf_dir).result()
    results = r["results"].select(F.lit("result").alias("part"), "student", "subject", "status", "value", F.col("approved").cast("bigint").alias("approved"))
    conflicts = r["conflicts"].where("type = 'nota'").select(F.lit("conflict").alias("part"), "student", "subject", F.col("type").alias("status"), F.col("detail").cast("double").alias("value"))
    subjects = r["subject_stats"].select(F.lit("subject").alias("part"), "subject", F.col("average").alias("value"), "approved", "failed", "pending")
    return results.unionByName(conflicts, allowMissingColumns=True).unionByName(subjects, allowMissingColumns=True)


@query(f"""with {_ENTRIES.format(where="and k <> 1 and c_custkey <> 3 and subject <> 'Subject 2'")}, edits as (select * from (values (5, 'Subject 1', 17.5), (8, 'Subject 9', 4.0)) v(c_custkey, subject, edit)),
b as (select coalesce(b.c_custkey, e.c_custkey) as c_custkey, coalesce(b.subject, e.subject) as subject, coalesce(e.edit, {_VALUE}) as value, case when e.edit is null then {_STATUS} end as status, {_VALUE} as original, e.edit is not null as edited
 from best b full outer join edits e on b.c_custkey = e.c_custkey and b.subject = e.subject)
select 'id:' || (900000 + c_custkey) as student, subject, cast(value as double) as value, status, edited, case when edited then original end as original_value,
case when value is not null then floor(value + 0.5) >= 12 - 1e-9 when status is not null then false end as approved from b""")
def engine_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's grades made components, a student and a subject left out, grades typed, a higher pass mark."""
    e = _engine(spark, sf_dir)
    e.update(overrides={"f1s0": {"2": {"kind": "component"}}}, settings={"pass_mark": 12, "grade_overrides": {"id:900005": {"Subject 1": "17,5"}, "id:900008": {"Subject 9": 4}}})
    e.remove_student("id:900003")
    e.remove_subject("Subject 2")
    again = Engine(spark, e.folder)  # as kept
    return again.result()["results"].select("student", "subject", "value", "status", "edited", "original_value", "approved")


@query(f"""with {_ENTRIES.format(where="and k not in (1, 2)")}
select 'result' as part, 'id:' || (900000 + c_custkey) as id, subject, {_STATUS} as status, {_VALUE} as value from best
union all select 'document', 'f3s0', b, c, cast(null as double) from (select cast(900000 + c_custkey as varchar) as b, {_GRADE1} as c from customer join nations using (c_nationkey) where k = 3 union all select 'Nº Aluno', 'Nota Final')
union all select 'question', 'f1s0:final', 'final_column', 'warning', 2.0
union all select 'warning', 'pauta sem nota final', 'Subject ' || c_nationkey % 5, 'warning', null from nations where k = 1
union all select 'confirmed', 'f3s0', null, null, null""")
def engine_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet's only grade made a component, which is asked and warned about; two sheets
    confirmed; a file removed, with what was decided about it; then, from the state as written: what is asked, the results
    of what is left, one file's rows, and what is confirmed."""
    e = _engine(spark, sf_dir)
    e.update(overrides={"f1s0": {"2": {"kind": "component"}}, "f2s0": {"2": {"kind": "component"}}})
    e.confirm("f2s0")
    e.confirm("f3s0")
    e.remove_file(e.tables().where("source_id = 'f2s0'").first()["filename"])
    again = Engine(spark, e.folder)
    r, asked = again.result(), again.review()["questions"]
    null = lambda kind="string": F.lit(None).cast(kind)
    results = r["results"].select(F.lit("result").alias("part"), F.col("student").alias("id"), "subject", "status", "value")
    rows = again.document("f3s0")[1].select(F.lit("document"), "source_id", F.get("cells", F.lit(1)), F.get("cells", F.lit(2)), null("double"))
    questions = asked.where("type = 'final_column'").select(F.lit("question"), "id", "type", "severity", F.col("default").try_cast("double"))
    warnings = r["warnings"].where("type = 'pauta sem nota final'").select(F.lit("warning"), "type", "subject", "severity", null("double"))
    confirmed = spark.createDataFrame([(x,) for x in again.settings.confirmed_sources], "id string").select(F.lit("confirmed"), "id", null(), null(), null("double"))
    return results.union(rows).union(questions).union(warnings).union(confirmed)


@query(f"""with {_ENTRIES.format(where="")}, top as (select c_custkey, subject, raw, k, {_VALUE} as value, {_STATUS} as status, row_number() over (partition by c_custkey, subject order by k desc) as n from entries where raw <> '')
select 'id:' || (900000 + c_custkey) as student, subject, '1.ª Época' as season, value, case status when 'REPROVADO' then 'Reprovado' when 'FALTOU' then 'Faltou' end as status, cast(floor(value + 0.5) as bigint) as final,
 case when value is not null then floor(value + 0.5) >= 9.5 else false end as approved, (select count(*) from top o where o.c_custkey = top.c_custkey and o.subject = top.subject and o.n > 1) as others from top where n = 1""")
def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result as one JSON document, written by tasks and read again: seasons, grades and versions in words."""
    e = _engine(spark, sf_dir)
    at = f"{e.folder}/document"
    e.write_json(at)
    lines = spark.read.text(at)
    student = "key string, subjects map<string, struct<epocas: map<string, struct<label: string, grade: struct<value: double, status: string, label: string>, other_versions: array<struct<source: string>>>>, best_rounded: bigint, approved: boolean>>"
    of = lines.where(F.col("value").startswith('{"key"')).select(F.from_json(F.regexp_replace("value", ",$", ""), student).alias("s"))
    of = of.select(F.col("s.key").alias("student"), F.explode("s.subjects").alias("subject", "x")).select("student", "subject", F.explode("x.epocas").alias("e", "g"), "x.best_rounded", "x.approved")
    words = F.when(F.col("g.grade.status").isNotNull(), F.col("g.grade.label"))
    return of.select("student", "subject", F.col("g.label").alias("season"), F.col("g.grade.value").alias("value"), words.alias("status"), F.col("best_rounded").alias("final"), "approved", F.size("g.other_versions").cast("bigint").alias("others"))


# ---------------------------------------------------------------- metadata, questions


_TABLES = """t as (select p_partkey, p_size, upper(left(p_type, 1)) || lower(p_type[2:]) as kind, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') as name from part)"""


@query(f"""with {_TABLES} select p_partkey, case when p_size % 4 = 0 then name || ' Aplicada' when p_size % 4 > 1 then name || ' de ' || kind end as subject,
cast(case p_size % 4 when 0 then 0.35 when 1 then 0 when 2 then 0.9 else 0.85 end as double) as subject_confidence,
case when p_size % 4 = 2 then lpad(cast(p_partkey as varchar), 8, '0') end as subject_code, case when p_size % 4 > 1 then cast(p_size % 2 + 1 as varchar) end as semester,
case when p_size % 4 > 1 then '2023/2024' end as academic_year, '2024-' || lpad(cast(p_size % 12 + 1 as varchar), 2, '0') || '-' || lpad(cast(p_size % 28 + 1 as varchar), 2, '0') as document_date,
case when p_size % 4 = 1 then 'Teste ' || (p_size % 3 + 1) end as component_label, cast(case when p_size % 4 = 1 then 30 end as int) as component_weight,
case p_size % 3 when 0 then 'epoca1' when 1 then 'epoca2' end as file_season from t""")
def sheet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, code, semester, year, date, component and season of a sheet for each part."""
    k, name = F.col("p_size") % 4, T.title_name("p_name")
    full = F.concat(name, F.lit(" de "), F.initcap("p_type"))
    term = F.concat((F.col("p_size") % 2 + 1).cast("string"), F.lit(".º semestre 2023/24"))
    code = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    none = F.array().cast("array<string>")
    titles = F.when(k == 0, none).when(k == 1, F.array(F.concat(F.lit("Teste "), (F.col("p_size") % 3 + 1).cast("string"), F.lit(" (30%)"))))
    titles = titles.when(k == 2, F.array(F.concat(code, F.lit(" - "), F.upper(F.substring("p_type", 1, 3)), F.lit(" - "), full), term)).otherwise(F.array(F.concat(F.lit("Universidade Nova | "), full, F.lit(" | "), term)))
    m = F.col("p_size") % 3
    t = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(m == 0, "Pauta_1E.xlsx").when(m == 1, "a/recurso.csv").otherwise("x.csv").alias("filename"), F.when(k == 0, F.concat(name, F.lit(" Aplicada"))).alias("sheet_name"), titles.alias("title_lines"),
        F.array(F.concat(F.lit("Lisboa, "), (F.col("p_size") % 28 + 1).cast("string"), F.lit("/"), (F.col("p_size") % 12 + 1).cast("string"), F.lit("/2024"))).alias("footer_lines"),
    )
    return with_metadata(t).select("p_partkey", "subject", "subject_confidence", "subject_code", "semester", "academic_year", "document_date", "component_label", "component_weight", "file_season")


@query("""with s as (select p_partkey as source_id, case when p_size % 3 > 0 then p_name end as subject, p_size / 50.0 as confidence, p_size % 7 as k from part)
select source_id || ':subject' as id, 'subject' as type, source_id, case when subject is null then 'warning' else 'info' end as severity, subject as "default" from s where subject is null or confidence < 0.6
union all select source_id || ':final', 'final_column', source_id, 'warning', '2' from s where k = 0
union all select source_id || ':final:epoca1', 'final_column', source_id, 'info', '2' from s where k = 1
union all select source_id || ':moment:2', 'moment', source_id, 'warning', 'epoca2' from s where k = 2
union all select source_id || ':epoca', 'epoca', source_id, 'warning', 'epoca1' from s where k = 3
union all select source_id || ':scale:2', 'scale', source_id, 'info', '20' from s where k = 4 and source_id % 2 = 0""")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is undecided about a sheet for each part, of two grade columns; some scale questions are answered."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("subject"), (F.col("p_size") / F.lit(50.0)).alias("subject_confidence"), (F.col("p_size") % 7).alias("k"))
    k, second = F.col("k"), F.col("col") == 2
    columns = p.select("source_id", "k", F.explode(F.array(F.lit(1), F.lit(2))).alias("col")).select(
        "source_id", "col", F.lit("grade").alias("role"), F.when(second & (k != 0), "final").otherwise("component").alias("kind"), F.when(k == 1, 0.5).otherwise(0.8).alias("confidence"),
        F.when(k == 2, "epoca2").when(k != 3, "epoca1").alias("season"), F.when(second & (k == 2), 2).otherwise(1).alias("moment"), F.when(k == 4, 9.0).otherwise(18.0).alias("max_value"), F.lit(20.0).alias("scale"),
    )
    answered = p.where("source_id % 2 = 1").select(F.concat(F.col("source_id").cast("string"), F.lit(":scale:2")).alias("id"))
    return O.questions(p, columns, answered)


@query("""select o_orderpriority as source_id, v.col, v.header, v.role, v.kind, v.season, v.route, cast(v.confidence as double) as confidence from (select distinct o_orderpriority from orders) cross join
(values (0, 'Nome', 'name', null, null, null, 0.95), (1, 'Nº Aluno', 'id', null, null, null, 0.95), (2, 'Teste 1', 'grade', 'component', 'epoca1', 'continua', 0.6), (3, 'Nota Final', 'grade', 'final', 'epoca1', null, 0.8),
 (4, 'Recurso', 'grade', 'final', 'epoca2', 'exame', 0.75), (5, 'Obs', 'ignore', null, null, null, 0.7)) v(col, header, role, kind, season, route, confidence)""")
def column_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets by priority; the roles, seasons and routes that their headers and cells mean."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    row = F.array(F.lit("Ana Silva"), (F.col("o_custkey") + 900000).cast("string"), (F.col("o_custkey") % 20).cast("string"), F.when(k % 7 == 0, "RE").otherwise((k % 21).cast("string")), F.when(k % 3 == 0, (k % 19).cast("string")).otherwise(""), F.col("o_orderstatus"))
    data = o.select(F.col("o_orderpriority").alias("source_id"), (k + 1).cast("bigint").alias("row"), F.posexplode(row).alias("col", "text"))
    head = F.array(*map(F.lit, ["Nome", "Nº Aluno", "Teste 1", "Nota Final", "Recurso", "Obs"]))
    heads = o.select(F.col("o_orderpriority").alias("source_id")).distinct().select("source_id", F.lit(0).cast("bigint").alias("row"), F.posexplode(head).alias("col", "text"))
    sheets = table_of(heads, "heads").unionByName(data)
    columns, _ = N.classify_columns(sheets, N.header_rows(sheets))
    return columns.select("source_id", "col", "header", "role", "kind", "season", "route", "confidence")


# ---------------------------------------------------------------- pages of word boxes


def _page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of pages of PAGE_ROWS customers: a title, a header, and number, two words of a name and a grade a line."""
    c = table(spark, sf_dir, "customer").select(((F.col("c_custkey") / PAGE_ROWS).cast("int") + 1).alias("page"), (F.col("c_custkey") % PAGE_ROWS).alias("n"), (F.col("c_custkey") + 900000).cast("string").alias("number"), F.initcap("c_mktsegment").alias("first"), (F.col("c_custkey") * 7 % 21).cast("string").alias("grade"))
    box = lambda x, t: F.struct(F.lit(x).cast("double").alias("x0") if not isinstance(x, Column) else x.cast("double").alias("x0"), t.alias("text"))
    body = c.select("page", (F.lit(60.0) + F.col("n") * 10).alias("top"), F.explode(F.array(box(40, F.col("number")), box(100, F.col("first")), box(F.lit(103) + 3 * F.length("first"), F.lit("Silva")), box(200, F.col("grade")))).alias("w"))
    over = F.array(F.struct(F.lit(10.0).alias("top"), box(50, F.lit("Pauta")).alias("w")), *[F.struct(F.lit(40.0).alias("top"), box(x, F.lit(t)).alias("w")) for x, t in ((40, "Numero"), (100, "Nome"), (200, "Nota"))])
    head = c.select("page").distinct().select("page", F.explode(over).alias("h")).select("page", "h.top", "h.w")
    return body.unionByName(head).select(F.lit("d").alias("doc"), "page", "w.text", "w.x0", (F.col("w.x0") + 3 * F.length("w.text")).alias("x1"), "top", (F.col("top") + 5.85).alias("bottom"))


@query(f"""with c as (select c_custkey // {PAGE_ROWS} + 1 as page, c_custkey % {PAGE_ROWS} + 1 as row, [cast(900000 + c_custkey as varchar), upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) || ' Silva', cast(c_custkey * 7 % 21 as varchar)] as t from customer),
r as (select page, row, t from c union all select distinct page, 0, ['Numero', 'Nome', 'Nota'] from c)
select page, row, unnest([0, 1, 2]) as col, unnest(t) as text from r""")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8, A8a-A8j: tables out of word boxes, page by page."""
    return Y.tables(_page_words(spark, sf_dir)).select("page", "row", "col", "text")


@query(f"select c_custkey // {PAGE_ROWS} + 1 as page, c_custkey % {PAGE_ROWS} + 2 as line, 3 as segments from customer union all select distinct c_custkey // {PAGE_ROWS} + 1, unnest([0, 1]), unnest([1, 3]) from customer")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8a, A8j: words in lines, and lines in pieces of text apart."""
    s = Y.segments(Y.lines(_page_words(spark, sf_dir)))
    return s.groupBy("page", "line").agg(F.count(F.lit(1)).alias("segments"))


@query("""with p as (select p_brand as doc, p_partkey % 2 + 1 as page, p_name, cast(p_size as varchar) as grade, row_number() over (partition by p_brand, p_partkey % 2 order by p_partkey) as row from part),
h as (select distinct doc from p), two as (select doc from p group by 1 having count(distinct page) = 2)
select doc, page, row, unnest(case page when 1 then [0, 1] else [0, 2, 1] end) as col, unnest(case page when 1 then [p_name, grade] else [p_name, 'x', grade] end) as text from p where doc in (from two)
union all select doc, unnest([1, 1, 2, 2, 2]), 0, unnest([0, 1, 0, 2, 1]), unnest(['Nome', 'Nota', 'Nome', 'Extra', 'nota']) from two""")
def stitched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of a document for each brand, the second with a further column between."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), (F.col("p_partkey") % 2 + 1).cast("int").alias("page"), "p_partkey", "p_name", F.col("p_size").cast("string").alias("grade"))
    both = p.groupBy("doc").agg(F.countDistinct("page").alias("n")).where("n = 2").select("doc")
    p = p.join(both, "doc").withColumn("row", F.expr("row_number() over (partition by doc, page order by p_partkey)"))
    body = p.select("doc", "page", "row", F.posexplode(F.when(F.col("page") == 1, F.array("p_name", "grade")).otherwise(F.array(F.col("p_name"), F.lit("x"), F.col("grade")))).alias("col", "text"))
    lit = lambda *t: F.array(*map(F.lit, t))
    head = both.select("doc", F.explode(F.array(F.struct(F.lit(1).alias("page"), lit("Nome", "Nota").alias("t")), F.struct(F.lit(2).alias("page"), lit("Nome", "Extra", "nota").alias("t")))).alias("h")).select("doc", "h.page", F.lit(0).alias("row"), F.posexplode("h.t").alias("col", "text"))
    return Y.stitch(head.unionByName(body)).select("doc", "page", "row", F.col("col").cast("int").alias("col"), "text")


@query("""with n as (select p_brand as doc, p_partkey // 40 as page, count(*) as n from part group by 1, 2 having count(*) >= 2) select doc, page, 1 as candidate, 2 * (n + 1) as cells from n""")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two readings of a page the one with a header and full columns."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), (F.col("p_partkey") / 40).cast("bigint").alias("page"), "p_partkey", T.title_name("p_name").alias("name"), (F.col("p_size") % 21).cast("string").alias("grade"))
    p = p.withColumn("row", F.expr("row_number() over (partition by doc, page order by p_partkey)"))
    heads = p.select("doc", "page").distinct().select("doc", "page", F.lit(0).alias("row"), F.lit("Nome").alias("name"), F.lit("Nota").alias("grade"))
    rows = heads.unionByName(p.select("doc", "page", "row", "name", "grade"))
    # the poor reading has everything in its first column
    poor = rows.select("doc", "page", F.lit(0).alias("candidate"), "row", F.posexplode(F.array(F.concat_ws("", "name", "grade"), F.lit(""), F.lit(""))).alias("col", "text"))
    good = rows.select("doc", "page", F.lit(1).alias("candidate"), "row", F.posexplode(F.array("name", "grade")).alias("col", "text"))
    best = Y.best_tables(poor.unionByName(good), ["doc", "page"], "candidate")
    return best.groupBy("doc", "page", "candidate").agg(F.count(F.lit(1)).alias("cells"))
