"""Queries of the consolidation core over the lens, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.grades import format_grade, guess_scale, is_empty, rank_of, rescale, round_grade, with_grade
from rollbook.operators import reports as P
from rollbook.operators import results as R
from rollbook.plans import lens as L
from rollbook.plans.catalog import Catalog
from rollbook.session import arrive, drop_folder, new_folder, table_of
from rollbook.streaming import incremental

CATALOG = Catalog()
query = CATALOG.query
SUBJECTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"with {L.BASE_SQL} select student, subject, season_ord, source, raw, document_date from base")
def scan_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with subject and source looked up."""
    return L.base(spark, sf_dir).select("student", "subject", "season_ord", "source", "raw", "document_date")


@query(f"with {L.BASE_SQL} select student, subject, value, status, tier, score from ranked where not (value is null and status = 'SEM_NOTA')")
def filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, ranked, empty ones dropped."""
    e = L.entries(spark, sf_dir, deal=False)
    r = rank_of(F.col("value"), F.col("status"))
    return e.where(~is_empty(F.col("value"), F.col("status"))).select("student", "subject", "value", "status", r["tier"].alias("tier"), r["score"].alias("score"))


@query(f"with {L.BASE_SQL} select raw, count(*) as n, min(value) as value, min(status) as status from entries group by raw")
def parse_grade_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 over every spelling in the lens."""
    texts = L.base(spark, sf_dir).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))  # each spelling is read once
    return with_grade(texts, "raw", name="g").select("raw", "n", F.col("g.value").alias("value"), F.col("g.status").alias("status"))


@query(f"with {L.BASE_SQL} select value, count(*) as n, cast(floor(value + 0.5) as bigint) as final, round(value * 100 / 20, 4) as value100 from entries where value is not null group by value")
def round_and_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17, C18."""
    e = L.entries(spark, sf_dir, deal=False).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    g = F.struct(F.col("value"), F.lit(None).cast("string").alias("status"), F.lit("").alias("raw"), F.lit(20.0).alias("scale"))
    return e.select("value", "n", round_grade(F.col("value")).alias("final"), rescale(g, 100.0)["value"].alias("value100"))


@query("""
with v as (select distinct cast(l_quantity as bigint) * 4 / 10.0 as value from lineitem)
select value, case when value = round(value) then cast(cast(round(value) as bigint) as varchar) else replace(cast(value as varchar), '.', ',') end as label from v""")
def grade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16."""
    v = L.table(spark, sf_dir, "lineitem").select(((F.col("l_quantity").cast("bigint") * 4) / F.lit(10.0)).alias("value")).distinct()
    return v.select("value", format_grade(F.col("value")).alias("label"))


@query("""
select p_type as subject, max(l_quantity) as top, case when max(l_quantity) > 100 then max(l_quantity) when max(l_quantity) > 20 then 100.0 else 20.0 end as scale
from lineitem join part on l_partkey = p_partkey group by p_type""")
def scale_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C22 from the largest value of a column."""
    j = L.table(spark, sf_dir, "lineitem").join(L.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_type").alias("subject")).agg(F.max("l_quantity").alias("top")).withColumn("scale", guess_scale(F.col("top")))


@query(f"with {L.VERSIONS_SQL} select student, subject, season_ord, source, value, status from picked where pick = 1")
def best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, G5."""
    return R.best_per_source(L.entries(spark, sf_dir), L.ORDER, are_dealt=True).where("pick = 1").select("student", "subject", "season_ord", "source", "value", "status")


@query(f"with {L.VERSIONS_SQL} select student, subject, season_ord, source, value, status from seasons")
def streamed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.L: the grades that count, kept up to date by a stream: sources 0 and 1 come first, with one that says twenty of
    everybody; then that one is taken back and source 2 comes."""
    at = new_folder(spark, "stream")
    needed = {*R.GROUP, "source", "file_order", "document_date", "value", "status", *L.ORDER}
    e = L.entries(spark, sf_dir, deal=False)
    e = e.select(*[c for c in e.columns if c in needed]).withColumn("removed", F.lit(False))
    e = table_of(e, "stream-entries", f"{at}/entries")
    nine = lambda c: F.lit(9).cast(dict(e.dtypes)[c])
    wrong = e.where("source = 0").withColumns({"source": nine("source"), "file_order": nine("file_order"), "value": F.lit(20.0), "status": F.lit(None).cast("string")})
    back = wrong.select("student", "source", F.lit(True).alias("removed")).distinct()
    batches = e.where("source <> 2").unionByName(wrong), e.where("source = 2").unionByName(back, allowMissingColumns=True)
    for i, batch in enumerate(batches):
        table_of(batch, "stream-batch", f"{at}/{i}")
    drop_folder(spark, f"{at}/entries")  # each entry lies in its batch now
    for i in range(len(batches)):
        arrive(spark, f"{at}/{i}", f"{at}/in/{i}")
        incremental.start(spark.readStream.schema(e.schema).parquet(f"{at}/in/*"), f"{at}/out", L.ORDER).awaitTermination()
    return incremental.current(spark, f"{at}/out").select("student", "subject", "season_ord", "source", "value", "status")


@query(f"with {L.VERSIONS_SQL} select student, subject, season_ord, source, version, by_date, case when by_date then 'reason.newest_document' else 'reason.latest_file' end as reason from versions")
def version_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2."""
    p = R.best_per_source(L.entries(spark, sf_dir), L.ORDER, are_dealt=True).where("pick = 1")
    return R.version_rank(p, L.ORDER).select("student", "subject", "season_ord", "source", "version", "by_date", "reason")


@query(f"""with {L.VERSIONS_SQL} select student, subject, season_ord, count(*) as versions, count(distinct coalesce(cast(value as varchar), '') || '|' || coalesce(status, '')) as distinct_grades
from firsts group by all having count(distinct coalesce(cast(value as varchar), '') || '|' || coalesce(status, '')) > 1""")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return R.version_conflicts(L.entries(spark, sf_dir), L.ORDER, are_dealt=True)


@query(f"""with {L.BASE_SQL} select student, subject, season_ord, source, l_linenumber, count(*) as rows, count(distinct coalesce(cast(value as varchar), '') || '|' || coalesce(status, '')) as distinct_grades
from entries group by student, subject, season_ord, source, l_linenumber having count(distinct coalesce(cast(value as varchar), '') || '|' || coalesce(status, '')) > 1""")
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line number stands for the column."""
    return R.repeated_rows(L.entries(spark, sf_dir), "l_linenumber")


@query(f"""with {L.VERSIONS_SQL}
select student, subject, season_ord, source, value, status, 'route' as lost_as from picked where pick > 1 and not (value is null and status = 'SEM_NOTA')
union all select student, subject, season_ord, source, value, status, 'version' from versions where version > 1 and not (value is null and status = 'SEM_NOTA')""")
def other_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return R.other_versions(L.entries(spark, sf_dir), L.ORDER, are_dealt=True).select("student", "subject", "season_ord", "source", "value", "status", "lost_as")


@query(f"with {L.BEST_SQL} select * from best")
def best_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return R.best_season(L.seasons(spark, sf_dir))


@query(f"with {L.BEST_SQL} select student, subject, pass_mark, final, approved from results")
def approved_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21, F4."""
    return L.results(spark, sf_dir).select("student", "subject", "pass_mark", "final", "approved")


_STATS = """select s.subject, {idle} as students, count(*) filter (where approved) as approved, count(*) filter (where not approved) as failed,
  {pending} as pending, round(avg(final), 2) as average, round(count(*) filter (where approved) / nullif(count(*) filter (where approved is not null), 0), 3) as pass_rate
from subjects s left join results r on r.subject = s.subject group by s.subject"""


@query(f"with {L.BEST_SQL} {_STATS.format(idle='count(r.student)', pending='count(r.student) filter (where approved is null)')}")
def subject_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the lens to one row for each subject; the flagship."""
    return R.subject_stats(L.subjects(spark, sf_dir), L.results(spark, sf_dir))


@query(f"""with {L.BEST_SQL}, listed as (select distinct student, subject from base union select student, subject from results),
idle as (select l.subject, count(*) as n from listed l where not exists (select 1 from results r where r.student = l.student and r.subject = l.subject and r.status is distinct from null or r.student = l.student and r.subject = l.subject and r.value is not null) group by 1)
select s.subject, count(r.student) + coalesce(max(i.n), 0) as students, count(*) filter (where approved) as approved, count(*) filter (where not approved) as failed,
 count(r.student) filter (where approved is null) + coalesce(max(i.n), 0) as pending, round(avg(final), 2) as average,
 round(count(*) filter (where approved) / nullif(count(*) filter (where approved is not null), 0), 3) as pass_rate
from subjects s left join results r on r.subject = s.subject and (r.value is not null or r.status is not null) left join idle i on i.subject = s.subject group by s.subject""")
def subject_stats_with_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students whom a sheet lists without any grade are pending."""
    all_results = L.results(spark, sf_dir)
    graded = all_results.where("value is not null or status is not null")
    return R.subject_stats(L.subjects(spark, sf_dir), graded, R.seen_subjects(L.base(spark, sf_dir), all_results))


@query(f"""with {L.BEST_SQL} select count(distinct student) as students, count(distinct subject) as subjects, count(*) filter (where approved) as approved,
count(*) filter (where not approved) as failed, count(*) filter (where approved is null) as pending, round(avg(final), 2) as average from results""")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    return R.global_stats(L.results(spark, sf_dir))


_MEAN = "round(case when count(*) filter (where coalesce(ects, 0) = 0) = 0 then sum(final * ects) / sum(ects) else avg(final) end, 2)"
_COUNTED = "counted as (select r.student, r.subject, r.final, c.ects, c.year, c.semester from results r left join curriculum c on c.subject = r.subject where approved and final is not null)"
_LEVELS = f"""
select student, 'semester' as level, year, semester, {_MEAN} as mean, count(*) as count, count(*) filter (where coalesce(ects, 0) = 0) = 0 as weighted from counted where year is not null and semester is not null group by student, year, semester
union all select student, 'year', year, null, {_MEAN}, count(*), count(*) filter (where coalesce(ects, 0) = 0) = 0 from counted where year is not null and semester is not null group by student, year
union all select student, 'final', null, null, {_MEAN}, count(*), count(*) filter (where coalesce(ects, 0) = 0) = 0 from counted group by student"""


@query(f"with {L.BEST_SQL}, {_COUNTED}, levels as ({_LEVELS}) select *, cast(floor(mean + 0.5) as bigint) as rounded from levels")
def student_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets."""
    return R.student_averages(L.results(spark, sf_dir), L.curriculum(spark, sf_dir))


@query(f"with {L.BEST_SQL}, {_COUNTED} select student, subject from counted where year is null or semester is null")
def missing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return R.missing_curriculum(L.results(spark, sf_dir), L.curriculum(spark, sf_dir))


_PLAN = """known as (select subject, course from curriculum union all select distinct p_brand, case cast(right(p_brand, 1) as int) % 3 when 0 then 'A' when 1 then 'B' end from part),
mine as (select distinct s.student, k.course from results s join known k on k.subject = s.subject where k.course is not null),
plan as (select st.student, k.subject from (select distinct student from results) st join known k on k.course is null or exists (select 1 from mine m where m.student = st.student and m.course = k.course))"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with their course: those of the lens, and brands, in which nobody has a result."""
    course = F.when(F.col("p_brand").rlike("[0369]$"), "A").when(F.col("p_brand").rlike("[147]$"), "B")
    brands = L.table(spark, sf_dir, "part").select(F.col("p_brand").alias("subject"), course.alias("course")).distinct()
    return L.curriculum(spark, sf_dir).select("subject", "course").unionByName(brands)


@query(f"""with {L.BEST_SQL}, {_PLAN}, n as (select student, count(*) as n, min(course) as one from mine group by 1)
select p.student, case when max(n.n) = 1 then max(n.one) end as course, coalesce(max(n.n), 0) as n_courses, count(*) filter (where exists (select 1 from results s where s.student = p.student and s.subject = p.subject)) as have, count(*) as total
from plan p left join n on n.student = p.student group by p.student""")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return R.plan_coverage(L.results(spark, sf_dir), _known(spark, sf_dir))


@query(f"with {L.BEST_SQL}, {_PLAN} select student, subject from plan except select student, subject from results")
def plan_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference of plan and results."""
    return R.plan_missing(L.results(spark, sf_dir), _known(spark, sf_dir))


@query(f"with {L.BEST_SQL} select distinct student, subject from base union select student, subject from results")
def seen_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    return R.seen_subjects(L.base(spark, sf_dir), L.results(spark, sf_dir))


_EDITS = "edits as (select o_custkey as student, p_type as subject, max(o_orderkey) % 20 + 0.5 as edit from orders join part on p_partkey = o_custkey where o_custkey % 7 = 0 group by 1, 2)"


@query(f"""with {L.BEST_SQL}, {_EDITS} select coalesce(b.student, e.student) as student, coalesce(b.subject, e.subject) as subject, coalesce(e.edit, b.value) as value,
case when e.edit is null then b.status end as status, e.edit is not null as edited, case when e.edit is not null then b.value end as original_value, case when e.edit is not null then b.status end as original_status
from best b full outer join edits e on b.student = e.student and b.subject = e.subject""")
def grade_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """full outer join."""
    o, p = L.table(spark, sf_dir, "orders"), L.table(spark, sf_dir, "part")
    edits = o.where("o_custkey % 7 = 0").join(p, F.col("p_partkey") == F.col("o_custkey")).groupBy(F.col("o_custkey").alias("student"), F.col("p_type").alias("subject"))
    edits = edits.agg((F.max("o_orderkey") % 20 + F.lit(0.5)).alias("edit"))
    return R.apply_edits(R.best_season(L.seasons(spark, sf_dir)), edits).drop("best_season")


@query(f"with {L.BASE_SQL} select student, subject, raw from base where subject not in (select p_type from part where length(p_type) > 6)")
def removed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join before anything else reads the rows."""
    gone = L.table(spark, sf_dir, "part").where("length(p_type) > 6").select(F.col("p_type").alias("subject")).distinct()
    return L.base(spark, sf_dir).join(gone, "subject", "left_anti").select("student", "subject", "raw")


@query(f"with {L.BEST_SQL} select student, subject, value from best where student not in (select c_custkey from customer where c_acctbal < 0)")
def removed_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3."""
    gone = L.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("student"))
    return R.best_season(L.seasons(spark, sf_dir)).join(gone, "student", "left_anti").select("student", "subject", "value")


_PIVOT = ", ".join(f"max(case when subject = '{s}' then final end) as \"{s}\"" for s in SUBJECTS)


@query(f"""with {L.BEST_SQL} select student, {_PIVOT}, round(avg(final), 2) as mean, count(*) filter (where final >= pass_mark) as passed, count(final) as graded
from results where subject in ({", ".join(f"'{s}'" for s in SUBJECTS)}) group by student""")
def pivot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2."""
    return P.summary(L.results(spark, sf_dir), SUBJECTS)


@query(f"""with {L.VERSIONS_SQL}, w as (select student, subject, max(value) filter (where season_ord = 0) as season1, max(value) filter (where season_ord = 1) as season2, max(value) filter (where season_ord = 2) as season3 from seasons group by 1, 2)
select *, greatest(season1, season2, season3) as best, case greatest(season1, season2, season3) when season1 then 1 when season2 then 2 when season3 then 3 end as best_season from w""")
def pivot_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5, the spreadsheet's MAX and MATCH."""
    return P.seasons_side_by_side(L.seasons(spark, sf_dir))


@query(f"""with {L.BEST_SQL} select subject, case when final <= 9 then '<10' when final between 10 and 13 then '10-13' when final between 14 and 15 then '14-15' when final between 16 and 17 then '16-17' else '18-20' end as band, count(*) as n
from results where final is not null and final <= 20 group by 1, 2""")
def grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4, G16."""
    return P.grade_bands(L.results(spark, sf_dir))


@query(f"with {L.BEST_SQL} select subject, round(avg(final), 2) as mean, count(*) filter (where final >= pass_mark) as passed, count(final) as graded from results group by subject")
def subject_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3."""
    return P.subject_footer(L.results(spark, sf_dir))


@query(f"with {L.BEST_SQL}, {_COUNTED} select student, round(sum(final * coalesce(ects, 1)) / sum(coalesce(ects, 1)), 2) as mean, cast(sum(coalesce(ects, 1)) as double) as weight from counted group by student")
def credit_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6."""
    return P.credit_means(L.results(spark, sf_dir), L.curriculum(spark, sf_dir))


@query(f"with {L.VERSIONS_SQL} select student, subject, season_ord, value, status, source from seasons")
def detail_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7."""
    return P.detail(L.seasons(spark, sf_dir))


@query(f"""with {L.VERSIONS_SQL}, n as (select student, subject, 'nota' as type, 'warning' as severity from firsts group by student, subject, season_ord having count(distinct coalesce(cast(value as varchar), '') || '|' || coalesce(status, '')) > 1
union all select student, subject, 'linha repetida', 'warning' from entries group by student, subject, season_ord, source, l_linenumber having count(distinct coalesce(cast(value as varchar), '') || '|' || coalesce(status, '')) > 1
union all select c_custkey, null, 'nome', 'info' from customer where c_acctbal < 0) select type, severity, count(*) as n, count(subject) as with_subject from n group by 1, 2""")
def notices_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8, J2."""
    e = L.entries(spark, sf_dir)
    kind = lambda df, t, s: df.withColumns({"type": F.lit(t), "severity": F.lit(s)})
    grades = kind(R.version_conflicts(e, L.ORDER, are_dealt=True).select("student", "subject"), "nota", "warning")
    rows = kind(R.repeated_rows(e, "l_linenumber").select("student", "subject"), "linha repetida", "warning")
    names = kind(L.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("student")), "nome", "info")
    return P.notices(grades, rows, names).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count("subject").alias("with_subject"))


_PICKS = "picks as (select row_number() over (order by c_custkey) as pos, case when c_custkey % 2 = 0 then c_name else cast(c_custkey as varchar) end as pick from customer where c_custkey % 11 = 0)"


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = L.table(spark, sf_dir, "customer").where("c_custkey % 11 = 0")
    pick = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    return c.select(((F.col("c_custkey") / 11).cast("bigint") + 1).alias("pos"), pick.alias("pick"))


def _students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"), F.col("c_name").alias("name"))


@query(f"with {_PICKS} select c_custkey as student, c_name as name, min(pos) as pos from customer join picks on pick = cast(c_custkey as varchar) or pick = c_name group by 1, 2")
def selection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picked by number or by name."""
    return P.select_students(_students(spark, sf_dir), _selection(spark, sf_dir))


@query(f"with {_PICKS} select c_custkey as student, c_name as name, pos from customer left join picks on pick = cast(c_custkey as varchar) or pick = c_name order by pos nulls last, lower(c_name), c_custkey limit 50")
def pinned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k list is the feature."""
    students = _students(spark, sf_dir)
    pinned = P.select_students(students, _selection(spark, sf_dir)).select("student", "pos")
    return P.pinned_order(students, pinned, 50).select("student", "name", "pos")


@query("select c_custkey as student, c_name as name from customer where contains(lower(c_name), '00012') or contains(cast(c_custkey as varchar), '00012')")
def search_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    return P.search(_students(spark, sf_dir), "00012")


@query(f"with {L.BEST_SQL} select student, round(avg(final), 2) as mean, count(final) as n from results where subject in ('ECONOMY', 'PROMO') group by student")
def visible_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    return P.visible_mean(L.results(spark, sf_dir), ["ECONOMY", "PROMO"])


@query(f"with {L.BEST_SQL} select subject, year, semester, row_number() over (order by year nulls last, semester nulls last, lower(subject), subject) as place from curriculum")
def order_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1."""
    return P.subject_order(L.curriculum(spark, sf_dir).select("subject", "year", "semester"))


@query(f"""with {L.BEST_SQL}, o as (select subject, year, semester, row_number() over (order by year nulls last, semester nulls last, lower(subject), subject) as place from curriculum)
select dense_rank() over (order by year nulls last, semester nulls last) as run, year, semester, count(*) as subjects, min(place) as first_place from o group by year, semester""")
def subject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: gaps and islands."""
    return P.subject_groups(L.curriculum(spark, sf_dir).select("subject", "year", "semester"))


@query("""with o as (select o_custkey as student, o_orderstatus as status, o_orderdate as t, o_orderkey from orders),
l as (select *, case when lag(status) over (partition by student order by t, o_orderkey) is distinct from status then 1 else 0 end as starts from o),
r as (select *, sum(starts) over (partition by student order by t, o_orderkey rows unbounded preceding) as run from l)
select student, max(n) as longest_run from (select student, run, count(*) as n from r group by 1, 2) group by student""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of equal states in order."""
    from rollbook.operators.layout import longest_run as run

    o = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("student"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return run(o, "student", ["o_orderdate", "o_orderkey"], "status")
