"""The order tables seen as grade sheets: customers are students, part types subjects, suppliers sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.grades import with_grade
from rollbook.operators import results as R
from rollbook.session import spread

#: What decides between equal entries.
ORDER = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "raw"]
PASS = "cast(case when subject like 'STANDARD%' then 10.0 when subject like 'PROMO%' then 12.0 end as double)"
#: Year, semester, credits and course of a subject, from its name alone.
YEAR = "cast(case when length(subject) % 5 = 0 then null else 1 + length(subject) % 3 end as bigint)"
SEMESTER = "cast(case when length(subject) % 7 = 0 then null else 1 + length(subject) % 2 end as bigint)"
ECTS, COURSE = "cast(case when length(subject) % 4 = 0 then null else 3 + length(subject) % 4 end as bigint)", "case when length(subject) % 3 = 0 then 'A' when length(subject) % 3 = 1 then 'B' end"

BASE_SQL = """
base as (
  select o_custkey as student, c_name as name, p_type as subject,
         case l_linenumber % 3 when 1 then 0 when 2 then 1 else 2 end as season_ord,
         l_suppkey % 3 as source, l_suppkey % 3 as file_order,
         case when l_suppkey % 3 <> 2 then strftime(l_shipdate, '%Y-%m-%d') end as document_date,
         case when l_returnflag = 'R' and l_discount >= 0.08 then 'RE' when l_returnflag = 'A' and l_discount >= 0.09 then 'NA' when l_discount < 0.01 then '-'
              else cast(cast(l_quantity as bigint) * 4 // 10 as varchar) || ',' || cast(cast(l_quantity as bigint) * 4 % 10 as varchar) end as raw,
         o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey),
entries as (
  select *, try_cast(case when regexp_full_match(raw, '[0-9]+,[0-9]+') then replace(raw, ',', '.') end as double) as value,
         case raw when 'RE' then 'REPROVADO' when 'NA' then 'NAO_ADMITIDO' when '-' then 'SEM_NOTA' end as status from base),
ranked as (
  select *, case when value is not null then 2 when status is not null then 1 else 0 end as tier,
         case when value is not null then value when status = 'REPROVADO' then 5.0 when status = 'NAO_ADMITIDO' then 2.0 when status = 'SEM_NOTA' then 1.0 else 0.0 end as score from entries)
"""
_O = ", ".join(ORDER)
VERSIONS_SQL = f"""{BASE_SQL},
picked as (select *, row_number() over (partition by student, subject, season_ord, source order by tier desc, score desc, {_O}) as pick from ranked),
firsts as (select *, bool_and(document_date is not null) over (partition by student, subject, season_ord) as by_date from picked where pick = 1),
versions as (select *, row_number() over (partition by student, subject, season_ord
    order by case when by_date then document_date else '' end desc, file_order desc, case when by_date then '' else coalesce(document_date, '') end desc, {_O}) as version from firsts),
seasons as (select * from versions where version = 1)
"""
BEST_SQL = f"""{VERSIONS_SQL},
best as (
  select student, subject, season_ord as best_season, value, status from (
    select *, row_number() over (partition by student, subject order by tier desc, score desc, season_ord) as n from seasons where not (value is null and status = 'SEM_NOTA')) where n = 1
  union all
  select distinct student, subject, cast(null as int), cast(null as double), cast(null as varchar) from seasons s
  where not exists (select 1 from seasons t where t.student = s.student and t.subject = s.subject and not (t.value is null and t.status = 'SEM_NOTA'))),
results as (
  select student, subject, best_season, value, status, coalesce({PASS}, cast(9.5 as double)) as pass_mark, cast(floor(value + 0.5) as bigint) as final,
         case when value is not null then floor(value + 0.5) >= coalesce({PASS}, cast(9.5 as double)) - 1e-9 when status in ('REPROVADO', 'NAO_ADMITIDO') then false end as approved from best),
subjects as (select distinct p_type as subject from part),
curriculum as (select subject, {YEAR} as year, {SEMESTER} as semester, {ECTS} as ects, {COURSE} as course from subjects)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    tenths = F.col("l_quantity").cast("bigint") * 4
    raw = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08), "RE").when((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.09), "NA").when(F.col("l_discount") < 0.01, "-")
    raw = raw.otherwise(F.concat_ws(",", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")))
    joined = spread(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    season = F.when(F.col("l_linenumber") % 3 == 1, 0).when(F.col("l_linenumber") % 3 == 2, 1).otherwise(2)
    source = F.col("l_suppkey") % 3
    return joined.select(
        F.col("o_custkey").alias("student"), F.col("c_name").alias("name"), F.col("p_type").alias("subject"), season.alias("season_ord"), source.alias("source"), source.alias("file_order"),
        F.when(source != 2, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("document_date"), raw.alias("raw"), "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax",
    )


def entries(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """The lens with grades read; dealt by student and subject first unless no operator over these follows."""
    rows = base(spark, sf_dir)
    g = with_grade(R.dealt(rows) if deal else rows, "raw", name="g")
    return g.withColumns({"value": F.col("g.value"), "status": F.col("g.status")}).drop("g")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("subject")).distinct()


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(spark, sf_dir).select("subject", F.expr(YEAR).alias("year"), F.expr(SEMESTER).alias("semester"), F.expr(ECTS).alias("ects"), F.expr(COURSE).alias("course"))


def pass_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(spark, sf_dir).select("subject", F.expr(PASS).cast("double").alias("pass_mark"))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.season_results(entries(spark, sf_dir), ORDER, are_dealt=True)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_marks(R.best_season(seasons(spark, sf_dir)), pass_marks(spark, sf_dir), 9.5)
