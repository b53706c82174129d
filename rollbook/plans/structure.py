"""Queries of text functions, identity, inference and layout over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions import text as T
from rollbook.functions.numbers import parse_number, parse_student_id, split_id_from_name, student_key
from rollbook.operators import identity as I
from rollbook.operators import inference as N
from rollbook.operators import layout as Y
from rollbook.operators.similarity import similar_names as similar
from rollbook.plans.catalog import Catalog
from rollbook.plans.lens import table
from rollbook.session import spread, table_of

CATALOG = Catalog()
query = CATALOG.query


# ---------------------------------------------------------------- text

_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[\\x{{2010}}-\\x{{2014}}\\x{{2212}}]', '-', 'g'), '{_SPACE}', ' ', 'g'))"


def _plain(c: str) -> str:
    return f"regexp_replace(strip_accents({c}), '\\p{{M}}+', '', 'g')"


def _norm(c: str) -> str:
    split = f"regexp_replace(regexp_replace({_clean(c)}, '[ºª°]', '', 'g'), '([a-zà-ÿ])([A-ZÀ-Þ])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({_plain(split)}), '{_SPACE}', ' ', 'g'))"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, f"{sf_dir}/documents.parquet", "doc_id")


@query(f"select doc_id, md5({_clean('text')}) as cleaned, length({_clean('text')}) as n from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 over whole texts; the digest stands for the text."""
    t = T.clean_text("text")
    return _documents(spark, sf_dir).select("doc_id", F.md5(t.cast("binary")).alias("cleaned"), F.length(t).cast("bigint").alias("n"))


@query(f"select doc_id, md5({_plain('coalesce(text, chr(32))')}) as plain from documents")
def strip_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1."""
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.strip_accents(F.coalesce("text", F.lit(" "))).cast("binary")).alias("plain"))


@query(f"select doc_id, md5(trim(regexp_replace({_norm('text')}, '[^a-z0-9]+', ' ', 'g'))) as header, md5({_norm('text')}) as norm from documents")
def norm_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, C4."""
    d = _documents(spark, sf_dir).select("doc_id", T.norm_text("text").alias("norm"))
    return d.select("doc_id", F.md5(T.header_of(F.col("norm")).cast("binary")).alias("header"), F.md5(F.col("norm").cast("binary")).alias("norm"))


@query("select p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || 'x' || p_size), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')) as apart from (select p_partkey, replace(p_brand, '#', '') as p_brand, p_size from part)")
def split_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.split_glued(F.lower(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("x"), F.col("p_size").cast("string")))).alias("apart"))


@query("""select p_partkey, lower(p_name) as key, len([x for x in string_split(lower(p_name), ' ') if len(x) > 1 and x not in ('de', 'da', 'do', 'das', 'dos', 'e', 'del', 'la', 'van', 'von', 'y')]) as words,
array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(p_name, ' ')], ' ') as title, len(string_split(p_name, ' ')) >= 2 and not regexp_matches(p_name, '[0-9]') as person from part""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6-C9 on part names, which are all lower-case words."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.norm_name("p_name").alias("key"), F.size(T.name_tokens("p_name")).cast("bigint").alias("words"), T.title_name("p_name").alias("title"), T.looks_like_person_name("p_name").alias("person"))


@query(r"""with v as (select l_orderkey, l_partkey, l_suppkey, l_linenumber,
 case l_linenumber % 4 when 0 then cast(l_partkey as varchar) || ',' || l_suppkey % 10 when 1 then cast(l_suppkey as varchar) || '%' when 2 then cast(l_partkey as varchar) || '/' || l_suppkey else 'x' || l_partkey end as raw from lineitem)
select raw, count(*) as n, min(case when regexp_full_match(raw, '[0-9]+/[0-9]+') then case when cast(split_part(raw, '/', 2) as bigint) <> 0 then cast(split_part(raw, '/', 1) as double) end
 when regexp_full_match(raw, '[0-9]+([,][0-9]+)?%?') then cast(replace(replace(raw, '%', ''), ',', '.') as double) end) as number from v group by raw""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals, percentages, fractions, and what is no number."""
    k, p, s = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    raw = F.when(k == 0, F.concat(p, F.lit(","), (F.col("l_suppkey") % 10).cast("string"))).when(k == 1, F.concat(s, F.lit("%"))).when(k == 2, F.concat(p, F.lit("/"), s)).otherwise(F.concat(F.lit("x"), p))
    v = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return v.select("raw", "n", parse_number("raw").alias("number"))


@query("select c_custkey, case when length(regexp_replace(c_name, '[^0-9]', '', 'g')) between 4 and 12 then coalesce(nullif(ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0'), ''), '0') end as student_id, 'id:' || coalesce(nullif(ltrim(regexp_replace(c_name, '[^0-9]', '', 'g'), '0'), ''), '0') as key from customer")
def student_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, C20."""
    i = parse_student_id("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", i.alias("student_id"), student_key(i, T.norm_name("c_name")).alias("key"))


@query("""with n as (select p_partkey, cast(100000 + p_partkey as varchar) as number, case when p_size % 6 = 0 then string_split(p_name, ' ')[1] else p_name end as words from part),
c as (select *, array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(words, ' ')], ' ') as name from n),
s as (select *, case p_partkey % 4 when 0 then number || name when 1 then number || ' ' || name when 2 then number || ' - ' || name else name || ' | ' || number end as cell from c)
select p_partkey, case when contains(words, ' ') then number end as student_id, case when contains(words, ' ') then name else cell end as name from s""")
def id_name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and name in one cell, glued, spaced, or the name first; a lone word is no name, and its cell stays whole."""
    words = F.when(F.col("p_size") % 6 == 0, F.get(F.split("p_name", " "), F.lit(0))).otherwise(F.col("p_name"))
    p = table(spark, sf_dir, "part").withColumn("words", words)
    number, name, k = (F.col("p_partkey") + 100000).cast("string"), T.title_name("words"), F.col("p_partkey") % 4
    cell = F.when(k == 0, F.concat(number, name)).when(k == 1, F.concat(number, F.lit(" "), name)).when(k == 2, F.concat(number, F.lit(" - "), name)).otherwise(F.concat(name, F.lit(" | "), number))
    s = split_id_from_name(cell)
    return p.select("p_partkey", s["student_id"].alias("student_id"), s["name"].alias("name"))


@query("""with h as (select p_partkey, case p_size % 5 when 0 then 'Nota Final ' || p_size % 4 when 1 then 'Teste ' || p_size % 4 when 2 then 'Época Especial' when 3 then 'Recurso' else 'Ex ' || p_size % 4 end as header, p_size from part)
select p_partkey, header, case when p_size % 5 = 2 then 'especial' when p_size % 5 = 3 then 'epoca2' when p_size % 5 = 1 and p_size % 4 = 1 then 'epoca1' end as season,
case when p_size % 5 < 2 and p_size % 4 in (2, 3) then p_size % 4 end as moment, case p_size % 5 when 1 then 'continua' when 3 then 'exame' end as route, case when p_size % 5 = 0 then 90 else 0 end as priority from h""")
def header_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23-C27 on headers made of sizes."""
    k, m = F.col("p_size") % 5, (F.col("p_size") % 4).cast("string")
    h = F.when(k == 0, F.concat(F.lit("Nota Final "), m)).when(k == 1, F.concat(F.lit("Teste "), m)).when(k == 2, "Época Especial").when(k == 3, "Recurso").otherwise(F.concat(F.lit("Ex "), m))
    p = table(spark, sf_dir, "part").select("p_partkey", h.alias("header"))
    return p.select("p_partkey", "header", T.season_from_text("header")["season"].alias("season"), T.moment_index("header").alias("moment"), T.route_of("header").alias("route"), T.final_priority("header").alias("priority"))


# ---------------------------------------------------------------- identity

_RECORDS = """records as (select o_orderkey as row_id, case when o_orderkey % 3 <> 0 then cast(o_custkey as varchar) end as student_id,
 case when o_orderkey % 4 <> 0 then 'name ' || cast(o_custkey // 2 as varchar) || case when o_orderkey % 5 = 0 then ' long' else '' end else '' end as name from orders)"""
_CLUSTERS = f"""{_RECORDS},
links as (select a.row_id as x, b.m as y from records a join (select student_id, min(row_id) as m from records where student_id is not null group by 1) b using (student_id)
          union select a.row_id, b.m from records a join (select name, min(row_id) as m from records where name <> '' group by 1) b using (name)),
both_ways as (select x, y from links union select y, x from links),
reach(node, root) as (select row_id, row_id from records union select b.y, r.root from reach r join both_ways b on b.x = r.node),
clusters as (select node as row_id, min(root) as cluster from reach group by node)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("o_custkey") / 2).cast("string")
    name = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("name "), half, F.when(F.col("o_orderkey") % 5 == 0, " long").otherwise(""))).otherwise("")
    number = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), number.alias("student_id"), name.alias("name"), name.alias("name_key"))


@query(f"with recursive {_CLUSTERS} select row_id, cluster from clusters")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """connected components over numbers and names."""
    return I.cluster_records(_records(spark, sf_dir)).select("row_id", "cluster")


@query(f"""with recursive {_CLUSTERS}, r as (select c.cluster, r.* from records r join clusters c using (row_id)),
n as (select cluster, name as best_name from r where name <> '' qualify row_number() over (partition by cluster order by len(string_split(name, ' ')) - (case when regexp_matches(name, ' [0-9]( |$)') then 1 else 0 end) desc, length(name) desc, row_id) = 1),
i as (select cluster, student_id as best_id from r where student_id is not null group by 1, 2 qualify row_number() over (partition by cluster order by count(*) desc, length(student_id), student_id) = 1)
select cluster, best_name, best_id, ids, spelled from (select cluster, count(distinct student_id) as ids, count(distinct nullif(name, '')) as spelled from r group by 1) left join n using (cluster) left join i using (cluster)""")
def best_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, E6."""
    s = I.described(I.cluster_records(_records(spark, sf_dir)))
    return s.select("cluster", "best_name", "best_id", F.size("all_ids").cast("bigint").alias("ids"), F.size("all_names").cast("bigint").alias("spelled"))


@query(f"with recursive {_CLUSTERS} select row_id, cluster from clusters")
def changed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, K2: the same after changes: a seventh of the rows came later, and others went that had joined different people."""
    rows, k = _records(spark, sf_dir), F.col("row_id")
    ghosts = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select((-F.col("o_orderkey")).alias("row_id"), F.col("o_custkey").cast("string").alias("student_id"), F.concat(F.lit("name "), F.floor((F.col("o_custkey") + 50) / 2).cast("string")).alias("name"))
    ghosts = ghosts.withColumn("name_key", F.col("name"))
    before = table_of(I.cluster_records(rows.where(k % 7 != 0).unionByName(ghosts)), "before")
    return I.recluster(before, rows.where(k % 7 == 0), ghosts.select("row_id")).select("row_id", "cluster")


@query(f"""with recursive {_CLUSTERS}, r as (select c.cluster, r.* from records r join clusters c using (row_id))
select cluster, 'numero' as type, 'warning' as severity, string_agg(distinct student_id, ', ' order by student_id) as detail from r group by 1 having count(distinct student_id) > 1
union all select cluster, 'nome', 'info', string_agg(distinct name, '; ' order by name) filter (where name <> '') from r group by 1 having count(distinct nullif(name, '')) > 1""")
def identity_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    return I.identity_notices(I.spellings(I.cluster_records(_records(spark, sf_dir))))


@query("""with s as (select p_partkey as source_id, case when p_size % 3 = 0 then 'codigo:' || lower(p_brand) else 'nome:' || lower(p_name) end as group_key, case when p_size % 5 <> 0 then p_name || case when p_size % 2 = 0 then ' ' || p_type else '' end end as subject, 'sheet ' || p_partkey as label from part),
n as (select group_key, min_by(subject, (-length(subject), subject)) as longest, string_agg(distinct subject, '|' order by subject) as names from s where subject is not null group by 1)
select source_id, case when group_key like '%brand#1' then coalesce(subject, label) when group_key like '%brand#2' then 'Second' else coalesce(longest, subject, label) end as canonical, coalesce(names, '') as names, group_key like '%brand#1' or group_key like '%brand#2' as confirmed
from s left join n using (group_key)""")
def resolve_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By code or by name, with one renamed and one split group."""
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 5 != 0, F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_type"))).otherwise("")))
    key = I.subject_group_key(F.when(F.col("p_size") % 3 == 0, F.lower("p_brand")), F.lit(0.9), F.lower("p_name"), F.col("p_partkey").cast("string"))
    sheets = p.select(F.col("p_partkey").alias("source_id"), key.alias("group_key"), said.alias("subject"), F.concat(F.lit("sheet "), F.col("p_partkey").cast("string")).alias("label"))
    aliases = spark.createDataFrame([("codigo:brand#1", I.SPLIT), ("codigo:brand#2", "Second")], "group_key string, alias string")
    r = I.resolve_subjects(sheets, aliases)
    return r.select("source_id", "canonical", F.array_join("names", "|").alias("names"), "confirmed")


@query("select p_type as subject, count(distinct p_brand) as files, string_agg(distinct p_brand, ', ' order by p_brand) as names from part group by p_type")
def subject_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    s = F.array_sort(F.collect_set("p_brand"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("subject")).agg(F.countDistinct("p_brand").alias("files"), F.array_join(s, ", ").alias("names"))


@query()
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, type and part names as people; the ratio is beyond SQL, so tests compare with brute force."""
    p = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", T.title_name("p_name"), F.initcap("p_type"), F.concat(F.lit("nr"), F.col("p_retailprice").cast("bigint").cast("string")))
    return similar(p.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("person"), F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("ids")))


# ---------------------------------------------------------------- inference


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets: a source for each priority, a row for each order."""
    o = spread(spark, f"{sf_dir}/orders.parquet", "o_orderkey")
    cols = F.array(
        F.concat(F.lit("Ana Silva "), F.col("o_orderstatus")), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "RE").otherwise(F.concat_ws(",", (F.col("o_orderkey") % 20).cast("string"), (F.col("o_custkey") % 10).cast("string"))),
        F.when(F.col("o_orderkey") % 4 == 0, (F.col("o_custkey") % 20).cast("string")).otherwise(""), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(F.col("o_orderstatus")),
    )
    return o.select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").alias("row"), F.posexplode(cols).alias("col", "text"))


_CELLS = """cells as (select o_orderpriority as source_id, o_orderkey as row, unnest([0, 1, 2, 3, 4]) as col, unnest(['Ana Silva ' || o_orderstatus, cast(o_custkey as varchar),
 case when o_orderkey % 7 = 0 then 'RE' else (o_orderkey % 20) || ',' || (o_custkey % 10) end, case when o_orderkey % 4 = 0 then cast(o_custkey % 20 as varchar) else '' end, case when o_orderkey % 2 = 0 then '-' else o_orderstatus end]) as text from orders)"""


@query(f"""with {_CELLS} select source_id, col, count(*) as rows, count(*) filter (where text <> '') as filled, count(*) filter (where regexp_full_match(text, '[0-9]+(,[0-9]+)?')) as numbers,
 count(*) filter (where length(regexp_replace(text, '[^0-9]', '', 'g')) between 4 and 12) as ids, max(case when regexp_full_match(text, '[0-9]+(,[0-9]+)?') then cast(replace(text, ',', '.') as double) end) as max_value,
 count(distinct nullif(text, '')) as "distinct", count(*) filter (where col = 0) as names, round(count(*) filter (where text <> '') / count(*), 9) as filled_ratio from cells group by source_id, col""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the profile of every column, whole tables."""
    p = N.profiles(_cells(spark, sf_dir))
    return p.select("source_id", "col", "rows", "filled", "numbers", "ids", "max_value", "distinct", "names", F.round("filled_ratio", 9).alias("filled_ratio"))


@query(f"""with {_CELLS}, g as (select source_id, row, col, case when regexp_full_match(text, '[0-9]+(,[0-9]+)?') then cast(replace(text, ',', '.') as double) end as value, text = 'RE' as re from cells where col in (2, 3)),
w as (select source_id, row, max(value) filter (where col = 2) as a, bool_or(re) filter (where col = 2) as re, max(value) filter (where col = 3) as b from g group by 1, 2)
select source_id, count(*) as n, count(b) as second, count(*) filter (where b is not null and (a < 9.5 or re)) as failed_first,
 case when count(b) = 0 then 'recurso' when count(*) filter (where b is not null and (a < 9.5 or re)) / count(b) >= 0.8 and count(b) / count(*) <= 0.7 then 'recurso' when count(b) / count(*) >= 0.7 then 'continua'
      when count(*) filter (where b is not null and (a < 9.5 or re)) / count(b) >= 0.5 then 'recurso' else 'continua' end as verdict,
 round(count(*) filter (where b is not null and (a is not null or re)) / (count(b) + count(*) filter (where a is not null or re) - count(*) filter (where b is not null and (a is not null or re))), 9) as jaccard from w group by source_id""")
def moment_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts of two grade columns, the verdict on the second, and the overlap of their filled rows."""
    cells = _cells(spark, sf_dir).where("col in (2, 3)")
    columns = cells.select("source_id", "col").distinct().withColumns({"role": F.lit("grade"), "scale": F.lit(20.0)})
    p = N.column_pairs(cells, columns).where("a = 2 and b = 3")
    verdict = N.moment_verdict(F.col("n"), F.col("n_b"), F.col("failed_first"))
    jaccard = F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 9)
    return p.select("source_id", "n", F.col("n_b").alias("second"), "failed_first", verdict.alias("verdict"), jaccard.alias("jaccard"))


@query(f"""with {_CELLS}, w as (select source_id, row, bool_or(text <> '' and text <> '-') filter (where col = 2) as fin, bool_or(text <> '') filter (where col = 3) as exam from cells group by 1, 2)
select source_id, count(*) filter (where exam) as own, count(*) filter (where exam and not fin) as alone, case when count(*) filter (where exam) >= 2 and count(*) filter (where exam and not fin) >= 0.9 * count(*) filter (where exam) then 'final' else 'component' end as kind from w group by 1""")
def exam_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exam column beside a final that everybody has stays a component."""
    cells = _cells(spark, sf_dir).where("col in (2, 3)")
    base = cells.select("source_id", "col").distinct()
    header, kind = F.when(F.col("col") == 2, "Nota Final").otherwise("Exame"), F.when(F.col("col") == 2, "final").otherwise("component")
    columns = base.withColumns({"header": header, "role": F.lit("grade"), "kind": kind, "route": F.lit(None).cast("string"), "season": F.lit("epoca1"), "scale": F.lit(20.0), "locked": F.lit(False), "reason": F.lit(""), "confidence": F.lit(0.5)})
    done = N.promote_exam_routes(columns, cells).where("col = 3").select("source_id", "kind")
    pair = N.column_pairs(cells, columns).where("a = 2 and b = 3").select("source_id", F.col("n_b").alias("own"), (F.col("n_b") - F.col("n_both")).alias("alone"))
    return pair.join(done, "source_id")


@query("""with p as (select p_brand as source_id, p_partkey, p_name, row_number() over (partition by p_brand order by p_partkey) as n from part),
r as (select source_id, 3 * n as row, [upper(p_name), cast(p_partkey as varchar), cast(n % 21 as varchar), ''] as t from p
 union all select source_id, 3 * n + 1, case n % 6 when 1 then ['Total', '1', '2', '3'] when 2 then ['', '', '', ''] when 3 then ['', 'x', '', 'Total'] when 4 then ['Outra pessoa', '', '', ''] else null end from p),
kept as (select * from r where t is not null and list_aggregate(t, 'string_agg', '') <> '')
select source_id, row, unnest([0, 1, 2, 3]) as col, unnest(t) as text from kept""")
def data_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below the header of a sheet for each brand, without blank ones and those of totals and signatures; a row
    that starts with such a word and has four cells filled stays."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), "p_partkey", "p_name", F.expr("row_number() over (partition by p_brand order by p_partkey)").cast("bigint").alias("n"))
    lit = lambda *t: F.array(*[F.lit(x) for x in t])
    n = F.col("n") % 6
    between = F.when(n == 0, lit("Total", "12", "13", "")).when(n == 1, lit("Total", "1", "2", "3")).when(n == 2, lit("", "", "", "")).when(n == 3, lit("", "x", "", "Total")).when(n == 4, lit("Outra pessoa", "", "", "")).otherwise(lit("", "Assinatura", "", ""))
    rows = p.select("source_id", (3 * F.col("n")).alias("row"), F.array(F.upper("p_name"), F.col("p_partkey").cast("string"), (F.col("n") % 21).cast("string"), F.lit("")).alias("t"))
    rows = rows.unionByName(p.select("source_id", (3 * F.col("n") + 1).alias("row"), between.alias("t")))
    heads = p.select("source_id").distinct().select("source_id", F.lit(0).cast("bigint").alias("row"), lit("Nome", "Nº Aluno", "Nota Final", "Obs").alias("t"))
    cells = heads.unionByName(rows).select("source_id", "row", F.posexplode("t").alias("col", "text"))
    return N.data_cells(cells, heads.select("source_id", F.lit(0).alias("header")))


@query()
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells to roles, seasons and finals; sheet by sheet rules, tested on fixtures."""
    cells = _cells(spark, sf_dir).withColumn("row", F.col("row") + 1)
    head = ["Nome", "Nº Aluno", "Nota Final", "Exame", "Obs"]
    titles = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_id")).distinct().select("source_id", F.lit(0).cast("bigint").alias("row"), F.posexplode(F.array(*map(F.lit, head))).alias("col", "text"))
    cells = cells.unionByName(table_of(titles, "titles"))
    columns, _ = N.classify_columns(cells, N.header_rows(cells))
    return columns.select("source_id", "col", "header", "role", "kind", "season", "route", "scale", "confidence")


_HEADED = """placed as (select p_brand as source_id, cast(right(p_brand, 1) as int) % 5 as k, p_name, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) as n from part),
rows as (select distinct source_id, unnest(range(k)) as row, ['Pauta de Redes', '', ''] as cells from placed
 union all select distinct source_id, k, ['Nome', 'Nº Aluno', case when k % 2 = 0 then 'Nota Final' else 'Final grade' end] from placed
 union all select source_id, k + n, [upper(p_name), cast(900000 + p_partkey as varchar), cast(p_size % 21 as varchar)] from placed)"""


@query(f"""with {_HEADED}, cells as (select source_id, row, unnest(cells) as text from rows where row < 12),
scored as (select source_id, row, case when text = '' then 0 when text = 'Nome' then 3 when text = 'Nº Aluno' then 5 when text in ('Nota Final', 'Final grade', 'Pauta de Redes') then 2
  when regexp_full_match(text, '[0-9]+') then case when length(text) >= 4 then -5 else -2 end else 0 end as score from cells),
sums as (select source_id, row, sum(score) as score from scored group by 1, 2)
select source_id, cast(arg_min(row, (-score, row)) as int) as header from sums group by source_id""")
def header_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of sheets of all parts, under zero to four title lines, by the scores of its cells."""
    w = Window.partitionBy("source_id").orderBy("p_partkey")
    p = table(spark, sf_dir, "part").withColumns({"source_id": F.col("p_brand"), "k": (F.right("p_brand", F.lit(1)).cast("int") % 5).cast("bigint")}).withColumn("n", F.row_number().over(w))
    lit = lambda *t: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in t])
    sheets = p.select("source_id", "k").distinct()
    titles = sheets.where("k > 0").select("source_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("row"), lit("Pauta de Redes", "", "").alias("cells"))
    heads = sheets.select("source_id", F.col("k").alias("row"), lit("Nome", "Nº Aluno", F.when(F.col("k") % 2 == 0, "Nota Final").otherwise("Final grade")).alias("cells"))
    data = p.select("source_id", (F.col("k") + F.col("n")).alias("row"), lit(F.upper("p_name"), (F.col("p_partkey") + 900000).cast("string"), (F.col("p_size") % 21).cast("string")).alias("cells"))
    cells = titles.unionByName(heads).unionByName(data).select("source_id", "row", F.posexplode("cells").alias("col", "text"))
    return N.header_rows(cells)


# ---------------------------------------------------------------- layout

_BOXES = """boxes as (select l_suppkey % 10 as page, l_orderkey as line, cast(l_linenumber * 40 + case when l_linenumber > 4 then 60 else 0 end + l_partkey % 7 as double) as x0, cast(l_linenumber * 40 + case when l_linenumber > 4 then 60 else 0 end + l_partkey % 7 + 6 + l_quantity % 20 as double) as x1 from lineitem),
cuts as (select page, x0, x1, greatest(max(x1) over w, min(x0) over w) as reach from boxes window w as (partition by page order by x0, x1 rows between unbounded preceding and 1 preceding)),
bounds as (select page, unnest([min(x0) - 1] || list((reach + x0) / 2) filter (where x0 > reach + 4.5) || [max(x1) + 1]) as bound from cuts group by page)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = (F.col("l_linenumber") * 40 + F.when(F.col("l_linenumber") > 4, 60).otherwise(0) + F.col("l_partkey") % 7).cast("double")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("page"), F.col("l_orderkey").alias("line"), x0.alias("x0"), (x0 + 6 + F.col("l_quantity") % 20).alias("x1"))


@query(f"with {_BOXES} select page, bound, row_number() over (partition by page order by bound) - 1 as place from bounds")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8d, H5: gaps that no word covers."""
    b = Y.column_bounds(_boxes(spark, sf_dir), ["page"])
    return b.select("page", F.posexplode("bounds").alias("place", "bound")).select("page", "bound", F.col("place").cast("bigint").alias("place"))


@query(f"""with {_BOXES}, placed as (select b.page, b.x0, b.x1, (select count(*) from bounds o where o.page = b.page and o.bound <= (b.x0 + b.x1) / 2) - 1 as col from boxes b)
select page, col, count(*) as words, min(x0) as lo, max(x1) as hi from placed group by page, col""")
def assign_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8f, A8h: words in their bands, and where each column has values."""
    boxes = _boxes(spark, sf_dir)
    placed = Y.band_of(boxes, Y.column_bounds(boxes, ["page"]), ["page"])
    n = placed.groupBy("page", "col").agg(F.count(F.lit(1)).alias("words"))
    return n.join(Y.value_spans(placed, ["page"]), ["page", "col"]).withColumn("col", F.col("col").cast("bigint"))


# ---------------------------------------------------------------- overlays and serialisation


@query("""with old as (select user_id as k, value as v from events where event_id % 2 = 0 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1), new as (select user_id as k, case when event_type = 'error' then null else value end as v from events where event_id % 2 = 1 and user_id % 3 <> 0 qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select coalesce(o.k, n.k) as k, case when n.k is not null then n.v else o.v end as v from old o full outer join new n on o.k = n.k where case when n.k is not null then n.v else o.v end is not null""")
def upsert_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: new values over old ones, empty ones delete; a third of the users get none, so that old ones stay."""
    from rollbook.operators.overlays import upsert

    e = table(spark, sf_dir, "events")
    last = lambda d, v: d.groupBy(F.col("user_id").alias("k")).agg(F.max_by(F.struct(v.alias("x")), F.struct("ts", "event_id")).alias("s")).select("k", F.col("s.x").alias("v"))
    old = last(e.where("event_id % 2 = 0"), F.col("value"))
    new = last(e.where("event_id % 2 = 1 and user_id % 3 <> 0"), F.when(F.col("event_type") != "error", F.col("value")))
    return upsert(old, new, ["k"], "v")


@query("""select c_mktsegment as segment, '[' || string_agg('{"student":' || c_custkey || ',"nation":' || c_nationkey || '}', ',' order by c_custkey) || ']' as payload from customer group by 1""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows as JSON text."""
    c = table(spark, sf_dir, "customer")
    rows = F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("student"), F.col("c_nationkey").alias("nation"))))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.to_json(rows).alias("payload"))


@query("""select type, lang, case when lang = 'en' then case type when 'numero' then 'More than one number: ' else 'Grades differ: ' end else case type when 'numero' then 'Mais de um número: ' else 'Notas diferentes: ' end end || n as message
from (select case when c_nationkey % 2 = 0 then 'numero' else 'nota' end as type, count(*) as n from customer group by 1) cross join (values ('pt'), ('en')) v(lang)""")
def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled in for each language."""
    from rollbook.functions.messages import render

    c = table(spark, sf_dir, "customer").groupBy(F.when(F.col("c_nationkey") % 2 == 0, "numero").otherwise("nota").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    both = c.withColumn("lang", F.explode(F.array(F.lit("pt"), F.lit("en"))))
    key = F.concat(F.lit("notice."), F.col("type"))
    return both.select("type", "lang", render(key, F.create_map(F.lit("n"), F.col("n").cast("string")), F.col("lang")).alias("message"))
