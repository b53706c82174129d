"""What the columns of a sheet mean.

cells (source_id, row, col, text) are profiled by grouped aggregation; rules over the profiles are expressions. The
division of a sheet's columns into seasons, and the choice of its final grades, are windows over a row for each column
and joins with counts for pairs of columns; the sheet's rows are not looked at again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import vocabulary as V
from rollbook.functions.grades import guess_scale, is_empty, with_grade
from rollbook.functions.numbers import looks_like_id_and_name, number_of, parse_number, parse_student_id, plain_number
from rollbook.functions.text import clean_text, looks_like_person_name, mentions, moment_index, norm_header, norm_text, padded, priority_in, route_in, season_of
from rollbook.session import table_of

#: Rows looked at for a header, samples kept, and the mark below which a first result counts as failed.
HEADER_ROWS, SAMPLES, FAILED_BELOW = 12, 5, 9.5
#: What a cell may be: a cell, a grade; scales, on which a grade may fail, count from 0.
CELL, FILLED = -2, -1
#: Rows of a sheet go in blocks, whose bits are one number. Blocks that are counted in one group, and at a time.
BUCKET_BLOCKS, PAIR_BLOCKS = 512, 64
BLOCK, BIT = "shiftright(row, 6)", "shiftleft(1L, cast(row & 63 as int))"
#: Samples are looked for in so many rows, and in so many times as many until there are enough.
SAMPLE_ROWS, SAMPLE_STEP = 1 << 12, 1 << 6
#: Grade columns, by number, up to which cells of others are told apart by a list.
LISTED_COLUMNS = 100


# ---------------------------------------------------------------- header and rows


def with_score(cells: DataFrame, text: str = "text") -> DataFrame:
    """Cells with score: what a cell says for or against its row being the header. Steps keep expressions small."""
    c = cells.withColumns({"_h": norm_header(text), "_number": parse_number(text), "_id": parse_student_id(text)}).withColumn("_p", padded(F.col("_h")))
    p = F.col("_p")
    hit = lambda test, n: F.when(test, n).otherwise(0)
    said = hit(mentions(p, V.NAME_WORDS), 3) + hit(mentions(p, V.ID_WORDS), 2) + hit(mentions(p, V.FINAL_WORDS + V.COMPONENT_WORDS), 2) + hit(season_of(p)["season"].isNotNull(), 1)
    score = F.when(F.col("_h") == "", 0).otherwise(said - hit(F.col("_number").isNotNull(), 2) - hit(F.col("_id").isNotNull(), 3))
    return c.withColumn("score", score).drop("_h", "_p")


def header_rows(cells: DataFrame) -> DataFrame:
    """source_id, header: the best scored of the first rows, the topmost of equals; -1 if no row scores and row 0 is data."""
    c = with_score(cells.where(F.col("row") < HEADER_ROWS)).withColumn("_person", looks_like_person_name("text"))
    is_data = F.col("_person") | F.col("_id").isNotNull() | F.col("_number").isNotNull()
    rows = c.groupBy("source_id", "row").agg(F.sum("score").alias("score"), F.bool_or(is_data).alias("data"))
    best = rows.groupBy("source_id").agg(F.max(F.struct("score", (-F.col("row")).alias("up"))).alias("b"), F.bool_or(F.col("data") & (F.col("row") == 0)).alias("first_is_data"))
    return best.select("source_id", F.when(F.col("b.score") > 0, -F.col("b.up")).when(F.col("first_is_data"), -1).otherwise(0).cast("int").alias("header"))


def _is_clean(text: Column) -> Column:
    """Whether a text is of ASCII alone, with lone spaces inside as its only white space: most cells are, and stay as they are."""
    spaced = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for other in ("  ", *"\t\n\v\f\r"):
        spaced = spaced | F.contains(text, F.lit(other))
    return (F.octet_length(text) == F.length(text)) & ~spaced


def _odd_rows(below: DataFrame) -> DataFrame:
    """(source_id, row) of rows that may be left out: blank ones, and ones with a footer's word. Rows are bits of blocks."""
    bits = lambda test, name: F.coalesce(F.bit_or(F.when(test, F.expr(BIT))), F.lit(0)).alias(name)
    seen = below.groupBy("source_id", F.expr(BLOCK).alias("block")).agg(F.bit_or(F.expr(BIT)).alias("all"), bits(F.col("text") != "", "filled"), bits(F.col("footer"), "footers"))
    odd = seen.select("source_id", "block", F.expr("all & ~filled | footers").alias("odd")).where("odd <> 0")
    return odd.select("source_id", F.explode(F.expr("transform(filter(sequence(0, 63), i -> shiftright(odd, i) & 1 = 1), i -> shiftleft(block, 6) + i)")).alias("row"))


def data_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cleaned cells below the header, without blank rows and rows of totals or signatures.

    Only rows that are blank or hold a footer's word are put together and looked at as rows.
    """
    clean, glued = _is_clean(F.col("text")), [w.replace(" ", "") for w in V.FOOTER_WORDS]
    # what is compared of a clean text differs by case and further spaces only
    may_be = F.length("text").between(min(map(len, glued)), max(map(len, V.FOOTER_WORDS))) & F.lower(F.replace("text", F.lit(" "), F.lit(""))).isin(glued)
    footer = F.when(clean & ~may_be, F.lit(False)).otherwise(norm_text("text").isin(V.FOOTER_WORDS))
    below = cells.join(headers, "source_id").where("row > header").select("source_id", "row", "col", F.when(clean, F.col("text")).otherwise(clean_text("text")).alias("text"), footer.alias("footer"))
    odd = table_of(_odd_rows(below), "odd-rows")
    if not odd.isEmpty():
        filled = F.col("text") != ""
        first = F.min(F.when(filled, F.col("col").cast("bigint") * 2 + F.col("footer").cast("int")))
        rows = below.join(odd, ["source_id", "row"], "left_semi").groupBy("source_id", "row").agg(F.count_if(filled).alias("n"), first.alias("first"))
        below = below.join(table_of(rows.where("n = 0 or n <= 3 and first % 2 = 1").select("source_id", "row"), "left-out"), ["source_id", "row"], "left_anti")
    return below.select("source_id", "row", "col", "text")


def counted(cells: DataFrame) -> DataFrame:
    """source_id, col, text, _k: the different texts of each column, with the number of their cells."""
    return cells.groupBy("source_id", "col", "text").agg(F.count(F.lit(1)).alias("_k"))


def _samples(cells: DataFrame, filled: DataFrame) -> DataFrame:
    """source_id, col, samples: the first filled cells of each column; rows are read until all columns (filled: source_id, col
    and their number) have enough, or all they have."""
    some, upto = cells.where("text <> ''").select("source_id", "col", "row", "text"), SAMPLE_ROWS
    first = F.row_number().over(Window.partitionBy("source_id", "col").orderBy("row", "text"))
    while True:
        kept = (some.where(F.col("row") < upto) if upto < 1 << 62 else some).withColumn("_n", first).where(F.col("_n") <= SAMPLES)
        kept = kept.groupBy("source_id", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("samples"))
        kept = table_of(kept, "samples")
        short = F.coalesce(F.size("samples"), F.lit(0)) < F.least("filled", F.lit(SAMPLES))
        if upto >= 1 << 62 or filled.join(kept, ["source_id", "col"], "left").where(short).isEmpty():
            return kept
        upto *= SAMPLE_STEP


def profiles(cells: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """D3: one row for each source_id and col: ratios, extremes, distinct values and samples (the first filled cells).

    The rules look at each different text of a column once, with the number of its cells (`counted`, if these are not given).
    """
    texts = (counted(cells) if texts is None else texts).withColumn("_decimal", plain_number("text"))
    # plain numbers are told apart first: they are no names, and numbers of students by their digits
    rest = lambda plain, other: F.when(F.col("_decimal").isNotNull(), plain).otherwise(other)
    is_id = rest(F.length(F.regexp_replace("text", "[^0-9]", "")).between(4, 12), parse_student_id("text").isNotNull())
    texts = with_grade(texts, "text", name="_g").withColumns(
        {"_number": rest(F.col("_decimal"), number_of(clean_text("text"))), "_id": is_id, "_person": rest(F.lit(False), looks_like_person_name("text")), "_both": rest(F.lit(False), looks_like_id_and_name("text"))}
    )
    filled = F.col("text") != ""
    status = F.col("_g.value").isNull()
    on = lambda c: F.coalesce(F.sum(F.when(filled & c, F.col("_k"))), F.lit(0))
    p = texts.groupBy("source_id", "col").agg(
        F.sum("_k").alias("rows"), on(F.lit(True)).alias("filled"), on(F.col("_number").isNotNull()).alias("numbers"), on(F.col("_id")).alias("ids"),
        on(F.col("_person")).alias("names"), on(F.col("_both")).alias("combined"), on(status & (F.col("_g.status") != V.NO_GRADE)).alias("statuses"), on(status & (F.col("_g.status") == V.NO_GRADE)).alias("dashes"),
        F.max(F.when(filled, F.col("_number"))).alias("max_value"), F.min(F.when(filled, F.col("_number"))).alias("min_value"), F.count_if(filled).alias("distinct"),
    )
    of = lambda c: F.col(c) / F.greatest("filled", F.lit(1))
    p = table_of(p, "profiles")
    p = p.join(_samples(cells, p.select("source_id", "col", "filled")), ["source_id", "col"], "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return p.withColumns(
        {
            "filled_ratio": F.col("filled") / F.greatest("rows", F.lit(1)), "numeric_ratio": of("numbers"), "status_ratio": of("statuses"), "dash_ratio": of("dashes"),
            "gradeish_ratio": (F.col("numbers") + F.col("statuses") + F.col("dashes")) / F.greatest("filled", F.lit(1)), "id_ratio": of("ids"), "name_ratio": of("names"), "combined_ratio": of("combined"),
        }
    )


# ---------------------------------------------------------------- roles


def classify(profiled: DataFrame) -> DataFrame:
    """Profiles with header -> role, kind, scale, confidence, reason and combined, by rules in order."""
    profiled = profiled.withColumn("_p", padded(norm_header("header")))
    is_ = lambda words: mentions(F.col("_p"), words)
    c = F.col
    gradeish = (is_(V.FINAL_WORDS) | is_(V.COMPONENT_WORDS) | season_of(F.col("_p"))["season"].isNotNull()) & (c("gradeish_ratio") >= 0.95) & (c("filled") > 0)
    grade = (c("numeric_ratio") >= 0.4) | (c("numeric_ratio") + c("status_ratio") >= 0.5) | gradeish
    final, component = is_(V.FINAL_WORDS), is_(V.COMPONENT_WORDS)
    by_season = season_of(F.col("_p"), strong_only=True)["season"].isNotNull() & ~component
    rules = [
        (c("filled") == 0, "ignore", None, 0.9, "reason.empty_column"),
        (is_(V.IGNORE_WORDS), "ignore", None, 0.7, "reason.header_not_grade"),
        (c("combined_ratio") >= 0.6, "name", None, 0.9, "reason.id_and_name"),
        (is_(V.NAME_WORDS) & (c("numeric_ratio") < 0.5), "name", None, 0.95, "reason.header_name"),
        (is_(V.ID_WORDS) & (c("id_ratio") > 0.5), "id", None, 0.95, "reason.header_id"),
        (c("name_ratio") >= 0.7, "name", None, 0.8, "reason.values_names"),
        ((c("id_ratio") >= 0.8) & (c("distinct") >= F.greatest(F.lit(2), c("filled") - 2)), "id", None, 0.8, "reason.values_ids"),
        (~grade, "ignore", None, 0.4, "reason.not_recognised"),
        (by_season, "grade", "final", 0.75, "reason.epoca_grade"),
        (final & ~component, "grade", "final", 0.8, "reason.header_final"),
        (final, "grade", "final", 0.55, "reason.header_final"),
        (component, "grade", "component", 0.6, "reason.header_component"),
        (F.lit(True), "grade", "component", 0.4, "reason.header_component"),
    ]
    out = None
    for test, role, kind, confidence, reason in rules:
        value = F.struct(F.lit(role).alias("role"), F.lit(kind).cast("string").alias("kind"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    done = profiled.withColumn("_r", out)
    named = {k: F.col(f"_r.{k}") for k in ("role", "kind", "confidence", "reason")}
    return done.withColumns(named | {"scale": guess_scale(F.col("max_value")), "combined": F.col("_r.reason") == "reason.id_and_name", "locked": F.lit(False)}).drop("_r", "_p")


def one_name_one_id(columns: DataFrame) -> DataFrame:
    """Of several name columns the surest stays, of several numbers too; without a name the column most like one."""
    w = Window.partitionBy("source_id")
    text = F.length(F.array_join("samples", " "))
    rank = lambda role, *order: F.row_number().over(Window.partitionBy("source_id", "role").orderBy(*order, "col"))
    out = columns.withColumns({"_name": rank("name", F.desc("confidence"), text.desc()), "_id": rank("id", F.desc("confidence")), "_has": F.max((F.col("role") == "name").cast("int")).over(w)})
    like = F.row_number().over(w.orderBy(F.desc("name_ratio"), "col"))
    out = out.withColumn("_like", like)
    fallback = (F.col("_has") == 0) & (F.col("_like") == 1) & (F.col("name_ratio") >= 0.4)
    lost_name, lost_id = (F.col("role") == "name") & (F.col("_name") > 1), (F.col("role") == "id") & (F.col("_id") > 1)
    role = F.when(fallback, "name").when(lost_name, "ignore").when(lost_id, F.when(F.col("numeric_ratio") > 0.8, "grade").otherwise("ignore")).otherwise(F.col("role"))
    kind = F.when(lost_id & (F.col("numeric_ratio") > 0.8), F.coalesce("kind", F.lit("component"))).otherwise(F.col("kind"))
    reason = F.when(fallback, "reason.name_by_text").when(lost_name, "reason.other_name_column").when(lost_id, "reason.other_id_column").otherwise(F.col("reason"))
    return out.withColumns({"role": role, "kind": kind, "reason": reason, "confidence": F.when(fallback, 0.5).otherwise(F.col("confidence"))}).drop("_name", "_id", "_has", "_like")


# ---------------------------------------------------------------- seasons


def row_bits(cells: DataFrame, columns: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """source_id, block, col, own, said, bits: the rows of each block that have a cell of a grade column of which the same is said.

    said: CELL, FILLED for a grade, and each scale of the sheet (own: the column's) on which it fails. Each different text
    of a column (`counted`, if these are not given) is read once; each cell is one bit of one number.
    """
    grades = columns.where("role = 'grade'").select("source_id", "col", F.coalesce("scale", F.lit(-1.0)).alias("scale"))
    scales = grades.groupBy("source_id").agg(F.array_sort(F.collect_set("scale")).alias("scales"))
    listed = [r[0] for r in grades.select("col").distinct().limit(LISTED_COLUMNS + 1).collect()]
    if len(listed) <= LISTED_COLUMNS:
        cells = cells.where(F.col("col").isin(listed))
    texts = (counted(cells) if texts is None else texts).select("source_id", "col", "text").join(grades.join(scales, "source_id"), ["source_id", "col"])
    graded = with_grade(texts, "text", F.col("scale"), "g")
    fails = lambda s: F.when(F.col("g.value").isNotNull(), F.col("g.value") < s * FAILED_BELOW / 20).otherwise(F.coalesce(F.col("g.status").isin(V.FAILING), F.lit(False)))
    filled = F.when(~is_empty(F.col("g.value"), F.col("g.status")), FILLED)
    said = F.array_compact(F.concat(F.array(F.lit(CELL), filled), F.transform("scales", lambda s, i: F.when(fails(s), i))))
    read = table_of(graded.select("source_id", "col", "text", (F.array_position("scales", F.col("scale")) - 1).cast("int").alias("own"), said.alias("said")), "grade-texts")
    placed = cells.join(read, ["source_id", "col", "text"]).select("source_id", F.expr(BLOCK).alias("block"), "col", "own", "said", F.expr(BIT).alias("bit"))
    return table_of(placed.groupBy("source_id", "block", "col", "own", "said").agg(F.bit_or("bit").alias("bits")), "row-bits")


def column_pairs(cells: DataFrame, columns: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """source_id, a, b (b <> a, both grade columns): rows of the sheet, with a, with b, with both, and with b where a failed.

    Rows are bits (`row_bits`, if they are not given). Blocks of one bucket of rows meet, and pairs are counted there as
    products of their bits; nothing is shuffled for a pair of columns and a row.
    """
    bits = row_bits(cells, columns) if bits is None else bits
    maps = bits.select("source_id", F.expr(f"floor(block / {BUCKET_BLOCKS})").alias("bucket"), F.expr(f"cast(pmod(block, {BUCKET_BLOCKS}) as int)").alias("at"), "col", "own", F.explode("said").alias("said"), "bits")
    kind = dict(cells.dtypes)
    counted = maps.groupBy("source_id", "bucket").applyInPandas(_bucket_pairs, f"source_id {kind['source_id']}, a {kind['col']}, b {kind['col']}, n long, n_a long, n_b long, n_both long, failed_first long")
    return counted.groupBy("source_id", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "n_a", "n_b", "n_both", "failed_first")])


def _bucket_pairs(maps: pd.DataFrame) -> pd.DataFrame:
    """The counts of all pairs of columns in one bucket of rows, from its blocks, some blocks of all columns at a time."""
    cols, place = np.unique(maps["col"], return_inverse=True)
    kinds, kind = np.unique(maps["said"], return_inverse=True)
    blocks, at = np.unique(maps["at"], return_inverse=True)
    own = np.zeros(len(cols), np.int64)
    own[place] = maps["own"]
    packed = np.zeros((len(kinds), len(cols), len(blocks)), np.int64)
    np.bitwise_or.at(packed, (kind, place, at), maps["bits"].to_numpy())
    n, n_a, both, failed = (np.zeros((len(cols), len(cols))) for _ in range(4))
    for start in range(0, len(blocks), PAIR_BLOCKS):
        some = np.ascontiguousarray(packed[:, :, start : start + PAIR_BLOCKS])
        bits = np.unpackbits(some.view(np.uint8), axis=2).astype(np.float32)
        of = {int(k): x for k, x in zip(kinds, bits, strict=True)}
        cell, filled = of[CELL], of.get(FILLED, np.zeros_like(bits[0]))
        n += cell @ cell.T
        n_a += filled @ cell.T
        both += filled @ filled.T
        for s in np.unique(own):  # on the scale of the second column
            if s in of:
                failed[:, own == s] += of[s] @ filled[own == s].T
    a, b = np.nonzero(~np.eye(len(cols), dtype=bool) & (n > 0))
    counts = {k: x[a, b].astype(np.int64) for k, x in (("n", n), ("n_a", n_a), ("n_b", n_a.T), ("n_both", both), ("failed_first", failed))}
    return pd.DataFrame({"source_id": maps["source_id"].iloc[0], "a": cols[a], "b": cols[b], **counts})


def moment_verdict(rows: Column, second: Column, failed: Column | None) -> Column:
    """`recurso` (another season) or `continua` (the same one), by who has a grade at the second moment."""
    cover = second / F.greatest(rows, F.lit(1))
    share = F.coalesce(F.try_divide(failed, second), F.lit(0.0)) if failed is not None else F.lit(0.0)
    only = (share >= 0.8) & (cover <= 0.7) if failed is not None else F.lit(False)
    return F.when(second == 0, "recurso").when(only, "recurso").when(cover >= 0.7, "continua").when(share >= 0.5, "recurso").otherwise("continua")


def season_blocks(columns: DataFrame) -> DataFrame:
    """Grade columns with block, block_moment, block_season and shared, from left to right.

    A column whose header names a season for certain begins a block of that season; one that names another moment than
    the block so far begins a block of that moment, unless the file as a whole names its season. In any other block the
    first header that hints at a season gives it. Columns of the first block that come before any season are shared.
    columns: _season, _strength and _moment say what the header says, file_season what the file says.
    """
    left = Window.partitionBy("source_id").orderBy("col")
    strong = F.coalesce(F.col("_strength") == "strong", F.lit(False))
    by_moment = F.col("_moment").isNotNull() & F.col("file_season").isNull()
    # the moment that holds after a column: that of its block, 0 for none; 1 before any
    c = columns.where("role = 'grade'").withColumn("_holds", F.when(strong, 0).when(by_moment, F.col("_moment")))
    before = F.coalesce(F.last("_holds", ignorenulls=True).over(left.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    c = c.withColumn("_starts", strong | (by_moment & (before != F.col("_moment"))))
    c = c.withColumn("block", F.sum(F.col("_starts").cast("int")).over(left.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    inside = Window.partitionBy("source_id", "block").orderBy("col")
    whole, so_far = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), inside.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_hint", F.when((F.col("_strength") == "weak") & ~F.col("_starts"), F.col("_season")))
    opened = F.first(F.when(F.col("_starts") & strong, F.col("_season")), ignorenulls=True).over(whole)
    hinted = F.first("_hint", ignorenulls=True)
    c = c.withColumns(
        {
            "block_season": F.coalesce(opened, F.when(F.col("block") == 0, F.col("file_season")), hinted.over(whole)),
            "block_moment": F.when(F.col("block") == 0, 1).otherwise(F.first(F.when(F.col("_starts"), F.col("_holds")), ignorenulls=True).over(whole)),
            "shared": (F.col("block") == 0) & F.col("file_season").isNull() & hinted.over(so_far).isNull(),
        }
    )
    return c.drop("_holds", "_starts", "_hint")


def assign_seasons(columns: DataFrame, pairs: DataFrame, file_season: DataFrame | None = None) -> DataFrame:
    """Columns with season, route and moment.

    A block of a moment without a season has that of the block before it or the one after that, as the final grades of
    both say. file_season: (source_id, file_season) that the file as a whole names.
    """
    c = columns.withColumns({"_p": padded(norm_header("header")), "_moment": moment_index("header")})
    c = c.withColumns({"_said": season_of(F.col("_p")), "_route": route_in(F.col("_p"))}).withColumns({"_season": F.col("_said.season"), "_strength": F.col("_said.strength")}).drop("_said", "_p")
    c = c.join(file_season, "source_id", "left") if file_season is not None else c.withColumn("file_season", F.lit(None).cast("string"))
    c = season_blocks(c)
    verdict, alone = moment_verdict(F.col("n"), F.col("n_b"), F.col("failed_first")), moment_verdict(F.col("n"), F.col("n_b"), None)
    said = pairs.select("source_id", F.col("a").alias("_final_before"), F.col("b").alias("_final"), verdict.alias("_both"))
    lone = pairs.groupBy("source_id", F.col("b").alias("_final")).agg(F.max(alone).alias("_alone"))
    # a row for each block: its final grade is the last column that is one, or the last
    blocks = c.groupBy("source_id", "block").agg(
        F.first("block_season").alias("known"), F.first("block_moment").alias("moment"), F.first("file_season").alias("file_season"),
        F.coalesce(F.max(F.when(F.col("kind") == "final", F.col("col"))), F.max("col")).alias("_final"),
    )
    order = Window.partitionBy("source_id").orderBy("block")
    blocks = blocks.withColumn("_final_before", F.lag("_final").over(order))
    blocks = blocks.join(said, ["source_id", "_final", "_final_before"], "left").join(lone, ["source_id", "_final"], "left")
    verdict = F.coalesce(F.when(F.col("_final_before").isNull(), F.col("_alone")).otherwise(F.col("_both")), F.lit("recurso"))
    open_ = F.col("known").isNull() & (F.col("moment") > 1)
    place = lambda s: F.array_position(F.array(*map(F.lit, V.SEASONS)), s).cast("int") - 1
    # steps from the last block whose season is known; the first block counts as the first season, present or not
    fixed = F.when(~open_, F.coalesce(place(F.col("known")), F.lit(0)))
    blocks = blocks.withColumns({"_fixed": fixed, "_step": F.when(open_, (verdict == "recurso").cast("int")).otherwise(0), "_way": F.when(open_, F.when(verdict == "continua", "continua").otherwise("exame"))})
    blocks = blocks.withColumn("_run", F.count("_fixed").over(order))
    run = Window.partitionBy("source_id", "_run").orderBy("block")
    start = F.coalesce(F.first("_fixed", ignorenulls=True).over(run), place(F.col("file_season")), F.lit(0))
    at = F.least(start + F.sum("_step").over(run), F.lit(len(V.SEASONS) - 1))
    sheet = Window.partitionBy("source_id")
    several = F.max("block").over(sheet) > 0
    season = F.when(open_ | (several & (F.col("block") == 0)), F.get(F.array(*map(F.lit, V.SEASONS)), at)).otherwise(F.col("known"))
    blocks = blocks.withColumn("_of_block", season).withColumn("_seasons", F.size(F.collect_set("_of_block").over(sheet)))
    blocks = blocks.select("source_id", "block", "moment", "_of_block", "_way", "_seasons")
    c = c.join(blocks, ["source_id", "block"]).withColumn("shared", F.col("shared") & (F.col("_seasons") > 1))
    own = F.when(~F.col("shared"), F.col("_of_block"))
    route = F.when(F.col("shared"), F.col("_route")).when(own.isin(V.SEASONS[1:]), "exame").otherwise(F.coalesce("_route", "_way"))
    c = c.select("source_id", "col", own.alias("season"), route.alias("route"), F.nullif(F.col("moment"), F.lit(0)).alias("moment"))
    return columns.join(c, ["source_id", "col"], "left").select(*columns.columns, "season", "route", "moment")


def promote_exam_routes(columns: DataFrame, cells: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """An exam column filled only where the season's finals are empty is a route of its own: a final grade.

    The finals of each season are laid over each other, and the exam column over these, as bits of rows (`row_bits`).
    """
    bits = row_bits(cells, columns) if bits is None else bits
    may_be = (F.col("kind") != "final") & ~F.col("locked") & mentions(padded(norm_header("header")), V.EXAM_WORDS)
    grades = columns.where("role = 'grade'").select("source_id", "col", F.coalesce("season", F.lit("")).alias("s"), (F.col("kind") == "final").alias("is_final"), may_be.alias("may_be"))
    on = bits.join(grades, ["source_id", "col"]).withColumn("on", F.array_contains("said", FILLED))
    finals = on.where("is_final").groupBy("source_id", "s", "block").agg(F.bit_or("bits").alias("finals"), F.coalesce(F.bit_or(F.when(F.col("on"), F.col("bits"))), F.lit(0)).alias("filled_finals"))
    counts = on.where("may_be and on").join(finals, ["source_id", "s", "block"]).groupBy("source_id", "col").agg(F.expr("sum(bit_count(bits & finals))").alias("own"), F.expr("sum(bit_count(bits & finals & ~filled_finals))").alias("alone"))
    good = counts.where("own >= 2 and alone >= own * 0.9").select("source_id", "col", F.lit(True).alias("_exam"))
    out = columns.join(good, ["source_id", "col"], "left").withColumn("_exam", F.coalesce("_exam", F.lit(False)))
    when = lambda yes, c: F.when(F.col("_exam"), yes).otherwise(F.col(c))
    return out.withColumns({"kind": when(F.lit("final"), "kind"), "route": when(F.lit("exame"), "route"), "reason": when(F.lit("reason.exam_route"), "reason"), "confidence": when(F.greatest("confidence", F.lit(0.7)), "confidence")}).drop("_exam").select(*columns.columns)


def with_clusters(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns with cluster, for grade columns: the least column that a chain of overlaps leads to among the final grades
    of one season. Columns overlap that share half of the rows that either has."""
    share = F.try_divide(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both"))
    finals = columns.where("role = 'grade' and kind = 'final'").select("source_id", "col", F.coalesce("season", F.lit("")).alias("s"))
    linked = pairs.where((share >= 0.5) & (F.col("a") < F.col("b"))).select("source_id", "a", "b")
    linked = linked.join(finals.withColumnRenamed("col", "a"), ["source_id", "a"]).join(finals.withColumnRenamed("col", "b"), ["source_id", "b", "s"])
    links = linked.groupBy("source_id", "s").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("links"))
    groups = finals.groupBy("source_id", "s").agg(F.collect_list(F.struct("col", F.col("col").alias("cluster"))).alias("of")).join(links, ["source_id", "s"])
    label = lambda of, col: F.get(F.filter(of, lambda x: x["col"] == col), F.lit(0))["cluster"]

    def join(of: Column, link: Column) -> Column:
        p, q = label(of, link["a"]), label(of, link["b"])
        return F.transform(of, lambda x: F.struct(x["col"].alias("col"), F.when((x["cluster"] == p) | (x["cluster"] == q), F.least(p, q)).otherwise(x["cluster"]).alias("cluster")))

    groups = groups.select("source_id", F.explode(F.aggregate("links", F.col("of"), join)).alias("x")).select("source_id", "x.col", F.col("x.cluster").alias("_cluster"))
    out = columns.join(groups, ["source_id", "col"], "left")
    return out.withColumn("cluster", F.when(F.col("role") == "grade", F.coalesce("_cluster", "col"))).drop("_cluster")


def pick_finals(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns with cluster; one final grade for each season and cluster of columns filled for the same rows.

    Beside final grades of seasons, a grade of no season is a shared component. Of the final grades of a cluster the last
    locked one stays, else the one of highest priority, the last of equals; it is less sure if another comes close, and
    an alternative route if the season has several clusters. A season without final grade takes its last column that is
    not locked, numeric ones first. Locked columns stay as they are.
    """
    c = with_clusters(columns, pairs)
    c = c.withColumn("_p", padded(norm_header("header"))).withColumn("_priority", priority_in(F.col("_p"))).drop("_p")
    grade = F.col("role") == "grade"
    c = c.withColumns({"_grade": grade, "_final": grade & (F.col("kind") == "final"), "_s": F.coalesce("season", F.lit(""))})
    sheet = Window.partitionBy("source_id")
    season = Window.partitionBy("source_id", "_grade", "_s")
    cluster = Window.partitionBy("source_id", "_final", "_s", "cluster")
    locked, free = F.col("locked"), ~F.col("locked")
    best = cluster.orderBy(F.desc("locked"), F.when(locked, 0).otherwise(F.col("_priority")).desc(), F.desc("col"))
    last = season.orderBy(locked, (F.col("numeric_ratio") <= 0.3), F.desc("col"))
    c = c.withColumns(
        {
            "_seasonal": F.bool_or(F.col("_final") & (F.col("_s") != "")).over(sheet), "_finals": F.count_if("_final").over(season), "_parts": F.size(F.collect_set(F.when(F.col("_final"), F.col("cluster"))).over(season)),
            "_best": F.row_number().over(best) == 1, "_next": F.lead("_priority").over(best), "_fixed": F.bool_or("locked").over(cluster), "_last": F.row_number().over(last) == 1,
        }
    )
    shared = F.col("_grade") & (F.col("_s") == "") & F.col("_seasonal")
    fallback = F.col("_grade") & ~shared & (F.col("_finals") == 0) & F.col("_last") & free
    chosen = F.col("_final") & ~shared & F.col("_best")
    lost = F.col("_final") & ~shared & ~F.col("_best") & free
    close = chosen & ~F.col("_fixed") & (F.col("_priority") - F.col("_next") < 20)
    kind = F.when((shared & free) | lost, "component").when(fallback, "final").otherwise(F.col("kind"))
    reason = F.when(shared & free, "reason.shared_component").when(fallback, "reason.last_of_block").when(lost, "reason.other_final_chosen").when(chosen & (F.col("_parts") > 1), "reason.alt_route").otherwise(F.col("reason"))
    sure = F.when(fallback, F.least("confidence", F.lit(0.35))).when(close, F.least("confidence", F.lit(0.55))).otherwise(F.col("confidence"))
    return c.withColumns({"kind": kind, "reason": reason, "confidence": sure}).select(*columns.columns, "cluster")


def refresh_columns(columns: DataFrame, cells: DataFrame, bits: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Routes, clusters and finals again, after columns have been changed; bits and pairs, if these still hold."""
    base = columns.drop("cluster")
    bits = row_bits(cells, base) if bits is None else bits
    base = table_of(promote_exam_routes(base, cells, bits), "routes")
    return pick_finals(base, column_pairs(cells, base, bits) if pairs is None else pairs)


def classified(cells: DataFrame, headers: DataFrame, data: DataFrame, file_season: DataFrame | None = None) -> DataFrame:
    """Columns with roles, seasons, routes and final grades, from raw cells, header rows and data cells."""
    deepest = headers.agg(F.max("header")).first()[0]
    titles = cells.where(F.col("row") <= F.lit(deepest)).join(headers, "source_id").where("row = header").select("source_id", "col", clean_text("text").alias("header"))
    everywhere = cells.select("source_id", "col").distinct()
    texts = table_of(counted(data), "texts")
    shaped = everywhere.join(profiles(data, texts), ["source_id", "col"], "left").join(titles, ["source_id", "col"], "left")
    numbers = [c for c, t in shaped.dtypes if t in ("bigint", "double") and c not in ("max_value", "min_value", "col")]
    named = F.when(F.coalesce("header", F.lit("")) != "", F.col("header")).otherwise(F.concat(F.lit("Coluna "), (F.col("col") + 1).cast("string")))
    shaped = shaped.fillna(0, numbers).withColumns({"header": named, "samples": F.coalesce("samples", F.array().cast("array<string>")), "col": F.col("col").cast("int")})
    # a row for each column from here on: written, so that each later step starts from rows, not from the whole plan
    columns = table_of(one_name_one_id(classify(shaped)), "columns")
    bits = row_bits(data, columns, texts)
    pairs = table_of(column_pairs(data, columns, bits), "pairs")  # of columns by role and scale, which stay from here on
    columns = table_of(assign_seasons(columns, pairs, file_season), "seasons-of-columns")
    return refresh_columns(columns, data, bits, pairs)


def classify_columns(cells: DataFrame, headers: DataFrame, file_season: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(columns, data): from raw cells and header rows."""
    headers = table_of(headers, "headers")
    data = data_cells(cells, headers)
    return classified(cells, headers, data, file_season), data
