"""Tables from word boxes: words (doc, page, text, x0, x1, top, bottom) become lines, bands and cells.

Gaps, bands and runs are window functions over a page. Only the running anchor of visual lines and the placing of header
labels depend on what was decided before, and run page by page.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.numbers import parse_student_id
from rollbook.functions.text import clean_text, looks_like_person_name
from rollbook.operators.inference import with_score

# Distances in points, and shares.
COLUMN_GAP, SEGMENT_GAP, HEADER_GAP, LABEL_GAP, LABEL_TOUCH, ID_NAME_GAP = 4.5, 22.0, 7.0, 6.0, 3.0, 1.5
SAME_COLUMN_OVERLAP, ALIGN_TOLERANCE, MAX_ROW_SKIP, MAX_HEADER_WORDS, HEADER_LINES, LEAST_ROWS = 0.25, 5.0, 2, 4, 6, 3
# End of fixed values.
PAGE = ["doc", "page"]


def longest_run(rows: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """H5: key, longest_run: the most consecutive rows of one state. Gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    starts = (~F.lag(state).over(w).eqNullSafe(F.col(state)) | (F.row_number().over(w) == 1)).cast("int")
    run = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_starts", starts).withColumn("_run", run).groupBy(key, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest_run"))


def lines(words: DataFrame) -> DataFrame:
    """Words with line (from 0, top to bottom). A word is of the line whose first word is near enough above it."""
    schema = f"{words.schema.simpleString()[7:-1]}, line int"

    def one_page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["top", "x0"], kind="stable").reset_index(drop=True)
        tolerance = min(max((pdf["bottom"] - pdf["top"]).median() * 0.55, 1.5), 4.0)
        out, line, anchor = [], -1, float("-inf")
        for top in pdf["top"]:
            if line < 0 or abs(top - anchor) > tolerance:
                line, anchor = line + 1, top
            out.append(line)
        pdf["line"] = pd.Series(out, dtype="int32")
        return pdf

    return words.groupBy(*PAGE).applyInPandas(one_page, schema)


def records(lined: DataFrame) -> DataFrame:
    """Doc, page, line, left, right of the lines that look like a person's row."""
    lined = with_score(lined)
    in_order = F.array_sort(F.collect_list(F.struct("x0", "x1", "text", F.col("_number").isNull().alias("word"))))
    of = lined.groupBy(*PAGE, "line").agg(
        in_order.alias("w"), F.sum("score").alias("score"), F.bool_or(F.col("_id").isNotNull()).alias("has_id"),
        F.count_if(F.col("_number").isNotNull() | (F.length("text") <= 3)).alias("values"), F.min_by("x1", F.struct("x0", "x1")).alias("right"), F.min("x0").alias("left"),
    )
    name = F.array_join(F.transform(F.filter("w", lambda x: x["word"]), lambda x: x["text"]), " ")
    good = (F.size("w") >= 2) & (F.col("score") < 3) & (F.col("has_id") | looks_like_person_name(name)) & (F.col("values") >= 1)
    return of.where(good).select(*PAGE, "line", "left", "right")


def body_lines(found: DataFrame) -> DataFrame:
    """Doc, page, line of the table's body: the longest run of aligned records, by left or by right edge.

    Groups of aligned records start at the first edge beyond the tolerance; runs allow for MAX_ROW_SKIP lines between.
    """
    schema = "doc string, page int, line int"

    def one_page(pdf: pd.DataFrame) -> pd.DataFrame:
        best: list[int] = []
        for edge in ("left", "right"):
            at = pdf.sort_values([edge, "line"])
            group, start = [], None
            for x, line in [*zip(at[edge], at["line"], strict=True), (float("inf"), -1)]:
                if start is None or x - start > ALIGN_TOLERANCE:
                    s = pd.Series(sorted(group), dtype="int64")
                    if len(s):
                        runs = s.groupby((s.diff() > MAX_ROW_SKIP).cumsum()).agg(list)
                        run = max(runs, key=len)
                        best = run if len(run) > len(best) else best
                    group, start = [], x
                group.append(line)
        kept = best if len(best) >= 2 else sorted(pdf["line"])
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "page": pdf["page"].iloc[0], "line": pd.Series(kept, dtype="int32")})

    return found.groupBy(*PAGE).applyInPandas(one_page, schema)


def covers(words: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """H5: keys, x0, x1: disjoint intervals, more than gap apart, that cover the words of each batch of rows.

    To join intervals again that were joined before in parts gives what joining all at once would.
    """
    kinds = dict(words.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = pa.StructArray.from_arrays([b.column(i) for i in range(len(keys))], list(keys)) if len(keys) > 1 else b.column(0)
            code = _codes(b, len(keys))
            x0, x1 = (b.column(i).to_numpy(zero_copy_only=False) for i in (-2, -1))
            order = np.lexsort((x1, x0, code))
            code, x0, x1 = code[order], x0[order], x1[order]
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            fresh = np.zeros(len(code), bool)
            for at, end in zip(starts, [*starts[1:], len(code)], strict=True):
                reach = np.maximum.accumulate(x1[at:end])
                fresh[at] = True
                fresh[at + 1 : end] = x0[at + 1 : end] > np.maximum(reach[:-1], x0[at]) + gap
            first = np.flatnonzero(fresh)
            kept = key.take(pa.array(order[first]))
            parts = kept.flatten() if len(keys) > 1 else [kept]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(x0[first]), pa.array(np.maximum.reduceat(x1, first))], names=[*keys, "x0", "x1"])

    rows = words.select(*keys, F.col("x0").cast("double"), F.col("x1").cast("double"))
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x0 double, x1 double")


def _codes(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """A number for each different value of the first n columns together."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(n):
        own = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)
    return code


def column_bounds(body: DataFrame, keys: Sequence[str] = PAGE, gap: float = COLUMN_GAP) -> DataFrame:
    """A8d: keys, bounds: left end, the middle of every gap that no word covers, right end. Running maximum and gap test.

    Words that touch are first joined where they lie (`covers`), so that a page, however long, is a few intervals in its window.
    """
    body = covers(body, keys, gap)
    w = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = body.withColumn("_reach", F.greatest(reach, F.min("x0").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    cut = cut.withColumn("_cut", F.when(F.col("x0") > F.col("_reach") + gap, (F.col("_reach") + F.col("x0")) / 2))
    inner = F.array_sort(F.array_compact(F.collect_list("_cut")))
    return cut.groupBy(*keys).agg(F.concat(F.array(F.min("x0") - 1), inner, F.array(F.max("x1") + 1)).alias("bounds"))


def band_of(words: DataFrame, bounds: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """A8h: words with col, the band that holds their centre, the nearest one outside. An equi-join on the page; the place
    among its few bounds is an expression, not a range join."""
    inside = F.size(F.filter("bounds", lambda b: b <= (F.col("x0") + F.col("x1")) / 2)) - 1
    return words.join(bounds, list(keys)).withColumn("col", F.greatest(F.lit(0), F.least(inside, F.size("bounds") - 2))).drop("bounds")


def value_spans(placed: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """A8f: keys, col, lo, hi: where each column has values."""
    return placed.groupBy(*keys, "col").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))


def line_cells(placed: DataFrame) -> DataFrame:
    """A8h: doc, page, line, col, text: words of a cell in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*PAGE, "line", "col").agg(clean_text(text).alias("text"))


def segments(lined: DataFrame, gap: float = SEGMENT_GAP) -> DataFrame:
    """A8j: doc, page, line, segment, text: loose text cut at wide gaps."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x0")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(w)) > gap, F.lit(False)).cast("int")
    cut = lined.withColumn("_wide", wide).withColumn("segment", F.sum("_wide").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return cut.groupBy(*PAGE, "line", "segment").agg(clean_text(text).alias("text")).where("text <> ''")


def split_id_column(placed: DataFrame, bounds: DataFrame, n_lines: DataFrame) -> DataFrame:
    """A8e: bounds with a cut between number and name where most lines of a column have one before the other."""
    w = Window.partitionBy(*PAGE, "col", "line").orderBy("x0")
    numbered = placed.withColumn("_n", F.row_number().over(w))
    row = numbered.groupBy(*PAGE, "col", "line").agg(
        F.max(F.when(F.col("_n") == 1, F.col("text"))).alias("first"), F.max(F.when(F.col("_n") == 1, F.col("x1"))).alias("end"), F.max(F.when(F.col("_n") == 2, F.col("x0"))).alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.struct("x0", "text")))), lambda x: x["text"]), " ").alias("rest"),
    )
    row = row.where(F.col("start").isNotNull() & parse_student_id("first").isNotNull() & parse_student_id("rest").isNull() & looks_like_person_name("rest"))
    cuts = row.groupBy(*PAGE, "col").agg(F.max("end").alias("end"), F.min("start").alias("start"), F.count(F.lit(1)).alias("n")).join(n_lines, PAGE)
    cuts = cuts.where((F.col("n") >= F.greatest(F.lit(2.0), F.col("lines") * 0.6)) & (F.col("start") - F.col("end") >= ID_NAME_GAP))
    cuts = cuts.groupBy(*PAGE).agg(F.min_by((F.col("end") + F.col("start")) / 2, "col").alias("cut"))
    return bounds.join(cuts, PAGE, "left").select(*PAGE, F.when(F.col("cut").isNotNull(), F.array_sort(F.array_append("bounds", F.col("cut")))).otherwise(F.col("bounds")).alias("bounds"))


def header_labels(lined: DataFrame, first_body: DataFrame) -> DataFrame:
    """A8i: doc, page, line, label, x0, x1, words of the lines that may be a header, up to HEADER_LINES above the body.

    Such a line has a gap of HEADER_GAP; a label ends at a gap of LABEL_GAP and has fewer than MAX_HEADER_WORDS words; the
    first line upwards that is none ends the header.
    """
    above = lined.join(first_body, PAGE).where(F.col("line").between(F.col("first") - HEADER_LINES, F.col("first") - 1))
    w = Window.partitionBy(*PAGE, "line").orderBy("x0")
    above = above.withColumn("_gap", F.col("x0") - F.lag("x1").over(w)).withColumn("_new", F.coalesce(F.col("_gap") >= LABEL_GAP, F.lit(False)).cast("int"))
    above = above.withColumn("label", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    label = above.groupBy(*PAGE, "first", "line", "label").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("words"), text.alias("text"), F.max(F.coalesce("_gap", F.lit(0.0))).alias("gap"))
    line = Window.partitionBy(*PAGE, "line")
    ok = (F.max("gap").over(line) >= HEADER_GAP) & (F.count(F.lit(1)).over(line) >= 2) & (F.max("words").over(line) < MAX_HEADER_WORDS)
    label = label.withColumn("_ok", ok)
    stop = F.max(F.when(~F.col("_ok"), F.col("line")).otherwise(-1)).over(Window.partitionBy(*PAGE))
    lowest = F.max("line").over(Window.partitionBy(*PAGE))
    return label.withColumn("_stop", stop).withColumn("_low", lowest).where("_ok and line > _stop and _low = first - 1").select(*PAGE, "line", "label", "x0", "x1", "words", "text")


def merge_straddled(bounds: DataFrame, labels: DataFrame, placed: DataFrame) -> DataFrame:
    """A8g: bounds without those that a header word reaches over, if hardly any line has values on both sides."""
    spans = value_spans(placed)
    rows = placed.groupBy(*PAGE, "col").agg(F.collect_set("line").alias("rows"))
    side = spans.join(rows, [*PAGE, "col"])
    right = side.select(*PAGE, (F.col("col") - 1).alias("col"), F.col("lo").alias("r_lo"), F.col("rows").alias("r_rows"))
    pair = side.join(right, [*PAGE, "col"]).join(bounds, PAGE).where("size(bounds) > 3").withColumn("cut", F.get("bounds", F.col("col") + 1))
    share = F.size(F.array_intersect("rows", "r_rows")) / F.size(F.array_union("rows", "r_rows"))
    reach = (labels["x0"] < F.col("cut")) & (labels["x1"] > F.col("cut")) & (labels["x0"] <= F.col("hi") + LABEL_TOUCH) & (labels["x1"] >= F.col("r_lo") - LABEL_TOUCH)
    # few labels and few bounds on a page: the condition is looked at within the page
    gone = pair.where(share < SAME_COLUMN_OVERLAP).join(labels.select(*PAGE, "x0", "x1"), PAGE).where(reach).groupBy(*PAGE).agg(F.collect_set("cut").alias("gone"))
    return bounds.join(gone, PAGE, "left").select(*PAGE, F.when(F.col("gone").isNotNull(), F.array_except("bounds", "gone")).otherwise(F.col("bounds")).alias("bounds"))


def place_labels(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """A8i: doc, page, col, text: each label goes to the column that it overlaps most, else to the nearest one without."""

    def one_page(key, labels: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.sort_values("col")
        parts: dict[int, list[str]] = {}
        for lab in labels.sort_values(["line", "x0"]).itertuples():
            over = spans[["hi"]].clip(upper=lab.x1)["hi"] - spans["lo"].clip(lower=lab.x0)
            if len(over) and over.max() > 0:
                col = int(spans.loc[over.idxmax(), "col"])
            else:
                free = spans[~spans["col"].isin(list(parts))]
                if not len(free):
                    continue
                away = ((free["lo"] + free["hi"]) / 2 - (lab.x0 + lab.x1) / 2).abs()
                col = int(free.loc[away.idxmin(), "col"])
            parts.setdefault(col, []).append(lab.text)
        return pd.DataFrame([(key[0], key[1], c, " ".join(t)) for c, t in parts.items()], columns=["doc", "page", "col", "text"])

    spans = spans.withColumnsRenamed({"doc": "sdoc", "page": "spage"}).select(F.col("sdoc").alias("d"), F.col("spage").alias("p"), "col", "lo", "hi")
    return labels.groupBy(*PAGE).cogroup(spans.groupBy("d", "p")).applyInPandas(one_page, "doc string, page int, col int, text string")


def tables(words: DataFrame) -> DataFrame:
    """Doc, page, row, col, text of the table on each page; row 0 is the header where one is found.

    Pages of fewer than LEAST_ROWS lines, of fewer than two body lines or columns, and columns without any text give nothing.
    """
    words = words.select(F.col("doc").cast("string"), F.col("page").cast("int"), "text", *[F.col(c).cast("double") for c in ("x0", "x1", "top", "bottom")])
    lined = lines(words)
    body_at = body_lines(records(lined))
    body = lined.join(body_at, [*PAGE, "line"], "left_semi")
    n_lines = body_at.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first"))
    bounds = column_bounds(body).where("size(bounds) >= 3")
    bounds = split_id_column(band_of(body, bounds), bounds, n_lines)
    labels = header_labels(lined, n_lines.select(*PAGE, "first"))
    bounds = merge_straddled(bounds, labels, band_of(body, bounds))
    placed = band_of(body, bounds)
    head = place_labels(labels, value_spans(placed)).select(*PAGE, F.lit(-1).alias("line"), "col", "text")
    cells = line_cells(placed).unionByName(head).where("text <> ''")
    rows = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("line")) - 1
    cols = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("col")) - 1
    return cells.withColumn("row", rows).withColumn("c", cols).select(*PAGE, "row", F.col("c").alias("col"), "text")


def stitch(cells: DataFrame) -> DataFrame:
    """Pages of a document joined by the names in their first rows.

    cells (doc, page, row, col, text). Columns of one name are one column, in the order of first appearance; a page that
    shares fewer than two names with the document's first page, and is not as wide, keeps its own table (part).
    """
    name = F.lower(F.trim("text"))
    heads = cells.where("row = 0 and text <> ''").select("doc", "page", "col", name.alias("name"))
    first = F.min("page").over(Window.partitionBy("doc"))
    heads = heads.withColumn("first", first)
    base = heads.where("page = first").select("doc", "name", F.col("col").alias("base_col"))
    on = heads.join(base, ["doc", "name"], "left")
    shared = on.groupBy("doc", "page").agg(F.count("base_col").alias("shared"))
    joined = on.join(shared.where("shared >= 2"), ["doc", "page"])
    # a name of a later page that the first lacks is a new column behind the others
    new = joined.where("base_col is null").groupBy("doc", "name").agg(F.min(F.struct("page", "col")).alias("at"))
    width = base.groupBy("doc").agg((F.max("base_col") + 1).alias("width"))
    new = new.join(width, "doc").withColumn("base_new", F.col("width") + F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1)
    target = joined.join(new.select("doc", "name", "base_new"), ["doc", "name"], "left").select("doc", "page", "col", F.coalesce("base_col", "base_new").alias("to"))
    return cells.join(target, ["doc", "page", "col"], "left").select(
        "doc", "page", "row", F.coalesce("to", "col").alias("col"), "text", F.when(F.col("to").isNull() & ~F.col("page").isin([1]), F.col("page")).alias("part")
    )


def table_scores(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, score of candidate tables: share of filled cells in percent, less 10 for each empty column, plus the best
    header score of the first four rows up to 12. Tables of fewer than LEAST_ROWS rows have none.

    cells: (*keys, row, col, text), every cell of a table present.
    """
    filled = F.col("text") != ""
    columns = cells.groupBy(*keys, "col").agg(F.bool_or(filled).alias("used")).groupBy(*keys).agg(F.count_if(~F.col("used")).alias("empty"))
    whole = cells.groupBy(*keys).agg((F.count_if(filled) / F.count(F.lit(1)) * 100).alias("share"), F.countDistinct("row").alias("rows"))
    heads = with_score(cells.where("row < 4")).groupBy(*keys, "row").agg(F.sum("score").alias("s")).groupBy(*keys).agg(F.max("s").alias("head"))
    out = whole.join(columns, list(keys)).join(heads, list(keys)).where(F.col("rows") >= LEAST_ROWS)
    return out.select(*keys, (F.col("share") - F.col("empty") * 10 + F.least("head", F.lit(12))).alias("score"))


def best_tables(cells: DataFrame, page_keys: Sequence[str], candidate: str) -> DataFrame:
    """The cells of the best scored candidate table of each page, the first of equals."""
    scores = table_scores(cells, [*page_keys, candidate])
    best = scores.groupBy(*page_keys).agg(F.max_by(candidate, F.struct("score", -F.col(candidate))).alias(candidate))
    return cells.join(best, [*page_keys, candidate], "left_semi")
