"""Grade sheets in files: delimited and fixed-width text in any encoding, spreadsheets, and word boxes.

Files are read by Spark, so any store that it reaches will do. Most are binary rows that a task parses whole; long
delimited texts are read in pieces (`texts`). A table is (source_id, filename, kind, location, sheet_name, title_lines,
footer_lines); its rows are a table of their own, which cells() turns into long form.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.session import table_of
from rollbook.sources.texts import long_texts

#: What can be read, byte order marks and encodings in the order tried, separators in theirs.
KINDS = {"csv": "csv", "tsv": "csv", "txt": "txt", "xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx", "pdf": "pdf"}
MARKS = [(b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")]
ENCODINGS = ["utf-8-sig", "utf-8", "cp1252", "latin-1"]
SEPARATORS = ["\t", ";", "|", ","]
SAMPLE_LINES = 60
# End of fixed values.

TABLES = "source_id string, file_order long, filename string, kind string, location string, sheet_name string, title_lines array<string>, footer_lines array<string>, error string"
ROWS = "source_id string, file_order long, row long, cells array<string>"
#: Delimited text beyond so many bytes is parsed in pieces. Rows that a task hands on together.
SPLIT_BYTES, PARSED_ROWS = 8 << 20, 10_000
_DASH = str.maketrans("‐‑‒–—−", "------")


def kind_of(name: str) -> str | None:
    """A1: the kind of a file by its extension; None for others."""
    return KINDS.get(name.rpartition(".")[2].lower()) if "." in name else None


def clean(value: object) -> str:
    """A cell as text: whole floats without a fraction, hyphens for dashes, single spaces."""
    if value is None:
        return ""
    text = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
    return " ".join(text.translate(_DASH).split())


def decode(data: bytes) -> str:
    """A2: text by byte order mark, else the first encoding that fits."""
    marked = next((e for m, e in MARKS if data.startswith(m)), None)
    for encoding in ([marked] if marked else []) + ENCODINGS:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def separator_of(lines: list[str]) -> str | None:
    """A3: the separator whose count is most alike over the lines that have it; None if no one is in most lines."""
    sample = lines[:SAMPLE_LINES]
    scored = []
    for sep in SEPARATORS:
        counts = [n for n in (line.count(sep) for line in sample) if n]
        if len(counts) < max(2, int(len(sample) * 0.6)):
            continue
        # of equally frequent counts the one that a set yields first decides nothing: consistency is the same
        usual, times = max(Counter(counts).items(), key=lambda x: (x[1], x[0]))
        if times / len(counts) >= 0.7:
            scored.append((times / len(counts) * 10 + usual, sep))
    return max(scored, key=lambda x: x[0])[1] if scored else None


def fixed_width(lines: list[str]) -> list[list[str]]:
    """A5: cells between corridors of two spaces or more that all lines share; else between runs of spaces."""
    width = max(map(len, lines))
    blank = "".join(" " if all(len(x) <= i or x[i] == " " for x in lines) else "x" for i in range(width))
    # a corridor at the right margin is only cut if it ends there
    cuts = [(m.start() + m.end()) // 2 for m in re.finditer(" {2,}", blank)]
    if not cuts:
        return [re.split(" {2,}", x.strip()) for x in lines]
    ends = [*cuts, width]
    return [[clean(x[a:b]) for a, b in zip([0, *cuts], ends, strict=True)] for x in lines]


def text_rows(content: str) -> list[list[str]]:
    """A4: rows of equal width, without blank ones; [] if there are fewer than two."""
    lines = [x for x in content.splitlines() if x.strip()]
    if len(lines) < 2:
        return []
    sep = separator_of(lines)
    rows = [[clean(c) for c in r] for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=sep)] if sep else fixed_width(lines)
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows] if len(rows) > 1 else []


# ---------------------------------------------------------------- spreadsheets

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _letters(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, v = c.get("t"), c.find(f"{_NS}v")
    if kind == "inlineStr":
        return clean("".join(t.text or "" for t in c.iter(f"{_NS}t")))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return clean(shared[int(v.text)])
    if kind in ("str", "e"):
        return clean(v.text)
    if kind == "b":
        return "True" if v.text == "1" else "False"
    try:
        return clean(float(v.text))
    except ValueError:
        return clean(v.text)


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of the visible sheets; cached values stand for formulas; rows are read one at a time."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if si.tag == f"{_NS}si":
                    shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
                    si.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{_NS}sheet"):
            if s.get("state", "visible") != "visible":
                continue
            target = targets[s.get(_REL)].lstrip("/")
            rows: list[list[str]] = []
            for _, row in ElementTree.iterparse(z.open(target if target.startswith("xl/") else f"xl/{target}")):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = _letters(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [_cell(c, shared)]
                rows.append(cells)
                row.clear()
            yield s.get("name", ""), trimmed(rows)


def trimmed(rows: list[list[str]]) -> list[list[str]]:
    """Rows with something in them, of equal width, without empty columns at the edges."""
    rows = [r for r in rows if any(r)]
    used = [i for r in rows for i, c in enumerate(r) if c]
    if not used:
        return []
    lo, hi = min(used), max(used)
    return [(r + [""] * (hi + 1 - len(r)))[lo : hi + 1] for r in rows]


def titles_of(rows: list[list[str]], most: int = 4) -> list[str]:
    """Leading rows of one filled cell of four characters or more."""
    out: list[str] = []
    for r in rows[:most]:
        filled = [c for c in r if c]
        if len(filled) != 1 or len(filled[0]) < 4:
            break
        out.append(filled[0])
    return out


def notes_of(rows: list[list[str]], most: int = 3) -> list[str]:
    """Sparse ones among the last rows."""
    return [" ".join(f) for f in ([c for c in r if c] for r in rows[-most:]) if 0 < len(f) <= 2]


def parse(name: str, data: bytes) -> list[tuple[str, str | None, list[str], list[str], list[list[str]]]]:
    """(location, sheet name, titles, notes, rows) of every table of a file. Unknown kinds raise ValueError."""
    kind = kind_of(name)
    if kind in ("csv", "txt"):
        rows = text_rows(decode(data))
        return [("text", None, [], [], rows)] if rows else []
    if kind == "xlsx":
        return [(f"sheet:{n}", n, titles_of(r), notes_of(r), r) for n, r in sheets(data) if len(r) > 1]
    raise ValueError(f"cannot read {name}" + (": word boxes are taken instead (operators.layout.tables)" if kind == "pdf" else ""))


# ---------------------------------------------------------------- Spark


def _numbered(paths: DataFrame, first: int) -> DataFrame:
    """(path, file_order): paths counted in order from `first`, by a distributed sort and sums of a row for each partition."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = table_of(paths.orderBy("path").select("path", F.spark_partition_id().alias("part"), at.alias("at")), "paths")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(base, "part").select("path", (F.col("base") + F.col("at") + first).alias("file_order"))


def _parsed(files: DataFrame) -> DataFrame:
    """A row for each table (row is null) and for each row of one, of files (path, content) that tasks parse whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = dict.fromkeys(names) | {"path": path}
                try:
                    found = parse(path.rpartition("/")[2], data)
                    error = None if found else "no table"
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
                    found, error = [], str(e)
                heads = [base | {"n": i, "location": loc, "sheet_name": sheet, "title_lines": t, "footer_lines": f} for i, (loc, sheet, t, f, _) in enumerate(found)]
                yield pa.RecordBatch.from_pylist(heads or [base | {"title_lines": [], "footer_lines": [], "error": error}], schema=schema)
                for i, (*_, rows) in enumerate(found):
                    for at in range(0, len(rows), PARSED_ROWS):
                        part = rows[at : at + PARSED_ROWS]
                        yield pa.RecordBatch.from_pylist([base | {"n": i, "row": at + j, "cells": r} for j, r in enumerate(part)], schema=schema)

    s, strings = pa.string(), pa.list_(pa.string())
    schema = pa.schema([("path", s), ("n", pa.int32()), ("location", s), ("sheet_name", s), ("title_lines", strings), ("footer_lines", strings), ("error", s), ("row", pa.int64()), ("cells", strings)])
    names = schema.names
    return files.mapInArrow(run, "path string, n int, location string, sheet_name string, title_lines array<string>, footer_lines array<string>, error string, row long, cells array<string>")


def read_sheets(spark: SparkSession, paths: str | list[str], first_order: int = 1, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(tables, rows) of the files. tables has a row for each table; a file that cannot be read, or has no table, is a
    row with `error`. rows (source_id, file_order, row, cells) has the tables' rows, of equal width in each.

    file_order counts files by path from first_order on; source_id is f<file>s<table>. A task parses whole files; of
    delimited text beyond split_bytes it parses pieces, with the same rows as outcome.
    """
    m = F.col("_metadata")
    files = spark.read.format("binaryFile").load(paths).select(m.file_path.alias("path"), "length", "content")
    texts = [k for k, kind in KINDS.items() if kind in ("csv", "txt")]
    long_text = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(texts) & (F.col("length") > split_bytes)
    if not files.where(long_text).select("path").limit(1).count():
        return sheets_in(files.select("path", "content"), first_order)
    named, pieces = long_texts(spark, paths, split_bytes, texts, SAMPLE_LINES, separator_of, clean)
    named, pieces = table_of(named, "long-files"), table_of(pieces, "pieces")
    whole = files.where(long_text).join(named.where("whole").select("path"), "path", "left_semi")
    many = pieces.groupBy("path").agg(F.count(F.lit(1)).alias("many"))
    none = F.array().cast("array<string>")
    some = F.col("many") > 1
    heads = named.where("not whole").join(many, "path", "left").select("path", F.when(some, 0).alias("n"), F.when(some, "text").alias("location"), none.alias("title_lines"), none.alias("footer_lines"), F.when(F.coalesce("many", F.lit(0)) < 2, "no table").alias("error"))
    body = pieces.join(many.where(some).select("path"), "path", "left_semi").select("path", F.lit(0).alias("n"), "row", "cells")
    parsed = _parsed(files.where(~long_text).unionByName(whole).select("path", "content")).unionByName(heads, allowMissingColumns=True).unionByName(body, allowMissingColumns=True)
    return _named(parsed, files.select("path"), first_order)


def sheets_in(files: DataFrame, first_order: int = 1) -> tuple[DataFrame, DataFrame]:
    """(tables, rows), as `read_sheets` has them, of files that are rows (path, content) already."""
    return _named(_parsed(files), files.select("path"), first_order)


def _named(parsed: DataFrame, paths: DataFrame, first_order: int) -> tuple[DataFrame, DataFrame]:
    """(tables, rows) of what was parsed, with the names that files and tables have by their order."""
    parsed = table_of(parsed, "parsed").join(table_of(_numbered(paths, first_order), "numbered"), "path")
    number, table = F.col("file_order").cast("string"), F.col("n").cast("string")
    parsed = parsed.withColumn("source_id", F.when(F.col("n").isNull(), F.concat(F.lit("f"), number)).otherwise(F.concat(F.lit("f"), number, F.lit("s"), table)))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    tables = parsed.where("row is null").withColumn("filename", name).withColumn("kind", F.try_element_at(kind, F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))))
    return tables.select(*[c.split()[0] for c in TABLES.split(", ")]), parsed.where("row is not null").select(*[c.split()[0] for c in ROWS.split(", ")])


def cells(rows: DataFrame) -> DataFrame:
    """Long form: source_id, row, col, text."""
    return rows.select("source_id", F.col("row").cast("long").alias("row"), F.posexplode("cells").alias("col", "text"))
