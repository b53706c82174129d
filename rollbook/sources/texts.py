"""Long delimited files, read in pieces: lines come from Spark's text reader, which splits files at any store it reaches.

A first pass looks at every piece and keeps what decides about the file (does it decode, has it quotes over line ends) and
its first lines; encoding and separator are decided once a file from that. A second pass parses lines where they lie and
numbers them within their piece; sums over pieces, of which a file has few, make that the number within the file. A file
of which a line cannot be parsed alone is named, and is to be read whole.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.session import table_of

#: Files whose decisions tasks hold at once.
FILES = 100_000
#: Line ends that only a whole text shows: what Python's splitlines() knows beside \n and \r\n.
_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_BYTES = "path string, start long, lines array<binary>, utf8 boolean, cp1252 boolean, alone boolean, marked boolean"
_HELD = frozenset((0x81, 0x8D, 0x8F, 0x90, 0x9D))


def _lines(spark: SparkSession, paths: str | list[str], longer_than: int, kinds: list[str]) -> DataFrame:
    """(path, start, value): the lines of the long files of the given extensions; tasks get the lines of a piece in order."""
    m = F.col("_metadata")
    named = F.lower(F.regexp_extract(m.file_name, r"\.([^.]*)$", 1)).isin(kinds)
    lines = spark.read.option("lineSep", "\n").text(paths).where((m.file_size > longer_than) & named)
    return lines.select(m.file_path.alias("path"), m.file_block_start.alias("start"), F.col("value").cast("binary").alias("value"))


def _pieces(lines: DataFrame, sample: int) -> DataFrame:
    """A row for each piece and batch of it: its first filled lines, and what its bytes allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, start, value = (b.column(i).to_pylist() for i in range(3))
            runs: dict[tuple, list[bytes]] = {}
            for p, s, v in zip(path, start, value, strict=True):
                runs.setdefault((p, s), []).append(v)
            out = []
            for (p, s), own in runs.items():
                whole = b"\n".join(own)
                try:
                    text, utf8 = whole.decode(), True
                except UnicodeDecodeError:
                    text, utf8 = whole.decode("latin-1"), False
                ends = any(c in text for c in _ENDS) if utf8 else any(c in text for c in _ENDS[:6])
                alone = not ends and whole.replace(b"\r\n", b"\n").count(b"\r") <= own[-1].endswith(b"\r") and all(v.count(b'"') % 2 == 0 for v in own)
                marked = s == 0 and own[0][:2] in (b"\xff\xfe", b"\xfe\xff", b"\x00\x00")
                filled = [v for v in own if v.strip()][:sample]
                out.append({"path": p, "start": s, "lines": filled, "utf8": utf8, "cp1252": utf8 or not _HELD & set(whole), "alone": alone, "marked": marked})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in _BYTES.split(", "))])
    return lines.mapInArrow(run, _BYTES)


def _decided(pieces: DataFrame, sample: int, separator_of) -> DataFrame:
    """(path, encoding, separator, whole): of each file; whole if lines cannot be parsed alone."""

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "seq"])
        encoding = "utf-8" if rows.utf8.all() else "cp1252" if rows.cp1252.all() else "latin-1"
        lines = [bytes(v).decode(encoding, "replace").removeprefix("\ufeff").rstrip("\r") for x in rows.lines for v in x]
        separator = separator_of([x for x in lines if x.strip()][:sample])
        return pd.DataFrame([(key[0], encoding, separator, bool(not rows.alone.all() or rows.marked.any() or separator is None))], columns=["path", "encoding", "separator", "whole"])

    # a row for each piece and batch: the first lines of the first ones are enough
    first = Window.partitionBy("path").orderBy("start", "seq")
    kept = pieces.withColumn("nth", F.row_number().over(first)).withColumn("lines", F.when(F.col("nth") <= sample, F.col("lines")).otherwise(F.array().cast("array<binary>")))
    return kept.drop("nth").groupBy("path").applyInPandas(decide, "path string, encoding string, separator string, whole boolean")


def long_texts(spark: SparkSession, paths: str | list[str], longer_than: int, kinds: list[str], sample: int, separator_of, clean) -> tuple[DataFrame, DataFrame]:
    """(files, rows) of the delimited files longer than so many bytes: files (path, whole) names every one of them; rows
    (path, row, cells) has those that need not be read whole, without blank rows, of equal width in each file, as
    reading them whole would give them."""
    lines = _lines(spark, paths, longer_than, kinds)
    pieces = table_of(_pieces(lines, sample).withColumn("seq", F.monotonically_increasing_id()), "pieces")
    decided = table_of(_decided(pieces, sample, separator_of), "decided")
    parsed = None
    groups = max(1, -(-decided.count() // FILES))
    for k in range(groups):
        own = decided.where(~F.col("whole")) if groups == 1 else decided.where(~F.col("whole") & (F.pmod(F.xxhash64("path"), F.lit(groups)) == k))
        some = _parsed(lines, {r.path: (r.encoding, r.separator) for r in own.collect()}, clean)  # about FILES rows
        parsed = some if parsed is None else parsed.unionByName(some)
    parsed = table_of(parsed, "parsed")
    torn = table_of(parsed.where("cells is null").select("path").distinct(), "torn")
    files = decided.join(torn.withColumn("torn", F.lit(True)), "path", "left").select("path", (F.col("whole") | F.coalesce("torn", F.lit(False))).alias("whole"))
    parsed = parsed.join(torn, "path", "left_anti")
    # a row for each piece
    counts = parsed.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cells")).alias("width"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.max("width").over(Window.partitionBy("path")).alias("width"))
    rows = parsed.join(base, ["path", "start"])
    padded = F.concat("cells", F.array_repeat(F.lit(""), (F.col("width") - F.size("cells")).cast("int")))
    return files, rows.select("path", (F.col("base") + F.col("nth")).alias("row"), padded.alias("cells"))


def _parsed(lines: DataFrame, decided: dict[str, tuple[str, str]], clean) -> DataFrame:
    """(path, start, nth, cells) of the filled lines of the decided files, counted from 0 in each piece; cells is null where a
    line does not end its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}  # a piece is the work of one task, in order
        for b in batches:
            paths, starts, nths, cells = [], [], [], []
            for p, s, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p not in decided:
                    continue
                encoding, separator = decided[p]
                text = v.decode(encoding, "replace")
                text = text.removeprefix("\ufeff") if s == 0 and (p, s) not in seen else text
                seen.setdefault((p, s), 0)
                if not text.strip():
                    continue
                read = list(csv.reader([text.removesuffix("\r"), "."], delimiter=separator))
                row = [clean(c) for c in read[0]] if len(read) == 2 else None  # else a quote is open at the end
                if row is None or any(row):
                    paths.append(p)
                    starts.append(s)
                    nths.append(seen[p, s])
                    cells.append(row)
                    seen[p, s] += 1
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(starts, pa.int64()), pa.array(nths, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["path", "start", "nth", "cells"])

    return lines.mapInArrow(run, "path string, start long, nth long, cells array<string>")
