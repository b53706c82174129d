"""Long texts read in pieces give the rows that reading them whole gives."""

from __future__ import annotations

import random

import pytest

from rollbook.sources.files import read_sheets


def both(spark, folder, pattern="*.*"):
    """Rows and tables by file: read whole, and in pieces of a few hundred bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    out = []
    try:
        for split in (1 << 30, 100):
            spark.conf.set("spark.sql.files.maxPartitionBytes", "700" if split == 100 else held["spark.sql.files.maxPartitionBytes"])
            spark.conf.set("spark.sql.files.openCostInBytes", "1" if split == 100 else held["spark.sql.files.openCostInBytes"])
            tables, rows = read_sheets(spark, f"{folder}/{pattern}", 5, split)
            found = sorted((r.source_id, r.filename, r.kind, r.location or "", r.error or "", r.file_order) for r in tables.collect())
            out.append((found, sorted((r.source_id, r.row, tuple(r.cells)) for r in rows.collect())))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return out


def sheet(r, sep, n, quoted=False):
    words = ["Ana", "João", "12,5", "7", "", " x  y ", "–", "ç"]
    lines = [sep.join(["Nome", "Nº", "Nota"])]
    for i in range(n):
        cells = [r.choice(words).replace(",", "." if sep == "," else ",") for _ in range(r.choice((3, 3, 3, 2, 4)))]
        if quoted and i % 9 == 0:
            cells[0] = f'"a{sep}b ""c"""'
        lines.append(sep.join(cells) if i % 13 else r.choice(["", "   ", sep * 2]))
    return lines


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "utf-16", "latin-1"])
def test_pieces_equal_whole(spark, tmp_path, encoding):
    r = random.Random(encoding)
    for i, (sep, end) in enumerate([(";", "\n"), (",", "\r\n"), ("\t", "\n"), ("|", "\r\n")]):
        lines = sheet(r, sep, 120, quoted=i % 2 == 0)
        text = end.join(lines) + (end if i % 2 else "")
        (tmp_path / f"file {i}+ç.csv").write_bytes(text.encode(encoding, "replace") + (b"\x81" if encoding == "latin-1" else b""))
    whole, pieces = both(spark, tmp_path)
    assert len(whole[0]) == 4 and len(whole[1]) > 300
    assert pieces == whole


def test_what_cannot_be_cut_is_read_whole(spark, tmp_path):
    r = random.Random(1)
    lines = sheet(r, ";", 80)
    (tmp_path / "a.csv").write_text("\n".join(lines[:40] + ['"over;two', 'lines";x;y'] + lines[40:]), newline="")
    (tmp_path / "b.csv").write_text("\n".join(lines[:40] + ['x;"open and closed" ;"', '";y'] + lines[40:]), newline="")
    (tmp_path / "c.csv").write_text("\r".join(lines), newline="")
    (tmp_path / "d.txt").write_text("\n".join(f"{'Pessoa ' + str(i):<20}{i:<8}{i % 20}" for i in range(60)))
    (tmp_path / "e.csv").write_text("\n".join(lines[:30]) + "\u2028" + "\n".join(lines[30:]), newline="")
    (tmp_path / "f.csv").write_text("only one line " * 30)
    (tmp_path / "g.csv").write_text("\n" * 300)
    (tmp_path / "h.csv").write_text("\n".join(['a;"b', *lines[1:]]), newline="")
    (tmp_path / "i.doc").write_text("x" * 500)
    (tmp_path / "small.csv").write_text("Nome;Nota\nAna;12\n")
    whole, pieces = both(spark, tmp_path)
    assert len(whole[0]) == 10 and pieces == whole
