"""Sheets of many rows: no cell is shuffled by its row, and what is made of bits equals brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rollbook.functions import vocabulary as V
from rollbook.operators import inference as N

CELLS = "source_id string, row long, col int, text string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_data_rows_are_found_without_windows_and_equal_brute_force(spark):
    r = random.Random(6)
    words = ["", "", "", "  ", "12", "Total", " MÉDIA ", "Ana  Silva", "a–b", "Observações", "O b s", "TotAl", None]
    cells = [(s, row, c, r.choice(words)) for s in "ab" for row in [*range(70), *range(126, 131), 4_200] for c in range(5) if r.random() < 0.8]
    heads = spark.createDataFrame([("a", 0), ("b", -1)], "source_id string, header int")
    clean = lambda t: " ".join((t or "").replace("–", "-").split())
    # the comparable form of each word above: inner capitals begin words
    plain = {"Total": "total", "MÉDIA": "media", "Observações": "observacoes", "O b s": "o b s", "TotAl": "tot al", "Ana Silva": "ana silva"}
    want = set()
    for s, top in (("a", 0), ("b", -1)):
        for row in {x[1] for x in cells if x[0] == s and x[1] > top}:
            of = sorted((c, clean(t)) for s2, r2, c, t in cells if (s2, r2) == (s, row))
            full = [t for _, t in of if t]
            if full and not (len(full) <= 3 and plain.get(full[0]) in V.FOOTER_WORDS):
                want |= {(s, row, c, t) for c, t in of}
    data = N.data_cells(spark.createDataFrame(cells, CELLS).repartition(3), heads)
    assert {tuple(x) for x in data.collect()} == want
    assert 0 < len(want) < len(cells) and "Window" not in plan_of(data)


def test_exam_routes_by_bits_equal_brute_force(spark):
    r = random.Random(7)
    columns = [(0, "Nota Final", "final", "epoca1"), (1, "Nota 2", "final", "epoca1"), (2, "Exame", "component", "epoca1"), (3, "Exame B", "component", "epoca2"), (4, "Final B", "final", "epoca2")]
    cells, want = [], {}
    for s in "abcdef":
        mostly = r.random() < 0.6  # exams where the finals are empty
        for row in range(3, 150):
            finals = [r.choice(["", "-", "12"]) for _ in range(2)]
            free = all(x != "12" for x in finals)
            of = [*finals, r.choice(["10", ""]) if free or (not mostly and r.random() < 0.4) else "", r.choice(["", "9"]), r.choice(["", "8", "Faltou"])]
            cells += [(s, row, c, t) for c, t in enumerate(of) if r.random() < 0.9]
        at = {(x[1], x[2]): x[3] for x in cells if x[0] == s}
        on = lambda row, c, at=at: at.get((row, c), "") not in ("", "-")
        for exam, of in ((2, (0, 1)), (3, (4,))):
            own = [row for row in range(3, 150) if on(row, exam) and any((row, f) in at for f in of)]
            alone = [row for row in own if not any(on(row, f) for f in of)]
            want[s, exam] = "final" if len(own) >= 2 and len(alone) >= 0.9 * len(own) else "component"
    table = [(s, c, h, "grade", k, None, e, 20.0, False, "", 0.5) for s in "abcdef" for c, h, k, e in columns]
    frame = spark.createDataFrame(table, "source_id string, col int, header string, role string, kind string, route string, season string, scale double, locked boolean, reason string, confidence double")
    done = N.promote_exam_routes(frame, spark.createDataFrame(cells, CELLS).repartition(3))
    assert {(x.source_id, x.col): x.kind for x in done.where("col in (2, 3)").collect()} == want and set(want.values()) == {"final", "component"}
    assert "Window" not in plan_of(done)


def test_samples_from_rows_far_below(spark):
    far = [3, 4_096, 300_000, 20_000_000_000, 1 << 50, 1 << 61]
    cells = [("s", row, 0, f"v{i}") for i, row in enumerate(far)] + [("s", i, 1, "") for i in range(9)] + [("s", 1 << 62, 2, "w")]
    p = {x.col: x.samples for x in N.profiles(spark.createDataFrame(cells, CELLS)).collect()}
    assert p == {0: [f"v{i}" for i in range(5)], 1: [], 2: ["w"]}


def test_cells_are_gone_over_a_few_times_only(spark):
    """Roles, seasons and routes of a sheet come from few passes over its cells, and none after its columns are known."""
    rows = spark.range(1, 400).select(F.lit("s").alias("source_id"), F.col("id").alias("row"), F.posexplode(F.array(F.lit("Ana Silva"), (F.col("id") + 900000).cast("string"), (F.col("id") % 21).cast("string"), F.when(F.col("id") % 3 == 0, "9").otherwise(""))).alias("col", "text"))
    head = spark.createDataFrame([("s", 0, c, t) for c, t in enumerate(["Nome", "Nº Aluno", "Nota Final", "Recurso"])], CELLS)
    looked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            looked.add(b.num_rows)
            yield b

    cells = head.unionByName(rows).mapInArrow(seen, CELLS)
    columns, _ = N.classify_columns(cells, spark.createDataFrame([("s", 0)], "source_id string, header int"))
    got = {x.col: (x.role, x.season) for x in columns.collect()}
    assert got == {0: ("name", None), 1: ("id", None), 2: ("grade", None), 3: ("grade", "epoca2")}
    assert looked.value <= 7 * 4 * 400
