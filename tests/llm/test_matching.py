from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from conftest import prose

from rollbook.llm.decontamination import Canonical, decontaminate, decontamination_stage
from rollbook.llm.sharding import pack, shard


def bench(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, doc_id long")


Q = "A train leaves the station with 120 passengers and travels 45 km before Maria Lopez counts 120 tickets again in the second car."


def test_exact_and_reparameterised_questions(spark, frame):
    other = Q.replace("120", "77").replace("45 km", "9 miles").replace("Maria Lopez", "Ivan Petrov")
    mixed = Q.replace("120 passengers", "55 passengers")
    rows = [(1, prose(1, 50) + " " + Q + " " + prose(2, 50)), (2, other), (3, mixed), (4, prose(5, 400)), (5, None), (6, ""), (7, Q.upper()), (1, prose(9, 20)), (8, " ".join(Q.split()[:5]))]
    items = bench(spark, [(10, Q), (10, Q), (11, None), (12, ""), (13, "too short"), (14, "Only six words are in here")])
    for limit in (0, 200_000):  # shuffled and broadcast
        got = {(r.doc_id, r.item_id): r for r in decontaminate(frame(rows), items, broadcast_rows=limit).collect()}
        assert {1, 2} <= {k[0] for k in got} and not {4, 5, 6, 8} & {k[0] for k in got}
        assert not got[1, 10].reparameterised and got[2, 10].reparameterised
        assert (3, 10) not in got or got[3, 10].matched_windows < got[1, 10].matched_windows


def test_inconsistent_slots_do_not_count(spark, frame):
    item = "take 3 red and 3 blue then 3 green or 3 black plus 3 white and 3 gray"
    good, bad = item.replace("3", "8"), "take 1 red and 2 blue then 3 green or 4 black plus 5 white and 6 gray"
    got = {r.doc_id for r in decontaminate(frame([(1, good), (2, bad)]), bench(spark, [(1, item)])).collect()}
    assert got == {1}


def test_short_items_match_whole(spark, frame):
    got = {r.doc_id for r in decontaminate(frame([(1, "well Only six words are in here indeed"), (2, "only six words are in")]), bench(spark, [(14, "Only six words are in here")])).collect()}
    assert got == {1}


def test_items_of_few_literals_match_whole(spark, frame):
    sums, row, name = "What is 345 + 678 + 12?", "3 14 15 92 65 35 89 79 32 38 46 26", "Who was Ada Lovelace?"
    items = bench(spark, [(1, sums), (2, row), (3, name), (4, "3 14 15")])
    rows = [(1, prose(1, 30) + ". " + sums + " " + prose(2, 30)), (2, "see " + row + " there"), (3, prose(3, 20) + " who was Ada Lovelace then"), (4, "3 14, 15")]
    rows += [(5, sums.replace("345", "346")), (6, row[:-3]), (7, "Who was Ada?"), (8, "3 14 15 16"), (9, row[3:] + " " + row[:6])]
    for limit in (0, 200_000):
        got = {(r.doc_id, r.item_id): r for r in decontaminate(frame(rows), items, broadcast_rows=limit).collect()}
        assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4)} and not any(r.reparameterised for r in got.values())
        assert all(r.matched_windows == r.item_windows for r in got.values())


def test_names_at_sentence_starts(spark, frame):
    item = "Tom has 5 apples. Tom gives 2 away."
    rows = [(1, prose(1, 20) + ". " + item.replace("Tom", "Sam").replace("5", "9")), (2, "Sam has 5 apples. Eve gives 2 away."), (3, item), (4, prose(4, 90))]
    got = {r.doc_id: r.reparameterised for r in decontaminate(frame(rows), bench(spark, [(1, item)])).collect()}
    assert got == {1: True, 3: False}


def test_other_values_away_from_sentence_starts(spark, frame):
    item = "we took the old road past 12 mills and over many hills with cold rain. Nobody there saw the light from our small camp that night"
    got = {r.doc_id: r.reparameterised for r in decontaminate(frame([(1, item.replace("12", "15")), (2, item)]), bench(spark, [(1, item)])).collect()}
    assert got == {1: True, 2: False}


def test_against_brute_force(spark, frame):
    items = [(i, prose(200 + i, 30)) for i in range(10)]
    rows = [(i, prose(i, 100) + ". " + items[i % 10][1] + " " + prose(i + 50, 60) if i % 4 == 0 else prose(i, 200)) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontaminate(frame(rows), bench(spark, items)).collect()}
    can = Canonical()

    def grams(t):
        code, value, _ = can.words([t])
        return {tuple(code[i : i + 8].tolist()) for i in range(len(code) - 7) if (value[i : i + 8] == 0).sum() >= 4}

    want = {(d, i) for d, t in rows for i, q in items if grams(t) & grams(q)}
    assert got == want  # no numbers or names here: each shared window counts


def test_slots_against_brute_force(spark, frame):
    r = random.Random(7)
    common = "red blue green stone river house walks sings takes finds under above near every small quiet".split()

    def question(k):
        return [r.choice(common) if r.random() < 0.7 else r.choice(["Anna", "Boris", "Carla", "7", "8", "9"]) for _ in range(k)]

    items = [(i, ["what", *question(14)]) for i in range(12)]
    rows = []
    for d in range(80):
        q = list(r.choice(items)[1])
        if d % 2:  # other values, the same for each, or only here and there
            swap = {"Anna": "Dora", "7": "70", "Boris": "Egon"}
            q = [swap.get(w, w) if d % 4 == 1 or r.random() < 0.5 else w for w in q]
        rows.append((d, " ".join(["so", *question(r.randint(0, 9)), *q[r.randint(0, 3) :], *question(6)])))
    got = {(x.doc_id, x.item_id) for x in decontaminate(frame(rows), bench(spark, [(i, " ".join(q)) for i, q in items])).collect()}
    can = Canonical()
    parsed = {d: [x.tolist() for x in can.words([t])[:2]] for d, t in rows}
    want = set()
    for i, q in items:
        ic, iv = (x.tolist() for x in can.words([" ".join(q)])[:2])
        for d, (dc, dv) in parsed.items():
            for shift in range(-len(ic), len(dc)):
                at = [p for p in range(len(ic) - 7) if 0 <= p + shift and p + shift + 8 <= len(dc) and ic[p : p + 8] == dc[p + shift : p + shift + 8] and iv[p : p + 8].count(0) >= 4]
                slots: dict[int, set[int]] = {}
                for p in at:
                    for o in range(8):
                        if iv[p + o]:
                            slots.setdefault(iv[p + o], set()).add(dv[p + shift + o])
                if at and (any(not any(iv[p : p + 8]) for p in at) or all(len(s) == 1 for s in slots.values())):
                    want.add((d, i))
    assert got == want and 10 < len(want) < len(rows) * len(items)


def test_reparameterised_questions_are_found(spark, frame):
    r = random.Random(3)
    kinds = ["If {a} buys {n} pears and {b} buys {m} more, how many pears do they have in all?", "A tank of {n} litres loses {m} litres each hour while {a} waits for it to run dry.", "{a} walked {n} km on the first day and {m} km on the second day of the long trip."]
    names = ["Anna", "Boris", "Carla", "Dmitri", "Elena", "Farid"]
    fill = lambda t: t.format(a=r.choice(names), b=r.choice(names), n=r.randint(2, 900), m=r.randint(2, 900))
    rows = [(d, prose(d, 60) + ". " + fill(kinds[d % 3]) + " " + prose(d + 9, 40)) for d in range(90)] + [(1000 + d, prose(d, 200)) for d in range(60)]
    got = {(x.doc_id, x.item_id) for x in decontaminate(frame(rows), bench(spark, [(k, fill(t)) for k, t in enumerate(kinds)])).collect()}
    assert {(d, d % 3) for d in range(90)} == got


def test_very_long_text(spark, frame):
    long = prose(2, 150_000) + ". " + Q
    assert {r.doc_id for r in decontaminate(frame([(1, long), (2, prose(5, 50))]), bench(spark, [(1, Q)])).collect()} == {1}


def test_empty_tables_and_stage(spark, frame, tmp_path):
    assert decontaminate(frame([]), bench(spark, [(1, Q)])).count() == 0
    assert decontaminate(frame([(1, Q)]), bench(spark, [])).count() == 0
    bench(spark, [(1, Q)]).write.parquet(f"file://{tmp_path}/benchmark.parquet")
    d = frame([(1, Q), (2, prose(3, 90)), (None, "x")])
    out = decontamination_stage(spark, d, f"file://{tmp_path}")
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {2, None}


def law(got, rows, shards):
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    return [total[s] for s in range(shards)]


def test_shards_are_even_and_groups_stay_together(frame):
    rows = [(i, prose(i % 700, 20 + i % 50)) for i in range(900)] + [(2000 + i, "hot copy of a text") for i in range(450)] + [(5000, None), (5001, ""), (1, "again")]
    got = shard(frame(rows), shards=8).collect()
    sizes = law(got, rows, 8)
    assert max(sizes) < 1.1 * sum(sizes) / 8 and min(sizes) > 0.9 * sum(sizes) / 8
    where = {}
    for r in got:
        where.setdefault(dict(rows)[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t and t.startswith(prose(3, 5)))
    assert shard(frame([])).count() == 0


def test_shards_with_a_very_long_text(frame):
    rows = [(0, "w " * 100_000)] + [(i, prose(i, 30)) for i in range(1, 200)]
    law(shard(frame(rows), shards=4).collect(), rows, 4)


def test_packing_takes_the_largest_dot_product():
    left = np.array([[10.0, 1.0, 5.0], [1.0, 10.0, 5.0]])
    assert pack(np.array([[5.0, 0.0, 1.0], [0.0, 5.0, 1.0]]), left, np.array([10.0, 10.0, 10.0])).tolist() == [0, 1]
