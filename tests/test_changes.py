"""What is kept up to date equals what a full run gives: clusters, streams, orders; and partial forms equal whole ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import identity as I
from rollbook.operators import inference as N
from rollbook.operators import layout as Y
from rollbook.operators import order_keys as K
from rollbook.operators import results as R
from rollbook.streaming import incremental

PEOPLE = "row_id long, student_id string, name_key string"
ENTRY = "student string, subject string, season_ord int, source string, file_order long, document_date string, value double, status string, n long, removed boolean"


def person(r, i, spread):
    return (i, r.choice([None, "", f"n{r.randrange(spread)}"]), r.choice([None, "", f"name {r.randrange(spread)}"]))


@pytest.mark.parametrize("by_name", [True, False])
def test_clusters_after_changes_equal_a_full_run(spark, by_name):
    r = random.Random(by_name)
    rows = {i: person(r, i, 40) for i in range(90)}
    frame = lambda xs: spark.createDataFrame(list(xs), PEOPLE)
    kept = I.cluster_records(frame(rows.values()), by_name)
    for turn in range(2):
        gone = r.sample(sorted(rows), 12)
        added = [person(r, 100 * (turn + 1) + i, 40) for i in range(15)] + [(gone[0], "n1", None)]  # a changed row
        kept = I.recluster(kept, frame(added), spark.createDataFrame([(g,) for g in gone], "row_id long"), by_name)
        rows = {i: x for i, x in rows.items() if i not in gone} | {x[0]: x for x in added}
        whole = I.cluster_records(frame(rows.values()), by_name)
        of = lambda df: {x.row_id: x.cluster for x in df.collect()}
        assert of(kept) == of(whole)
    nothing = I.recluster(kept, frame([]), spark.createDataFrame([], "row_id long"), by_name)
    assert of(nothing) == of(whole)


def test_a_stream_with_retractions_equals_a_batch(spark, tmp_path):
    r = random.Random(2)
    held, n = [], 0
    cols = ("student", "subject", "season_ord", "value", "status", "source")
    for turn in range(3):
        new = []
        for _ in range(25):
            n += 1
            source = f"f{r.randrange(4)}"
            value = r.choice([None, float(r.randrange(20))])
            new.append((r.choice("abcd"), r.choice("XY"), r.randrange(2), source, int(source[1]), r.choice([None, "2024-01-02", "2024-03-04"]), value, None if value is not None else r.choice(["FALTOU", "SEM_NOTA"]), n, False))
        gone = [(s, None, None, f"f{r.randrange(4)}", None, None, None, None, None, True) for s in "ab"] if turn else []
        gone += [("d", None, None, f"f{k}", None, None, None, None, None, True) for k in range(4)] if turn == 2 else []
        new = [x for x in new if turn < 2 or x[0] != "d"]  # of d nothing is left
        spark.createDataFrame(new + gone, ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = incremental.start(spark.readStream.schema(ENTRY).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["n"])
        q.awaitTermination(300)
        assert q.exception() is None
        back = {(x[0], x[3]) for x in gone}
        held = [x for x in held if (x[0], x[3]) not in back] + new
        want = R.season_results(spark.createDataFrame(held, ENTRY), ["n"]).select(*cols).collect()
        got = incremental.current(spark, f"{tmp_path}/out").select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), turn
    assert not any(x[0] == "d" for x in got)


def test_pairs_of_columns_equal_brute_force(spark):
    r = random.Random(4)
    scales = {0: 20.0, 1: 100.0, 2: 20.0, 3: None}
    rows = [*range(60), *range(32_700, 32_840, 3), 70_000]
    cells = [(s, row, c, r.choice(["", "-", "5", "9,5", "12", "48", "RE", "NA", "Faltou"])) for s in ("a", "b") for row in rows for c in range(4) if r.random() < 0.9]
    columns = spark.createDataFrame([(s, c, "grade", scales[c]) for s in ("a", "b") for c in range(4)] + [("a", 4, "name", None)], "source_id string, col int, role string, scale double")
    got = {(x.source_id, x.a, x.b): tuple(x[3:]) for x in N.column_pairs(spark.createDataFrame(cells, "source_id string, row long, col int, text string"), columns).select("source_id", "a", "b", "n", "n_a", "n_b", "n_both", "failed_first").collect()}
    number = lambda t: float(t.replace(",", ".")) if t and t[0].isdigit() else None
    at = {(s, row, c): t for s, row, c, t in cells}
    want = {}
    for s in ("a", "b"):
        for a in range(4):
            for b in range(4):
                both = [(at[s, row, a], at[s, row, b]) for row in rows if (s, row, a) in at and (s, row, b) in at and a != b]
                if not both:
                    continue
                full = lambda t: t not in ("", "-")
                failed = lambda t, b=b: number(t) < (-1.0 if scales[b] is None else scales[b]) * 9.5 / 20 if number(t) is not None else t in ("RE", "NA", "Faltou")
                want[s, a, b] = (len(both), sum(full(x) for x, _ in both), sum(full(y) for _, y in both), sum(full(x) and full(y) for x, y in both), sum(full(y) and failed(x) for x, y in both))
    assert got == want


def test_covers_in_parts_give_the_same_bounds(spark):
    r = random.Random(5)
    words = [(d, p, x, x + r.choice([0.0, 3.0, 9.0, -1.0])) for d in ("d", "e") for p in (1, 2) for _ in range(120) for x in [float(r.randrange(400)) * r.choice([1, 1, 0.5])]]
    want = {}
    for key in {w[:2] for w in words}:
        own = sorted(w[2:] for w in words if w[:2] == key)
        cuts, reach, low = [], own[0][1], own[0][0]
        for x0, x1 in own[1:]:
            if x0 > max(reach, low) + 4.5:
                cuts.append((max(reach, low) + x0) / 2)
            reach = max(reach, x1)
        want[key] = [own[0][0] - 1, *cuts, max(x1 for _, x1 in own) + 1]
    df = spark.createDataFrame(words, "doc string, page int, x0 double, x1 double").repartition(7)
    got = {(x.doc, x.page): x.bounds for x in Y.column_bounds(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and max(map(len, want.values())) > 4
    n = Y.covers(df, ["doc", "page"], 4.5).count()
    assert n < len(words)


def test_order_keys_follow_a_list():
    r = random.Random(6)
    keys, model = {}, []
    for i in range(3000):
        what = r.random()
        if what < 0.05 or len(model) < 3:
            keys, model = K.placed(keys, f"s{i}"), [*model, f"s{i}"]
            continue
        name, target = r.choice(model), model[r.randrange(min(3, len(model)))]  # one gap is halved again and again
        before = dict(keys)
        if what < 0.6:
            after = r.random() < 0.5
            keys = K.moved(keys, name, target, after)
            if name != target:
                model.remove(name)
                model.insert(model.index(target) + after, name)
        else:
            step = r.choice((-1, 1))
            keys, at = K.nudged(keys, name, step), model.index(name)
            if 0 <= at + step < len(model):
                model[at], model[at + step] = model[at + step], model[at]
        changed = sum(keys[k] != before.get(k) for k in keys)
        assert K.ordered(keys) == model and max(map(len, keys.values())) <= K.LONGEST and changed in (0, 1, len(model))
    assert K.moved(keys, "nobody", model[0], True) == keys and K.nudged(keys, model[0], -1) == keys
    seen = {model[0], model[4], model[7]}
    shown = [k for k in K.ordered(K.nudged(keys, model[0], 1, seen)) if k in seen]
    assert shown == [model[4], model[0], model[7]]
    assert K.even(100) == sorted(K.even(100)) and not any(k.endswith("0") for k in K.even(5000))


def test_rows_listed_follow_picks(spark):
    from rollbook.operators import reports as P

    s = spark.createDataFrame([(f"s{i}", f"Name {9 - i}") for i in range(6)], "student string, name string")
    keys = {}
    for name in ("s1", "s2", "s3"):
        keys = K.placed(keys, name)
    keys = K.moved(keys, "s3", "s1", False)
    pinned = spark.createDataFrame(list(keys.items()), "student string, pos string")
    assert [r.student for r in P.pinned_order(s, pinned, 5).collect()] == ["s3", "s1", "s2", "s5", "s4"]
    assert s.select(F.count("*")).first()[0] == 6
