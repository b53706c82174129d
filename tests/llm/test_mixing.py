from __future__ import annotations

import hashlib
import math
import re

import pytest

from rollbook.llm import mixing as M


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """(targets by source, copies by row): what is over is shared again until no source has too much."""
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget = share * sum(size.values())
    target, open_ = {}, {s for s in order if size[s]}
    target |= {s: 0.0 for s in order if not size[s]}
    while open_:
        left = budget - sum(target.values())
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > most * size[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: most * size[s] for s in over}
        open_ -= over
    copies = []
    for i, t, _, s in rows:
        rate = target[s] / size[s] if size[s] else 0.0
        key = ":".join([str(M.SEED), "" if i is None else str(i), hashlib.md5((t or "").encode()).hexdigest()])
        draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        copies.append(math.floor(rate) + (draw < rate - math.floor(rate)))
    return target, copies


def odd_rows():
    rows = [(i, "a b c\x0bd" + " x" * (i * i % 40), "en", f"s{i % 7}") for i in range(150)]
    rows += [(i, "w " * 5, "en", None) for i in range(200, 205)]
    rows += [(300, None, "en", "empty"), (301, "  \t\n", None, "empty"), (302, "", "en", "Ä"), (303, "ein Wort", "de", "Ä"), (303, "ein Wort", "de", "Ä")]
    rows += [(None, "no id", "en", "s1"), (400, "long " * 50_000, "en", "s2"), (401, "one", "en", "\U0001f600")]
    return rows


def check(spark, frame, rows):
    target, copies = brute(rows)
    got = [tuple(r) for r in M.mix_plan(frame(rows)).collect()]
    size = {s: sum(words(r[1]) for r in rows if r[3] == s) for s in target}
    want = [(r[0], words(r[1]), size[r[3]], target[r[3]], c, c * words(r[1])) for r, c in zip(rows, copies, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert [r[:3] + r[4:] for r in sorted(got, key=key)] == [r[:3] + r[4:] for r in sorted(want, key=key)]
    assert [r[3] for r in sorted(got, key=key)] == pytest.approx([r[3] for r in sorted(want, key=key)])
    return target, copies


def test_plan_equals_brute_force(spark, frame):
    rows = odd_rows()
    target, _ = check(spark, frame, rows)
    assert any(target[s] == 2 * sum(words(r[1]) for r in rows if r[3] == s) > 0 for s in target)  # some are full


def test_sources_beyond_the_broadcast(spark, frame, monkeypatch):
    monkeypatch.setattr(M, "HOT", 3)
    check(spark, frame, [(i, "a b c " * (1 + i % 3), "en", "big" if i % 3 else f"h{i}") for i in range(200)])


def test_mix_emits_copies_with_all_columns(spark, frame):
    rows = odd_rows()
    _, copies = brute(rows)
    docs = frame(rows)
    got = M.mix(docs).collect()
    want = sum(([(r[0], r[1], r[3])] * c for r, c in zip(rows, copies, strict=True)), [])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=key) == sorted(want, key=key)
    assert M.mix(docs).columns == docs.columns


def test_taken_comes_near_the_targets(spark, frame):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"s{i % 4}") for i in range(8000)]
    for r in M.mix_plan(frame(rows)).groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert r[2] == pytest.approx(r[1], rel=0.05)
    again = [M.mix_plan(frame(rows)).agg({"taken": "sum"}).first()[0] for _ in range(2)]
    assert again[0] == again[1]


def test_no_words_and_no_rows(spark, frame):
    assert [tuple(r)[1:] for r in M.mix_plan(frame([(1, None, None, None), (2, " ", "en", "a")])).collect()] == [(0, 0, 0.0, 0, 0)] * 2
    assert M.mix_plan(frame([])).collect() == [] and M.mix(frame([])).collect() == []


def test_ranks_over_partitions(spark):
    names = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)] + [(None,)], "x string").repartition(7)
    got = {r.x: r._rank for r in M.ranked(names, "x").collect()}
    assert got == {f"n{i:04d}": i for i in range(500)} | {None: 500}


def test_main_path_is_native(spark, frame):
    plan = M.mix_plan(frame(odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
