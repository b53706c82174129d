from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from rollbook.llm import clustering as C


def brute(rows, k, rounds, dims, scale, seed=2):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cents)]
    return sorted((-1 if i is None else i, j, d) for i, v in kept for d, j in [near(v)]), cents


def run(spark, rows, k, rounds, dims, scale=16):
    t = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, _id string, v int").repartition(3)
    got, cents = C.sort_means(t, k, rounds, dims, scale)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect()), cents.tolist()


def odd_rows(n, dims):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=dims) * 4).astype(float).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 3)]  # copies
    rows += [(5, rows[7][1]), (None, rows[9][1]), (2000, None), (2001, []), (2002, [1.0] * (dims + 1)), (2003, [None] + [1.0] * (dims - 1)), (2004, [float("nan")] * dims), (2005, [float("inf")] + [0.0] * (dims - 1)), (2006, [-1e6] * dims)]
    return rows


@pytest.mark.parametrize("n,k,rounds,dims", [(150, 12, 4, 3), (40, 60, 2, 2), (5, 1, 1, 4)])
def test_equals_plain_rounds(spark, n, k, rounds, dims):
    rows = odd_rows(n, dims) if n > 9 else [(i, [float(i)] * dims) for i in range(n)]
    assert run(spark, rows, k, rounds, dims) == brute(rows, k, rounds, dims, 16)


def test_empty_and_nothing_kept(spark):
    assert run(spark, [], 3, 2, 2) == ([], [])
    assert run(spark, [(1, [float("nan"), 0.0])], 3, 2, 2) == ([], [])


def test_scan_gives_the_nearest_and_the_smaller_of_ties():
    rng = np.random.default_rng(1)
    for spread in (2, 5, 100):
        x, c = rng.integers(-spread, spread, (400, 4)), rng.integers(-spread, spread, (30, 4))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        for held in (np.zeros(400, np.int64), rng.integers(0, 30, 400), d.argmin(1)):
            best, dist = C.nearest(x, held, c)
            assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_scan_stops_early(monkeypatch):
    """Near vectors are compared with few centroids."""
    c = np.arange(50)[:, None] * 1000 + np.zeros((1, 2), np.int64)
    x = np.repeat(c, 20, 0) + 1
    held = np.repeat(np.arange(50), 20)
    looked = []
    found = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: looked.append(int(found(a, v, **k))) or found(a, v, **k))
    C.nearest(x, held, c)
    assert sum(looked) == 0


def test_far_components_are_held(spark):
    got, _ = run(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])], 1, 0, 2)
    assert sorted(d for _, _, d in got) == [0, (2 * C.HELD) ** 2]
