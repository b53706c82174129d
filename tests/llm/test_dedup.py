from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import xxhash
from conftest import SCHEMA, prose

from rollbook.llm.exact_dedup import MisraGries, exact_dedup, exact_dedup_stage
from rollbook.llm import simhash_dedup as S
from rollbook.llm.simhash_dedup import PLAN, golay_tables, linked_fingerprints, near_duplicates, shingle_hashes, shingle_set, simhash_dedup, simhash_stage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (7, "a b "), (7, "a b "), (8, "w " * 30_000), (9, "W " * 30_000), (10, " \t\n")]


def test_exact_against_brute_force(frame):
    for counters in (2, 512):
        got = exact_dedup(frame(EDGE), counters=counters).collect()
        assert len(got) == len(EDGE)
        groups: dict[str, list[int]] = {}
        for i, t in EDGE:
            groups.setdefault((t or "").translate(LOWER), []).append(i)
        want = {i: (max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
        assert sum(r.kept for r in got) == len(groups)


def test_exact_hot_group_and_empty(frame):
    rows = [(i, "Hot text") for i in range(400)] + [(1000 + i, f"t{i % 50}") for i in range(100)]
    got = {r.doc_id: r for r in exact_dedup(frame(rows), counters=4).collect()}
    assert got[0].keep_id == 399 and got[0].group_size == 400 and got[1000].keep_id == 1050
    assert exact_dedup(frame([])).count() == 0


def test_exact_stage_keeps_one_row_and_columns(spark, frame):
    d = frame(EDGE)
    out = exact_dedup_stage(spark, d, "")
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 6, 7, 9, 10]
    clash = spark.createDataFrame([(1, "a", "mine"), (2, "A", "yours")], "doc_id long, text string, _sha string")
    assert [tuple(r) for r in exact_dedup_stage(spark, clash, "").collect()] == [(2, "A", "yours")]
    assert exact_dedup_stage(spark, frame([]), "").count() == 0


def test_misra_gries_keeps_frequent_keys():
    mg = MisraGries(3)
    for i in range(1000):
        mg.add("hot" if i % 3 == 0 else i)
    assert "hot" in mg.counts


def brute(rows):
    fps = []
    for _, t in rows:
        words = [w for w in (t or "").translate(LOWER).replace("\t", " ").replace("\n", " ").split(" ") if w]
        sh = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_simhash_against_brute_force(frame):
    rows = [*EDGE]
    for k in range(30):
        t = prose(k, 300)
        rows += [(100 + 3 * k, t), (101 + 3 * k, t + " end"), (102 + 3 * k, t.replace("the", "a", 1))]
    got = simhash_dedup(frame(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == brute(rows)
    assert any(r.component_id != r.doc_id for r in got if r.doc_id >= 100)


def test_all_links_within_three_bits_are_found(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = set(base.tolist())
    for x in base.tolist():
        for k in (1, 2, 3, 4):
            fps.add(int(np.int64(x ^ int(sum(1 << int(b) for b in r.choice(63, k, replace=False))))))
    fps = sorted(fps)
    got = {(x.a, x.b) for x in linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "_fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert got == want


def test_golay_code_is_perfect():
    _, patterns = golay_tables()
    assert all(bin(e).count("1") <= 3 for e in patterns[:, 0].tolist())
    assert len(shingle_hashes("", 3, 42)) == 0


def test_three_errors_always_leave_a_key():
    for errors in itertools.product(range(4), repeat=5):
        assert sum(errors) > 3 or any(errors[a] == errors[b] == 0 and errors[j] <= 1 for a, b, j in PLAN)


def test_simhash_hot_fingerprint(frame):
    rows = [(i, "one text that many rows have") for i in range(50)] + [(100 + i, prose(i, 40)) for i in range(900)]
    got = {r.doc_id: r for r in simhash_dedup(frame(rows)).collect()}
    assert len(got) == len(rows) and all(got[i].component_id == 0 and got[i].class_size == 50 for i in range(50))


def invented(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edited(r, words, every):
    """words with about one in `every` replaced."""
    return [r.choice(words) + "x" if r.random() < 1 / every else w for w in words]


def alike(a, b):
    x, y = set(shingle_set(a or "").tolist()), set(shingle_set(b or "").tolist())
    return len(x & y) >= 0.8 * len(x | y)


def near_brute(rows):
    """Groups of rows (id, text) that links of 0.8 or more join; each as the list of its places."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(rows[i][1], rows[j][1]):
            root[find(i)] = find(j)
    groups: dict[int, list[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def test_near_copies_are_found_and_others_left(spark):
    r = random.Random(4)
    rows, planted = [], []
    for k in range(120):
        words = invented(r, r.randint(60, 400))
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join(edited(r, words, 60)).upper()))
        if alike(rows[-1][1].lower(), rows[-2][1]):
            planted.append((len(rows) - 2, len(rows) - 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.node: x.component for x in near_duplicates(docs).collect()}
    node = {x.doc_id: x.h for x in docs.selectExpr("doc_id", "xxhash64(text) as h").collect()}
    hit = [found.get(node[rows[a][0]], 0) == found.get(node[rows[b][0]], 1) for a, b in planted]
    assert len(planted) > 60 and np.mean(hit) >= 0.93
    joined = {tuple(sorted((a, b))) for a, b in itertools.combinations(range(len(rows)), 2) if found.get(node[rows[a][0]], 0) == found.get(node[rows[b][0]], 1)}
    assert joined <= set(planted)


def test_a_large_group_of_near_copies_is_one(spark):
    r = random.Random(5)
    words = invented(r, 150)
    rows = [(i, " ".join([*words[: i % 150], f"n{i}", *words[i % 150 + 1 :]])) for i in range(400)] + [(1000 + i, " ".join(invented(r, 90))) for i in range(50)]
    out = simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted(x.doc_id for x in out.collect())
    assert got[0] == 0 and got[1:] == [1000 + i for i in range(50)]


def test_pairs_of_a_crowd_lose_none(spark):
    """Texts that are close, few of them near enough: every pair that is comes out, and not many others."""
    r = random.Random(8)
    words = invented(r, 120)
    rows = [(i, " ".join(edited(r, words, r.choice((8, 12, 20, 40, 90)))[: r.choice((120, 115, 100))])) for i in range(260)]
    rows += [(1000 + i, " ".join(w for w in words if r.random() > 0.03)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.selectExpr("xxhash64(text) as node").distinct()
    of = nodes.selectExpr("node", "node as component")
    pairs = {(x.a, x.b) for x in S._pairs_of_crowd(of, nodes, docs, "text").collect()}
    node = {x.doc_id: x.h for x in docs.selectExpr("doc_id", "xxhash64(text) as h").collect()}
    want = {tuple(sorted((node[a], node[b]))) for (a, s), (b, t) in itertools.combinations(rows, 2) if s != t and alike(s, t)}
    assert len(want) > 100 and want <= pairs
    assert len(pairs) < 0.35 * len(rows) * (len(rows) - 1) / 2


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 2)
    r = random.Random(9)
    words = invented(r, 150)
    rows = [(i, " ".join(edited(r, words, r.choice((15, 25, 60, 120))))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.node: x.component for x in near_duplicates(docs).collect()}
    node = [x.h for x in docs.selectExpr("doc_id", "xxhash64(text) as h").orderBy("doc_id").collect()]
    groups = [g for g in near_brute(rows) if len(g) > 1]
    split = sum(len({found.get(node[i], -i) for i in g}) - 1 for g in groups)
    assert sum(map(len, groups)) > 20 and split <= 0.05 * sum(map(len, groups))


def test_simhash_empty_and_stage(spark, frame):
    assert simhash_dedup(frame([])).count() == 0
    few = "only six words are in here"
    long = " ".join(invented(random.Random(1), 20_000))
    rows = [(5, "same text here now"), (3, "same text here now"), (9, prose(1, 50)), (7, None), (8, ""), (6, " \t"), (11, few), (12, few.upper()), (13, few + " too"), (14, long), (15, long + " end"), (None, prose(7, 50)), (9, prose(9, 50)), (9, prose(1, 50) + " x")]
    d = frame(rows)
    out = simhash_stage(spark, d, "")
    groups = near_brute(rows)
    assert out.columns == d.columns and out.count() == len(groups)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((min((rows[i][0] for i in g), key=lambda x: (x is None, x)) for g in groups), key=str)
    clash = spark.createDataFrame([(1, "a b", "mine", "k"), (2, "A b", "yours", "l")], "doc_id long, text string, _h string, node string")
    assert [tuple(r) for r in simhash_stage(spark, clash, "").collect()] == [(1, "a b", "mine", "k")]
    assert simhash_stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
