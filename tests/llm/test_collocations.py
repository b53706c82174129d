from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from rollbook.llm import collocations as C


def brute(rows, longest, least, top):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                count.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    cand = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, ws[i:j], a) for (lang, ws), a in cand.items() for i in range(len(ws)) for j in range(i + 2, len(ws) + 1) if j - i < len(ws)}
    by = {}
    for (lang, ws), a in cand.items():
        if (lang, ws, a) in inside:
            continue
        n = total[lang]
        cuts = [(1000 * a * n // (count[lang, ws[:k]] * count[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        by.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), count[lang, ws[:k]], count[lang, ws[k:]], n))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, xs in by.items() for i, x in enumerate(sorted(xs)[:top]))


def same(frame, rows, longest=5, least=3, top=2000, bits=12):
    got = sorted(tuple(r) for r in C.collocations(frame(rows), longest, least, top, bits).collect())
    want = brute(rows, longest, least, top)
    assert got == want
    return want


@pytest.fixture
def rows():
    rng = random.Random(5)
    voc = ["The", "the", "of", "a", "straße", "É", "x y", "\x1c", "b\0c", "naïve", "wo", "rd"]
    out = [(i, "".join(rng.choice(voc) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0c"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und"]), "s") for i in range(120)]
    return [*out, (500, None, "en", "s"), (501, "", None, None), (502, "ha ha ha ha ha ha.ha ha", "en", "s"), out[3], out[3], (None, "of the A of the A", "en", "s")]


def test_equals_brute_force(frame, rows):
    assert len(same(frame, rows)) > 50


def test_runs_of_few_texts_and_crowded_buckets(frame, rows, monkeypatch):
    monkeypatch.setattr(C, "RUN_CHARS", 100)  # workers are forked with it
    same(frame, rows, bits=12, least=4)


def test_top_and_ties(frame, rows):
    want = same(frame, rows, top=4, least=5)
    assert max(r[1] for r in want) == 4


def test_two_words_and_counts_over_a_byte(frame, rows):
    same(frame, rows, longest=2, least=2)
    same(frame, [(i, "big deal. big house", "en", "s") for i in range(400)], least=300)


def test_very_long_text_and_hot_language(frame):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(60_000))
    same(frame, [(1, text, "en", "s"), (2, "ax bx " * 500, "en", "s")], least=40, bits=14)


def test_nothing_to_report(frame):
    assert same(frame, []) == [] and same(frame, [(1, None, None, None), (2, "one two", "en", "s")]) == []


def test_score_beyond_64_bits(spark):
    big = spark.range(1).selectExpr("9000000000000L a", "9100000000000L n", "9200000000000L l", "9300000000000L r")
    assert big.selectExpr(C.SCORE).first()[0] == 1000 * 9000000000000 * 9100000000000 // (9200000000000 * 9300000000000)


def test_words_are_cut_as_by_pattern():
    texts = ["A b,c\td", "", "  ", "x", "é É.\x0bq\x85r", "..", "last "]
    words, piece, text = C.cut_words(texts)
    got = list(zip(words.to_pylist(), text.tolist(), strict=True))
    want = [(w, i) for i, t in enumerate(texts) for p in re.split(r"[.,;:!?\x0A-\x0D]", t) for w in re.findall(r"[^\x20\x09]+", p.translate({c: c + 32 for c in range(65, 91)}))]
    assert got == want and len(set(piece[:2])) == 1 and piece[1] != piece[2]
