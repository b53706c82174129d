from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, key string"
WORDS = "the of and to in is was for on that by with from at are this be as it not have has they which one had word would all".split()


def prose(k: int, n: int) -> str:
    """n words that depend on k; sentences of seven."""
    out = []
    for i in range(n):
        w = WORDS[(k * 7 + i * i + i * k) % len(WORDS)] + ("" if i % 3 else chr(97 + (i * k + k) % 26) + chr(97 + (i + k * 3) % 26))
        out.append(w.capitalize() if i % 7 == 0 else w + ("." if i % 7 == 6 else ""))
    return " ".join(out)


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names the operators use inside."""

    def make(rows):
        full = [(*(r + (None,) * 4)[:4], 0, 7, "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make
