from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import prose
from tokenizers import Tokenizer

from rollbook.llm.sp_sampling import Group, Pieces, decode_ids, log_inclusion, sample_encodings
from rollbook.llm.token_files import ChunkEncoder, token_spans, write_tokens
from rollbook.session import new_folder

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", "  two  spaces ", "tab\tand\n\nlines\r\n x", "é ½ ﬁ  x y　z", "日本語 テキスト", "𝄞 music", "a<|endoftext|>b", "x" * 5000, prose(3, 200), "don't 1234,5 ▁ mark"]


def test_encoder_equals_the_library():
    tok = Tokenizer.from_file(BPE)
    want = [e.ids + [2] for e in tok.encode_batch(TEXTS, add_special_tokens=False)]
    e = ChunkEncoder(BPE, 2)
    for _ in range(2):  # cold and warm
        flat, n = e.encode(pa.array(TEXTS))
        assert flat.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    flat, n = e.encode(pa.array([None, "a"])[:1])
    assert flat.tolist() == [2] and n.tolist() == [1]


def test_encoder_fuzz():
    r = random.Random(2)
    atoms = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u2009", "\u3000", "\x85", "\x1c", "'s", "'ll", "'", "don't", "a", "Zé", "é", "ß", ",", ".", "%%%", "“", "_", "12", "3.5", "²", "½", "中文", "e.g.", "\r\n", "-", "😀", "<", "|", "\u200b", "ª"]
    texts = ["".join(r.choice(atoms) for _ in range(r.randint(0, 9))) for _ in range(20_000)]
    tok, e = Tokenizer.from_file(BPE), ChunkEncoder(BPE, 2)
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        flat, n = e.encode(pa.array(part, pa.large_string() if at % 2000 else pa.string()))
        want = [x.ids + [2] for x in tok.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_encoder_of_another_kind():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, tok = ChunkEncoder(path, 2), Tokenizer.from_file(path)
    assert not e.by_pieces
    flat, n = e.encode(pa.array(["Some Words, 12", None, "x <|endoftext|> y"]))
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in ("Some Words, 12", "", "x <|endoftext|> y")]
    assert flat.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_the_id_of_null_is_refused(spark, frame):
    with pytest.raises(Exception, match="stands for null"):
        write_tokens(frame([(-(1 << 63), "a")]), new_folder(spark, "t"), BPE)


def test_files_round_trip(spark, frame):
    rows = [(10 * i, t) for i, t in enumerate(TEXTS)] + [(5, None), (30, "again"), (None, "no id")]
    m = write_tokens(frame(rows), new_folder(spark, "t"), BPE)
    got = token_spans(m, with_ids=True).collect()
    assert len(got) == len(rows)
    tok = Tokenizer.from_file(BPE)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        texts = [t or "" for i, t in rows if i == r.doc_id]
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.ids in [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_spans(write_tokens(frame([]), new_folder(spark, "t"), BPE)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return Pieces(SP)


def all_segmentations(pieces, text):
    """Every path of ids and its weight, by recursion."""
    s = "▁" + text.replace(" ", "▁")
    names = {}
    for k, (h, ids, w) in enumerate(pieces.by_len, 1):
        for i, x in zip(ids.tolist(), w.tolist(), strict=True):
            names[pieces.text[pieces.text_off[i] : pieces.text_off[i + 1]].tobytes().decode().replace(" ", "▁")] = (i, x)
    out = []

    def walk(at, path, w):
        if at == len(s):
            out.append((tuple(path), w))
        for k in range(1, pieces.width + 1):
            if at + k <= len(s) and s[at : at + k] in names:
                i, x = names[s[at : at + k]]
                walk(at + k, [*path, i], w + x)

    walk(0, [], 0.0)
    z = math.log(sum(math.exp(w) for _, w in out))
    return {p: w - z for p, w in out}


@pytest.mark.parametrize("text", ["cat is", "hello", "a  b"])
def test_samples_have_the_lattice_distribution(pieces, text):
    want = all_segmentations(pieces, text)
    n = 4000
    g = Group(pieces, [text] * n, np.arange(n).astype(np.uint64))
    *held, end = g.search(3)
    seen = []
    for h in held:
        ids, lens = g.ids(h)
        off = np.concatenate([[0], np.cumsum(lens)])
        seen.append([tuple(ids[off[i] : off[i + 1]].tolist()) if i in set(h["live"].tolist()) else None for i in range(n)])
        for i in h["live"][:200].tolist():
            assert seen[-1][i] in want and abs(want[seen[-1][i]] - h["log_prob"][i]) < 1e-6
    assert all(a != b for a, b in zip(seen[0], seen[1], strict=True) if b)
    assert all(held[0]["perturbed"] >= held[1]["perturbed"])
    first = Counter(seen[0])
    for p, w in want.items():
        assert abs(first[p] / n - math.exp(w)) < 5 * math.sqrt(math.exp(w) / n) + 1e-3
    # inclusion scores make sums over samples unbiased: the whole mass is one
    total = sum(np.where(np.isin(np.arange(n), h["live"]), np.exp(h["log_prob"] - log_inclusion(h["log_prob"], end["kappa"])), 0) for h in held)
    assert abs(total.mean() - 1) < 0.05


def test_round_trip_and_determinism(spark, frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (3, TEXTS[3]), (None, "no id")]
    got = sample_encodings(frame(rows), SP, k=3).collect()
    assert all(r.round_trip for r in got)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r["sample"]), []).append(tuple(r.ids))
    assert len(by[3, 0]) == 2 and len(set(by[3, 0])) == 1  # repeated rows, equal samples
    assert by[50, 0] == [()] and (50, 1) not in by
    assert all(len({x for k, v in by.items() if k[0] == i for x in v}) == len([k for k in by if k[0] == i]) for i in range(len(TEXTS)))
    back = {r.doc_id: r.text for r in decode_ids(spark.createDataFrame([(k[0], list(v[0])) for k, v in by.items() if k[1] == 0], "doc_id long, ids array<int>"), SP).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(TEXTS))
    again = sample_encodings(frame(rows).repartition(2), SP, k=3).collect()
    assert sorted((str(r.doc_id), r["sample"], r.ids_crc32) for r in got) == sorted((str(r.doc_id), r["sample"], r.ids_crc32) for r in again)
    assert sample_encodings(frame([]), SP).count() == 0
