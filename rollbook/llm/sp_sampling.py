"""SentencePiece encoding by sampling without replacement, and decoding.

A text's lattice has an edge for each piece that matches at a character. Backward sums of the piece probabilities turn
each node into a distribution over its edges. The search keeps, for a text, disjoint sets of segmentations, each with
the largest Gumbel-perturbed log-probability among its members; this bound is exact, so that the best set's best member
is the next sample. Popping a set fixes its next edge, follows sampled edges to the end, and leaves the sets of paths
that branch off at each step. The k samples are the k largest perturbed segmentations: distinct, drawn without
replacement, and the same for the same row key. All texts of a group take each step together.

No piece crosses from a word into the space before the next one, or spans two neighbouring characters that stand side by
side in no piece; what lies between such places is called a word here, and equal words share a lattice. Byte pieces
stand for characters that have no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import batched, by_chars, csr_take, read, texts_of

SAMPLES = 2
#: Texts are taken together up to so many characters; a longer text is a group of its own.
GROUP_CHARS = 200_000
#: What a worker keeps of words' lattices: about 70 MB at most.
BOOK_NODES, BOOK_EDGES = 600_000, 2_000_000
MARK = 0x2581
_B = np.uint64(0x9E3779B97F4A7C15)
_HOT = 20


class Pieces:
    """Pieces of a SentencePiece model by hash, with log-probabilities.

    A unigram model's scores are log-probabilities. A BPE model's are merge ranks; a piece of rank r then weighs 1/(r + 2).
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
        score = np.array([sp.get_score(i) for i in range(n)])
        ids = np.flatnonzero(plain)
        if (score[ids] == np.round(score[ids])).all():
            rank = np.minimum(-score[ids], n)
            score[ids] = -np.log(rank + 2)
            score[ids] -= np.log(np.exp(score[ids]).sum())
        self.width = max(len(names[i]) for i in ids)
        self.by_len: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        #: By length and hash: 1 where a piece may be, 2 where a longer one may begin.
        self.hot = np.zeros((self.width, 1 << _HOT), np.uint8)
        for k in range(1, self.width + 1):
            own = np.array([i for i in ids if len(names[i]) == k], np.int64)
            h = np.zeros(len(own), np.uint64)
            cp = np.array([[ord(c) for c in names[i]] for i in own], np.uint64).reshape(-1, k)
            with np.errstate(over="ignore"):
                for j in range(k):
                    h = h * _B + cp[:, j]
                    self.hot[j, self._slot(h)] |= 1 if j == k - 1 else 2
            order = np.argsort(h)
            self.by_len.append((h[order], own[order], score[own[order]]))
        #: By hash of two neighbouring characters: some piece holds them side by side.
        self.joined = np.zeros(1 << _HOT, bool)
        pairs = np.array(sorted({(ord(a), ord(b)) for i in ids for a, b in zip(names[i], names[i][1:])}), np.uint32).reshape(-1, 2)
        self.joined[self._pair(pairs[:, 0], pairs[:, 1])] = True
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.byte_score = float(score[ids].min() - 1)
        held = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else (b"" if not plain[i] else x.replace("▁", " ").encode()) for i, x in enumerate(names)]
        self.text = np.frombuffer(b"".join(held), np.uint8)
        self.text_off = np.concatenate([[0], np.cumsum([len(x) for x in held])])

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _HOT)).astype(np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _HOT)

    def apart(self, chars: np.ndarray) -> np.ndarray:
        """Whether no piece can span a character and the one before it."""
        return ~self.joined[self._pair(chars[:-1], chars[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, without the space that encoding puts first."""
        flat, _ = csr_take(self.text, self.text_off, np.asarray(ids, np.int64))
        return flat.tobytes()[1:]


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Nodes are the characters of different words. Node p has edges first[p] to first[p] + count[p], longest piece first.

    Of an edge, size is its characters, ids its piece (-2: the character's byte pieces), q its probability at its node.
    """

    def __init__(self, pieces: Pieces, chars: np.ndarray, start: np.ndarray):
        n, width = len(chars), pieces.width
        self.chars, self.width = chars, width
        rem = np.repeat(start[1:], np.diff(start)) - np.arange(n)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pos, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(1, width + 1):
            with np.errstate(over="ignore"):
                h = h * _B + chars[pos + k - 1]
            keys, ids, score = pieces.by_len[k - 1]
            hot = pieces.hot[k - 1][Pieces._slot(h)]
            near = np.flatnonzero(hot & 1) if len(keys) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
            hit = keys[at] == h[near] if len(keys) else np.zeros(0, bool)
            p, at = pos[near[hit]], at[hit]
            hits.append((p, ids[at], score[at]))
            on = np.flatnonzero((hot & 2).astype(bool) & (rem[pos] > k))
            pos, h = pos[on], h[on]
        # characters without a piece: one byte piece for each of their UTF-8 bytes
        none = np.ones(n, bool)
        none[hits[0][0]] = False
        none = np.flatnonzero(none)
        cp = chars[none].astype(np.int64)
        wide = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        own = np.where(wide == 1, pieces.byte[np.minimum(cp, 127)], -2)
        hits[0] = tuple(np.concatenate(x) for x in zip(hits[0], (none, own, pieces.byte_score * wide), strict=True))
        opened = np.concatenate([x[0] for x in hits[1:]])
        closed = np.concatenate([x[0] + k for k, x in enumerate(hits[1:], 1)])
        crossed = np.bincount(opened + 1, minlength=n + 1) - np.bincount(closed + 1, minlength=n + 1)[: n + 1]
        # no edge crosses a cut, so that distributions on both sides are independent
        cut = np.cumsum(crossed[:-1]) == 0
        cut[start[:-1]] = True
        cuts = np.append(np.flatnonzero(cut), n)
        left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(n)
        level = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")  # a radix sort
        self.count = np.bincount(np.concatenate([x[0] for x in hits]), minlength=n)
        self.first = np.empty(n, np.int64)
        self.first[level] = np.cumsum(self.count[level]) - self.count[level]
        total = int(self.count.sum())
        self.size, self.ids, w, node = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total), np.empty(total, np.int64)
        filled = self.first.copy()
        for k in range(width, 0, -1):
            p, ids, score = hits[k - 1]
            e = filled[p]
            filled[p] += 1
            self.size[e], self.ids[e], w[e], node[e] = k, ids, score, p
        # backward sums, all nodes of a level (distance to the next cut) at once
        beta = np.zeros(n + 1)
        ends = np.cumsum(np.bincount(left)).tolist() if n else []
        to = node + self.size
        at_cut = self.size == left[node]
        for t in range(1, len(ends)):
            p = level[ends[t - 1] : ends[t]]
            if not len(p):
                continue
            e = slice(self.first[p[0]], self.first[p[-1]] + self.count[p[-1]])
            x = w[e] + np.where(at_cut[e], 0.0, beta[to[e]])
            at = self.first[p] - e.start
            top = np.maximum.reduceat(x, at)
            beta[p] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, self.count[p])), at))
        self.logq = np.maximum(w + np.where(at_cut, 0.0, beta[to]) - beta[node], -690.0)
        self.q = np.exp(self.logq)
        run = np.cumsum(self.q)
        self.cum = run - (run - self.q)[self.first[node]] if total else run

    def choose(self, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by inverse of its distribution."""
        e = self.first[p]
        last = e + self.count[p] - 1
        live = np.flatnonzero((self.cum[e] <= u) & (e < last))
        while len(live):
            e[live] += 1
            live = live[(self.cum[e[live]] <= u[live]) & (e[live] < last[live])]
        return e

    def rest(self, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of the edges of each node, those in mask zero; a column for each possible edge."""
        j = np.arange(self.width)
        e = np.minimum(self.first[p][:, None] + j, max(0, len(self.q) - 1))
        return np.where((j < self.count[p][:, None]) & ~(mask[:, None] >> j & 1).astype(bool), self.q[e], 0)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, at: np.ndarray, draw: int) -> np.ndarray:
    """In (0, 1), by row key, place in the text and number of the draw."""
    with np.errstate(over="ignore"):
        x = _mix(key + _mix(at.astype(np.uint64) * np.uint64(64) + np.uint64(draw)) * _B)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


class Book:
    """Lattices of the words seen so far by a worker, one after the other in arrays of a fixed size; begun anew when full."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.width = pieces, pieces.width
        self.first, self.count, self.chars = (np.empty(BOOK_NODES, t) for t in (np.int64, np.int8, np.uint32))
        self.size, self.ids, self.q, self.logq, self.cum = (np.empty(BOOK_EDGES, t) for t in (np.int8, np.int32, np.float64, np.float64, np.float64))
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.nodes = self.edges = 0

    choose, rest = Lattice.choose, Lattice.rest

    def look(self, words: list[bytes]) -> tuple[Book | Lattice, np.ndarray]:
        """A lattice that holds the words (UTF-32), and the first node of each."""
        new = [w for w in words if w not in self.at]
        size = sum(map(len, new)) // 4
        if self.nodes + size > BOOK_NODES:
            self.clear()
            new, size = words, sum(map(len, words)) // 4
        lat, start = self._made(new)
        if size > BOOK_NODES or self.edges + len(lat.q) > BOOK_EDGES:
            self.clear()
            if len(new) < len(words):
                lat, start = self._made(words)
            if len(start) - 1 < len(words) or start[-1] > BOOK_NODES or len(lat.q) > BOOK_EDGES:
                return lat, start[:-1]
            new = words
        n, e = slice(self.nodes, self.nodes + int(start[-1])), slice(self.edges, self.edges + len(lat.q))
        self.first[n], self.count[n], self.chars[n] = lat.first + self.edges, lat.count, lat.chars
        self.size[e], self.ids[e], self.q[e], self.logq[e], self.cum[e] = lat.size, lat.ids, lat.q, lat.logq, lat.cum
        self.at.update(zip(new, (start[:-1] + self.nodes).tolist(), strict=True))
        self.nodes, self.edges = n.stop, e.stop
        return self, np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _made(self, words: list[bytes]) -> tuple[Lattice, np.ndarray]:
        start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) // 4)])
        return Lattice(self.pieces, np.frombuffer(b"".join(words), np.uint32).astype(np.uint64), start), start


@lru_cache(1)
def book_of(path: str) -> Book:
    return Book(pieces_of(path))


class Group:
    """The texts of a group: their words, each a run of nodes of the lattice, and the search over all of them."""

    def __init__(self, pieces: Pieces, texts: list[str], keys: np.ndarray, book: Book | None = None):
        self.pieces, self.keys, self.n = pieces, keys, len(texts)
        whole = "".join(("▁" + t if t else "") for t in texts).replace(" ", "▁")
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        self.begin = np.cumsum(size) - size
        mark = chars == MARK
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[1:] |= pieces.apart(chars)
        first[self.begin[size > 0]] = True
        self.word = np.append(np.flatnonzero(first), len(chars))  # of all words, first character
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(self.word) - 1, [None, pa.py_buffer((self.word * 4).astype(np.int32)), pa.py_buffer(chars.tobytes())])
        found = raw.dictionary_encode()
        self.lat, node = (book or Book(pieces)).look(found.dictionary.to_pylist())
        # node of a character = the character + shift of its word
        self.shift = node[found.indices.to_numpy()] - self.word[:-1] if len(node) else np.zeros(0, np.int64)
        self.shift_at = np.repeat(self.shift.astype(np.int32), np.diff(self.word))
        self.words_of = np.searchsorted(self.word[:-1], np.append(self.begin, len(chars)))
        self.text_of = np.repeat(np.arange(self.n), np.diff(self.words_of))

    def follow(self, word: np.ndarray, at: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled paths from character `at` to the end of each word: characters and edges of all steps, in order."""
        key, begin, stop, shift = self.keys[self.text_of[word]], self.begin[self.text_of[word]], self.word[word + 1], self.shift[word]
        chars, edges = [], []
        live = np.flatnonzero(at < stop)
        at = at.copy()
        while len(live):
            c = at[live]
            e = self.lat.choose(c + shift[live], uniform(key[live], c - begin[live], draw))
            chars.append(c)
            edges.append(e)
            at[live] = c + self.lat.size[e]
            live = live[at[live] < stop[live]]
        if not chars:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        c, e = np.concatenate(chars), np.concatenate(edges)
        order = np.argsort(c, kind="stable")
        return c[order], e[order]

    def node(self, c: np.ndarray) -> np.ndarray:
        return c + self.shift_at[c]

    def search(self, k: int) -> list[dict[str, np.ndarray]]:
        """Up to k samples of each text, best first: steps (chars, edges, cut by text), log_prob, perturbed; then kappa."""
        texts = np.arange(self.n)
        zero = np.zeros(self.n, np.int64)
        top = -np.log(-np.log(uniform(self.keys, zero, 63)))
        all_words = np.arange(len(self.word) - 1)
        chars, edges = self.follow(all_words, self.word[:-1].copy(), 0)
        prefix = zero
        live = texts
        held: list[dict[str, np.ndarray]] = []
        for r in range(k):
            # a path of each live text; sets branch off after its prefix
            cut = np.searchsorted(chars, np.append(self.begin, 1 << 60))
            cut[-1] = len(chars)
            nodes = self.node(chars)
            q, logq = self.lat.q[edges], self.lat.logq[edges]
            text = np.repeat(texts, np.diff(cut))
            cum = np.cumsum(logq)
            base = np.concatenate([[0], cum])[cut[:-1]]
            before = cum - logq - base[text]
            total = np.concatenate([[0], cum])[cut[1:]] - base
            fresh = np.arange(len(chars)) - cut[text] >= prefix[text]
            free = self._free(before, q, text, chars, r)
            free[~fresh] = -np.inf
            held.append({"live": live, "chars": chars, "edges": edges, "cut": cut, "nodes": nodes, "before": before, "mask": np.int64(1) << (edges - self.lat.first[nodes]), "gone": q.copy(), "free": free, "log_prob": total, "perturbed": top})
            best = [_argmax(h["free"], h["cut"]) for h in held]
            value = np.stack([_below(b[0], h["perturbed"]) for b, h in zip(best, held, strict=True)])
            pick = value.argmax(0)
            bound = value[pick, texts]
            if r == k - 1:
                return [*held, {"kappa": bound}]
            live = np.flatnonzero(bound > -np.inf)
            # pop the best set of each text: another edge at its step, then sampled edges to the end
            parts, prefix, top = [], zero.copy(), bound
            for s, h in enumerate(held):
                own = live[pick[live] == s]
                if not len(own):
                    continue
                j = best[s][1][own]
                p, c = h["nodes"][j], h["chars"][j]
                q_left = self.lat.rest(p, h["mask"][j])
                sums = np.cumsum(q_left, 1)
                u = uniform(self.keys[own], c - self.begin[own], 40 + r) * sums[:, -1]
                way = np.minimum((sums <= u[:, None]).sum(1), self.lat.width - 1 - np.argmax((q_left > 0)[:, ::-1], 1))
                h["mask"][j] |= np.int64(1) << way
                q_left[np.arange(len(j)), way] = 0
                h["gone"][j] = 1 - q_left.sum(1)
                new = _below(self._free(h["before"][j], h["gone"][j], own, c, 16 + r), bound[own])
                h["free"][j] = np.where((q_left > 0).any(1), _unbound(new, h["perturbed"][own]), -np.inf)
                e = self.lat.first[p] + way
                n_before = j - h["cut"][own]
                prefix[own] = n_before + 1
                old, _ = csr_take(h["chars"], np.stack([h["cut"][own], j], 1).ravel(), np.arange(len(own)) * 2)
                old_e, _ = csr_take(h["edges"], np.stack([h["cut"][own], j], 1).ravel(), np.arange(len(own)) * 2)
                word = np.searchsorted(self.word, c, side="right") - 1
                later, _ = csr_take(all_words, np.stack([word + 1, self.words_of[own + 1]], 1).ravel(), np.arange(len(own)) * 2)
                words = np.concatenate([word, later])
                at = np.concatenate([c + self.lat.size[e], self.word[later]])
                new_c, new_e = self.follow(words, at, r + 1)
                parts.append((np.concatenate([old, c, new_c]), np.concatenate([old_e, e, new_e])))
            if parts:
                chars, edges = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(chars, kind="stable")
                chars, edges = chars[order], edges[order]
            else:
                chars, edges = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return held

    def _free(self, before, gone, text, chars, draw: int) -> np.ndarray:
        """The largest perturbed value of each set if nothing bounded it; of sets of one bound the order is the same."""
        left = 1 - gone
        with np.errstate(divide="ignore"):
            e = -np.log(uniform(self.keys[text], chars - self.begin[text], 8 + draw))
            return before + np.log(np.where(left > 1e-12, left, 0) / e)

    def ids(self, h: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a sample of all texts, and how many each has."""
        out = self.lat.ids[h["edges"]].astype(np.int64)
        text = np.repeat(np.arange(self.n), np.diff(h["cut"]))
        wide = np.flatnonzero(out == -2)
        if len(wide):
            raw = [chr(int(c)).encode() for c in self.lat.chars[h["nodes"][wide]]]
            times = np.ones(len(out), np.int64)
            times[wide] = [len(x) for x in raw]
            first = np.cumsum(times) - times
            out, text = np.repeat(out, times), np.repeat(text, times)
            for at, x in zip(first[wide].tolist(), raw, strict=True):
                out[at : at + len(x)] = self.pieces.byte[list(x)]
        return out, np.bincount(text, minlength=self.n)


def _below(free: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Perturbed values given that they are below those of their texts' last samples."""
    return -np.logaddexp(-top, -free)


def _unbound(value: np.ndarray, top: np.ndarray) -> np.ndarray:
    """What _below makes into value; value < top."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(value > -np.inf, value - np.log(-np.expm1(np.minimum(value - top, -1e-16))), -np.inf)


def _argmax(g: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest of each run and where it is; -inf for an empty run."""
    value, at = np.full(len(cut) - 1, -np.inf), np.zeros(len(cut) - 1, np.int64)
    full = np.flatnonzero(np.diff(cut) > 0)
    if len(full):
        value[full] = np.maximum.reduceat(g, cut[full])
        own = np.repeat(full, np.diff(cut)[full])
        hits = np.flatnonzero(g == value[own])
        at[own[hits[::-1]]] = hits[::-1]
    return value, at


def log_inclusion(log_prob: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log of the probability that a segmentation's perturbed value passes kappa, the next one's."""
    x = log_prob - kappa
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(x < -30, x, np.where(x > 30, 0.0, np.log(-np.expm1(-np.exp(np.clip(x, -30, 30))))))


def sample_encodings(docs: DataFrame, model_path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Up to k (at most 8) rows per input row: id_col, sample, n_pieces, log_prob, perturbed, log_inclusion, ids_crc32, round_trip, ids.

    Samples are distinct segmentations of the whole text, the largest perturbed one first; a text with fewer has fewer
    rows, all of inclusion 1. ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers; round_trip says that
    the ids decode to the text (▁ being a space). Null and empty texts have one sample without pieces; a very long text is
    searched whole. Repeated rows give equal samples; a null id is a key like any other; other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    if not 1 <= k <= 8:
        raise ValueError("k is from 1 to 8")
    batched(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_key"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for b in batches:
            texts, keys = texts_of(b, "_text"), b.column(1).to_numpy().view(np.uint64)
            for first, own in by_chars(texts, GROUP_CHARS):
                g = Group(pieces, own, keys[first : first + len(own)], book_of(model_path))
                *held, end = g.search(k)
                for s, h in enumerate(held):
                    ids, n = g.ids(h)
                    off = np.concatenate([[0], np.cumsum(n)])
                    live = h["live"]
                    wide = ids.astype("<u4")
                    crc = [zlib.crc32(wide[off[i] : off[i + 1]]) for i in live.tolist()]
                    raw, size = csr_take(pieces.text, pieces.text_off, ids)
                    ends = np.concatenate([[0], np.cumsum(size)])[off].tolist()
                    raw = raw.tobytes()
                    same = [raw[ends[i] + 1 : ends[i + 1]] == own[i].replace("▁", " ").encode() for i in live.tolist()]
                    cols = [b.column(0).take(pa.array(live + first)), pa.array(np.full(len(live), s, np.int32)), pa.array(n[live]), pa.array(h["log_prob"][live]), pa.array(h["perturbed"][live])]
                    cols += [pa.array(log_inclusion(h["log_prob"], end["kappa"])[live]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                    names = ["_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "round_trip"]
                    if with_ids:
                        flat, lens = csr_take(ids.astype(np.int32), off, live)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"_id {dict(rows.dtypes)['_id']}, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of every row of encoded; null ids give a null text. Bytes that are no UTF-8 become U+FFFD."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for b in batches:
            text = [None if x is None else pieces.decode(np.array(x, np.int64)).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["_id", "text"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, text string").withColumnRenamed("_id", id_col)


def op6_sp_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_encodings(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return out.withColumn("inclusion", F.exp("log_inclusion"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SAMPLES encodings of every document, drawn without replacement: doc_id, sample, n_pieces, log_prob, inclusion,
    ids_crc32, round_trip (the ids decode to the text) and ids."""
    out = sample_encodings(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "sample", "n_pieces", "log_prob", F.exp("log_inclusion").alias("inclusion"), "ids_crc32", "round_trip", "ids")


QUERIES = {"op6_sp_sampling": op6_sp_sampling}
ORACLES: dict[str, str] = {}
