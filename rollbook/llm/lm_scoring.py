"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Spark counts the words of the corpus; the most frequent have ids of their own and the others share ids by hash. The
network, in numpy, embeds the words around a masked one, passes their position-wise sum through a tanh layer, and gives
the probability of the word's id as that of its class times that within the class. A word that shares its id has of it
the share that its spelling has, by a model of byte pairs counted over all such words of the corpus. Texts become ids
once, and training and scoring read these. Training is data-parallel: in each round every partition takes the round's
share of its documents from common weights and masks each of their words in turn, so that all rounds have learned from
every word once; the partitions' weights are averaged in two levels of aggregation, so that no task holds more than one
model and what is gathered follows the corpus. A document's score is the sum of the log-probabilities of all its words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import batched, csr_take, read, shuffle_parts
from rollbook.session import table_of

#: Words with ids of their own by default, and ids that all others share; both are multiples of CLASS.
FREQUENT, SHARED = 3840, 256
CLASS = 64
#: Bytes, and the edge of a word.
SYMBOLS = 257
#: Words on either side that a prediction sees; 0 stands beyond the ends.
SIDE, WIDTH = 2, 24
ROUNDS = 2
#: masked() names one position of every so many.
MASKED = 8
MINIBATCH = 4096
#: Words scored together.
SCORED = 4096
#: A worker forgets its words beyond so many.
CACHE_WORDS = 400_000
#: What stands between white space is counted in runs of so many, repeats included.
COUNTED = 4_000_000
_WORD = re.compile(r"\w+|[^\w\s]")
_WORD_OR_END = re.compile(r"\w+|[^\w\s]|\n")


def words_of(text: str) -> list[str]:
    """Lower-case words and single marks; none spans white space, so those of a text are those of its split parts."""
    return _WORD.findall(text.lower())


def _parts(texts: pa.Array) -> pa.ListArray:
    """What stands between ASCII white space in each text (null: empty); other white space stays inside."""
    return pc.ascii_split_whitespace(pc.fill_null(texts, ""))


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()


def _words_of_parts(parts: list[str]) -> tuple[list[str], np.ndarray]:
    """Words of all parts, which hold no line ends, and how many each has: lower-casing looks at no word but its own."""
    found = _WORD_OR_END.findall("\n".join([*parts, ""]).lower())
    ends = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
    return list(filter("\n".__ne__, found)), np.diff(ends, prepend=-1) - 1


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts, counted in each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def counted() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held))
            held.clear()
            words, lens = _words_of_parts(_strings(found.field("values")))
            n: dict[str, int] = {}
            for w, k in zip(words, np.repeat(found.field("counts").to_numpy(), lens).tolist(), strict=True):
                n[w] = n.get(w, 0) + k
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            held.append(_parts(b.column(0)).flatten())
            if sum(map(len, held)) > COUNTED:
                yield counted()
        if held:
            yield counted()

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_model(counts: DataFrame, frequent: DataFrame) -> np.ndarray:
    """(SYMBOLS, SYMBOLS) log-probabilities of a byte after another, 256 being the edge, over all words but the frequent ones.

    counts: (word, n); frequent: (word), bounded. Pairs are summed in each partition before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            pairs, lens = _pairs(b.column(0).to_pylist())
            held += np.bincount(pairs, np.repeat(b.column(1).to_numpy(), lens), minlength=len(held)).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["pair", "n"])

    rare = counts.join(F.broadcast(frequent.select("word")), "word", "left_anti").select("word", "n")
    found = rare.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # SYMBOLS^2 rows at most
    n = np.full(SYMBOLS * SYMBOLS, 0.01)
    n[found.column("pair").to_numpy()] += found.column("n").to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS)
    return np.log(n / n.sum(1, keepdims=True)).astype(np.float32)


def _pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of words, their edges included, and how many each has."""
    raw = [w.encode() for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(lens)
    after = np.full(int(lens.sum()), SYMBOLS - 1, np.int64)
    inside = np.ones(len(after), bool)
    inside[ends - 1] = False
    after[inside] = np.frombuffer(b"".join(raw), np.uint8)
    before = np.concatenate([[SYMBOLS - 1], after[:-1]]) if len(after) else after
    return before * SYMBOLS + after, lens


class Vocabulary:
    """Ids of words; what stands between white space is looked at once and kept with the ids of its words."""

    def __init__(self, frequent: list[str], most: int = FREQUENT, spelling: np.ndarray | None = None):
        self.frequent, self.most, self.spelling = frequent, most, spelling
        self.clear()

    def clear(self) -> None:
        self.own = {w: i + 1 for i, w in enumerate(self.frequent)}
        self.index: dict[str, int] = {}
        self.flat, self.share, self.off = np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)

    def __getstate__(self):
        return self.frequent, self.most, self.spelling

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def dtype(self) -> np.dtype:
        """The smallest type that holds every id."""
        return np.min_scalar_type(self.most + SHARED)

    def _id(self, word: str) -> int:
        return self.own.get(word) or 1 + self.most + zlib.crc32(word.encode()) % SHARED

    def _shares(self, words: list[str], ids: np.ndarray) -> np.ndarray:
        """log of a word's share of its id: 0 for its own; else its spelling's, of which each shared id has one in SHARED."""
        out = np.zeros(len(words), np.float32)
        at = np.flatnonzero(ids > self.most)
        if self.spelling is not None and len(at):
            pairs, lens = _pairs([words[i] for i in at.tolist()])
            out[at] = np.minimum(0, np.add.reduceat(self.spelling.ravel()[pairs], np.cumsum(lens) - lens) + np.log(SHARED))
        return out

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (from 1; 0 is no word) of all words of the texts, log shares of their ids, and how many words each text has."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        parts = _parts(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        coded = parts.flatten().dictionary_encode()
        found, index, known = _strings(coded.dictionary), self.index, len(self.index)
        codes = np.fromiter((index.setdefault(x, len(index)) for x in found), np.int64, len(found))
        if len(index) > known:
            flat, lens = _words_of_parts([found[i] for i in np.flatnonzero(codes >= known).tolist()])
            ids = np.fromiter(map(self._id, flat), np.int32, len(flat))
            self.flat = np.concatenate([self.flat, ids])
            self.share = np.concatenate([self.share, self._shares(flat, ids)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])
        where, lens = csr_take(np.arange(len(self.flat), dtype=np.int32), self.off, codes[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])]
        return self.flat[where], self.share[where], np.diff(ends)


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _key (its hash), _ids (of all words, unsigned integers of vocabulary.dtype), _share (sum of their log shares)."""
    batched(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_key"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for b in batches:
            ids, share, lens = words.ids(b.column(2))
            ends = np.concatenate([[0], np.cumsum(lens * words.dtype.itemsize)])
            if ends[-1] >= 1 << 31:
                raise ValueError("the words of one batch of texts take over 2 GB")
            flat = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(words.dtype))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, pa.array(_sums(share, lens))], names=["_id", "_key", "_ids", "_share"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _key long, _ids binary, _share double")


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sum of each run of values, whatever stands beside it."""
    out, full = np.zeros(len(lens)), np.flatnonzero(lens)
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), np.cumsum(lens[full]) - lens[full])
    return out


def _ids_of(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a column that encoded() wrote, and how many each row has."""
    lens = pc.binary_length(column).to_numpy() // dtype.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), dtype), lens


def windows(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids laid out with SIDE zeros around each text, and the place of each word in that."""
    text = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(len(ids)) + SIDE * (2 * text + 1)
    out = np.zeros(len(ids) + 2 * SIDE * len(lens), np.int32)
    out[at] = ids
    return out, at


def masked(keys: np.ndarray, lens: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words of a thin draw for round k (train masks every word instead): one in each run of MASKED words of a text (its last may be shorter), drawn
    by a hash of the text's key, the run's place in the text and the round."""
    runs = -(-lens // MASKED)
    text = np.repeat(np.arange(len(lens)), runs)
    step = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    with np.errstate(over="ignore"):
        h = (keys.view(np.uint64)[text] ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) + step.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) >> np.uint64(1)
    first = step * MASKED
    return (np.cumsum(lens) - lens)[text] + first + h.astype(np.int64) % np.minimum(MASKED, lens[text] - first)


OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def runs(laid: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What windows() laid out, in runs of up to `most` words with SIDE ids on either side, and the places of the words
    in each run, the first SIDE ids not counted. Each word is in one run."""
    for i in range(0, len(at), most):
        own = at[i : i + most]
        yield laid[own[0] - SIDE : own[-1] + SIDE + 1], own - own[0]


def _sides(run: np.ndarray) -> list[slice]:
    """For each offset, where in a run the ids lie that stand so far from all its places."""
    return [slice(SIDE + o, len(run) - SIDE + o) for o in OFFSETS]


class Network:
    """Weights by name; words have ids from 1 to `ids`, class (id - 1) // CLASS."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 5, ids: int = FREQUENT + SHARED):
        r = np.random.default_rng(seed)
        self.ids = ids = len(weights["embed"]) - 1 if weights else ids
        n = ids // CLASS
        self.w = weights or {
            "embed": r.normal(0, 0.3, (ids + 1, WIDTH)).astype(np.float32), "place": np.ones((len(OFFSETS), WIDTH), np.float32), "bias": np.zeros(WIDTH, np.float32),
            "class_w": r.normal(0, 0.1, (WIDTH, n)).astype(np.float32), "class_b": np.zeros(n, np.float32),
            "word_w": r.normal(0, 0.1, (n, WIDTH, CLASS)).astype(np.float32), "word_b": np.zeros((n, CLASS), np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def of(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k, x in self.w.items():
            out[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return Network(out)

    def _before(self, x: np.ndarray, sides: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """What goes into the tanh, and the weights of each offset as often as that has rows (arrays of one shape are
        multiplied fastest). x has embeddings, sides the rows of x that stand at each offset."""
        n = len(x[sides[0]])
        place = np.repeat(self.w["place"][:, None], n, 1)
        h = np.repeat(self.w["bias"][None], n, 0)
        part = np.empty_like(h)
        for side, by in zip(sides, place, strict=True):
            h += np.multiply(x[side], by, out=part)
        return h, place

    def _sorted(self, before: np.ndarray, at: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """By class of the targets: their order, the hidden layer with a last column of ones, targets, classes, and how many each class has."""
        c = (target - 1) // CLASS
        order = np.argsort(c.astype(np.min_scalar_type(self.ids)), kind="stable")
        h = np.ones((len(order), WIDTH + 1), np.float32)
        np.tanh(before.take(at[order], 0), out=h[:, :WIDTH])
        return order, h, target[order] - 1, c[order], np.bincount(c, minlength=self.ids // CLASS)

    def _logits(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Logits of all classes, of the words of each row's class, and (class, from, to) of the rows, which come by class."""
        of_class = h @ np.vstack([self.w["class_w"], self.w["class_b"]])
        of_word = np.empty((len(h), CLASS), np.float32)
        held = np.flatnonzero(counts)
        ends = np.cumsum(counts[held])
        spans = list(zip(held.tolist(), (ends - counts[held]).tolist(), ends.tolist()))
        both = np.concatenate([self.w["word_w"][held], self.w["word_b"][held, None]], 1)
        for i, (_, a, z) in enumerate(spans):
            np.matmul(h[a:z], both[i], out=of_word[a:z])
        return of_class, of_word, spans

    @staticmethod
    def _near_zero(x: np.ndarray) -> None:
        """Takes each row's maximum off, but where no sum of powers comes near the ends of what floats hold."""
        if max(x.max(initial=0), -x.min(initial=0)) > 60:
            x -= x.max(1, keepdims=True)

    @staticmethod
    def _powers(x: np.ndarray) -> np.ndarray:
        """Sums of the rows of exp(x), which takes the place of x."""
        return np.exp(x, out=x) @ np.ones(x.shape[1], np.float32)

    @classmethod
    def _log_share(cls, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-softmax of x at one column of each row; x is used up."""
        cls._near_zero(x)
        own = x[np.arange(len(at)), at]
        return own - np.log(cls._powers(x))

    def _log_probs(self, x: np.ndarray, sides: list[slice], at: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, h, t, c, counts = self._sorted(self._before(x, sides)[0], at, target)
        of_class, of_word, _ = self._logits(h, counts)
        out = np.empty(len(t), np.float32)
        out[order] = self._log_share(of_class, c) + self._log_share(of_word, t % CLASS)
        return out

    def log_probs(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p of each target between the words near it: (words, offsets) ids."""
        x, n = self.w["embed"].take(near.ravel(), 0), near.shape[1]
        return self._log_probs(x, [slice(j, None, n) for j in range(n)], np.arange(len(near)), target)

    def log_probs_in(self, run: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p of each word of a run, at its places."""
        return self._log_probs(self.w["embed"].take(run, 0), _sides(run), at, run[at + SIDE].astype(np.int32))


class Trainer:
    """Adagrad on minibatches of masked positions."""

    def __init__(self, net: Network, rate: float = 0.1):
        self.net, self.rate = net, rate
        self.square = {k: np.full_like(x, 1e-3) for k, x in net.w.items()}
        self.seen = 0

    def _update(self, name: str, g: np.ndarray, rows=slice(None)) -> None:
        s = self.square[name][rows]
        s += g * g
        self.square[name][rows] = s
        g = g * self.rate
        g /= np.sqrt(s)
        self.net.w[name][rows] -= g

    def step(self, near: np.ndarray, target: np.ndarray) -> None:
        """near: (words, offsets) ids around each target."""
        n = near.shape[1]
        self._step(near.ravel(), [slice(j, None, n) for j in range(n)], np.arange(len(near)), target)

    def step_in(self, run: np.ndarray, at: np.ndarray) -> None:
        """Masks each word of a run, at its places."""
        self._step(run, _sides(run), at, run[at + SIDE].astype(np.int32))

    def _step(self, ids: np.ndarray, sides: list[slice], at: np.ndarray, target: np.ndarray) -> None:
        net, w, n = self.net, self.net.w, len(target)
        x = w["embed"].take(ids, 0)
        before, place = net._before(x, sides)
        order, h, t, c, counts = net._sorted(before, at, target)
        p, q, spans = net._logits(h, counts)
        rows, scaled = np.arange(n), []
        for logits, own in ((p, c), (q, t % CLASS)):  # gradients times what is divided by here, which h and back take: they are narrower
            net._near_zero(logits)
            sums = net._powers(logits)
            logits[rows, own] -= sums
            scaled.append((1 / (sums * n))[:, None])
        back = p @ w["class_w"].T
        back *= scaled[0]
        grad_class = (h * scaled[0]).T @ p
        by_word, h_word = np.empty_like(back), h * scaled[1]
        grad_word = np.empty((len(spans), WIDTH + 1, CLASS), np.float32)
        for i, (k, a, z) in enumerate(spans):
            np.matmul(q[a:z], w["word_w"][k].T, out=by_word[a:z])
            np.matmul(h_word[a:z].T, q[a:z], out=grad_word[i])
        by_word *= scaled[1]
        back += by_word
        slope = h[:, :WIDTH].copy()
        slope *= slope
        back *= np.subtract(1, slope, out=slope)
        held = np.array([k for k, _, _ in spans])
        self._update("word_w", grad_word[:, :WIDTH], held)
        self._update("word_b", grad_word[:, WIDTH], held)
        self._update("class_w", grad_class[:WIDTH])
        self._update("class_b", grad_class[WIDTH])
        self._update("bias", np.ones(n, np.float32) @ back)
        laid = before  # its values are used up
        laid[:] = 0
        laid[at[order]] = back
        g, grad_place, part, ones = np.zeros_like(x), np.empty_like(w["place"]), np.empty_like(laid), np.ones(len(laid), np.float32)
        for j, side in enumerate(sides):
            grad_place[j] = ones @ np.multiply(laid, x[side], out=part)
            g[side] += np.multiply(laid, place[j], out=part)
        self._update("place", grad_place)
        order = np.argsort(ids.astype(np.min_scalar_type(net.ids)), kind="stable")
        rows = ids[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        self._update("embed", np.add.reduceat(g.take(order, 0), first, axis=0), rows[first])
        self.seen += n


def _averaged(parts: DataFrame, size: int) -> tuple[np.ndarray | None, int]:
    """The mean of (n, weights) rows by n, summed in groups first; each task holds one sum."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(size)
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n += k
                held += np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64) * k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(held / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "weights"])

    groups = max(1, int(shuffle_parts(parts.sparkSession) ** 0.5))
    some = parts.repartition(groups).mapInArrow(total, "n long, weights binary")
    row = some.repartition(1).mapInArrow(total, "n long, weights binary").first()
    return (np.frombuffer(row[1], np.float32), row[0]) if row else (None, 0)


def vocabulary_of(docs: DataFrame, text_col: str = "text", words: int = FREQUENT) -> Vocabulary:
    """The `words` most frequent words of all texts, of equal ones the first in order, and a model of the others' spelling."""
    batched(docs.sparkSession)
    counts = table_of(word_counts(docs, text_col), "words")
    words = -(-words // CLASS) * CLASS
    frequent = counts.orderBy(F.desc("n"), "word").select("word").limit(words)
    return Vocabulary([r[0] for r in frequent.collect()], words, spelling_model(counts, frequent))


def learned(batches: Iterator[pa.RecordBatch], trainer: Trainer, dtype: np.dtype) -> Trainer:
    """The trainer after every word of batches of _ids has been masked once, MINIBATCH words at a time."""
    for b in batches:
        for run, at in runs(*windows(*_ids_of(b.column(0), dtype)), MINIBATCH):
            trainer.step_in(run, at)
    return trainer


def train_encoded(rows: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """The network from rows that encoded() made: each is of the round that its key names, which masks all its words."""
    spark, ids, dtype = rows.sparkSession, vocabulary.most + SHARED, vocabulary.dtype
    net = Network(ids=ids)
    size = len(net.flat())
    for k in range(rounds):
        share = rows.where(F.pmod("_key", F.lit(rounds)) == k).select("_ids")
        held = spark.sparkContext.broadcast(net.flat())

        def run(batches: Iterator[pa.RecordBatch], k: int = k, held=held) -> Iterator[pa.RecordBatch]:
            trainer = learned(batches, Trainer(Network(ids=ids).of(held.value), 0.1 if k == 0 else 0.05), dtype)
            if trainer.seen:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.seen]), pa.array([trainer.net.flat().tobytes()], pa.binary())], names=["n", "weights"])

        flat, n = _averaged(share.mapInArrow(run, "n long, weights binary"), size)
        if n:
            net = net.of(flat)
        held.unpersist()
    return net


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS, words: int = FREQUENT) -> tuple[Vocabulary, Network]:
    """Vocabulary and network from all texts of docs; a document is of the round that its hashed id names.

    words: how many have ids of their own, the most frequent, of equal ones the first in order. Without words nothing is
    learned. Repeated rows count each; the weights depend on how rows lie in partitions, as sums of averages do.
    """
    vocabulary = vocabulary_of(docs, text_col, words)
    return vocabulary, train_encoded(table_of(encoded(docs, vocabulary, id_col, text_col), "ids"), vocabulary, rounds)


def score(docs: DataFrame, vocabulary: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, log_likelihood (sum over all words), mean_log_prob (null without words).

    Null and empty texts have no words and the sum 0; a very long text is scored whole, by parts of SCORED words. Repeated
    rows count each; null ids are kept as they are; other columns are ignored, whatever their names; an empty table gives
    an empty one.
    """
    return score_encoded(encoded(docs, vocabulary, id_col, text_col), vocabulary, net, id_col)


def score_encoded(rows: DataFrame, vocabulary: Vocabulary, net: Network, id_col: str = "doc_id") -> DataFrame:
    """score() of rows that encoded() made."""
    batched(rows.sparkSession)
    model, dtype = rows.sparkSession.sparkContext.broadcast(net), vocabulary.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            ids, lens = _ids_of(b.column(1), dtype)
            logs = [own.log_probs_in(run, at) for run, at in runs(*windows(ids, lens), SCORED)]
            sums = _sums(np.concatenate(logs), lens) + b.column(2).to_numpy() if logs else np.zeros(len(lens))
            mean = pa.array(sums / np.maximum(1, lens), mask=lens == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.array(sums), mean], names=["_id", "n_words", "log_likelihood", "mean_log_prob"])

    out = rows.select("_id", "_ids", "_share").mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, n_words long, log_likelihood double, mean_log_prob double")
    return out.withColumnRenamed("_id", id_col)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    vocabulary = vocabulary_of(docs)
    rows = table_of(encoded(docs, vocabulary), "ids")
    return score_encoded(rows, vocabulary, train_encoded(rows, vocabulary))


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES: dict[str, str] = {}
