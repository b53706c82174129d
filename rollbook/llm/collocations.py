"""Phrase collocation mining by passes of hashed counting (PCY, DHP).

Pass k counts the k-word phrases exactly that can still be frequent, and beside them the (k+1)-word phrases by hash bucket.
A phrase is counted only if both its parts of one word less are frequent (Apriori) and its bucket is. What decides that in
tasks are bitmaps of fixed size: one of the frequent phrases of the pass before, one of the buckets that reach the least
count. A bit that is set by another phrase costs work and nothing else, as counts are exact and by the words themselves.

Tasks hold bucket counters in one byte each, which stops at the least count; blocks of them are summed across tasks. Words
of a run of texts are cut out of their bytes at once, coded within the run, and phrases are numbered exactly from the codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import batched, by_chars, read, texts_of
from rollbook.session import drop_folder, new_folder, table_of

#: Words of the longest phrase, the least count of a phrase, and rows of the report for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Hash buckets (a byte each in a task, a bit each in the bitmap), and bits of the bitmap of frequent phrases.
BUCKET_BITS, PHRASE_BITS = 24, 26
#: Counters in a block that tasks hand on.
BLOCK = 4096
#: Characters of texts that are counted together; a longer text is a run of its own.
RUN_CHARS = 4 << 20
#: Parts of a hot key (a word that many phrases begin or end with, a language).
SALTS = 32
#: floor(1000 a n / (l r)), exact to 38 digits.
SCORE = "cast(1000 as decimal(4,0)) * a * n div (cast(l as decimal(19,0)) * r)"

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_DELIMITERS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NAMES = ["lang", "phrase", "n", "block", "counters"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- words and phrases of a run of texts


def mixed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of phrases, each one word longer than what h is the hash of."""
    x = (h ^ words) * _MIX
    return x ^ (x >> np.uint64(29))


def hashes_of(names: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))


def cut_words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z lowered, in order; the piece of each word and the index of its text.

    Pieces end at the marks and line ends of `_DELIMITERS`, and with their text.
    """
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside, prepend=False)
    starts = np.flatnonzero(edge & inside)
    ends = np.flatnonzero(edge & ~inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside]))
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    return words, piece, text


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the different ones, index of one of its places by number)."""
    number = pa.array(keys).dictionary_encode().indices.to_numpy()
    place = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    place[number] = np.arange(len(number))
    return number, place


class Run:
    """Words of a run of texts as codes, with what phrases of any length need."""

    def __init__(self, texts: list[str], langs: list[str]):
        words, self.piece, text = cut_words(texts)
        coded = words.dictionary_encode()
        self.code, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.langs = list(dict.fromkeys(langs))
        at = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.array([at[x] for x in langs], np.int64)[text]
        self.lang_hash, self.word_hash = hashes_of(self.langs), hashes_of(self.words.to_pylist())

    def first_hash(self) -> np.ndarray:
        """Of each word by itself, and its language."""
        return mixed(self.lang_hash[self.lang], self.word_hash[self.code])

    def longer(self, start: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases of k - 1 words at `start` those that have a further word in their piece, and the hashes with it."""
        ok = start + k - 1 < len(self.code)
        ok[ok] = self.piece[start[ok]] == self.piece[start[ok] + k - 1]
        start = start[ok]
        return start, mixed(h[ok], self.word_hash[self.code[start + k - 1]])

    def counted(self, start: np.ndarray, k: int) -> pa.RecordBatch:
        """(lang, phrase, n) of the phrases of k words that begin at `start`."""
        number = self.lang[start]
        place = np.arange(len(start))
        for i in range(k):  # by the words' codes, so exact
            number, place = numbered(number * (len(self.words) + 1) + self.code[start + i])
        n = np.bincount(number, minlength=len(place)).astype(np.int64)
        parts = [self.words.take(pa.array(self.code[start[place] + i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[start[place]]))
        return pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Runs of about RUN_CHARS characters, over batches."""
    texts, langs, size = [], [], 0
    for b in batches:
        own = b.column(b.schema.get_field_index("lang")).to_pylist()
        for first, part in by_chars(texts_of(b), RUN_CHARS):
            texts += part
            langs += own[first : first + len(part)]
            size += sum(map(len, part))
            if size >= RUN_CHARS:
                yield Run(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Run(texts, langs)


# ---------------------------------------------------------------- bitmaps


class Bitmap:
    """Bits of fixed number, set at the low bits of hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, rows: DataFrame, bits: int) -> Bitmap:
        """From rows (word int, bits long), at most 2^(bits - 6) of them after they are joined."""
        joined = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << bits - 6, np.int64)
        words[joined.column("word").to_numpy()] = joined.column("bits").to_numpy()
        return cls(words.view(np.uint64))

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_bits(phrases: DataFrame, bits: int) -> DataFrame:
    """(word, bits) of the hashes of phrases (lang, phrase), as `Run` hashes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = hashes_of(b.column(0).to_pylist())
            parts = [p.split(" ") for p in b.column(1).to_pylist()]
            for i in range(len(parts[0])):  # all of one length
                h = mixed(h, hashes_of([p[i] for p in parts]))
            slot = h & np.uint64((1 << bits) - 1)
            word, inverse = np.unique((slot >> np.uint64(6)).astype(np.int32), return_inverse=True)
            out = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(out, inverse, np.uint64(1) << (slot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(out.view(np.int64))], names=["word", "bits"])

    return phrases.select("lang", "phrase").mapInArrow(run, "word int, bits long")


def packed(counters: np.ndarray) -> bytes:
    """A block of counters; places and counters of those that are not zero, if that is shorter."""
    used = np.flatnonzero(counters)
    short = len(used) * (2 + counters.itemsize) < counters.nbytes
    return used.astype("<u2").tobytes() + counters[used].tobytes() if short else counters.tobytes()


def unpacked(data: pa.Buffer, kind: np.dtype) -> np.ndarray:
    if data.size == BLOCK * kind.itemsize:
        return np.frombuffer(data, kind)
    n = data.size // (2 + kind.itemsize)
    out = np.zeros(BLOCK, kind)
    out[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, kind, n, 2 * n)
    return out


def bucket_bits(blocks: DataFrame, least: int) -> DataFrame:
    """(word, bits) of the buckets that reach `least`, from blocks (block, counters) of all tasks."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counters in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = unpacked(counters.as_buffer(), kind)
                sums[block] = np.minimum(sums[block].astype(np.int64) + own, least).astype(kind) if block in sums else own
        for block, s in sums.items():
            bits = np.packbits(s >= least, bitorder="little").view(np.int64)
            word = np.flatnonzero(bits).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(word + np.int32(block * (BLOCK // 64))), pa.array(bits[word])], names=["word", "bits"])

    return blocks.select("block", "counters").repartition("block").mapInArrow(run, "word int, bits long")


# ---------------------------------------------------------------- passes


def _pass(docs: DataFrame, k: int, frequent: Bitmap | None, buckets: Bitmap | None, least: int, bits: int, last: bool) -> DataFrame:
    """(lang, phrase, n) of phrases of k words that may be frequent, by run of texts; and, in rows of their own, (block,
    counters) of the buckets of phrases of k + 1 words whose parts may both be."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, buckets))
    size, kind = 1 << bits, np.min_scalar_type(least)

    def found(run: Run) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of k words begin that may be frequent, and their hashes."""
        known, hashed = sent.value
        start, h = np.arange(len(run.code)), run.first_hash()
        for length in range(2, k + 1):
            if length == k:
                kept = known.has(h)  # phrases of k - 1 words, each of them at its start
                at = np.zeros(len(run.code) + 1, bool)
                at[start[kept]] = True
                start, h = start[kept], h[kept]
                both = at[start + 1]
                start, h = start[both], h[both]
            start, h = run.longer(start, h, length)
        if k > 1:
            kept = hashed.has(h)
            start, h = start[kept], h[kept]
        return start, h

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0 if last else size, kind)
        for run in runs(batches):
            start, h = found(run)
            if not len(start):
                continue
            rows = run.counted(start, k)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary())], names=NAMES)
            if not last:
                at = np.zeros(len(run.code) + 1, bool)
                at[start] = True
                both = at[start + 1]
                _, h = run.longer(start[both], h[both], k + 1)
                slot, n = np.unique((h & np.uint64(size - 1)).astype(np.int32), return_counts=True)
                held[slot] = np.minimum(held[slot] + n, least)
        blocks = held.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        for at in range(0, len(used), 256):
            part = used[at : at + 256]
            counters = pa.array([packed(blocks[i]) for i in part], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), t) for t in (pa.string(), pa.string(), pa.int64())), pa.array(part.astype(np.int32)), counters], names=NAMES)

    return docs.select("lang", "text").mapInArrow(work, "lang string, phrase string, n long, block int, counters binary")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BUCKET_BITS) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, n) of each length whose n reaches least], (lang, n) of all words) of docs (lang, text)."""
    spark = docs.sparkSession
    out, frequent, buckets, totals = [], None, None, None
    for k in range(1, longest + 1):
        path = new_folder(spark, f"pass-{k}")
        found = table_of(_pass(docs, k, frequent, buckets, least, bits, k == longest), f"pass-{k}", path)
        counts = found.where("phrase is not null")
        if k == 1:
            totals = table_of(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        out.append(table_of(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"phrases-{k}"))
        if k < longest:
            frequent = Bitmap.of(phrase_bits(out[-1], PHRASE_BITS), PHRASE_BITS)
            buckets = Bitmap.of(bucket_bits(found.where("block is not null"), least), bits)
        drop_folder(spark, path)
    return out, totals


# ---------------------------------------------------------------- scores


def _salted(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _salt_of(column: str):
    return F.pmod(F.hash(column), F.lit(SALTS))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, bits: int = BUCKET_BITS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, of 2 to `longest` words.

    Texts are lower-cased (A-Z) and cut into pieces at marks and line ends, pieces into words at spaces and tabs. a counts
    the phrase's occurrences within pieces, at least `least`; l and r those of its two parts and n all words of the language;
    the score is floor(1000 a n / (l r)) for the cut where that is lowest, of equal ones the first. Phrases inside a longer
    one that is as frequent are left out. Ties go to the greater a, then to the lesser phrase in UTF-8. A null language is
    `und`, a null text empty; a very long text is counted whole; repeated rows count each time; an empty table gives an
    empty one. Other columns are ignored, whatever their names. least must be positive.
    """
    batched(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    phrases, totals = frequent_phrases(rows, longest, least, bits)

    cuts, inside = [], []
    for m, table in enumerate(phrases[1:], start=2):
        head, tail = (lambda k: F.substring_index("phrase", " ", k)), (lambda k: F.substring_index("phrase", " ", -k))
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), head(k).alias("first"), tail(m - k).alias("rest"), F.lit(k == 1).alias("fw"), F.lit(m - k == 1).alias("rw")) for k in range(1, m)]))
        cuts.append(table.select("lang", "phrase", F.col("n").alias("a"), each.alias("c")).select("lang", "phrase", "a", "c.*"))
        if m > 2:
            inside.append(table.select("lang", F.explode(F.array(head(m - 1), tail(m - 1))).alias("phrase"), F.col("n").alias("a")))
    # a phrase inside one that is longer by several words and as frequent is inside one longer by one that is
    kept = reduce(DataFrame.unionByName, cuts)
    if inside:
        kept = kept.join(reduce(DataFrame.unionByName, inside).distinct(), ["lang", "phrase", "a"], "left_anti")

    # single words and languages have many phrases: they are salted
    parts = _salted(phrases[0]).unionByName(reduce(DataFrame.unionByName, phrases[1:], phrases[0].limit(0)).withColumn("salt", F.lit(0)))
    for part, is_word, count in (("first", "fw", "l"), ("rest", "rw", "r")):
        known = parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(count), "salt")
        kept = kept.withColumn("salt", F.when(F.col(is_word), _salt_of("phrase")).otherwise(0)).join(known, ["lang", part, "salt"]).drop("salt")
    kept = kept.withColumn("salt", _salt_of("phrase")).join(_salted(totals), ["lang", "salt"]).drop("salt")
    best = kept.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    few = best.withColumn("salt", _salt_of("phrase"))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS ws FROM p
), o AS (
  SELECT lang, ws, k.k, unnest(range(1, len(ws) - k.k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) k WHERE len(ws) >= k.k
), f AS MATERIALIZED (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS n FROM o GROUP BY ALL
), t AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 100
), inner_parts AS (
  SELECT DISTINCT c.lang, array_to_string(list_slice(c.ws, i.i, i.i + m.m - 1), ' ') AS phrase, c.a
  FROM c, (SELECT unnest(range(2, 5)) AS m) m, (SELECT unnest(range(1, 5)) AS i) i WHERE m.m < c.k AND i.i + m.m - 1 <= c.k
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)
), cuts AS (
  SELECT kept.*, j.j, array_to_string(list_slice(ws, 1, j.j), ' ') AS first, array_to_string(list_slice(ws, j.j + 1, k), ' ') AS rest
  FROM kept, (SELECT unnest(range(1, 5)) AS j) j WHERE j.j < k
), s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * cuts.a * t.n) // (x.n::HUGEINT * y.n) AS score, cuts.j
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.first JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rest JOIN t ON t.lang = cuts.lang
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE place = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": ORACLE}
