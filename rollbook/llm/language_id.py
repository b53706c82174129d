"""Language identification by interpolated Kneser-Ney character models, one per language.

Spark counts the packed 4-grams of each language, and derives continuation counts, discounts and back-off weights by
grouped aggregation. The models of all languages lie in one pair of arrays sorted by 64-bit hash, so that what is looked
up is verified. The broadcast is bounded by 2 x ENTRIES entries whatever the corpus: beyond that the grams of lowest
counts are left out, and their share goes to the shorter grams, as in any Kneser-Ney model with cut-offs. A text goes to
the language of least mean cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import batched, read, texts_of
from rollbook.session import table_of

ORDER = 4
#: Grams kept for all languages: a half of them 4-grams, a quarter 3-grams, and so on; as many contexts at most.
ENTRIES = 1 << 23
#: Documents whose cross-entropies calibrate score and rejection; a bound, drawn by hash, and a tenth of the rows at most.
#: The models do not learn from them.
CALIBRATION_ROWS = 2000
#: Probability of a character that no model has seen, by the uniform distribution below the unigrams.
BASE = 1.0 / 4096
#: A text is rejected at so many times the largest deviation among the calibration rows.
REJECT_FACTOR = 1.5
_CACHE_BITS = 19


# ---------------------------------------------------------------- characters


@lru_cache(1)
def _fold() -> np.ndarray:
    """UTF-16 unit -> itself if part of a letter, else a space. Surrogates count as letters only in pairs of one."""
    out = np.full(1 << 16, 32, np.uint16)
    for i in range(1 << 16):
        if 0xD800 <= i < 0xE000 or chr(i).isalpha():
            out[i] = i
    return out


def packed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the texts, packed into 64 bits, and how many each text has (0: no letter)."""
    parts, lens = [], np.zeros(len(texts), np.int64)
    fold = _fold()
    for k, t in enumerate(texts):
        if not any(map(str.isalpha, t)):
            continue
        u = fold[np.frombuffer(t.lower().encode("utf-16-le", "surrogatepass"), "<u2")]
        space = u == 32
        if space.any():
            u = u[~(space & np.concatenate([[True], space[:-1]]))]
        lens[k] = len(u)
        parts.append(np.concatenate([np.full(ORDER - 1, 32, np.uint16), u]))
    if not parts:
        return np.zeros(0, np.uint64), lens
    flat = np.concatenate(parts).astype(np.uint64)
    g = flat[3:] | flat[2:-1] << np.uint64(16) | flat[1:-2] << np.uint64(32) | flat[:-3] << np.uint64(48)
    full = lens[lens > 0]
    ends = np.cumsum(full + ORDER - 1)[:-1]
    if len(ends):  # grams across two texts
        keep = np.ones(len(g), bool)
        keep[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
        g = g[keep]
    return g, lens


# ---------------------------------------------------------------- training


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, g, n) of docs (_lang, _text), summed per worker before the shuffle."""
    limit = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            size.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])

        for b in batches:
            langs, texts = b.column(0).to_pylist(), texts_of(b, "_text")
            for lang in set(langs):
                g, _ = packed_grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                held.setdefault(lang, []).append(g)
                size[lang] = size.get(lang, 0) + len(g)
            if sum(size.values()) > limit:
                yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    return docs.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _masked(c: Column, chars: int) -> Column:
    return c.bitwiseAND(F.lit((1 << 16 * chars) - 1)) if chars < 4 else c


def _cutoff(c: DataFrame, most: int) -> int:
    """The least power of two so that at most `most` grams occur as often; 1 where all are kept."""
    at = F.floor(F.log2("n")).cast("int")
    for power, n in sorted(((r[0], r[1]) for r in c.groupBy(at.alias("p")).agg(F.count(F.lit(1))).collect()), reverse=True):  # up to 64 rows
        most -= n
        if most < 0:
            return 1 << power + 1
    return 1


def _entries(counts: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(lang, kind, key, value): kind 2k is the discounted share of a k-gram, 2k + 1 the back-off weight of its context."""
    out = None
    c = counts
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuation counts: different characters before it
            c = c.groupBy("lang", _masked(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        d = c.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        d = d.select("lang", F.greatest(F.lit(0.1), F.coalesce(F.try_divide("n1", F.expr("n1 + 2 * n2")), F.lit(0.5))).alias("d"))
        # a row for each language
        own = c.join(F.broadcast(d), "lang").withColumns({"ctx": F.shiftrightunsigned("g", 16), "stays": F.col("n") >= _cutoff(c, entries >> ORDER + 1 - k)})
        mass = F.when(F.col("stays"), F.col("d")).otherwise(F.col("n"))
        of = own.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum(mass).alias("mass"), F.bool_or("stays").alias("some"))
        # contexts hold the rows of few k-grams each, so the join back is even
        shares = own.where("stays").join(of, ["lang", "ctx"])
        shares = shares.select("lang", F.lit(2 * k).alias("kind"), F.col("g").alias("key"), F.expr("greatest(n - d, 0) / total").alias("value"))
        weights = of.where("some").select("lang", F.lit(2 * k + 1).alias("kind"), F.col("ctx").alias("key"), F.expr("mass / total").alias("value"))
        both = shares.unionByName(weights)
        out = both if out is None else out.unionByName(both)
    return out


def slots(key: np.ndarray, kind: int | np.ndarray, lang: int | np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) ^ (np.asarray(kind, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(lang, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Models:
    """Sorted hash arrays of all languages; cross-entropies of grams, kept in a direct-mapped cache."""

    def __init__(self, langs: list[str], keys: np.ndarray, values: np.ndarray):
        self.langs, self.keys, self.values = langs, keys, values
        self.seen = None

    def __getstate__(self):
        return self.langs, self.keys, self.values

    def __setstate__(self, state):
        self.__init__(*state)

    def look(self, slot: np.ndarray, default: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, slot), len(self.keys) - 1)
        return np.where(self.keys[at] == slot, self.values[at], np.float32(default))

    def surprise(self, g: np.ndarray) -> np.ndarray:
        """-log p of the last character of each gram after the others, by language."""
        out = np.empty((len(g), len(self.langs)), np.float32)
        for lang in range(len(self.langs)):
            p = np.full(len(g), BASE, np.float32)
            for k in range(1, ORDER + 1):
                own = g & np.uint64((1 << 16 * k) - 1)
                share, weight = self.look(slots(own, 2 * k, lang), 0), self.look(slots(own >> np.uint64(16), 2 * k + 1, lang), 1)
                p = share + weight * p
            out[:, lang] = -np.log(np.maximum(p, 1e-12))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean cross-entropy, and the characters of each text."""
        if self.seen is None:
            self.seen = np.full(1 << _CACHE_BITS, 1, np.uint64)  # 1 is no gram: its first characters are 0
            self.kept = np.zeros((1 << _CACHE_BITS, len(self.langs)), np.float32)
        g, lens = packed_grams(texts)
        at = (slots(g, 0, 0) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        rows = self.kept[at]
        miss = np.flatnonzero(self.seen[at] != g)
        if len(miss):
            new, inverse = np.unique(g[miss], return_inverse=True)
            own = self.surprise(new)
            rows[miss] = own[inverse]
            to = (slots(new, 0, 0) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            self.seen[to], self.kept[to] = new, own
            clash = self.seen[to] != new  # of several grams of a slot one stays, with its own row
            last = to[~clash]
            self.kept[last] = own[~clash]
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(lens)
        if len(full):
            out[full] = np.add.reduceat(rows.astype(np.float64), np.cumsum(lens[full]) - lens[full], axis=0) / lens[full, None]
        return out, lens


def train_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", entries: int = ENTRIES) -> Models:
    """The models of all non-null values of lang_col (1000 at most, else it raises), from the whole texts of docs."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    batched(docs.sparkSession)
    counts = table_of(_counts(rows), "grams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(1001).collect())
    if len(langs) > 1000:
        raise ValueError("more than 1000 languages")
    index = {x: i for i, x in enumerate(langs)}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([index[x] for x in b.column(0).to_pylist()], np.uint64)
            s = slots(b.column(2).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.uint64), lang)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), b.column(3).cast(pa.float32())], names=["slot", "value"])

    found = _entries(counts, entries).mapInArrow(hashed, "slot long, value float").toArrow()  # at most 2 x entries rows
    keys, values = found.column("slot").to_numpy().view(np.uint64), found.column("value").to_numpy().astype(np.float32)
    order = np.argsort(keys)
    return Models(langs, keys[order], values[order])


# ---------------------------------------------------------------- prediction


def _scored(docs: DataFrame, models: Models, temperature: float, centre: list[float], limit: float) -> DataFrame:
    """docs (_id, _lang, _held, _text) -> prediction, score, rejection and the cross-entropy of each language."""
    model = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ce, n = m.entropies(texts_of(b, "_text"))
            best = ce.argmin(1)
            z = np.exp(-(ce - ce.min(1, keepdims=True)) * np.minimum(n, 200)[:, None] * temperature)
            score = np.where(n > 0, 1 / z.sum(1), 0)
            low = ce[np.arange(len(n)), best]
            away = (low - np.array(centre)[best]) * np.sqrt(n)
            names = [m.langs[i] if k else "und" for i, k in zip(best.tolist(), n.tolist(), strict=True)]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(names), pa.array(score), pa.array(low), pa.array((away > limit) | (n == 0)), pa.array(n), pa.array(ce.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "_lang", "_held", "lang_pred", "score", "cross_entropy", "rejected", "chars", "all_ce"])

    kind = dict(docs.dtypes)["_id"]
    return docs.mapInArrow(run, f"_id {kind}, _lang string, _held boolean, lang_pred string, score double, cross_entropy double, rejected boolean, chars long, all_ce array<double>")


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score (0 to 1), cross_entropy, rejected.

    Learns from rows that are not held_out and have a language. lang_pred is a learned value, the first in order of equal
    ones, `und` for null texts and texts without a letter (score 0, rejected); with nothing to learn from it is `und` for
    all. rejected marks texts that no model explains as well as calibration rows. Very long texts are read whole. A null
    held_out counts as held out. Repeated rows count each; null ids are ids like any other; other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    batched(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.coalesce(held_out, F.lit(True)).alias("_held"), F.col(text_col).alias("_text"))
    known = rows.where("not _held and _lang is not null and _text is not null").withColumn("_key", F.xxhash64("_id", "_text"))
    # languages of few rows are learned from all of them
    counts = [(r[0], r[1]) for r in known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").orderBy(F.desc("n"), "_lang").limit(1000).collect()]
    some = known.where(F.col("_lang").isin([c[0] for c in counts]))
    keys = table_of(some.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(min(calibration_rows, sum(c[1] for c in counts) // 10)), "calibration")
    models = train_models(known.join(F.broadcast(keys), "_key", "left_anti"), "_text", "_lang")  # calibration_rows keys at most
    if not models.langs:
        return rows.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))

    sample = known.join(F.broadcast(keys), "_key", "left_semi").dropDuplicates(["_key"]).select("_id", "_lang", "_held", "_text")
    seen = [r for r in _scored(sample, models, 1.0, [0.0] * len(models.langs), 0.0).where("chars > 0").select("_lang", "chars", "all_ce").collect() if r[0] in models.langs]
    temperature, centre, limit = calibrated(models.langs, seen)
    out = _scored(rows, models, temperature, centre, limit)
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def calibrated(langs: list[str], seen: list) -> tuple[float, list[float], float]:
    """Temperature of least log loss; each language's usual cross-entropy; the largest usual deviation from it."""
    if not seen:
        return 1.0, [0.0] * len(langs), float("inf")
    ce, n = np.array([r[2] for r in seen]), np.array([r[1] for r in seen])
    own = np.array([langs.index(r[0]) for r in seen])
    gap = (ce - ce.min(1, keepdims=True)) * np.minimum(n, 200)[:, None]
    at = np.arange(len(own))

    def loss(t: float) -> float:
        return float(np.mean(gap[at, own] * t + np.log(np.exp(-gap * t).sum(1))))

    temperature = min((0.02, 0.05, 0.1, 0.2, 0.5, 1.0), key=loss)
    centre = [float(np.median(ce[own == i, i])) if (own == i).any() else float(np.median(ce.min(1))) for i in range(len(langs))]
    away = (ce[at, own] - np.array(centre)[own]) * np.sqrt(n)
    return temperature, centre, float(REJECT_FACTOR * max(away.max(), 1e-9))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identify(read(spark, sf_dir, "documents"), held_out)


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
