"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again with other values has the same
template. Windows of template words of benchmark and documents are joined on their hash; a bit filter of fixed size,
built from the benchmark, first drops the document windows that can have no partner. What stood in the placeholders
must then agree along each alignment of a document and an item: one value of the item always becomes one value of the
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import batched, by_chars, free_name, read, texts_of
from rollbook.session import table_of

WINDOW = 8
#: A window of fewer words that are no placeholders is no evidence. An item without a better one must match whole, token
#: by token; one of fewer tokens than this must be all of the document.
MIN_LITERALS = 4
#: Readings: sentence starts are literals; capitals at sentence starts are names; tokens as they are.
PLAIN, NAMED, EXACT = range(3)
FILTER_BITS = 24
#: Texts are looked at together up to so many characters.
GROUP_CHARS = 1_000_000
#: Benchmark windows are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 200_000
TOKEN = re.compile(r"[^\W_]+(?:[.,:'’/-][^\W_]+)*|[.!?:;\n\"“”]")
NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
NUMBER_UNIT = re.compile(r"(\d+(?:[.,]\d+)*)([^\W\d_]+)")
#: A text without this has no number with a unit glued to it.
GLUED = re.compile(r"\d[^\W\d_]")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "ml cl l liter liters litre litres gallon gallons percent degrees degree celsius fahrenheit kelvin "
    "dollar dollars cent cents euro euros usd eur gbp yen mph kph kmh hz khz mhz ghz b kb mb gb tb w kw mw v kv a ma j kj n pa kpa".split()
)
LITERAL, NUM, NAME, UNIT, MARK = range(5)
_CODE = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], np.uint64)
_P = 0x100000001B3


def _kind(tok: str) -> int:
    if len(tok) == 1 and not tok.isalnum():
        return MARK
    if NUMBER.fullmatch(tok):
        return NUM
    if tok[0].isupper() and not (len(tok) > 1 and tok.isupper()):
        return NAME  # unless a sentence starts with it
    return UNIT if tok in UNITS else LITERAL  # a unit only after a number


def _parts(tok: str) -> tuple[str, ...]:
    """A number and the unit that is glued to it, or the token as it is."""
    m = NUMBER_UNIT.fullmatch(tok) if tok[0].isdigit() else None
    return m.groups() if m else (tok,)


class Canonical:
    """Template codes and slot values of texts; each different token is looked at once."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index, self.kinds, self.codes, self.raw = {}, np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def words(self, texts: list[str], within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, value, text) of every template word: value is 0 for a literal, else stands for what was replaced.

        within: the texts are read as if they stood inside a sentence, so that a capital at their start makes a name.
        """
        return self.template(*self.tokens(texts), within=within)[:3]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kind, code, text, starts) of every token that is no mark: starts says that a sentence starts with it."""
        toks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = TOKEN.findall(t)
            if GLUED.search(t):
                own = [y for x in own for y in _parts(x)]
            counts[i] = len(own)
            toks += own
        if len(self.index) > self.most:
            self.clear()
        new = list(set(toks).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            h = xxhash.xxh64_intdigest
            self.kinds = np.concatenate([self.kinds, np.fromiter(map(_kind, new), np.int8, len(new))])
            self.codes = np.concatenate([self.codes, np.fromiter((h(x.casefold()) | 1 for x in new), np.uint64, len(new))])
        at = np.fromiter(map(self.index.__getitem__, toks), np.int64, len(toks))
        text = np.repeat(np.arange(len(texts)), counts)
        kind, code = self.kinds[at], self.codes[at]
        starts = np.ones(len(at), bool)
        if len(at):
            first = np.concatenate([[True], text[1:] != text[:-1]])
            starts[1:] = kind[:-1] == MARK
            starts |= first
        keep = kind != MARK
        return kind[keep], code[keep], text[keep], starts[keep]

    def template(self, kind, code, text, starts, within: bool = False, named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, value, text, new) of the template words of tokens; named: capitals at all sentence starts make names, new there."""
        if not len(kind):
            return code, code, text, starts
        held = starts
        if within:
            held = starts & ~np.concatenate([[True], text[1:] != text[:-1]])
        if not named:
            kind = np.where((kind == NAME) & held, LITERAL, kind)
        after = np.zeros(len(kind), bool)
        after[1:] = (kind[:-1] == NUM) & (text[1:] == text[:-1])
        kind = np.where((kind == UNIT) & ~after, LITERAL, kind)
        # a run of names is one name
        more = np.zeros(len(kind), bool)
        more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (text[1:] == text[:-1]) & ~starts[1:]
        first = np.flatnonzero(~more)
        step = np.arange(len(kind)) - np.repeat(first, np.diff([*first.tolist(), len(kind)]))
        with np.errstate(over="ignore"):
            value = np.add.reduceat(code * (np.uint64(2) * step.astype(np.uint64) + np.uint64(1)), first)
        kind, text = kind[first], text[first]
        literal = kind == LITERAL
        return np.where(literal, code[first], _CODE[kind]), np.where(literal, np.uint64(0), value | np.uint64(1)), text, (kind == NAME) & held[first]


def windows(code: np.ndarray, value: np.ndarray, text: np.ndarray, n: int, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all windows of n words inside a text with enough literals, and with some word that is new if given."""
    m = len(code) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * np.uint64(_P) + code[j : j + m]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    lits = np.concatenate([[0], np.cumsum(value == 0)])
    ok = (text[:m] == text[n - 1 :]) & (lits[n:] - lits[:m] >= min(MIN_LITERALS, n))
    if new is not None:
        news = np.concatenate([[0], np.cumsum(new)])
        ok &= news[n:] > news[:-n]
    at = np.flatnonzero(ok)
    return at, h[at]


_WINDOW = "reading int, pos long, width int, hash long, vals array<long>"


def _batch(ids: pa.Array, reading: int, rows: list[np.ndarray], name: str, per_text: list[pa.Array] = (), names: list[str] = ()) -> pa.RecordBatch:
    text, pos, width, h, vals, off = rows
    cols = [ids.take(pa.array(text)), pa.array(np.full(len(text), reading, np.int32)), pa.array(pos), pa.array(width.astype(np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(vals.view(np.int64)))]
    return pa.RecordBatch.from_arrays([*cols, *(c.take(pa.array(text)) for c in per_text)], names=[name, "reading", "pos", "width", "hash", "vals", *names])


def _rows(code, value, text, widths: list[int], take, new: np.ndarray | None = None, exact: bool = False) -> list[np.ndarray]:
    """The windows that take() lets pass, with their texts, positions in the text and slot values; exact: of tokens as they
    are, which have no slots (value 0) and any number of which is enough."""
    first = np.searchsorted(text, np.arange(text[-1] + 2)) if len(text) else np.zeros(1, np.int64)
    out = []
    for n in widths:
        at, h = windows(code, value, text, n, new)
        if exact:
            h = (h ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(_P)
        ok = take(h, n, at)
        at, h = at[ok], h[ok]
        vals = value[at[:, None] + np.arange(n)] if len(at) else np.zeros((0, n), np.uint64)
        out.append((text[at] if len(at) else at, at - first[text[at]] if len(at) else at, np.full(len(at), n), h, vals.ravel(), np.full(len(at), n)))
    cat = [np.concatenate(x) for x in zip(*out, strict=True)]
    return [*cat[:5], np.concatenate([[0], np.cumsum(cat[5])])]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, reading, pos, width, hash, vals, item_windows): items shorter than a window have one, of all their words. Each
    item is read as a text of its own, as part of a sentence, and with names at sentence starts.

    Items without a window of MIN_LITERALS literals have windows of all their tokens as they are; null and empty ones none.
    """
    batched(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        can = Canonical()
        for b in batches:
            tokens = can.tokens(texts_of(b, "_text"))
            found = np.zeros(b.num_rows, np.int64)
            for reading, within in ((PLAIN, False), (PLAIN, True), (NAMED, False), (EXACT, False)):
                if reading == EXACT:
                    code, value, text, new = tokens[1], np.zeros(len(tokens[1]), np.uint64), tokens[2], None
                else:
                    code, value, text, new = can.template(*tokens, within=within, named=reading == NAMED)
                size = np.bincount(text, minlength=b.num_rows)
                least = 1 if reading == EXACT else MIN_LITERALS
                widths = sorted({min(window, int(n)) for n in size[found == 0] if n >= least} if reading == EXACT else {min(window, int(n)) for n in size if n >= least})
                if not widths:
                    continue
                whole = found == 0 if reading == EXACT else np.ones(b.num_rows, bool)
                take = lambda h, n, at: whole[text[at]] & ((size[text[at]] == n) | ((n == window) & (size[text[at]] >= n)))  # noqa: B023, E731
                got = _rows(code, value, text, widths, take, new if reading == NAMED else None, reading == EXACT)
                own = np.bincount(got[0].astype(np.int64), minlength=b.num_rows)
                found += own
                yield _batch(b.column(0), reading, got, "item", [pa.array(own)], ["item_windows"])

    return rows.mapInArrow(run, f"item {dict(rows.dtypes)['item']}, {_WINDOW}, item_windows long")


def _filter(bench: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set where a benchmark window's hash falls."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = bench.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {(1 << FILTER_BITS) - 1}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    found = words.toArrow()  # at most 2^(FILTER_BITS - 6) rows
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per contaminated document and item: id_col, item_id, matched_windows, item_windows, reparameterised.

    A pair counts if some alignment of the two shares a window and its slots are consistent, or shares a window without
    slots; for an item without a window of MIN_LITERALS literals, if it stands in the document whole. reparameterised says
    that a slot holds another value than the item's. Null and empty texts match nothing; very long texts are read whole;
    rows of one id are judged together, null being an id like any other; a repeated item counts once; other columns are
    ignored, whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    batched(spark)
    bench = table_of(benchmark_windows(benchmark, item_col, item_text_col, window).dropDuplicates(["item", "reading", "pos", "width", "hash"]), "benchmark-windows")
    widths: dict[int, list[int]] = {}
    for r in sorted(bench.select("reading", "width").distinct().collect()):  # at most 3 x `window` values
        widths.setdefault(r[0], []).append(r[1])
    bits = spark.sparkContext.broadcast(_filter(bench))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        can, mask = Canonical(), np.uint64((1 << FILTER_BITS) - 1)

        def passes(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
            s = h & mask
            return (bits.value[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)

        for b in batches if widths else ():
            for first, own in by_chars(texts_of(b, "_text"), GROUP_CHARS):
                tokens = can.tokens(own)
                for reading, some in widths.items():
                    if reading == EXACT:
                        size = np.bincount(tokens[2], minlength=len(own))
                        alone = lambda h, n, at: passes(h, n, at) & ((n >= MIN_LITERALS) | (size[tokens[2][at]] == n))  # noqa: B023, E731
                        got = _rows(tokens[1], np.zeros(len(tokens[1]), np.uint64), tokens[2], some, alone, exact=True)
                    else:
                        code, value, text, new = can.template(*tokens, named=reading == NAMED)
                        got = _rows(code, value, text, some, passes, new if reading == NAMED else None)
                    if len(got[0]):
                        yield _batch(b.column(0).slice(first, len(own)), reading, got, "_id")

    near = rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, {_WINDOW}")
    item = bench.select("item", "reading", F.col("pos").alias("item_pos"), "width", "hash", F.col("vals").alias("item_vals"), "item_windows")
    if bench.count() <= broadcast_rows:
        item = F.broadcast(item)
    hits = table_of(near.join(item, ["hash", "width", "reading"]).drop("hash"), "window-hits")
    run_key = ["_id", "item", "reading", "shift"]
    hits = hits.withColumn("shift", F.expr("pos - item_pos"))
    slots = hits.where("exists(vals, v -> v <> 0)").select(*run_key, F.explode(F.arrays_zip("vals", "item_vals")).alias("s"))
    slots = slots.where("s.item_vals <> 0").groupBy(*run_key, F.col("s.item_vals").alias("bench")).agg(F.min("s.vals").alias("lo"), F.max("s.vals").alias("hi"))
    slots = slots.groupBy(*run_key).agg(F.bool_and(F.expr("lo = hi")).alias("consistent"), F.bool_or(F.expr("lo <> bench")).alias("other"))
    runs = hits.groupBy(*run_key).agg(F.countDistinct("item_pos").alias("n"), F.max("item_windows").alias("item_windows"), F.count_if(F.expr("not exists(vals, v -> v <> 0)")).alias("plain"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in run_key]
    runs = runs.alias("r").join(slots.alias("s"), on, "left").select("r.*", "s.consistent", "s.other").where("plain > 0 or coalesce(consistent, true)")
    runs = runs.where(f"reading <> {EXACT} or n = item_windows")
    other = F.expr("coalesce(other, false)")  # windows with names at sentence starts see only some slots: they speak if no others do
    return runs.groupBy(F.col("_id").alias(id_col), F.col("item").alias("item_id")).agg(
        F.max("n").alias("matched_windows"), F.max("item_windows").alias("item_windows"), F.coalesce(F.bool_and(F.when(F.col("reading") != NAMED, other)), F.bool_and(other)).alias("reparameterised")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, with their own columns, whatever their names.

    Rows of one id, a null one as well, go together if any has a passage. Null and empty texts have none and stay; very long
    texts are searched whole; repeated rows stay repeated; an empty table gives an empty one.
    """
    name = free_name("_hit", docs.columns)
    hit = decontaminate(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit.hint("merge"), docs["doc_id"].eqNullSafe(hit[name]), "left_anti")


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
