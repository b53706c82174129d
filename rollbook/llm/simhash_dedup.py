"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into five segments. Of at most three differing bits two segments hold none, and for some
such two a chosen third holds at most one: PLAN names the third of each two, and a test goes through all ways in which
three errors can fall. The perfect Golay code of length 23 has one codeword within distance 3 of any word, and for words
one bit apart the nearest codeword of the first lies within distance 4 of the second. So a fingerprint probes, for each
of the ten choices, with two segments as they are and the index of the third's nearest codeword, and is filed under the
indices of all codewords within distance 4 of the third (at most 6). Fingerprints within three bits of each other
therefore always meet, in a bucket of a key of 38 bits; the join verifies the distance. Equal fingerprints are one class
beforehand, so that copies are never expanded into pairs.

Near copies by words (`near_duplicates`) differ in more bits than three of a fingerprint of word sequences. There the
same keys are made of three fingerprints of the set of words, which an edit changes less, and what meets is verified on
the full sets of five-word shingles.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import LOWER, batched, free_name, read, shuffle_parts, texts_of
from rollbook.operators.components import connected_components
from rollbook.session import table_of

MAX_DISTANCE = 3
#: Low bit and width of the segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Two segments that a key holds as they are, and the one that it holds by codeword.
PLAN = tuple((a, b, min({0, 1, 2, 3, 4} - {a, b}, key=lambda j: (j - a - b) % 5)) for a, b in itertools.combinations(range(5), 2))
#: Fingerprints that more than 1/HOT of the rows have are broadcast to their rows: there are fewer than HOT.
HOT = 512
#: Nodes whose keys a task makes together.
KEYED_NODES = 8192
#: Bits of the filter, of fixed size, that texts of no pair are left out by before they are shuffled.
FILTER_BITS = 26
#: Near copies: words of a shingle, least share of common shingles, and the mean of differing bits beyond which no pair is
#: looked at (unrelated texts differ in 32).
WORDS_OF_SHINGLE, SIMILARITY, LOOSE = 5, 0.8, 12
#: Components that probe with one key, from which on they are a crowd.
CROWD = 8
#: Generator polynomial of the (23, 12) binary Golay code.
GENERATOR = 0b101011100011
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle (repeats included) of the words; of the whole sequence if there are fewer words."""
    words = WORDS.findall(text.translate(LOWER) if not text.islower() else text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    d = xxhash.xxh64_digest
    if len(words) <= shingle:
        return np.frombuffer(d(joined, seed), ">u8").astype(np.uint64)
    return np.frombuffer(b"".join([d(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]), ">u8").astype(np.uint64)


def majority_bits(hashes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """One fingerprint per run of hashes: a bit is set if set in over half of them; zero for an empty run."""
    out = np.zeros(len(lens), np.uint64)
    full = np.flatnonzero(lens)
    if not len(full):
        return out
    n = lens[full]
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    first = np.cumsum(n) - n
    blocks = -(-n // 255)  # a byte counts up to 255
    own = np.repeat(np.arange(len(n)), blocks)
    step = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sums = np.add.reduceat(bits, first[own] + step * 255, axis=0).view(np.uint8)
    sums = np.add.reduceat(sums.astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    out[full] = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(_id, _fp, _words): the SimHash of each row as a signed 64-bit number."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(t, shingle, seed) for t in texts_of(b, "_text")]
            fp = majority_bits(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array([len(h) for h in hashes], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["_id", "_fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, _fp long")


# ---------------------------------------------------------------- Golay keys


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """parity[m] of the 4096 messages; and for each of the 2048 syndromes the error patterns of weight up to 4.

    A row of patterns has the only one of weight up to 3 first; -1 fills up.
    """
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= GENERATOR << (i - 11)
        parity[m] = r
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(parity[e >> 11]) ^ (e & 2047)
            patterns[s, used[s]] = e
            used[s] += 1
    return parity, patterns


def segment_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within distance 4 of each 23-bit word, the nearest first, -1 for none."""
    parity, patterns = golay_tables()
    e = patterns[parity[words >> 11] ^ (words & 2047)]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def plan_keys(fp: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys that fingerprints probe with, or are filed under."""
    fp = fp.view(np.uint64)
    parts = [((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    coded = [segment_keys(x)[:, :1] if probes else segment_keys(x) for x in parts]
    rows, keys = [], []
    for p, (a, b, j) in enumerate(PLAN):
        own = ((((p << 13) | parts[a]) << 13 | parts[b]) << 12)[:, None] | coded[j]
        ok = coded[j] >= 0
        rows.append(np.nonzero(ok)[0])
        keys.append(own[ok])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, probes: bool) -> DataFrame:
    """nodes (node, its fingerprints, any number, in _fps) as (key, node), and with component if they have one: equal keys of
    different fingerprints differ. Of a component a task files one node under a key for each run of its nodes.

    A component goes as its difference from the node, mostly 0, which takes no room in a shuffle. A node has many keys:
    nodes are dealt to all partitions first.
    """
    whole = "component" in nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def keyed() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            fps = part.column("_fps").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
            node = part.column("node").to_numpy()
            comp = part.column("component").to_numpy() if whole else node
            _, group, n = np.unique(comp, return_inverse=True, return_counts=True)
            several = n[group] > 1
            for m in range(fps.shape[1]):
                rows, keys = plan_keys(np.ascontiguousarray(fps[:, m]), probes)
                keys = keys | m << 56
                if several.any():
                    often = several[rows]
                    order = np.lexsort((node[rows[often]], comp[rows[often]], keys[often]))
                    r, k = rows[often][order], keys[often][order]
                    first = np.concatenate([[True], (k[1:] != k[:-1]) | (comp[r[1:]] != comp[r[:-1]])])[: len(k)]
                    rows, keys = np.concatenate([rows[~often], r[first]]), np.concatenate([keys[~often], k[first]])
                cols = [pa.array(keys), pa.array(node[rows])] + [pa.array(comp[rows] ^ node[rows])] * whole
                yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "component"][: len(cols)])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= KEYED_NODES:
                yield from keyed()
                size = 0
        if size:
            yield from keyed()

    columns = ["node", "component"][: 1 + whole]
    dealt = nodes.select(*columns, "_fps").repartition(shuffle_parts(nodes.sparkSession), "node")
    return dealt.mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in columns))


def linked_fingerprints(classes: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints (column _fp, distinct) within MAX_DISTANCE bits."""
    nodes = classes.select(F.col("_fp").alias("node"), F.array("_fp").alias("_fps"))
    near, filed = _keyed(nodes, True).select("key", F.col("node").alias("x")), _keyed(nodes, False)
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("node")))
    # a fingerprint is filed many times over, which estimates of size do not know: never broadcast
    pairs = near.join(filed.hint("merge"), (near.key == filed.key) & (F.col("x") != F.col("node")) & (apart <= MAX_DISTANCE))
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


# ---------------------------------------------------------------- the operator


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id, class_size, links.

    Fingerprints link at MAX_DISTANCE or fewer differing bits; component_id is the smallest id reachable over links,
    the row's own included. class_size counts the rows of the same fingerprint, links the other fingerprints linked to
    it. Null and empty texts and texts of white space have fingerprint zero, which links like any other; a very long text
    is read whole; repeated rows and ties share a class; null ids are reachable but never a component_id unless there is
    no other. Other columns of docs are ignored, whatever their names. An empty table gives an empty one.
    """
    fps = table_of(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = table_of(fps.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("class_size")), "classes")
    links = table_of(linked_fingerprints(classes), "links")
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    comp = connected_components(links)
    # only fingerprints with links are renamed; all others are their own component
    of = classes.join(comp.withColumnRenamed("node", "_fp"), "_fp").join(degree.withColumnRenamed("a", "_fp"), "_fp")
    first = of.groupBy("component").agg(F.min("_first").alias("_least"))
    of = of.join(first, "component").select("_fp", "_least", "links")
    known = classes.join(of, "_fp", "left").select("_fp", F.coalesce("_least", "_first").alias("component_id"), "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    known = table_of(known, "known")
    # a fingerprint with a large share of the rows is settled where its rows lie: fewer than HOT can have over 1/HOT of them
    hot = F.broadcast(known.where(F.col("class_size") * HOT > fps.count()).limit(HOT))
    settled = fps.join(hot, "_fp")
    rest = fps.join(hot.select("_fp"), "_fp", "left_anti").join(known.hint("merge"), "_fp")
    return settled.unionByName(rest).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size", "links"
    )


# ---------------------------------------------------------------- near copies by words


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS_OF_SHINGLE, 42))


def word_fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, 3): three SimHashes of the set of words of each text; of the set of shingles where four are the most."""
    d = xxhash.xxh3_128_digest
    raw, lens, few = [], np.zeros(len(texts), np.int64), {}
    for i, t in enumerate(texts):
        words = WORDS.findall(t.translate(LOWER) if not t.islower() else t)
        if len(words) < 2 * WORDS_OF_SHINGLE - 1:  # sets of up to four shingles are equal or below the bound
            few[i] = _three(np.frombuffer(d(shingle_set(t).tobytes()), np.uint64)[None])[0]
        else:
            own = set(words)
            lens[i] = len(own)
            raw += own
    hashes = _three(np.frombuffer(b"".join(map(d, (w.encode() for w in raw))), np.uint64).reshape(-1, 2))
    out = np.stack([majority_bits(np.ascontiguousarray(hashes[:, m]), lens) for m in range(3)], 1)
    for i, x in few.items():
        out[i] = x
    return out


def _three(halves: np.ndarray) -> np.ndarray:
    """The two halves of 128-bit hashes, and a third number mixed from both."""
    with np.errstate(over="ignore"):
        x = (halves[:, 0] ^ (halves[:, 1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + halves[:, 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.column_stack([halves, x ^ (x >> np.uint64(29))])


def _word_nodes(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, _fps) of the different texts; a node is the 64-bit hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = word_fingerprints(texts_of(b, "_text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, fps.shape[1], dtype=np.int32)), pa.array(fps.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["node", "_fps"])

    rows = docs.select(_node_of(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "node long, _fps array<long>").dropDuplicates(["node"])


def _node_of(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _asked(nodes: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set at the lowest bits of the nodes."""
    slot = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = nodes.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63 as int))")).alias("bits")).toArrow()  # at most 2^(FILTER_BITS - 6) rows
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _shingle_sets(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the given nodes (node, repeated or not); only their texts are cut into shingles.

    Shingles travel as 32 bits of their hashes: two of one text that fall together count once.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_asked(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(0).to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            asked = (bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            b = b.filter(pa.array(asked))
            sets = [np.unique(shingle_set(t).astype(np.uint32)) for t in texts_of(b, "_text")]
            flat = pa.array(np.concatenate(sets).view(np.int32) if sets else np.zeros(0, np.int32))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "shingles"])

    rows = docs.select(_node_of(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return table_of(rows.mapInArrow(run, "node long, shingles array<int>").dropDuplicates(["node"]), "shingles")


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) whose texts share SIMILARITY of their shingles; only the texts of pairs are read again."""
    sets = _shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, text_col)
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")).hint("merge") for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.expr(f"common >= {SIMILARITY} * (size(sa) + size(sb) - common)")).select("a", "b")


def _crowded(of: DataFrame) -> DataFrame:
    """(node): texts in crowds: what CROWD components or more probe for with one key."""
    keyed = table_of(_keyed(of, True).select("key", "node"), "crowds")
    full = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD).select("key")
    return table_of(keyed.join(full.hint("merge"), "key", "left_semi").select("node").distinct(), "crowd")


def _pairs_of_crowd(of: DataFrame, crowd: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(a, b) with a < b: candidates among the texts of crowds, of different components: all that can share SIMILARITY = t.

    Texts of a crowd are close, and mostly not near enough. They are told apart by their rarest shingles. In any order that
    all sets follow, two that are near enough have their first common shingle among the first (1 - t) of either, and
    among the first (1 - t) / (1 + t) of one of them: what comes before it they do not share. In order of how many texts of
    the crowds have a shingle, what an edit made comes first, and few have that.
    """
    t = SIMILARITY
    sets = _shingle_sets(crowd, docs, text_col).join(crowd.hint("merge"), "node", "left_semi")
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    order = each.join(often.hint("merge"), "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("w"))
    order = order.select("node", F.size("w").alias("size"), F.slice("w", F.lit(1), F.ceil(F.size("w") * (1 - t) + 1 + 1e-6).cast("int")).alias("w"))
    rare = order.select("node", "size", F.posexplode("w").alias("place", "s")).where("s.n > 1").select("node", "size", "place", F.col("s.shingle").alias("shingle"))
    # of each component the text that has a shingle first stands for all
    first = F.min(F.struct("place", "size", "node")).alias("w")
    keyed = rare.join(of.select("node", "component").hint("merge"), "node").groupBy("shingle", "component").agg(first)
    keyed = table_of(keyed.select("shingle", "component", "w.*"), "rare-shingles")
    one, two = (keyed.select("shingle", *[F.col(c).alias(f"{c}_{v}") for c in ("component", "node", "size", "place")]) for v in "xy")
    one = one.where(F.col("place_x") * (1 + t) <= F.col("size_x") * (1 - t) + 1e-6)
    left = F.least(F.expr("size_x - place_x"), F.expr("size_y - place_y"))
    may = (F.col("component_x") != F.col("component_y")) & (left * (1 + t) + 1e-6 >= (F.col("size_x") + F.col("size_y")) * t)
    pairs = one.join(two.hint("merge"), (one["shingle"] == two["shingle"]) & may)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, component): the texts, by 64-bit hash, that have near copies, and the least node of their component.

    Near copies share SIMILARITY or more of their different five-word shingles (lower-cased A-Z; the whole sequence of
    fewer words; two texts without words are near copies). Candidates are texts that meet under a Golay key of one of three
    fingerprints of their words. First each text is compared, for each of the 30 keys it probes with, with the least of
    those that probe with the same, so that large groups come together by comparisons in proportion to their members, even
    where only some of their pairs are near enough. Then of each bucket one
    text of each component is compared with those of all others in it; texts of crowded buckets are told apart by their
    rarest shingles before (`_pairs_of_crowd`), which loses no pair. Null counts as empty; very long texts are read
    whole; equal texts are one node; ties go to the least node; an empty table gives an empty one.
    """
    batched(docs.sparkSession)
    nodes = table_of(_word_nodes(docs, text_col), "word-nodes")
    prints = nodes.select(F.col("node").alias("x"), F.col("_fps").alias("fx"))

    def close(pairs: DataFrame) -> DataFrame:
        """Different pairs (a < b) whose fingerprints are not too far apart."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        both = pairs.join(prints.select(F.col("x").alias("a"), F.col("fx").alias("fa")).hint("merge"), "a").join(prints.select(F.col("x").alias("b"), F.col("fx").alias("fb")).hint("merge"), "b")
        return both.where(F.expr(f"aggregate(zip_with(fa, fb, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= {LOOSE} * size(fa)")).select("a", "b")

    probes = _keyed(nodes, True)
    least = probes.groupBy("key").agg(F.min("node").alias("y"), F.max("node").alias("z")).where("y <> z").drop("z")
    met = probes.select("key", F.col("node").alias("x")).join(least.hint("merge"), "key")
    first = table_of(_verified(table_of(close(met), "first-pairs"), docs, text_col), "first-links")
    of = nodes.join(connected_components(first), "node", "left").select("node", "_fps", F.coalesce("component", "node").alias("component"))
    of = table_of(of, "first-components")
    crowd = _crowded(of)
    # any pair meets under the keys that either probes with: of pairs out of and in a crowd one that is filed is enough
    filed = of.join(crowd.hint("merge"), "node", "left_anti")

    def bucketed(probes: bool, node: str, component: str) -> DataFrame:
        # dealt by key once, for the grouping and for the join; tasks have brought each component's nodes down to few
        keyed = _keyed(of if probes else filed, probes).repartition("key").withColumn("component", F.col("component").bitwiseXOR(F.col("node")))
        keyed = keyed.groupBy("key", "component").agg(F.min("node").alias("node"))
        return keyed.select("key", F.col("component").alias(component), F.col("node").alias(node))

    met = bucketed(True, "x", "cx").join(bucketed(False, "y", "cy").hint("merge"), "key").where("cx <> cy").select("x", "y")
    others = table_of(close(met).unionByName(_pairs_of_crowd(of, crowd, docs, text_col)).distinct(), "other-pairs")
    return connected_components(first.unionByName(_verified(others, docs, text_col)))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (`near_duplicates`), with its own columns: that of the least id, of equal ids the
    one of the least text hash; repeated rows are one. A null id is larger than any other."""
    of = near_duplicates(docs)
    node = _node_of("text")
    members = docs.select(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), node.alias("h")).alias("_at"), node.alias("node"))
    # texts without near copies are their own group; the sum is partial before the shuffle
    grouped = members.join(of.hint("merge"), "node", "left").groupBy(F.coalesce("component", "node").alias("_group")).agg(F.min("_at").alias("_at"))
    stay = grouped.select(F.col("_at.i").alias("_kid"), F.col("_at.h").alias("_kh"))
    name = free_name("_h", docs.columns)
    rows = docs.withColumn(name, node)
    rows = rows.join(stay.hint("merge"), rows["doc_id"].eqNullSafe(stay["_kid"]) & (rows[name] == stay["_kh"]), "left_semi")
    return rows.dropDuplicates(["doc_id", name]).select(*docs.columns)


QUERIES = {"op9_simhash_dedup": op9_simhash_dedup}
ORACLES: dict[str, str] = {}
