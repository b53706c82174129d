"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, a group of equal texts at a time.

A group goes to the shard where the dot product of its demand with the residual capacity is highest. Groups beyond
1/(64 x shards) of any total are few (at most 3 x 64 x shards); they are placed first, as rows of (group, demand),
those beyond half a shard in even pieces and those beyond a shard over all shards, so that a group with a third of all
rows still spreads. The other groups are
placed in every partition on its own, against its share of the capacity that the large ones leave; each partition ends
within a small text of even, and so does the sum. No text is shuffled, and only large groups' demands reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import batched, read, shuffle_parts
from rollbook.session import table_of

SHARDS = 24
#: A group is large beyond 1/(LARGE x shards) of the bytes, tokens or rows; it is split beyond 1/(SPLIT x shards).
LARGE, SPLIT = 64, 2
#: Rows of sizes (no texts) that one task packs, about.
PART_ROWS = 500_000
DIMS = ("size", "tokens", "rows")
#: Bytes are the law of the result, and weigh more than what is balanced beside them.
WEIGHT = np.array([2.0, 1.0, 1.0])


def pack(demands: np.ndarray, residual: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The shard of each demand (n, dims), largest first; residual (shards, dims) is reduced in place.

    Demands and residuals are taken as shares of total, so that no dimension outweighs another by its unit.
    """
    scale = WEIGHT / np.maximum(total, 1e-9)
    d, left = demands * scale, residual * scale
    out = np.zeros(len(d), np.int64)
    for i in np.lexsort((np.arange(len(d)), -d.sum(1))):
        s = int(np.argmax(left @ d[i]))
        out[i] = s
        left[s] -= d[i]
    residual[:] = left / scale
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law (always `bytes`), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 8, a null text has none and counts as equal to the empty one; tokens are words
    between white space. Slots run from 0 without a gap in each shard, repeated rows each have their own. Rows of equal
    texts share a shard unless they need more than half a shard. A null id is an id like any other, a very long text takes
    up its shard's share; ties between shards go to the first, which turns from partition to partition. Other columns
    are ignored, whatever their names; no rows give no rows.
    """
    spark = docs.sparkSession
    batched(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.size(F.split(F.trim(text), r"\s+")).cast("long").alias("tokens"),
        F.unhex(F.md5(text.cast("binary"))).alias("grp"),
    )
    rows = table_of(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS[:2]] + [F.count(F.lit(1)).alias("rows")]
    total = np.array([float(v) for v in rows.agg(*sums).first()])
    n = max(shuffle_parts(spark), int(-(-total[2] // PART_ROWS)))
    groups = rows.groupBy("grp").agg(*sums)
    is_large = " or ".join(f"{c} > {t / (LARGE * shards)}" for c, t in zip(DIMS, total, strict=True))
    # at most 3 x LARGE x shards groups can each hold over 1/(LARGE x shards) of a total
    large = sorted((bytes(r[0]), *r[1:]) for r in groups.where(is_large).collect()) if total[2] else []

    residual = np.tile(total / shards, (shards, 1))
    demand = np.array([r[1:] for r in large], float).reshape(-1, 3)
    need = np.maximum(1, np.ceil((demand / np.maximum(total, 1) * SPLIT * shards).max(1, initial=0))).astype(int) if len(large) else np.zeros(0, int)
    # what fills more than a shard goes to all of them alike
    pieces = np.where(need > SPLIT, -(-need // shards) * shards, need)
    owner = np.repeat(np.arange(len(large)), pieces)
    placed = pack((demand / pieces[:, None])[owner], residual, total / shards) if len(large) else owner
    first = np.cumsum(pieces) - pieces
    known = {g[0]: (int(first[i]), int(pieces[i])) for i, g in enumerate(large)}
    share = np.maximum(residual, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(batches)
        if not b.num_rows:
            return
        b = b.sort_by([("grp", "ascending"), ("_row", "ascending")])
        grp = b.column("grp").combine_chunks()
        size, tokens, row = (b.column(c).to_numpy() for c in ("size", "tokens", "_row"))
        codes = grp.dictionary_encode()
        code, values = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        out = np.full(len(code), -1, np.int64)
        big = np.array([known.get(v, (-1, 0)) for v in values], np.int64).reshape(-1, 2)[code]
        at = np.flatnonzero(big[:, 0] >= 0)
        if len(at):
            out[at] = placed[big[at, 0] + row_mix(row[at]) % big[at, 1]]
        small = np.flatnonzero(out < 0)
        if len(small):
            own, inv = np.unique(code[small], return_inverse=True)
            d = np.stack([np.bincount(inv, w, len(own)) for w in (size[small], tokens[small], np.ones(len(small)))], 1)
            t = d.sum(0)
            left = share / np.maximum(share.sum(0), 1e-9) * t
            turn = TaskContext.get().partitionId() % len(left) if TaskContext.get() else 0
            left = np.roll(left, -turn, 0)  # ties go to another shard in each partition
            out[small] = ((pack(d, left, t / len(left)) + turn) % len(left))[inv]
        order = np.argsort(out, kind="stable")
        counts = np.bincount(out, minlength=len(share))
        slot = np.empty(len(out), np.int64)
        slot[order] = np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        cols = {"_id": b.column("_id"), "size": b.column("size"), "crc": b.column("crc"), "shard": pa.array(out, pa.int32()), "part": pa.array(np.full(len(out), part), pa.int32()), "local": pa.array(slot)}
        yield from pa.table(cols).to_batches(max_chunksize=8192)

    # rows of large groups go anywhere, others to where their group is
    big_keys = spark.createDataFrame([(bytearray(k),) for k in known], "grp binary").withColumn("_big", F.lit(True))
    spread = rows.join(F.broadcast(big_keys), "grp", "left")
    spread = spread.withColumn("_to", F.when(F.col("_big"), F.xxhash64("_row")).otherwise(F.xxhash64("grp"))).repartition(n, "_to")
    kind = dict(rows.dtypes)["_id"]
    done = spread.select("_id", "size", "crc", "tokens", "grp", "_row").mapInArrow(run, f"_id {kind}, size long, crc long, shard int, part int, local long")
    done = table_of(done, "shards")
    # a row for each partition and shard: prefix sums of its counts are the bases of its slots
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = done.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return done.join(base.drop("n"), ["shard", "part"]).select(
        F.col("_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def row_mix(row: np.ndarray) -> np.ndarray:
    """Spreads row numbers, which count up within each partition."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) ^ x).astype(np.int64) & 0x7FFFFFFF


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
