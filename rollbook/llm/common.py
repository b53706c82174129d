"""What the operators of this subpackage share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: a batch of the longest texts still fits in a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batched(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session, for good: plans are run after the operators return. A larger setting is
    lowered, a smaller one stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def free_name(name: str, columns: list[str]) -> str:
    """name, or the first of name1, name2, ... that no column has."""
    held = {c.lower() for c in columns}
    return next(x for x in [name, *(f"{name}{i}" for i in range(1, len(held) + 2))] if x.lower() not in held)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z, nothing else changes."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


LOWER = {ord(a): ord(b) for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)}


def csr_take(flat: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[off[c]:off[c + 1]] of all codes, one after the other, and the length of each."""
    start = off[codes]
    lens = off[codes + 1] - start
    if not len(codes):
        return flat[:0], lens
    ends = np.cumsum(lens)
    at = np.repeat(start - ends + lens, lens)
    at += np.arange(ends[-1], dtype=at.dtype)
    return flat[at], lens


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def by_chars(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of up to `most` characters; a longer text is a run of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > most:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, texts[first:]
