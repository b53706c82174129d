"""Results kept up to date as entries arrive, with a state for each student.

Students go in BUCKETS, of which each has a state: the entries that count for its students, by source. A batch reads the
states of its own buckets and no history, and writes those of its own sources. What it hands on are all entries of its own
students, and the batch rules of `results` run over them once: there is no second form of any rule, and nothing is kept
between two uses. A row with `removed` takes back what its source said of the student in earlier batches.
A batch that is run again starts from the same states and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollbook.operators import results as R
from rollbook.session import CLEANUP

#: Students are dealt to so many states, for the life of a stream: reading a state costs more than many entries do.
BUCKETS = 1 << 12
#: States lie in the store that `transformWithState` asks for; they are texts, which are packed well, in blocks of so many KB.
#: What a batch has shuffled goes when it is done.
CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd", "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "64",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", CLEANUP: "true",
}


class Entries(StatefulProcessor):
    """Adds and takes back entries of a bucket's students, and hands on what those of the batch have now; a row without
    entry for one who has nothing. Kept are lines of student and entry, both of them JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("entries", "source string", "entries string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        here, gone, added = set(), {}, {}
        for pdf in rows:
            for student, source, entry in zip(pdf["student"].tolist(), pdf["source"].tolist(), pdf["entry"].tolist(), strict=True):
                here.add(student)
                if entry is None:
                    gone.setdefault(source, set()).add(student)
                else:
                    added.setdefault(source, []).append(f"{student}\t{entry}")
        held = {k[0]: v[0].split("\n") for k, v in self.held.iterator()} if self.held.exists() else {}
        for source in gone.keys() & held.keys():
            held[source] = [x for x in held[source] if x.partition("\t")[0] not in gone[source]]
        for source, new in added.items():
            held[source] = held.get(source, []) + new
        for source in added.keys() | (gone.keys() & held.keys()):
            if held[source]:
                self.held.updateValue((source,), ("\n".join(held[source]),))
            else:
                self.held.removeKey((source,))
        out = [(student, entry) for of in held.values() for student, _, entry in (x.partition("\t") for x in of) if student in here]
        out += [(student, None) for student in here - {student for student, _ in out}]
        yield pd.DataFrame(out, columns=["student", "entry"])

    def close(self) -> None:
        pass


def _fields(entries: DataFrame) -> dict[str, str]:
    """Short names for what an entry holds besides its student."""
    return {c: f"c{i}" for i, c in enumerate(c for c in entries.columns if c not in ("student", "removed"))}


def with_states(entries: DataFrame) -> DataFrame:
    """(student, entry): of each batch all entries that its students have after it, as JSON; null if there are none.

    entries: a stream with student, source and what else the rules need; `removed`, if there is such a column, marks rows
    that take back their source.
    """
    removed = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in entries.columns else F.lit(False)
    entry = F.when(~removed, F.to_json(F.struct(*[F.col(c).alias(short) for c, short in _fields(entries).items()])))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # also of no source
    bucket = F.pmod(F.xxhash64("student"), F.lit(BUCKETS)).cast("int")
    rows = entries.select(bucket.alias("bucket"), F.to_json(F.struct(F.col("student").alias("s"))).alias("student"), source.alias("source"), entry.alias("entry"))
    now = rows.groupBy("bucket").transformWithStateInPandas(Entries(), "student string, entry string", "Update", "none")
    return now.select(F.from_json("student", f"s {dict(entries.dtypes)['student']}")["s"].alias("student"), "entry")


def consolidate_batch(batch: DataFrame, batch_id: int, folder: str, order_cols: Sequence[str], schema: str, names: dict[str, str]) -> None:
    """Writes the season results of a batch's students as those of this batch; a row `gone` of a student who has none left."""
    held = batch.select("student", F.from_json("entry", schema).alias("e"), F.col("entry").isNull().alias("gone"))
    held = held.select("student", "gone", *[F.col(f"e.{short}").alias(c) for c, short in names.items()])
    R.season_results(held, order_cols).write.mode("overwrite").parquet(f"{folder}/results/batch={batch_id}")


def start(entries: DataFrame, folder: str, order_cols: Sequence[str], trigger: dict | None = None):
    """A streaming query over entries; checkpoints, with the states, lie in folder, which all machines share."""
    for k, v in CONF.items():
        entries.sparkSession.conf.set(k, v)
    names, kinds = _fields(entries), {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    schema = ", ".join(f"{short} {kinds[c]}" for c, short in names.items())
    write = with_states(entries).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    return write.foreachBatch(lambda b, i: consolidate_batch(b, i, folder, order_cols, schema, names)).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The season results as of the last batch: of each student, those of the last batch that touched them."""
    rows = spark.read.parquet(f"{folder}/results")
    last = rows.groupBy("student").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["student", "batch"], "left_semi").where(~F.col("gone")).drop("batch", "gone")
