"""Results of single sheets, kept in a folder: only sheets whose key has changed are worked on again.

A key says what a sheet's results depend on beside its file, which never changes. Each refresh writes one part: the rows of
the sheets that were missing, then a list of them, without which a part does not count. So a driver that dies leaves
nothing half done, and of two that work on the same sheet at once either part may be read: the lesser one is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.session import drop_folder, scratch, table_of

DONE = "source_id string, key string"


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made = 0  # sheets worked on by this object

    def _parts(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _done(self) -> DataFrame:
        """(source_id, key, part): the part that counts for each sheet and key."""
        if not self._parts("done"):
            return self.spark.createDataFrame([], f"{DONE}, part string")
        return self.spark.read.schema(f"{DONE}, part string").parquet(f"{self.folder}/done").groupBy("source_id", "key").agg(F.min("part").alias("part"))

    def refresh(self, wanted: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The rows of all wanted sheets (source_id, key), by name of result, after make(missing ones) has made what lacks.

        make gives a table with source_id for each name, the same names each time; a sheet may have no rows in it.
        """
        wanted = table_of(wanted, "wanted")
        missing = table_of(wanted.join(self._done(), ["source_id", "key"], "left_anti"), "missing")
        n = missing.count()
        if n or not self._parts("done"):
            part = f"p{uuid.uuid4().hex}"  # a letter first: it stays a string
            with scratch():
                for name, rows in make(missing).items():
                    rows.join(missing, "source_id").write.parquet(f"{self.folder}/{name}/part={part}")
            missing.select("source_id", "key").write.parquet(f"{self.folder}/done/part={part}")
            self.made += n
        counts = wanted.join(self._done(), ["source_id", "key"])
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        return {x: self._read(x).join(counts, ["source_id", "key", "part"], "left_semi").drop("key", "part") for x in names if x != "done"}

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)
