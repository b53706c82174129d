"""A log of numbered states in a folder that several drivers share, without locks.

Every state is a file of its own, whole before it gets its name, and named by the next number only if nobody took that
number meanwhile. It says which state it was made from. A writer that comes too late learns so, reads the newest state, makes
its one change to that and tries again: no change is lost, and a driver that dies leaves nothing that others wait for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DIGITS = 12


class StateLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """All states there are, in order."""
        fs = self._fs()
        if not fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at())]
        return sorted(int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit())

    def read(self, number: int) -> dict | None:
        """A state, or None if it is no JSON object."""
        stream = self._fs().open(self._at(f"{number:0{DIGITS}d}.json"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()
        return held if isinstance(held, dict) else None

    def latest(self) -> tuple[int, dict | None]:
        """(number, state) of the newest; (0, None) if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def append(self, previous: int, state: dict) -> bool:
        """Writes the state that follows number `previous`; False if another one follows it already."""
        fs = self._fs()
        own = self._at(f".{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(state | {"previous": previous}, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        named = self._at(f"{previous + 1:0{DIGITS}d}.json")
        try:
            return self._name(fs, fs.makeQualified(own), fs.makeQualified(named))
        finally:
            fs.delete(own, False)

    def _name(self, fs, own, named) -> bool:
        """Gives a file its name, unless the name is taken, in one step."""
        try:
            if fs.getScheme() == "file":  # a rename would replace what is there; a link does not
                path = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(path(named), path(own))
            else:
                none = self._spark_array()
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf).rename(own, named, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def _spark_array(self):
        """No options: a rename that does not replace."""
        return self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def change(self, change: Callable[[dict | None], dict]) -> tuple[int, dict]:
        """(number, state) after change(newest state) has become the newest. change may run several times; what it gives back
        equal is not written again."""
        while True:
            number, held = self.latest()
            state = change(held)
            if held is not None and {k: v for k, v in held.items() if k != "previous"} == json.loads(json.dumps(state)):
                return number, state
            if self.append(number, state):
                return number + 1, state
