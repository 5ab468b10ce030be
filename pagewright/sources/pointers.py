"""Numbered pointers: the state of a folder of tables, changed by adding the next pointer and never by replacing one.

A change writes new tables beside the old ones and then renames a new pointer into place under the next number; the pointer
with the highest number is the state. So readers, and a run after a crash at any point, see the old or the new state.
Tables that no kept pointer names are garbage: those of changes that failed, and those that later changes replaced.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Pointers that are kept, so that a reader that has just chosen one still finds its tables.
KEPT = 8
#: Seconds for which a table stays, whatever names it: a change under way has written it, or a long reader is at it.
GRACE = 3600.0


class Pointers:
    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils.toString
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        """The pointers, the newest last."""
        if not self.fs.exists(self.path()):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path())]
        return sorted(n for n in names if n.startswith("current-") and n.endswith(".json"))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self._text(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        names = self.names()
        return self.read(names[-1]) if names else None

    def commit(self, state: dict) -> None:
        """Makes the state, whose ``version`` is that which it was made from, the current one."""
        state["version"] += 1
        self.fs.mkdirs(self.path())
        new = self.path(f"next-{uuid.uuid4().hex}.json")
        out = self.fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        at = self.path(f"current-{state['version']:012d}.json")
        if self.fs.exists(at) or not self.fs.rename(new, at):
            raise OSError("another writer has changed the folder")
        for name in self.names()[:-KEPT]:
            self.fs.delete(self.path(name), False)

    def collect(self, named: Callable[[dict], list[str]], grace: float = GRACE) -> list[str]:
        """Deletes the tables that no kept pointer names and that are older than the grace; returns their names. Pointers are
        read after the tables are listed, so one that a change has just named isn't taken for garbage."""
        found = [(x.getPath().getName(), x.getModificationTime() / 1000) for x in self.fs.listStatus(self.path())]
        kept = {t for name in self.names() for t in named(self.read(name))}
        old = time.time() - grace
        gone = [name for name, changed in found if name not in kept and changed <= old and not name.startswith("current-")]
        for name in gone:
            self.fs.delete(self.path(name), True)
        return gone
