"""A memory table with versions: appends are seen whole or not at all, and a reader stays on the version it opened.

An append writes its rows into a folder of their own, then publishes version n + 1 as one small file that names all folders
of the table. The file is created under a name that must be new, so of two writers that started from one version only one
publishes; the other's rows are named by no version, and it may append again. Readers list no folders: they read those that
the version's file names. Folders that no version names can be removed when no writer is at work.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stepforge.streaming.push import new_rows


class VersionTaken(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    folders: tuple[str, ...]


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The published versions, ascending."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d+)\.json", n) for n in names) if m)

    def version(self, number: int | None = None) -> Version:
        """A published version, the latest by default."""
        known = self.numbers()
        if not known or number is not None and number not in known:
            raise LookupError(f"no version {number if known else 'of a table'} at {self.path}")
        chosen = known[-1] if number is None else number
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/{chosen}.json").first()["value"]
        plain = json.loads(text)
        return Version(chosen, StructType.fromJson(plain["schema"]), tuple(plain["folders"]))

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version. What is appended later is not among them, however late they are read."""
        version = version or self.version()
        folders = [f"{self.path}/rows/{f}" for f in version.folders]
        return self.spark.read.schema(version.schema).parquet(*folders) if folders else self.spark.createDataFrame([], version.schema)

    def create(self, schema: StructType) -> Version:
        """Version 0, without rows; refused where there is a table."""
        return self._publish(Version(0, schema, ()))

    def append(self, rows: DataFrame, onto: Version | None = None) -> Version:
        """Publishes the version after ``onto`` (the latest) with ``rows``, whose columns must be the table's."""
        onto = onto or self.version()
        want = {f.name: f.dataType for f in onto.schema}
        if {f.name: f.dataType for f in rows.schema} != want:
            raise ValueError("the rows' columns are not the table's")
        folder = uuid.uuid4().hex
        rows.select(*want).write.parquet(f"{self.path}/rows/{folder}")
        return self._publish(Version(onto.number + 1, onto.schema, (*onto.folders, folder)))

    def _publish(self, version: Version) -> Version:
        text = json.dumps({"schema": version.schema.jsonValue(), "folders": list(version.folders)})
        name = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, f"{version.number}.json")
        hidden = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, f"_{version.number}-{uuid.uuid4().hex}")
        if self._files.exists(name):
            raise VersionTaken(f"version {version.number} of {self.path} is published")
        out = self._files.create(hidden, False)
        out.write(bytearray(text.encode()))
        out.close()
        # A file appears under its name whole; a rename onto a name that exists is refused.
        if not self._files.rename(hidden, name):
            self._files.delete(hidden, False)
            raise VersionTaken(f"version {version.number} of {self.path} is published")
        return version


class Memory:
    """A reader pinned to a version until it is refreshed; what is pushed through it is seen after the next refresh."""

    def __init__(self, table: VersionedTable):
        self.table, self.pinned = table, table.version()

    def refresh(self) -> bool:
        """Moves to the latest version; whether that is another one."""
        latest = self.table.version()
        moved, self.pinned = latest.number != self.pinned.number, latest
        return moved

    def rows(self) -> DataFrame:
        return self.table.read(self.pinned)

    def push(self, batch: DataFrame, keys: list[str], tries: int = 3) -> int:
        """Appends the rows of ``batch`` whose keys the table lacks, from the latest version; gives the version's number.

        Where another writer is faster, the rows are compared with that version and written again."""
        for _ in range(tries):
            onto = self.table.version()
            fresh = new_rows(batch, self.table.read(onto), keys)
            try:
                return self.table.append(fresh, onto).number
            except VersionTaken:
                continue
        raise VersionTaken(f"{tries} other writers were faster")
