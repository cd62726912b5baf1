"""Immutable table versions behind one pointer: readers pin a version, writers commit a new one atomically.

The pointer is a directory of numbered markers, each of which says what its
version holds. A marker is written aside and renamed into place without
overwrite: that one step is the commit, so two writers cannot both take number
n, a reader never meets half a marker, and a writer lost at any point before it
leaves everything as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.sources import files


class _Log:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n) for n in names if n.isdigit())

    def marker(self, version: int) -> str:
        return files.read_bytes(self._fs, self._path(f"{self.path}/_log/{version:012d}")).decode()

    def pinned(self, version: int | None) -> int:
        found = self.numbers()
        if not found:
            raise FileNotFoundError(f"{self.path} has no version")
        return found[-1] if version is None else version

    def _before(self, expected: int | None) -> int:
        before = max(self.numbers(), default=0)
        if expected is not None and expected != before:
            raise RuntimeError(f"version is {before}, not {expected}")
        return before

    def _write(self, df: DataFrame) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _mark(self, number: int, text: str) -> int:
        aside = self._path(f"{self.path}/_aside/{uuid.uuid4().hex}")
        files.write_bytes(self._fs, aside, text.encode())
        if not files.move(self.spark, aside, self._path(f"{self.path}/_log/{number:012d}"), overwrite=False):
            raise RuntimeError(f"version {number} was committed by another writer")
        return number


class VersionedTable(_Log):
    """One table."""

    def versions(self) -> list[tuple[int, str]]:
        """(number, data folder) of all commits in order."""
        return [(n, self.marker(n)) for n in self.numbers()]

    def read(self, version: int | None = None) -> DataFrame:
        """One pinned version (the newest by default); an absent table is an error."""
        return self.spark.read.parquet(f"{self.path}/{self.marker(self.pinned(version))}")

    def commit(self, df: DataFrame, expected: int | None = None) -> int:
        """Write df and make it the newest version; fails if another commit came first."""
        before = self._before(expected)
        return self._mark(before + 1, self._write(df))


class VersionedSite(_Log):
    """All tables of a site: one commit changes several of them together, and a reader pins all at once."""

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of one pinned version (the newest by default): a consistent snapshot."""
        found = json.loads(self.marker(self.pinned(version)))
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in found["tables"].items()}

    def note(self, version: int | None = None) -> str | None:
        return json.loads(self.marker(self.pinned(version)))["note"]

    def has(self, table: str, columns: tuple[str, ...] = ()) -> bool:
        """Whether the newest version has the table, with these columns."""
        if not self.numbers():
            return False
        found = self.tables()
        return table in found and set(columns) <= set(found[table].columns)

    def commit(self, changed: dict[str, DataFrame], expected: int | None = None, note: str | None = None) -> int:
        """Write the changed tables and make them, with the others as they were, the newest version."""
        before = self._before(expected)
        kept = json.loads(self.marker(before))["tables"] if before else {}
        kept |= {name: self._write(df) for name, df in changed.items()}
        return self._mark(before + 1, json.dumps({"tables": kept, "note": note}))
