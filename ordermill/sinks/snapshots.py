"""Published versions of a table folder: readers see one whole version, the old or the new.

A version is a folder of its own below the table's. It counts from the moment its pointer, an
empty file named after it, is created below ``_versions``; creating a file is one step on every
file system, a rename of a folder is not. The highest pointer is the current version. A writer
that is lost before that step leaves the old version current and a folder that nobody reads, which
``recover`` removes at the start of the next run. One job at a time may write a table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

POINTERS = "_versions"
PREFIX = "version-"


@dataclass(frozen=True)
class Snapshot:
    """One version of a table: a number that grows, and the folder that holds it."""

    number: int
    path: str


class Versions:
    """The versions of one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = folder.rstrip("/")
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._files.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(path))

    def all(self) -> list[Snapshot]:
        """The published versions, oldest first."""
        found = []
        for name in self._names(f"{self.folder}/{POINTERS}"):
            number, _, version = name.partition(".")
            if number.isdigit() and version.startswith(PREFIX):
                found.append(Snapshot(int(number), f"{self.folder}/{version}"))
        return found

    def current(self, number: int | None = None) -> Snapshot | None:
        """The newest version, or the one of that number, which a reader thereby pins."""
        found = [s for s in self.all() if number in (None, s.number)]
        return found[-1] if found else None

    def fresh(self) -> str:
        """Where to write a version that is not published yet."""
        return f"{self.folder}/{PREFIX}{uuid.uuid4().hex}"

    def publish(self, path: str) -> Snapshot:
        """Make a finished folder the current version."""
        last = self.current()
        number = last.number + 1 if last else 1
        name = path.rsplit("/", 1)[1]
        pointer = self._path(f"{self.folder}/{POINTERS}/{number:012}.{name}")
        self._files.create(pointer, False).close()
        return Snapshot(number, path)

    def tidy(self, keep: int) -> None:
        """Forget all but the last ``keep`` versions; those before the current one serve readers
        that began on them. The pointer goes first, so no pointer lacks its folder."""
        for old in self.all()[:-keep]:
            name = old.path.rsplit("/", 1)[1]
            self._files.delete(self._path(f"{self.folder}/{POINTERS}/{old.number:012}.{name}"), False)
            self._files.delete(self._path(old.path), True)

    def recover(self) -> list[str]:
        """Remove what lost writers left unpublished; the folders removed."""
        known = {s.path.rsplit("/", 1)[1] for s in self.all()}
        left = [n for n in self._names(self.folder) if n.startswith(PREFIX) and n not in known]
        for name in left:
            self._files.delete(self._path(f"{self.folder}/{name}"), True)
        return left
