"""Tables that grow by batches: segments on shared storage, listed by numbered manifests.

A batch is written as a segment of its own, and a manifest that names all segments in force is written last, so a reader
sees a batch whole or not at all, and a writer that dies leaves nothing that counts. When FAN segments of a level have
gathered they are merged into one of the next level: a row is rewritten once a level, and a reader meets few files. Any
Hadoop file system serves; nothing but names and counts passes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

#: Segments of a level that are merged.
FAN = 8


class Segment(NamedTuple):
    name: str
    level: int


class Segments:
    """The store under root. shapes: the schema of each table, as DDL; without one the files tell."""

    def __init__(self, spark: SparkSession, root: str, shapes: dict[str, str | None]):
        self.spark, self.root, self.shapes = spark, root.rstrip("/"), shapes

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        fs, at = self._fs(), self._path("manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self) -> tuple[int, list[Segment]]:
        """The last batch that is in, -1 for none, and the segments in force."""
        names = [n for n in self._manifests() if n.endswith(".json")]
        if not names:
            return -1, []
        stream = self._fs().open(self._path("manifests", names[-1]))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        return found["batch"], [Segment(*s) for s in found["segments"]]

    def _publish(self, number: int, batch: int, segments: list[Segment]) -> None:
        """A manifest appears whole, by renaming; one that another writer has put there is an error."""
        fs, target = self._fs(), self._path("manifests", f"{number:09d}.json")
        draft = self._path("manifests", f".{number:09d}-{batch}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "segments": segments}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"manifest {number} of {self.root} is there already: another writer is at work")

    def read(self, table: str, segments: list[Segment] | None = None) -> DataFrame:
        """All rows of a table in the segments given, else in those in force."""
        held = self.manifest()[1] if segments is None else segments
        paths = [f"{self.root}/{s.name}/{table}" for s in held]
        if not paths:
            return self.spark.createDataFrame([], self.shapes[table])
        reader = self.spark.read.schema(self.shapes[table]) if self.shapes[table] else self.spark.read
        return reader.parquet(*paths)

    def add(self, batch: int, tables: dict[str, DataFrame], merge: Callable[[str, DataFrame], DataFrame] | None = None) -> bool:
        """Write a batch and put it in force; False if it was in already. Batches come in order of their number. A batch
        whose writing was cut short is written again. merge says what becomes of a table's rows when segments are
        joined (all stay by default)."""
        last, segments = self.manifest()
        if batch <= last:
            return False
        number = len([n for n in self._manifests() if n.endswith(".json")])
        own = Segment(f"batch-{batch:09d}", 0)
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{own.name}/{table}")
        segments = [*segments, own]
        self._publish(number, batch, segments)
        self._compact(number + 1, batch, segments, merge or (lambda _, rows: rows))
        return True

    def _compact(self, number: int, batch: int, segments: list[Segment], merge: Callable[[str, DataFrame], DataFrame]) -> None:
        while True:
            level = next((x for x in sorted({s.level for s in segments}) if sum(s.level == x for s in segments) >= FAN), None)
            if level is None:
                return
            old = [s for s in segments if s.level == level]
            new = Segment(f"level-{level + 1:02d}-{number:09d}", level + 1)
            for table in self.shapes:
                merge(table, self.read(table, old)).write.mode("overwrite").parquet(f"{self.root}/{new.name}/{table}")
            segments = [new if s is old[0] else s for s in segments if s is old[0] or s not in old]
            self._publish(number, batch, segments)
            number += 1

    def vacuum(self) -> int:
        """Remove segments that no longer count; no reader of an older manifest may be at work. How many went."""
        fs, held, gone = self._fs(), {s.name for s in self.manifest()[1]}, 0
        for status in fs.listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith(("batch-", "level-")) and name not in held:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone
