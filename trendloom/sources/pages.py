"""A replay source for provider pages: page-<n>.jsonl files in a folder, each a page of JSON records.

``spark.read.format("trendloom_pages")`` reads a page a partition; ``readStream`` goes on from the last page seen,
its offset. A provider's client takes the place of ``_records``; retries stay inside it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def _pages(path: str) -> list[int]:
    return sorted(int(n[5:-6]) for n in os.listdir(path) if n.startswith("page-") and n.endswith(".jsonl"))


def _records(path: str, page: int) -> Iterator[tuple]:
    with open(os.path.join(path, f"page-{page}.jsonl"), encoding="utf-8") as f:
        for i, line in enumerate(f, 1):
            if line.strip():
                try:
                    record = json.loads(line)
                except ValueError as e:
                    raise ValueError(f"page {page}, line {i}: {e}") from e
                yield page, i, str(record.get("observation_id")), json.dumps(record, sort_keys=True, ensure_ascii=False)


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxPages", 1 << 30))

    def partitions(self):
        return [_Page(p) for p in _pages(self.path)[: self.most]]

    def read(self, partition):
        return _records(self.path, partition.page)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self):  # noqa: N802
        return {"page": -1}

    def read(self, start: dict):
        later = [p for p in _pages(self.path) if p > start["page"]]
        if not later:
            return iter([]), start
        return iter(list(_records(self.path, later[0]))), {"page": later[0]}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter([r for p in _pages(self.path) if start["page"] < p <= end["page"] for r in _records(self.path, p)])


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trendloom_pages"

    def schema(self) -> str:
        return "page int, line int, observation_id string, payload string"

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Stream(self.options)
