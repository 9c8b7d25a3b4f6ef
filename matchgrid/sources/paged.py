"""Landed pages of a paged interface as a data source: ``spark.read.format("landed_pages")``.

A page is a JSON array in a file named by its offset (``0.json``, ``100.json`` and so on).
Ranges of offsets are partitions. As on the interface itself, a page with fewer events than
asked for is the last, and so is the one before a page that isn't there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scratch import written
from .markets import EVENT


class Offsets(InputPartition):
    def __init__(self, offsets: list[int]):
        super().__init__(offsets)
        self.offsets = offsets


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("size", 100))
        self.each = int(options.get("pages_per_partition", 10))

    def partitions(self) -> list[Offsets]:
        """Offsets that follow each other without a gap, by the names of files; nothing is opened."""
        from pyarrow.fs import FileSelector

        system, path = _filesystem(self.path)
        there = {int(m[1]) for f in system.get_file_info(FileSelector(path)) if (m := re.fullmatch(r"(\d+)\.json", f.base_name))}
        offsets = []
        while len(offsets) * self.size in there:
            offsets.append(len(offsets) * self.size)
        return [Offsets(offsets[i : i + self.each]) for i in range(0, len(offsets), self.each)] or [Offsets([])]

    def read(self, partition: Offsets) -> Iterator[tuple]:
        """(offset, place, page_rows, event); a row without an event for an empty page. A short page ends its range."""
        system, path = _filesystem(self.path)
        for offset in partition.offsets:
            with system.open_input_stream(f"{path}/{offset}.json") as f:
                page = json.loads(f.read().decode())
            if not page:
                yield offset, -1, 0, None
            for place, event in enumerate(page):
                yield offset, place, len(page), json.dumps(event)
            if len(page) < self.size:
                return


class LandedPages(DataSource):
    """Options: path, size (events asked for in a page, 100), pages_per_partition (10)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "offset long, place int, page_rows int, event string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def read_paged(spark: SparkSession, path: str, size: int = 100, schema: str = EVENT, pages_per_partition: int = 10) -> DataFrame:
    """The events of all pages up to the first short one, with their offset and place."""
    spark.dataSource.register(LandedPages)
    pages = written(spark.read.format("landed_pages").options(path=path, size=size, pages_per_partition=pages_per_partition).load(), "pages")
    last = pages.where(F.col("page_rows") < size).agg(F.min("offset").alias("_last"))  # one row
    own = pages.crossJoin(F.broadcast(last)).where("event is not null and (_last is null or offset <= _last)")
    return own.select("offset", "place", F.from_json("event", schema).alias("e")).select("offset", "place", "e.*")
