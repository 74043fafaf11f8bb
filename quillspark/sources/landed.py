"""A Python data source for papers landed as JSON lines, with tests of year and source pushed into the reader.

    landed.load(spark, folder, sources="a, b").where("year >= 2020")

``load`` registers the source and turns pushed filters of Python sources on for the session, which Spark asks of a reader that takes some.

Files are cut into ranges of ``split_bytes``, small ones are read together, and folders are reached by URI
through Arrow's file systems, so they can be in any store that executors share.  Options ``year_min``, ``year_max``, ``sources`` (names
between commas) and ``query`` (words that are all in title or abstract) leave out papers where they are read; ``max_results`` bounds what the reader
puts out, in order of the files, by one task that stops there.  The order of a result is the caller's ``orderBy``.

It stands for connectors to services: a live one replaces ``_lines`` and keeps the rest.  For files alone ``readers.search_file`` does the same in the JVM.
Lines that are no JSON object, headers and footers go; a missing value, or one of another kind, is an empty one.
"""

from __future__ import annotations

import io
import itertools
import json
import posixpath
from collections.abc import Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .. import model
from .notes import opened

_FIELDS = [x.strip().split(" ") for x in model.PAPER.split(", ")]
_EMPTY = {"string": "", "int": 0, "array<string>": []}
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


def _as(kind: str, value: Any) -> Any:
    if value is None:
        return _EMPTY[kind]
    if kind == "int":
        try:
            number = int(value)
        except (TypeError, ValueError, OverflowError):
            return 0
        return number if -(1 << 31) <= number < 1 << 31 else 0
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return [_as("string", x) for x in value] if isinstance(value, list) else []


class Ranges(InputPartition):
    """(path, first byte, end) of what a task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("max_results", 0))
        self.split = max(1, int(options.get("split_bytes", 128 << 20)))
        self.first, self.last = int(options.get("year_min", -(1 << 31))), int(options.get("year_max", (1 << 31) - 1))
        self.sources = {s.strip() for s in options["sources"].split(",")} if options.get("sources") else None
        self.words = options.get("query", "").lower().split()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the year and names of sources are taken; every other filter goes back to Spark."""
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        of, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return of in (("year",), ("source",))  # never null, see ``_as``
        if of == ("source",):
            if isinstance(f, EqualTo) and isinstance(value, str):
                names = {value}
            elif isinstance(f, In) and all(isinstance(v, str) for v in value):
                names = set(value)
            else:
                return False
            self.sources = names if self.sources is None else self.sources & names
            return True
        if of != ("year",) or not isinstance(value, int) or not isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)):
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.first = max(self.first, value + isinstance(f, GreaterThan))
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.last = min(self.last, value - isinstance(f, LessThan))
        return True

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        at = store.get_file_info(root)
        found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in posixpath.relpath(p, root).split("/") if x != ".")
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path))
        step = lambda path, size: size if path.endswith(_PACKED) else self.split
        cuts = [(path, lo, min(lo + step(path, size), size)) for path, size in files for lo in range(0, size, step(path, size))]
        if self.most:
            return [Ranges(cuts)]
        out: list[Ranges] = []
        room = 0
        for cut in cuts:
            need = cut[2] - cut[1]
            if not out or need > room:
                out.append(Ranges([]))
                room = self.split
            out[-1].ranges.append(cut)
            room -= need
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        rows = (row for cut in partition.ranges for row in self._rows(*cut))
        return itertools.islice(rows, self.most or None)

    def _lines(self, path: str, lo: int, hi: int) -> Iterator[bytes]:
        """Lines that begin in the range."""
        store, _ = opened(self.path)
        if path.endswith(_PACKED):
            with store.open_input_stream(path) as packed:
                yield from io.BufferedReader(packed)
            return
        with store.open_input_file(path) as file:
            file.seek(max(lo - 1, 0))
            lines = io.BufferedReader(file, 1 << 20)
            at = lo - 1 + len(lines.readline()) if lo else 0  # to the end of the line that the range before has
            while at < hi and (line := lines.readline()):
                at += len(line)
                yield line

    def _rows(self, path: str, lo: int, hi: int) -> Iterator[tuple]:
        for line in self._lines(path, lo, hi):
            try:
                row = json.loads(line.decode("utf-8", "replace"))
            except ValueError:
                continue
            if not isinstance(row, dict) or row.get("type") in ("search_metadata", "sources_status"):
                continue
            paper = {name: _as(kind, row.get(name)) for name, kind in _FIELDS}
            if not self.first <= paper["year"] <= self.last or self.sources is not None and paper["source"] not in self.sources:
                continue
            if self.words:
                told = f"{paper['title']}\n{paper['abstract']}".lower()
                if not all(w in told for w in self.words):
                    continue
            yield tuple(paper.values())


class LandedPapers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_papers"

    def schema(self) -> str:
        return model.PAPER

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


def load(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPapers)
    return spark.read.format("landed_papers").options(path=path, **options).load()
