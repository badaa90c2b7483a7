"""Tables of strings as a Spark data source: `spark.read.format("docloom_table")`, after
`register(spark)`, with the options path, sheet, range, delimiter and flexible.

Files are opened by the file systems of Arrow: local paths and `file:`, `hdfs:`, `s3:` and `gs:`
URIs. `tables.read_table` reads the same through Spark's own readers, for stores that only
these know.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import groupby
from zipfile import ZipFile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources import ranges, tables

BOOKS = (".xls", ".xlsx")


def _store(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Part(InputPartition):
    """A file of lines, or a sheet of a workbook (its number)."""

    def __init__(self, path: str, sheet: int | None = None):
        self.path, self.sheet = path, sheet


def plain_value(v: str, kind: str) -> str:
    """A stored value as text: whole numbers without a fraction, TRUE and FALSE as words."""
    if kind == "b":
        return "TRUE" if v == "1" else "FALSE"
    if kind == "n":
        try:
            x = float(v)
        except ValueError:
            return v
        return str(int(x)) if x == x // 1 and abs(x) < 1e15 else repr(x)
    return v


class TableReader(DataSourceReader):
    """A partition for each file of lines and for each sheet asked for; all of them stream. Sheet and
    range go down to the parser, which stops behind the last row. Of a workbook its shared
    strings and one row are held."""

    def __init__(self, options: dict[str, str]):
        self.path, self.sheet = options["path"], options.get("sheet")
        self.range, self.delimiter = options.get("range", "*"), options.get("delimiter")
        self.flexible = options.get("flexible", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from fnmatch import fnmatch

        from pyarrow import fs

        store, path = _store(self.path)
        folder, pattern = (path.rsplit("/", 1) if any(s in path.rsplit("/", 1)[-1] for s in "*?[") else (path, "*"))
        info = store.get_file_info(folder)
        if info.type == fs.FileType.Directory:
            files = [i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and fnmatch(i.base_name, pattern) and not i.base_name.startswith((".", "_"))]
        else:
            files = [path] if info.is_file else []
        if not files:
            raise FileNotFoundError(self.path)
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        out: list[InputPartition] = []
        for name in sorted(files):
            if not name.lower().endswith(BOOKS):
                out.append(_Part(head + name))
                continue
            with store.open_input_file(name) as f, ZipFile(f) as z:
                sheets = [n for n, _ in tables.sheet_parts(z)]
            if self.sheet is not None and self.sheet not in sheets:
                raise ValueError(f"{name}: no sheet {self.sheet}")
            out.append(_Part(head + name, sheets.index(self.sheet) if self.sheet is not None else 0))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, path = _store(partition.path)
        if partition.sheet is not None:
            with store.open_input_file(path) as f, ZipFile(f) as z:
                yield from self._sheet(partition, z)
            return
        csv.field_size_limit(2**31 - 1)
        start, end = ranges.parse_rows(self.range)
        sign = self.delimiter or ("\t" if path.lower().endswith(".tsv") else ",")
        with io.TextIOWrapper(store.open_input_stream(path), encoding="utf-8", newline="") as f:
            rows = (row for row in csv.reader(f, delimiter=sign) if row)
            width = None
            for r, row in enumerate(rows):
                if end is not None and r > end:
                    break
                width = len(row) if width is None else width
                if len(row) != width and not self.flexible:
                    raise tables.RaggedRows(f"{partition.path}: row {r} has {len(row)} cells, those before it {width}")
                if r >= start:
                    yield partition.path, self.default_sheet, r, row

    def _sheet(self, partition: _Part, z: ZipFile) -> Iterator[tuple]:
        """The rows of the range; one that is open to the right is as wide as the whole sheet, which
        is read for it."""
        name, part = tables.sheet_parts(z)[partition.sheet]
        spec, shared = ranges.parse(self.range), tables.shared_strings(z)
        cells = lambda: ((r, c, plain_value(v, kind)) for r, c, v, kind in tables.sheet_cells(z, part, shared, spec.r1) if r >= spec.r0)
        last = spec.c1
        if last is None:
            last = max((c for _, c, *_ in tables.sheet_cells(z, part, shared)), default=-1)
        at = spec.r0
        empty = [""] * (last + 1 - spec.c0)
        for r, row in groupby(cells(), key=lambda x: x[0]):
            for gap in range(at, r):
                yield partition.path, name, gap, empty
            own = list(empty)
            for _, c, v in row:
                if spec.c0 <= c <= last:
                    own[c - spec.c0] = v
            yield partition.path, name, r, own
            at = r + 1
        for gap in range(at, (spec.r1 + 1) if spec.r1 is not None else at):
            yield partition.path, name, gap, empty

    default_sheet = "default"


class TableSource(DataSource):
    """The source itself; `DataSource` of files that have sheets and ranges."""

    @classmethod
    def name(cls) -> str:
        return "docloom_table"

    def schema(self) -> str:
        return "file string, sheet string, r int, cells array<string>"

    def reader(self, schema) -> TableReader:
        return TableReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session. Drivers and executors have to be able to import this
    package, as for all that runs in Python."""
    spark.dataSource.register(TableSource)
