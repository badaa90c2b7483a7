"""CSV and spreadsheet readers: every cell is a string and no header is consumed."""

from __future__ import annotations

import csv
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from io import BytesIO
from itertools import batched, chain
from zipfile import BadZipFile, ZipFile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import grids
from docloom.operators.perdoc import in_order
from docloom.sources import ranges
from docloom.store import stored


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    has_header: bool = True
    quote: str = '"'
    trim: bool = False
    flexible: bool = False

    @classmethod
    def tsv(cls) -> CsvOptions:
        return cls(delimiter="\t")

    @classmethod
    def semicolon(cls) -> CsvOptions:
        return cls(delimiter=";")

    def without_header(self) -> CsvOptions:
        return replace(self, has_header=False)


class RaggedRows(ValueError):
    pass


#: What is known of splits is broadcast if it is of at most so many; each is megabytes of input.
BROADCAST_SPLITS = 100_000


def _escaped(sign: str) -> str:
    return sign if sign.isalnum() else f"\\{sign}"


def _open(line: Column, options: CsvOptions) -> Column:
    """Whether a line that begins a record leaves a quoted cell open at its end."""
    q, d = _escaped(options.quote), _escaped(options.delimiter)
    whole = f"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}"
    raw = F.regexp_extract_all(F.concat(F.lit(options.delimiter), line), F.lit(f"{d}({whole}[^{d}]*+|[^{d}]*+)"), F.lit(1))
    return F.exists(raw, lambda c: c.startswith(options.quote) & ~c.rlike(f"^{whole}"))


def _states(before: bool, out: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether a quoted cell is open behind each line, given whether one is before the first, and
    what each line makes of a closed and of an open one. A line keeps the state, turns it, or ends
    in one whatever it was; so what counts is the last line of that kind and the turns since."""
    n = len(out)
    last = np.maximum.accumulate(np.where(out == inside, np.arange(n), -1))
    turns = np.cumsum(out & ~inside)
    since = np.where(last >= 0, out[last], before)
    return since ^ ((turns - np.where(last >= 0, turns[last], 0)) % 2 == 1)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """The rows of a task in pieces of one split (the first two columns), with whether a piece is
    the first of its split."""
    key = None
    for batch in batches:
        blocks = batch.column(1).to_numpy()
        names = batch.column(0).dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (names[1:] != names[:-1])])).tolist() if len(blocks) else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            own = batch.column(0)[start].as_py(), int(blocks[start])
            yield own, own != key, batch.slice(start, end - start)
            key = own


SUMMARY = "table_id string, block long, out boolean, inside boolean, out_rows long, inside_rows long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split what it makes of a closed and of an open cell before it, and how many records
    begin in it in either case."""
    held: list = []

    def done():
        cols = list(zip(*held, strict=True)) if held else [()] * 6
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], [f.split(" ")[0] for f in SUMMARY.split(", ")])

    for key, first, part in _splits(batches):
        if first:
            held.append([*key, False, True, 0, 0])
        full, out, inside = (part.column(c).to_numpy(zero_copy_only=False) for c in ("full", "out", "inside"))
        for at, rows in ((2, 4), (3, 5)):
            after = _states(held[-1][at], out, inside)
            before = np.concatenate([[held[-1][at]], after[:-1]])
            held[-1][rows] += int((full & ~before).sum())
            held[-1][at] = bool(after[-1])
    yield done()


def _chained(pdf):
    """The state and the number of records before each split of a file, and the state behind it."""
    pdf = pdf.sort_values("block", ignore_index=True)
    state, ahead, out = False, 0, []
    for row in pdf.itertuples():
        then = row.inside if state else row.out
        out.append((row.table_id, row.block, state, ahead, then))
        ahead += row.inside_rows if state else row.out_rows
        state = then
    return type(pdf)(out, columns=["table_id", "block", "open", "ahead", "left_open"])


def _parsed(options: CsvOptions) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parses the records that lie within a split; of one that reaches over its edges the lines here
    are a piece, with the record's number and the split's place."""

    def run(batches):
        csv.field_size_limit(2**31 - 1)
        names: list = []
        numbers: list = []
        cells: list = []
        blocks: list = []
        pieces: list = []

        def add(key, r, row, piece=None):
            names.append(key[0])
            numbers.append(r)
            cells.append(row)
            blocks.append(key[1])
            pieces.append(piece)

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array(blocks, pa.int64()), pa.array(pieces, pa.string())], ["table_id", "r", "cells", "block", "piece"])
            for held in (names, numbers, cells, blocks, pieces):
                held.clear()
            return out

        now, head, state, r, pending = None, False, False, 0, []

        def edge():
            """What is left of a split: lines of a record that goes on."""
            if pending:
                add(now, r - 1 if head else r, None, "\n".join(pending))
                pending.clear()

        for key, first, part in _splits(batches):
            if first:
                edge()
                now, state, r = key, part.column("open")[0].as_py(), part.column("ahead")[0].as_py()
                head = state
            values = part.column("value").to_pylist()
            after = _states(state, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("out", "inside")))
            closed = np.flatnonzero(~after)
            state = bool(after[-1])
            if not len(closed):
                pending += values
                continue
            start = 0
            if head:
                start = int(closed[0]) + 1
                pending += values[:start]
                edge()
                head = False
            end = int(closed[-1]) + 1
            lines = (x + "\n" for x in chain(pending, values[start:end]))
            for row in csv.reader(lines, delimiter=options.delimiter, quotechar=options.quote):
                if row:
                    add(key, r, [c.strip() for c in row] if options.trim else row)
                    r += 1
                    if len(names) >= 8192:
                        yield batch()
            pending[:] = values[end:]
        edge()
        yield batch()

    return run


PARSED = "table_id string, r long, cells array<string>, block long, piece string"


def _records(spark: SparkSession, path: str | list[str], options: CsvOptions) -> DataFrame:
    """table_id, r, cells of all records, ragged ones too.

    A split is read twice. First it is summed up: a quoted cell may be open before it or not; for
    either case, whether one is behind it and how many records begin in it. Chained along a
    file's splits these tell each split its state and its first number. Then splits are parsed
    apart from each other, and only the lines of records that reach over an edge are brought
    together. No other row is moved, and a task holds a batch of lines and the record it is in.
    A line break within a cell counts as one line feed.
    """
    value, quote = F.col("value"), F.lit(options.quote)
    has = value.contains(options.quote)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("table_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_n"), "value")
    flags = [(value != "").alias("full"), F.when(has, _open(value, options)).otherwise(False).alias("out"), F.when(has, _open(F.concat(quote, value), options)).otherwise(True).alias("inside")]
    summary = lines.select("table_id", "block", *flags).mapInArrow(_summaries, SUMMARY)
    starts = stored(summary.groupBy("table_id").applyInPandas(_chained, "table_id string, block long, open boolean, ahead long, left_open boolean"))
    known, spans = starts.agg(F.count("*"), F.count_if("left_open")).first()

    def parsed(told: DataFrame) -> DataFrame:
        told = told.select("table_id", "block", "open", "ahead")
        if known <= BROADCAST_SPLITS:
            met = lines.join(F.broadcast(told), ["table_id", "block"])
        else:
            met = lines.join(told, ["table_id", "block"]).repartition("table_id", "block").sortWithinPartitions("table_id", "block", "_n")
        return met.select("table_id", "block", "value", *flags[1:], "open", "ahead").mapInArrow(_parsed(options), PARSED)

    whole = parsed(starts).where("piece is null").select("table_id", "r", "cells")
    if not spans:
        return whole

    def step(key, rows):
        csv.field_size_limit(2**31 - 1)
        for row in csv.reader((x + "\n" for _, piece in rows for x in piece.split("\n")), delimiter=options.delimiter, quotechar=options.quote):
            yield *key, [c.strip() for c in row] if options.trim else row

    pieces = parsed(starts.where("open or left_open")).where("piece is not null")
    return whole.unionByName(in_order(pieces.select("table_id", "r", "block", "piece"), ["table_id", "r"], ["block"], step, "table_id string, r long, cells array<string>"))


def _uneven(rows: DataFrame) -> DataFrame:
    """table_id, lo, hi of tables whose rows differ in width."""
    return rows.groupBy("table_id").agg(F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi")).where("lo <> hi")


def read_csv(spark: SparkSession, path: str | list[str], options: CsvOptions = CsvOptions()) -> DataFrame:
    """table_id (the file), r, cells: all records of the files at `path`, numbered in file order
    from 0. A quoted cell may hold delimiters, doubled quotes and line breaks; empty lines are
    no records. A ragged file is an error unless `flexible`."""
    out = _records(spark, path, options)
    if not options.flexible:
        uneven = _uneven(out).head()
        if uneven:
            raise RaggedRows(f"{uneven['table_id']}: rows of {uneven['lo']} to {uneven['hi']} cells")
    return out


def counts(rows: DataFrame) -> DataFrame:
    """table_id, rows, columns (the first row's width)."""
    return rows.groupBy("table_id").agg(F.count("*").alias("rows"), F.max(F.when(F.col("r") == 0, F.size("cells"))).alias("columns"))


def csv_range(rows: DataFrame, text: str) -> DataFrame:
    """Rows of a range expression; the end may lie beyond the last row."""
    start, end = ranges.parse_rows(text)
    return rows.where(F.col("r") >= start) if end is None else rows.where(F.col("r").between(start, end))


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _events(z: ZipFile, name: str) -> Iterator[tuple[str, ET.Element]]:
    """A part's parse events; what is behind an element's end is not held."""
    with z.open(name) as stream:
        open_: list[ET.Element] = []
        for event, el in ET.iterparse(stream, ("start", "end")):
            if event == "start":
                open_.append(el)
                yield event, el
                continue
            yield event, el
            open_.pop()
            if open_ and el.tag in (f"{NS}c", f"{NS}row", f"{NS}si"):
                open_[-1].remove(el)


def sheet_parts(z: ZipFile) -> list[tuple[str, str]]:
    """Name and part of a workbook's sheets in order, empty ones too."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), targets[s.get(f"{REL}id")].lstrip("/")) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{NS}sheet")]
    return [(name, part if part.startswith("xl/") else f"xl/{part}") for name, part in found]


def shared_strings(z: ZipFile) -> list[str]:
    """The strings that a workbook's cells name by number; readings beside a text are left out."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    aside = f"{NS}rPh"
    return ["".join(t.text or "" for part in el if part.tag != aside for t in part.iter(f"{NS}t")) for event, el in _events(z, "xl/sharedStrings.xml") if event == "end" and el.tag == f"{NS}si"]


def sheet_cells(z: ZipFile, part: str, shared: list[str], last: int | None = None) -> Iterator[tuple]:
    """(r, c, v, type) of a sheet's stored cells in order, as the part streams by; behind row
    `last` it isn't read on. Cells and rows without an address follow the one before them."""
    r = c = -1
    for event, el in _events(z, part):
        if event == "start":
            if el.tag == f"{NS}row":
                r, c = int(el.get("r")) - 1 if el.get("r") else r + 1, -1
                if last is not None and r > last:
                    return
            continue
        if el.tag != f"{NS}c":
            continue
        c += 1
        if el.get("r"):
            spec = ranges.parse(el.get("r"))
            r, c = spec.r0, spec.c0
        kind, value = el.get("t", "n"), el.find(f"{NS}v")
        if kind == "inlineStr":
            yield r, c, "".join(t.text or "" for t in el.iter(f"{NS}t")), kind
        elif value is not None and value.text is not None:
            yield r, c, shared[int(value.text)] if kind == "s" else value.text, kind


def _cells(content: bytes) -> Iterator[tuple]:
    """(sheet number, sheet name, r, c, v, type) of a workbook: for each sheet a row of type
    `sheet` without a place, then its stored cells."""
    with ZipFile(BytesIO(content)) as z:
        shared = shared_strings(z)
        for number, (name, part) in enumerate(sheet_parts(z)):
            yield number, name, None, None, None, "sheet"
            for cell in sheet_cells(z, part, shared):
                yield number, name, *cell


def read_workbooks(spark: SparkSession, path: str | list[str], lenient: bool = False) -> DataFrame:
    """The cells of the workbooks at `path`."""
    return workbook_cells(spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "content"), lenient)


def workbook_cells(files: DataFrame, lenient: bool = False) -> DataFrame:
    """table_id (file and sheet), uri, sheet, sheet_no, r, c, v, type of each stored cell of
    workbooks (uri, content), and for each sheet, whether it has cells or not, a row of type
    `sheet` with no r, c and v. Files stream by one after another on the executors, their cells in
    batches. A file that is no workbook is an error, or where `lenient` a row of type `problem`
    behind what was read of it."""
    schema = "uri string, sheet_no int, sheet string, r int, c int, v string, type string"

    def cells(uri: str, content: bytes) -> Iterator[tuple]:
        try:
            for cell in _cells(content):
                yield (uri, *cell)
        except (BadZipFile, KeyError, ET.ParseError) as e:
            if not lenient:
                raise
            yield uri, 0, "", 0, 0, f"{type(e).__name__}: {str(e)[:200]}", "problem"

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in batched(cells(*(c[0].as_py() for c in batch.slice(i, 1).columns)), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uri", "sheet_no", "sheet", "r", "c", "v", "type"])

    return files.select("uri", "content").mapInArrow(run, schema).withColumn("table_id", F.concat("uri", F.lit("#"), "sheet"))


def list_sheets(cells: DataFrame) -> DataFrame:
    """uri, sheet_no, sheet of all sheets, empty ones too; numbers are their order."""
    return cells.where("type = 'sheet'").select("uri", "sheet_no", "sheet")


def formatted(cells: DataFrame, dates: bool = False) -> DataFrame:
    """Cell values as text: whole numbers without a fraction, TRUE and FALSE as words, serials
    as ISO dates where asked for."""
    from docloom.functions import text as fx

    number = F.expr("try_cast(v as double)")
    plain = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long").cast("string")).otherwise(number.cast("string"))
    own = F.when(F.col("type") == "b", F.when(F.col("v") == "1", "TRUE").otherwise("FALSE")).when((F.col("type") == "n") & number.isNotNull(), F.when(fx.like_serial_date(number), fx.serial_to_iso(number)).otherwise(plain) if dates else plain)
    return cells.where("type <> 'sheet'").withColumn("v", F.coalesce(own, "v"))


def sheet(cells: DataFrame, name: str | None = None) -> DataFrame:
    """The cells of a sheet, or of each workbook's first, which may be empty."""
    return cells.where("sheet_no = 0" if name is None else F.col("sheet") == name)


def read_range(cells: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """table_id, r, c, v of a range; strict ones must name cells."""
    return grids.dense(cells.where("r is not null").select("table_id", "r", "c", "v"), ranges.parse_strict(text) if strict else ranges.parse(text))


def read_table(spark: SparkSession, path: str, range_text: str = "*", sheet_name: str | None = None, options: CsvOptions | None = None) -> DataFrame:
    """table_id, r, cells by the file's ending: xls and xlsx as a workbook (its first sheet
    unless named), tsv by tabs, all else by commas."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("xls", "xlsx"):
        return grids.assembled(read_range(formatted(sheet(read_workbooks(spark, path), sheet_name)), range_text, strict=False))
    return csv_range(read_csv(spark, path, options or (CsvOptions.tsv() if end == "tsv" else CsvOptions())), range_text)


INCLUDE = r"^include::([^\[]+)\[(.*)\]$"


def includes(lines: DataFrame) -> DataFrame:
    """uri, ln, path, sheet, range, header, delimiter, others, is_data of include lines. Keys are
    lower-cased; the delimiter is the first character of its value."""
    bare = F.trim("line")
    own = lines.where(bare.rlike(INCLUDE)).select("uri", "ln", F.regexp_extract(bare, INCLUDE, 1).alias("path"), F.split(F.regexp_extract(bare, INCLUDE, 2), ",").alias("_attrs"))
    pairs = F.transform(F.filter("_attrs", lambda a: F.instr(a, "=") > 0), lambda a: F.struct(F.lower(F.trim(F.substring_index(a, "=", 1))).alias("k"), F.trim(F.regexp_replace(a, r"^[^=]*=", "")).alias("v")))
    flags = F.transform("_attrs", lambda a: F.lower(F.trim(a)))
    own = own.withColumn("_pairs", pairs)
    get = lambda key: F.element_at(F.transform(F.filter("_pairs", lambda p: p["k"] == key), lambda p: p["v"]), -1)
    safe = lambda key: F.when(F.exists("_pairs", lambda p: p["k"] == key), get(key))
    others = F.filter("_pairs", lambda p: ~p["k"].isin("sheet", "range", "delimiter", "header"))
    return own.select(
        "uri",
        "ln",
        "path",
        safe("sheet").alias("sheet"),
        safe("range").alias("range"),
        (F.array_contains(flags, "header") | F.exists("_pairs", lambda p: p["k"] == "header")).alias("header"),
        F.substring(safe("delimiter"), 1, 1).alias("delimiter"),
        F.map_from_entries(F.array_distinct(others)).alias("others"),
        F.lower("path").rlike(r"\.(xlsx|xls|csv|tsv)$").alias("is_data"),
    )


SPEC = "path string, sheet string, range string, delimiter string, uri string, kind string, r0 int, r1 int, c0 int, c1 int, problem string"


def _specs(found: DataFrame, base_dir: str) -> DataFrame:
    """SPEC of each distinct data include: the file that it means, its bounds, or its problem."""

    def run(batches):
        arrow = to_arrow(SPEC)
        for batch in batches:
            rows = []
            for path, sheet, text, delimiter in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = path if path.startswith("/") or "://" in path or path.startswith("file:") else f"{base_dir}/{path}"
                uri = uri if ":/" in uri else f"file:{uri}"
                book = path.lower().endswith((".xls", ".xlsx"))
                bounds, problem = (0, None, 0, None), None
                try:
                    if book:
                        spec = ranges.parse(text or "*")
                        bounds = spec.r0, spec.r1, spec.c0, spec.c1
                    else:
                        bounds = *ranges.parse_rows(text or "*"), 0, None
                except ranges.InvalidRange as e:
                    problem = f"InvalidRange: {e}"
                sign = delimiter or ("\t" if path.lower().endswith(".tsv") else ",")
                rows.append((path, sheet, text, delimiter, uri, "book" if book else sign, *bounds, problem))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def to_arrow(ddl: str) -> pa.Schema:
        kinds = {"string": pa.string(), "int": pa.int32()}
        return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])

    return found.where("is_data").select("path", "sheet", "range", "delimiter").distinct().mapInArrow(run, SPEC)


def resolve_includes(spark: SparkSession, found: DataFrame, base_dir: str) -> DataFrame:
    """uri, ln, r, cells, is_header, problem of data includes. The files of a format (workbooks,
    or text of one delimiter) are read in one scan, each file once; ranges are cut out of it
    by joins. What can't be read is a row with its problem instead of an abort.

    Which files there are is told from a listing, without their contents; their names are
    collected, as a scan needs them."""
    spec = _specs(found, base_dir)
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,tsv,xls,xlsx,CSV,TSV,XLS,XLSX}").load(base_dir).select(F.col("path").alias("file"))
    spec = spec.withColumn("_key", F.regexp_replace("uri", "^file:/*", "file:/")).join(names.withColumn("_key", F.regexp_replace("file", "^file:/*", "file:/")), "_key", "left").drop("_key")
    spec = spec.withColumn("problem", F.coalesce("problem", F.when(F.col("file").isNull(), F.concat(F.lit("FileNotFound: "), "path"))))
    files: dict[str, list[str]] = {}
    for row in spec.where("problem is null").select("kind", "file").distinct().toLocalIterator():
        files.setdefault(row["kind"], []).append(row["file"])
    plain = lambda c: F.regexp_replace(c, "^file:/*", "file:/")
    keys = ["path", "sheet", "range", "delimiter"]
    good = spec.where("problem is null").withColumn("_file", plain("file"))
    out = [spec.where("problem is not null").select(*keys, F.lit(0).cast("long").alias("r"), F.array().cast("array<string>").alias("cells"), "problem")]
    for kind, own in files.items():
        mine = good.where(F.col("kind") == kind)
        if kind == "book":
            cells = read_workbooks(spark, own, lenient=True)
            bad = cells.where("type = 'problem'").select(plain("uri").alias("_file"), F.col("v").alias("_why"))
            stored = formatted(cells.where("type not in ('problem', 'sheet')")).select(plain("uri").alias("_file"), F.col("sheet").alias("_sheet"), (F.col("sheet_no") == 0).alias("_is_first"), "r", "c", "v")
            met = mine.join(stored, "_file").where("coalesce(sheet = _sheet, _is_first) and r >= r0 and r <= coalesce(r1, r) and c >= c0 and c <= coalesce(c1, c)")
            table = F.to_json(F.struct(*keys))
            rows = grids.dense_rows(met.select(table.alias("table_id"), "r", "c", "v", "r0", "r1", "c0", "c1"))
            out.append(mine.withColumn("table_id", table).join(rows, "table_id").select(*keys, F.col("r").cast("long").alias("r"), "cells", F.lit(None).cast("string").alias("problem")))
        else:
            rows = _records(spark, own, CsvOptions(delimiter=kind)).withColumn("_file", plain("table_id"))
            bad = _uneven(rows).select(plain("table_id").alias("_file"), F.concat(F.lit("RaggedRows: rows of "), "lo", F.lit(" to "), "hi", F.lit(" cells")).alias("_why"))
            met = mine.join(bad, "_file", "left_anti").join(rows, "_file").where("r >= r0 and r <= coalesce(r1, r)")
            out.append(met.select(*keys, "r", "cells", F.lit(None).cast("string").alias("problem")))
        out.append(mine.join(bad, "_file").select(*keys, F.lit(0).cast("long").alias("r"), F.array().cast("array<string>").alias("cells"), F.col("_why").alias("problem")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    asked, got = found.where("is_data").alias("f"), rows.alias("g")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"g.{k}"))
    met = asked.join(got, same).select("f.uri", "f.ln", "f.header", "g.r", "g.cells", "g.problem")
    first = met.groupBy("uri", "ln").agg(F.min("r").alias("_from"))
    return met.join(first, ["uri", "ln"]).select("uri", "ln", (F.col("r") - F.col("_from")).cast("int").alias("r"), "cells", (F.col("header") & (F.col("r") == F.col("_from"))).alias("is_header"), "problem")


#: Listings of at most so many files are broadcast to the files they number.
BROADCAST_PATHS = 500_000


def read_workspace(spark: SparkSession, directory: str) -> DataFrame:
    """uri, load_ord, text of the *.adoc files below a folder, then of the *.asciidoc files;
    load_ord grows in this order, with gaps. Only names are sorted, contents stay where they
    are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{adoc,asciidoc}").load(directory)
    names = files.select("path")
    numbered = names.orderBy(F.col("path").endswith(".asciidoc"), "path").select("path", F.monotonically_increasing_id().alias("load_ord"))
    numbered = F.broadcast(numbered) if names.count() <= BROADCAST_PATHS else numbered
    return files.select("path", "content").join(numbered, "path").select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), "load_ord", F.decode("content", "UTF-8").alias("text"))
