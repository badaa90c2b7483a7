"""Order-dependent parsing, one document at a time in Arrow batches: no shuffle, and a
task holds no more than a batch of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, nullcontext
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def per_document(docs: DataFrame, parse: Callable[[str, Any], Iterator[tuple]], schema: str, rows: int = 128, read: Callable[[str], Any] | None = None, around: Callable[[], AbstractContextManager] = nullcontext) -> DataFrame:
    """The rows that `parse(uri, text)` yields for each document; a null text counts as empty.
    With `read` it gets what that makes of the text: first all of `rows` documents are read, then they
    are parsed within one context `around`. Joins of the rows are merge joins, as those of lines are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                uris, texts = (c.to_pylist() for c in batch.slice(start, rows).columns)
                texts = [read(text or "") if read else text or "" for text in texts]
                with around():
                    found = [row for uri, text in zip(uris, texts, strict=True) for row in parse(uri, text)]
                cols = list(zip(*found, strict=True)) if found else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select("uri", "text").mapInArrow(run, struct).hint("merge")


def per_document_rows(docs: DataFrame, parse: Callable[[str], tuple], schema: str, keep: tuple[str, ...] = ("uri",), rows: int = 128) -> DataFrame:
    """The row that `parse(text)` returns for each document, behind the columns that are kept; a
    null text counts as empty. A value of an array of structs is a list of tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = docs.select(*keep, "text")
    struct = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(struct)
    kept = [own.schema[c] for c in keep]
    whole = to_arrow_schema(type(struct)([*kept, *struct]))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                *same, texts = batch.slice(start, rows).columns
                cols = zip(*(parse(text or "") for text in texts.to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(same, whole, strict=False)), *(_array(list(c), f.type) for c, f in zip(cols, arrow, strict=True))], schema=whole)

    return own.mapInArrow(run, type(struct)([*kept, *struct]))


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """An array of lists of tuples is made of its columns."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    ends = [0]
    for v in values:
        ends.append(ends[-1] + len(v))
    fields = list(kind.value_type)
    cols = list(zip(*(row for v in values for row in v), strict=True)) or [()] * len(fields)
    flat = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=kind)


def in_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str, at_once: int = 4096) -> DataFrame:
    """The rows that `step(key, rows)` yields for each group of equal keys, whose rows stream by
    in order: no group has to fit into memory, and what `step` holds is its own affair."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = rows.sparkSession.createDataFrame([], schema).schema
    arrow, n = to_arrow_schema(struct), len(keys)

    def run(batches):
        each = (row for batch in batches for start in range(0, batch.num_rows, at_once) for row in zip(*(c.to_pylist() for c in batch.slice(start, at_once).columns), strict=True))
        held: list[tuple] = []

        def batch():
            cols = list(zip(*held, strict=True)) if held else [()] * len(arrow)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for key, group in groupby(each, key=lambda row: row[:n]):
            for out in step(key, (row[n:] for row in group)):
                held.append(out)
                if len(held) >= at_once:
                    yield batch()
        yield batch()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, struct)
