"""Grids of strings: cells, padding, ranges, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.ranges import RangeSpec
from docloom.store import stored


def padded(rows: DataFrame, key: str = "table_id", cells: str = "cells") -> DataFrame:
    """The rows with cells filled up with empty strings to their table's widest row. The width
    is aggregated first and joined, so that no table meets in one task."""
    width = rows.groupBy(key).agg(F.max(F.size(cells)).alias("_w"))
    fill = F.array_repeat(F.lit(""), (F.col("_w") - F.size(cells)).cast("int"))
    return rows.join(width, key).withColumn(cells, F.concat(cells, fill)).drop("_w")


def with_header(rows: DataFrame, order: str = "r", header: bool = True) -> DataFrame:
    return rows.withColumn("is_header", (F.col(order) == 0) & F.lit(header))


def to_cells(rows: DataFrame, key: str = "table_id", order: str = "r", cells: str = "cells") -> DataFrame:
    """table_id, r, c, v of a grid of rows."""
    return rows.select(key, order, F.posexplode(cells).alias("c", "v"))


#: Rows of a table that one row of its skeleton stands for until they are dealt out.
STRIDE = 4096


def dense_rows(cells: DataFrame) -> DataFrame:
    """table_id, r, cells of ranges (table_id, r, c, v, and bounds r0, r1, c0, c1 that are the same
    for a table): every row and column, absent cells empty; a null r1 or c1 reaches to the
    table's last row or column. A reversed range has no rows.

    Cells meet by row; only row numbers are made up, in strides that are dealt out first."""
    bounds = cells.groupBy("table_id").agg(*(F.first(c).alias(c) for c in ("r0", "c0")), F.coalesce(F.first("r1"), F.max("r")).alias("r1"), F.coalesce(F.first("c1"), F.max("c")).alias("c1")).where("r1 >= r0 and c1 >= c0")
    strides = bounds.withColumn("_at", F.explode(F.sequence(F.col("r0"), F.col("r1"), F.lit(STRIDE)))).repartition("table_id", "_at")
    rows = strides.select("table_id", "c0", "c1", F.explode(F.sequence(F.col("_at"), F.least(F.col("r1"), F.col("_at") + STRIDE - 1))).alias("r"))
    held = cells.where("c >= c0").groupBy("table_id", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("_held"))
    met = rows.join(held, ["table_id", "r"], "left")
    found = F.array_sort(F.map_entries("_held"))  # in order of columns
    filled = F.transform(F.sequence("c0", "c1"), lambda c: F.coalesce(F.try_element_at("_held", c), F.lit("")))
    whole = F.when(F.col("_held").isNull(), F.array_repeat(F.lit(""), F.col("c1") - F.col("c0") + 1)).when((F.size("_held") == F.col("c1") - F.col("c0") + 1) & (F.get(found, F.lit(0))["key"] == F.col("c0")) & (F.element_at(found, -1)["key"] == F.col("c1")), F.transform(found, lambda e: e["value"])).otherwise(filled)
    return met.select("table_id", "r", whole.alias("cells"))


def bounded(cells: DataFrame, spec: RangeSpec) -> DataFrame:
    """The cells of a range with its bounds, as dense_rows takes them."""
    last = lambda x: F.lit(x).cast("int")
    own = cells.withColumns({"r0": last(spec.r0), "r1": last(spec.r1), "c0": last(spec.c0), "c1": last(spec.c1)})
    return own


def dense(cells: DataFrame, spec: RangeSpec) -> DataFrame:
    """table_id, r, c, v: every cell of a range, absent ones empty; open ends reach to the
    table's last row or column. A reversed range has no cells."""
    rows = dense_rows(bounded(cells, spec))
    return rows.select("table_id", "r", F.posexplode("cells").alias("c", "v")).withColumn("c", (F.col("c") + spec.c0).cast("int"))


def assembled(cells: DataFrame) -> DataFrame:
    """table_id, r, cells: rows of a dense grid as arrays in order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"])
    return cells.groupBy("table_id", "r").agg(own.alias("cells"))


#: Rows that one task may number.
TOP = 100_000


def row_slice(rows: DataFrame, order: str, start: int, end: int, top: int = TOP) -> DataFrame:
    """Rows start to end, both counted in, from 0 in order; none from beyond the last. Each task
    hands on its first end + 1 rows at most. Up to `top` of these are numbered by one task;
    more stay in sorted ranges, which are counted and numbered from where those before end."""
    if end < top:
        n = F.row_number().over(Window.orderBy(order)) - 1
        return rows.orderBy(order).limit(end + 1).withColumn("r", n).where(F.col("r").between(start, end))
    nth = F.col("_at").bitwiseAND((1 << 33) - 1)
    # a range that is cut here has end + 1 rows, so those behind it begin beyond the end all the same
    ranged = stored(rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()).where(nth <= end))
    counts = ranged.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()  # a row a range
    before, total = [], 0
    for own in sorted(counts):
        before.append((own.p, total))
        total += own.n
    offsets = F.broadcast(rows.sparkSession.createDataFrame([x for x in before if x[1] <= end], "_p long, _before long"))
    numbered = ranged.withColumn("_p", F.shiftright("_at", 33)).join(offsets, "_p")
    return numbered.withColumn("r", (F.col("_before") + nth).cast("long")).drop("_at", "_p", "_before").where(F.col("r").between(start, end))


def projected(rows: DataFrame, indices: list[int], cells: str = "cells") -> DataFrame:
    """Columns by index; an absent one is empty."""
    return rows.withColumn(cells, F.array(*(F.coalesce(F.get(cells, F.lit(i)), F.lit("")) for i in indices)))
