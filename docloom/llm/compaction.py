"""Bin-packed compaction of Parquet files, carried out in place.

`write_files` starts one file for each key of a table, sorted; `compact` then reads the folder's
file sizes, packs small files of a day into groups and replaces each group by one file that
holds its files' rows in joining order. Files that are not joined are not touched. Keys, sizes,
groups and digests are tables, dealt by key; the driver only deletes replaced files, one after
another as their names stream by. A file is written and digested by one task, which holds a
batch of its rows at a time.

Files are packed day by day (first fit, largest first). Groups lie in buckets by the power of two
below their free room, each an index min-heap: every group of a higher bucket than a file's own
has room for it, so the heads of those are compared with the first group of the file's own bucket
that is found to have room, and the earliest of all is taken.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import Stored, quoted, shared_dir, unused


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The group of each size in turn: the earliest opened that it fits in, or a new one. A size
    over `room` gets a group that nothing joins."""
    free: list[int] = []
    heaps: list[list[int]] = [[] for _ in range(max(room, 1).bit_length() + 1)]
    of = lambda x: x.bit_length()  # noqa: E731  bucket b holds free rooms of 2**(b-1) to 2**b - 1
    out = []

    def head(b: int) -> int | None:
        while heaps[b] and of(free[heaps[b][0]]) != b:  # has gone to a lower bucket since
            heapq.heappop(heaps[b])
        return heaps[b][0] if heaps[b] else None

    for size in sizes:
        best = min((h for b in range(of(size) + 1, len(heaps)) if (h := head(b)) is not None), default=None)
        passed, edge = [], of(size)
        while edge < len(heaps) and (h := head(edge)) is not None and (best is None or h < best):
            if free[h] >= size:
                best = h
                break
            passed.append(heapq.heappop(heaps[edge]))
        for h in passed:
            heapq.heappush(heaps[edge], h)
        new = best is None
        if new:
            best = len(free)
            free.append(max(room, size))
        before = of(free[best])
        free[best] -= size
        if free[best] and (new or of(free[best]) != before):
            heapq.heappush(heaps[of(free[best])], best)
        out.append(best)
    return out


@dataclass
class Layout:
    """A folder of files, one for each (day, lot, piece), and its table's columns."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, str, str]
    rows: int

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def read(self) -> tuple[DataFrame, Column, Column]:
        """The folder's rows, each with its file's path and its place in it."""
        full = T.StructType([*self.schema.fields, *(T.StructField(k, T.LongType()) for k in self.keys)])
        df = self.spark.read.schema(full).parquet(self.path)
        meta = df.metadataColumn("_metadata")
        return df, meta["file_path"], meta["row_index"]


def _share(rows: int, x: int) -> int:
    return 1 + rows // x


def _day(df: DataFrame, at: str) -> Column:
    """Whole days since 1970 of a timestamp with or without a zone (UTC then), or of a date."""
    kind, col = df.schema[at].dataType, F.col(quoted(at))
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_micros(col) / F.lit(86_400_000_000)).cast("long")
    return F.unix_date(col.cast("date")).cast("long")


def write_files(df: DataFrame, path: str, *, id_col: str = "click_id", at_col: str = "arrived_at") -> Layout:
    """Writes `df` to the new folder `path`, one file for each day of `at_col`, lot and piece.

    With S(x) = 1 + floor(R / x) for R rows: a day of r rows has 1 + floor(r / S(200)) lots;
    lot and piece come from the crc32 of the decimal id. Rows are in the order of time and id, then
    of the other columns as far as these have an order. A null id counts as an empty text, rows
    without a time make a day of their own; repeated rows are rows like others. All columns are
    written, whatever their names. An empty table writes no file.

    Only days of S(200) rows or more have several lots; there are less than 200 of them, and they
    are all that is broadcast."""
    spark = df.sparkSession
    names: list[str] = []
    for name in ("day", "lot", "piece", "h", "lots", "of_day"):
        names.append(unused(name, [*df.columns, *names]))
    day, lot, piece, h, lots, of_day = names
    dated = df.withColumn(day, _day(df, at_col))
    days = Stored(dated.groupBy(day).agg(F.count("*").alias("r"))).df
    rows = days.agg(F.sum("r")).first()[0] or 0
    share = _share(rows, 200)
    large = days.where(F.col("r") >= share).select(F.col(day).alias(of_day), F.expr(f"1 + r div {share}").alias(lots))
    hashed = dated.withColumn(h, F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")))
    met = hashed.join(F.broadcast(large), F.col(day).eqNullSafe(F.col(of_day)), "left")
    parts = F.expr("least(`{0}` % 4, (`{0}` div 4) % 4)".format(h))
    keyed = met.withColumn(lot, F.expr(f"(`{h}` div 16) % coalesce(`{lots}`, 1L)")).withColumn(piece, parts)
    ordered = [f.name for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    order = [at_col, id_col, *(c for c in ordered if c not in (at_col, id_col))]
    out = keyed.select(*(F.col(quoted(c)) for c in df.columns), day, lot, piece).repartition(day, lot, piece)
    out.sortWithinPartitions(day, lot, piece, *map(quoted, order)).write.partitionBy(day, lot, piece).parquet(path)
    return Layout(spark, path, df.schema, (day, lot, piece), rows)


#: What `plan` gives for each file: its group, its turn in the group, the group's files in order.
PLAN = "day long, lot long, piece long, path string, n long, g long, seq long, of long, to_lot long, to_piece long, sources string"


def plan(layout: Layout, *, small: int = 750, room: int = 300) -> DataFrame:
    """The files of the folder, each with the group of its day that it joins. Files under S(small)
    rows are taken by falling rows, then lot and piece; a group holds S(room) rows at most. A day
    has at most 4 * 200 files of R rows, however many rows it has."""
    df, path, _ = layout.read()
    files = df.select(*(F.col(k).alias(n) for k, n in zip(layout.keys, ("day", "lot", "piece"), strict=True)), path.alias("path"))
    files = files.groupBy("day", "lot", "piece", "path").agg(F.count("*").alias("n"))
    under, most = _share(layout.rows, small), _share(layout.rows, room)

    def pack(pdf):
        pdf = pdf.sort_values(["n", "lot", "piece"], ascending=[False, True, True], ignore_index=True)
        few = pdf["n"] < under
        g = np.arange(len(pdf)) + len(pdf)  # files that are large enough stay alone
        g[few] = first_fit(pdf["n"][few].tolist(), most)
        pdf["g"] = g
        by = pdf.groupby("g")
        pdf["seq"], pdf["of"] = by.cumcount(), by["n"].transform("size")
        pdf["to_lot"], pdf["to_piece"] = by["lot"].transform("first"), by["piece"].transform("first")
        names = pdf["lot"].astype(str) + "-" + pdf["piece"].astype(str)
        pdf["sources"] = names.groupby(pdf["g"]).transform(",".join)
        return pdf[[c.split()[0] for c in PLAN.split(", ")]]

    return files.groupBy("day").applyInPandas(pack, PLAN)


def compact(layout: Layout, **limits: int) -> DataFrame:
    """Joins the small files of `layout.path` as `plan` says and returns the stored plan.

    The new files are added to the folder in one committed write, then the files they replace are
    deleted; so rows are there twice in between, but never missing."""
    groups = Stored(plan(layout, **limits)).df
    joined = groups.where("of > 1")
    if joined.isEmpty():
        return groups
    day, lot, piece = layout.keys
    df, path, place = layout.read()
    own = [unused(n, df.columns) for n in ("seq", "at", "lot_", "piece_", "path_")]
    seq, at, to_lot, to_piece, key = own
    wanted = joined.select(F.col("path").alias(key), F.col("seq").alias(seq), F.col("to_lot").alias(to_lot), F.col("to_piece").alias(to_piece))
    rows = df.withColumn(key, path).withColumn(at, place).join(wanted, key)
    rows = rows.repartition(day, to_lot, to_piece).sortWithinPartitions(day, to_lot, to_piece, seq, at)
    out = rows.select(*(F.col(quoted(c)) for c in layout.columns), F.col(day), F.col(to_lot).alias(lot), F.col(to_piece).alias(piece))
    out.write.mode("append").partitionBy(day, lot, piece).parquet(layout.path)
    jvm, conf = layout.spark._jvm.org.apache.hadoop.fs, layout.spark._jsc.hadoopConfiguration()
    for row in joined.select("path").toLocalIterator():
        at = jvm.Path(layout.spark._jvm.java.net.URI(row.path))
        at.getFileSystem(conf).delete(at, False)
    return groups


def digests(layout: Layout, id_col: str, cents: Column) -> DataFrame:
    """day, lot, piece, path, n_rows, min_id, max_id, cents (summed) and ids_sha256 (the decimal
    ids in file order, comma-joined; a null id is an empty text) of each file of the folder."""
    df, path, place = layout.read()
    own = [F.col(k).alias(n) for k, n in zip(layout.keys, ("day", "lot", "piece"), strict=True)]
    rows = df.select(*own, place.alias("at"), F.col(quoted(id_col)).cast("long").alias("id"), cents.cast("long").alias("cents"))
    kinds = "day long, lot long, piece long, n_rows long, min_id long, max_id long, cents long, ids_sha256 string"
    shape = pa.schema([(k, pa.string() if kind == "string" else pa.int64()) for k, kind in (x.split() for x in kinds.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, sums = None, None, None
        done: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [()] * len(shape), shape, strict=True)], schema=shape)
            done.clear()
            return out

        for got in batches:
            keys = np.stack([c.fill_null(-(1 << 62)).to_numpy() for c in got.columns[:3]])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist()
            for start, end in zip(starts, [*starts[1:], got.num_rows], strict=True):
                part = got.slice(start, end - start)
                at = tuple(c[0].as_py() for c in part.columns[:3])
                if at != key:
                    if key:
                        done.append((*key, *sums, sha.hexdigest()))
                    key, sha, sums = at, hashlib.sha256(), [0, None, None, 0]
                ids = part.column("id").to_pylist()
                sha.update(("," * bool(sums[0]) + ",".join("" if i is None else str(i) for i in ids)).encode())
                held = [i for i in ids if i is not None]
                sums[0] += len(ids)
                sums[1] = min([*held, *[x for x in sums[1:2] if x is not None]], default=None)
                sums[2] = max([*held, *[x for x in sums[2:3] if x is not None]], default=None)
                sums[3] += sum(part.column("cents").to_pylist())
            if done:
                yield batch()
        if key:
            done.append((*key, *sums, sha.hexdigest()))
        yield batch()

    files = df.select(*own, path.alias("path")).groupBy("day", "lot", "piece", "path").agg(F.count("*").alias("n")).select(F.col("day").alias("_d"), F.col("lot").alias("_l"), F.col("piece").alias("_p"), "path")
    found = rows.repartition("day", "lot", "piece").sortWithinPartitions("day", "lot", "piece", "at").mapInArrow(run, kinds)
    return found.join(files, F.col("day").eqNullSafe(F.col("_d")) & (F.col("lot") == F.col("_l")) & (F.col("piece") == F.col("_p"))).drop("_d", "_l", "_p")


def compacted(df: DataFrame, *, id_col: str = "click_id", at_col: str = "arrived_at", value_col: str = "value") -> DataFrame:
    """Writes `df` to a new folder below spark.checkpoint.dir, compacts it there and returns a row
    for each final file: day, lot, piece (of its first source), n_rows, min_id, max_id, cents
    (sum of floor(100 * value + 0.5); null and what is no finite number below 9e16 count 0), sources,
    ids_sha256, columns, path, rewritten. The folder stays."""
    spark = df.sparkSession
    layout = write_files(df, f"{shared_dir(spark)}/compacted-{uuid.uuid4().hex}", id_col=id_col, at_col=at_col)
    if not layout.rows:
        return spark.createDataFrame([], "day long, lot long, piece long, n_rows long, min_id long, max_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean")
    groups = compact(layout, small=750, room=300)
    value = F.col(quoted(value_col)).cast("double")
    cents = F.when(F.abs(value) < 9e16, F.floor(value * 100 + 0.5)).otherwise(0)
    found = digests(layout, id_col, cents)
    to = groups.where("seq = 0").select(F.col("day").alias("_d"), F.col("to_lot").alias("_l"), F.col("to_piece").alias("_p"), "sources", (F.col("of") > 1).alias("rewritten"))
    out = found.join(to, F.col("day").eqNullSafe(F.col("_d")) & (F.col("lot") == F.col("_l")) & (F.col("piece") == F.col("_p")))
    return out.select("day", "lot", "piece", "n_rows", "min_id", "max_id", "cents", "sources", "ids_sha256", F.lit(",".join(layout.columns)).alias("columns"), "path", "rewritten")
