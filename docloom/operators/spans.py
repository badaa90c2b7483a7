"""Which ranges cover a place: a join by equal keys instead of one by comparison.

A range is cut into the few dyadic intervals that make it up (at most two of each size), and a
place lies in one dyadic interval of each size; so a range and a place in it meet at exactly one
interval. A group of many ranges and many places is dealt over tasks by interval, and nothing but
the result's pairs is ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of intervals: 2^0 to 2^32, of all numbers there are.
SIZES = 33


def dyadic(start: Column, end: Column, sizes: int = SIZES) -> Column:
    """Array of (size, number): the dyadic intervals that make up the whole numbers from `start`
    to `end`, both from 0 and included; none where the end is before the start. `sizes` sizes,
    the least first, are enough for ranges of less than 2^sizes numbers."""

    def cut(size: Column) -> Column:
        width = F.pow(F.lit(2.0), size).cast("long")
        low = F.floor((start + width - 1) / width)
        high = F.floor((end + 1) / width)
        none = F.lit(None).cast("struct<size:int,number:bigint>")
        piece = lambda number: F.struct(size.cast("int").alias("size"), number.cast("long").alias("number"))
        return F.array(F.when((low < high) & (low % 2 == 1), piece(low)).otherwise(none), F.when((low < high) & (high % 2 == 1), piece(high - 1)).otherwise(none))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(sizes - 1)), cut)))


def covering(places: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each place (keys, at and more) with each range (keys, start, end and more) of equal keys
    that covers it, ends included. Places and ends are whole numbers below 2^32; rows with a null
    or negative one, and ranges that end before they start, cover nothing; null keys join nothing.
    Repeated rows are kept. Other columns of the two must differ in name.

    One pass over the ranges tells how many sizes the longest takes. The join is a merge join:
    Spark's estimate of either side is of rows before they are cut, too small to broadcast by."""
    in_ = ranges.where((F.col(start) >= 0) & (F.col(end) >= F.col(start)))
    longest = in_.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1).alias("n")).first().n
    sizes = max(1, min(SIZES, int(longest or 0).bit_length()))
    of = places.where(F.col(at) >= 0).select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(sizes - 1)), lambda s: F.floor(F.col(at) / F.pow(F.lit(2.0), s)))).alias("_size", "_number"))
    in_ = in_.select("*", F.explode(dyadic(F.col(start).cast("long"), F.col(end).cast("long"), sizes)).alias("_i")).select(*ranges.columns, F.col("_i.size").alias("_size"), F.col("_i.number").alias("_number"))
    return of.join(in_.hint("merge"), [*keys, "_size", "_number"]).drop("_size", "_number")
