"""Nearest smaller values in order: what heading trees, section ends and closing delimiters are.

Rows of a group lie in blocks of neighbouring places, which tasks look at apart. A block is summed
up by its open rows (those that no smaller value follows), and a row whose answer is not in its own
block finds it among the open rows of the blocks before. Both steps are windows: a value is smaller
than another where it is smaller in the highest digit in which they differ; so for each digit (of
DIGIT bits) one sort is enough, with a running maximum for each value of the digit over the rows
that agree above it. No stacks, no Python workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a block.
BLOCK = 4096
#: Bits of a digit: so many fewer sorts of the rows than one for each bit, and 2^DIGIT - 1 maxima in each.
DIGIT = 4


def bits_of(rows: DataFrame, value: str) -> int:
    """Bits that the values of a column (whole, from 0) take, by one pass over them."""
    most = rows.agg(F.max(value).alias("most")).first().most
    return int(most or 0).bit_length()


def _last_smaller(value: Column, at: Column, counts: Column, bits: int, part: list, order: list[str], equal: bool) -> Column:
    """The greatest `at` of counting rows before in order, within `part`, whose value is smaller
    (or equal too)."""
    before = lambda *more: Window.partitionBy(*part, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = [F.lit(None).cast("long")] * 2
    for shift in range(0, bits, DIGIT):
        wide = min(DIGIT, bits - shift)
        digit = F.shiftright(value, shift).bitwiseAND(F.lit((1 << wide) - 1))
        above = before(F.shiftright(value, shift + wide)) if shift + wide < bits else before()
        last = equal and shift == 0
        found += [F.when(digit >= d if last else digit > d, F.max(F.when((digit == d) & counts, at)).over(above)) for d in range((1 << wide) - (not last))]
    if equal and not bits:
        found.append(F.max(F.when(counts, at)).over(before()))
    return F.greatest(*found)


def nearest_smaller(rows: DataFrame, keys: list[str], order: str, value: str, *, ahead: bool = False, equal: bool = False, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows with `near`: the place, in column `order`, of the nearest row of the same keys
    before (or ahead) with a smaller (or equal) value; null where there is none.

    Places are whole numbers, values whole numbers from 0 that fit into `bits` bits (found by a
    pass over the rows where not given). A row without a value or place finds nothing and is
    found by nothing. Null keys are keys. Of rows at one place each may find the others.
    A group of many blocks lies in as many tasks; only its blocks' open rows come together."""
    if bits is None:
        bits = bits_of(rows, value)
    place = F.col(order).cast("long")
    own = rows.withColumn("_at", -place if ahead else place).withColumn("_v", F.col(value).cast("int"))
    own = own.withColumn("_block", F.floor(F.col("_at") / block)).repartition(*keys, "_block")
    at, v, seen = F.col("_at"), F.col("_v"), F.col("_v").isNotNull() & F.col("_at").isNotNull()
    own = own.withColumn("_near", F.when(seen, _last_smaller(v, at, seen, bits, [*keys, "_block"], ["_at"], equal)))

    # of each value in a block its last place, and whether a row of it is still without an answer
    summed = own.groupBy(*keys, "_block", "_v").agg(F.max(F.when(seen, at)).alias("_at"), F.max(seen & F.col("_near").isNull()).alias("_asks"))
    # a place is open where no smaller value of the block follows
    below = F.max("_at").over(Window.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    summed = summed.withColumn("_below", below).where("_at is not null")
    still = F.col("_below").isNull() | (F.col("_below") < at)
    roles = F.array_compact(F.array(F.when(still, F.lit(True)), F.when(F.col("_asks"), F.lit(False))))
    both = summed.select(*keys, "_block", "_v", "_at", F.explode(roles).alias("_open"))
    # questions of a block stand before its own open rows
    far = _last_smaller(v, at, F.col("_open"), bits, list(keys), ["_block", "_open"], equal)
    answers = both.withColumn("_far", far).where("not _open and _far is not null")
    answers = answers.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), F.col("_v").alias("_w"), "_far")
    same = (F.col("_block") == F.col("_b")) & (F.col("_v") == F.col("_w"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = F.coalesce("_near", "_far")
    return own.join(answers.hint("merge"), same, "left").withColumn("near", (-near if ahead else near).cast(rows.schema[order].dataType)).select(*rows.columns, "near")
