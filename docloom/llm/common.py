"""Shared pieces of the training-data operators: names, Arrow row maps, word hashing, joins
with hot keys, sieves and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.store import Stored, result, scope, shared_dir, stored  # noqa: F401

#: Rows that a Python worker turns into output at once; bounds its memory, not its results.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, taken: list[str]) -> str:
    """The name with as many signs before it as make it differ from those that are taken."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def map_slices(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Runs `make()` once in each task; what it returns gets the columns of `df` as lists,
    at most `rows` rows at a time, and returns the output columns as lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                cols = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, struct)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words with full avalanche (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words (bytes), remembered up to `most` words; then it starts anew."""

    def __init__(self, most: int = 200_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        get = seen.get
        got = list(map(get, words))
        if None in got:
            digest = xxhash.xxh3_64_intdigest
            for i, h in enumerate(got):
                if h is None:
                    w = words[i]
                    h = get(w)
                    if h is None:
                        seen[w] = h = digest(w)
                    got[i] = h
        return np.fromiter(got, np.uint64, len(got))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take Spark's fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: node, component (its least node).

    Large-star and small-star steps alternate until the edges are stars around the
    least node; no step collects nodes or edges, and a node's neighbours are only
    aggregated and joined, never gathered into a list. Edges between a node and
    itself, and those with a null end, are ignored.
    """
    x, y = F.col(a), F.col(b)
    now = Stored(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    mark = _mark(now.df)
    while mark[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        then = Stored(small)
        now.drop()
        now, before = then, mark
        mark = _mark(now.df)
        if mark == before:
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Most words of the bitmap that sieve() broadcasts (64 bits each), and the least.
SIEVE_WORDS, LEAST_WORDS = 1 << 20, 1 << 12
#: Bits of the bitmap for each key, at least.
SIEVE_BITS = 2


def sieve(df: DataFrame, key: Column, keys: DataFrame, keep: str = "left_semi", most: int | None = None) -> DataFrame:
    """The rows of `df` whose key may be among `keys` (one column), by a broadcast bitmap with
    at least SIEVE_BITS bits a key: no row of a present key is lost, and at most two in five
    of the others pass. "left_anti" gives the other rows.

    `most` says how many keys there may be, else they are counted. Where a bitmap of
    SIEVE_WORDS words is too small for them the keys themselves are joined, by a shuffle, and
    only rows of present keys pass."""
    most = keys.count() if most is None else most
    words = LEAST_WORDS
    while words * 64 < most * SIEVE_BITS and words < SIEVE_WORDS:
        words *= 2
    one, name = F.xxhash64(F.col(keys.columns[0])), unused("_key", df.columns)
    if words * 64 < most * SIEVE_BITS:
        held = keys.select(F.col(keys.columns[0]).alias(name)).distinct()
        return df.join(held, key == held[name], keep)
    bits = keys.select(F.pmod(one, F.lit(words)).alias("_word"), F.shiftrightunsigned(one, 58).cast("int").alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    own = F.xxhash64(key)
    held = F.broadcast(bits)
    return df.join(held, (F.pmod(own, F.lit(words)) == held["_word"]) & (F.bit_get(held["_bits"], F.shiftrightunsigned(own, 58).cast("int")) == 1), keep)


#: A key is hot if it holds a HOT-th of all rows; so there are at most HOT hot keys.
HOT = 4096
#: Rows of a table that may be broadcast for hot keys.
HOT_ROWS = 200_000


def split_join(rows: DataFrame, table: DataFrame, key: str | list[str], sizes: DataFrame | None = None) -> DataFrame:
    """rows.join(table, key), where a few keys may hold most of the rows: the rows of hot keys
    meet the table's by broadcast and stay where they are, the others by a shuffle. `sizes`
    (key, n: rows of each key) is counted from the rows unless given. Should the table have
    over HOT_ROWS rows of hot keys, all are joined by a shuffle."""
    on = [key] if isinstance(key, str) else key
    sizes = sizes if sizes is not None else rows.groupBy(*on).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = Stored(sizes.where((F.col("n") > 1) & (F.col("n") * HOT >= total)).select(*on)).df  # HOT rows at most
    if hot.isEmpty():
        return rows.join(table, on)
    met = Stored(table.join(F.broadcast(hot), on, "left_semi")).df
    if met.count() > HOT_ROWS:
        return rows.join(table, on)
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(table.join(F.broadcast(hot), on, "left_anti"), on)
    return rows.join(F.broadcast(met), on).unionByName(rest)
