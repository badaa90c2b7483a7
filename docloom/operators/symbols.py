"""Symbol search by an index of trigrams, kept as Parquet in a folder that outlives the session.

    names/part=p      name_id, name, places: symbols by a hash of their lower-cased name
    postings/part=p   gram, name_id: each three neighbouring characters with the names that hold them
    grams/part=p      gram, n: how long a gram's list is

A search reads the grams' lengths in the parts that its own grams fall in, then the lists of the
rarest of them, then the parts of the names that are in all of these, and verifies each name. What
the index yields is what a scan of all symbols yields (`graph.search_symbols`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of the index: folders that a search may leave unread.
PARTS = 64
#: Lists that a search intersects at most, and how many times as long as the shortest one they may be.
LISTS, TIMES = 8, 16


def grams(name: Column) -> Column:
    """The distinct runs of three characters of a text; none of a shorter one."""
    chars = F.split(name, "")
    at = F.sequence(F.lit(0), F.size(chars) - 3)
    runs = F.transform(at, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
    return F.when(F.length(name) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _write(rows: DataFrame, order: list[str], path: str) -> None:
    """Rows in ranges of (part, order): each task writes few parts, and a part of many rows, such
    as one gram's, is several tasks' work."""
    ranged = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    ranged.write.partitionBy("part").parquet(path)


def build(symbols: DataFrame, path: str, parts: int = PARTS) -> SymbolIndex:
    """An index of symbols (name and more) in a new folder; nameless symbols are left out. The
    texts behind `symbols` are read once."""
    spark = symbols.sparkSession
    named = symbols.where("name <> ''").withColumn("name_id", F.xxhash64(F.lower("name")))
    _write(named.withColumn("part", _part(F.col("name_id"), parts)), ["name_id"], f"{path}/names")
    names = spark.read.parquet(f"{path}/names").select(F.lower("name").alias("low"), "name_id").distinct()
    each = names.select(F.explode(grams(F.col("low"))).alias("gram"), "name_id").distinct()
    _write(each.withColumn("part", _part(F.col("gram"), parts)), ["gram", "name_id"], f"{path}/postings")
    lengths = spark.read.parquet(f"{path}/postings").groupBy("part", "gram").agg(F.count("*").alias("n"))
    _write(lengths, ["gram"], f"{path}/grams")
    return SymbolIndex(spark, path, parts)


class SymbolIndex:
    """An index that `build` wrote, with as many parts."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts
        self._tables: dict[str, DataFrame] = {}

    def _read(self, table: str) -> DataFrame:
        if table not in self._tables:  # files are listed once
            self._tables[table] = self.spark.read.parquet(f"{self.path}/{table}")
        return self._tables[table]

    def symbols(self) -> DataFrame:
        return self._read("names").drop("part", "name_id")

    def _of(self, table: str, wanted: list[str]) -> DataFrame:
        """The rows of some grams; the parts that they fall in are constants of the plan."""
        of = lambda gram: (F.col("part") == _part(F.lit(gram), self.parts)) & (F.col("gram") == gram)
        return self._read(table).where(reduce(Column.__or__, map(of, wanted)))

    def lists(self, query: str) -> list[tuple[str, int]]:
        """(gram, length) of the query's grams, the shortest lists first; that of a gram that no
        name holds is 0. At most as many as the query has characters."""
        low = query.lower()
        wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        length = {r.gram: r.n for r in self._of("grams", wanted).collect()} if wanted else {}
        return sorted(((x, length.get(x, 0)) for x in wanted), key=lambda x: (x[1], x[0]))

    def candidates(self, query: str) -> DataFrame | None:
        """name_id of the names that are in the shortest of the query's lists; None where the query
        has no grams (fewer than three characters)."""
        found = self.lists(query)
        if not found:
            return None
        used = [gram for gram, n in found[:LISTS] if n <= TIMES * found[0][1]]
        lists = [self._of("postings", [gram]).select("name_id") for gram in used]
        return reduce(lambda a, b: a.join(b, "name_id", "left_semi"), lists)

    def search(self, query: str) -> DataFrame:
        """The symbols whose name holds the query, whatever the case. A query of fewer than three
        characters has no grams: it is looked for in all names, an empty one yields all of them."""
        names, found = self._read("names"), self.candidates(query)
        if found is not None:
            ids = found.select("name_id", _part(F.col("name_id"), self.parts).alias("part"))
            names = names.join(ids, ["part", "name_id"], "left_semi")
        return names.where(F.lower("name").contains(query.lower())).drop("part", "name_id")
