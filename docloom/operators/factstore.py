"""What texts yield, kept by their content: a text that was seen before is not parsed again.

    facts/g=N      hash, ln, kind, name, value, col, level: what contents first seen then yield
    hashes/g=N     hash: contents first seen then, also those that yield nothing
    documents/g=N  uri, load_ord, hash: all documents of a generation

A generation counts once its documents are written, which is done last; what a broken run left
behind is written over by the next. Facts are read through the newest generation's documents, so
those of texts that are gone are left out, and come back with the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import lines as ln
from docloom.operators.graph import Workspace

HASH = "hash string"
FACTS = f"{HASH}, ln int, kind string, name string, value string, col int, level int"


@dataclass(frozen=True)
class Update:
    """A generation's number and how many contents were parsed for it."""

    generation: int
    parsed: int


class FactStore:
    """The facts of a workspace's generations in a folder that driver and executors share. One
    writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def generations(self) -> list[int]:
        """Numbers of the generations that are whole, in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents/g=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)

    def _read(self, table: str, schema: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{table}/g={n}" for n in numbers))

    def update(self, docs: DataFrame) -> Update:
        """Takes documents (uri, load_ord, text) as the next generation. Texts are read and hashed;
        one document of each content that no generation has seen is parsed. A null text counts as
        an empty one."""
        seen = self.generations()
        n = seen[-1] + 1 if seen else 0
        hashed = docs.select("uri", "load_ord", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
        known = self._read("hashes", HASH, seen)
        new = hashed.select("hash").distinct().join(known, "hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/hashes/g={n}")
        new = self._read("hashes", HASH, [n])
        count = new.count()
        if count:
            # of documents that share a new text the one with the least name is parsed
            first = hashed.join(new, "hash", "left_semi").groupBy("hash").agg(F.min("uri").alias("uri"), F.min_by("text", "uri").alias("text"), F.max("text").alias("any"))
            texts = first.select(F.col("hash").alias("uri"), F.lit(0).cast("long").alias("load_ord"), F.coalesce("text", "any").alias("text"))
            made = ln.facts(ln.lines(texts)).select(F.col("uri").alias("hash"), "ln", "kind", "name", "value", "col", "level")
        else:
            made = self.spark.createDataFrame([], FACTS)
        made.write.mode("overwrite").parquet(f"{self.path}/facts/g={n}")
        hashed.select("uri", "load_ord", "hash").write.mode("overwrite").parquet(f"{self.path}/documents/g={n}")
        return Update(n, count)

    def documents(self, generation: int | None = None) -> DataFrame:
        """uri, load_ord, hash of a generation, the newest unless told."""
        numbers = self.generations()
        return self._read("documents", f"uri string, load_ord long, {HASH}", numbers[-1:] if generation is None else [generation])

    def workspace(self, generation: int | None = None) -> Workspace:
        """The workspace of a generation: its rules read facts, no text is parsed. Its documents
        have no text, so rules on prose need the texts themselves."""
        docs = self.documents(generation)
        facts = self._read("facts", FACTS, self.generations()).join(docs, "hash").drop("hash")
        return Workspace(docs.drop("hash"), facts.select("uri", "load_ord", "ln", "kind", "name", "value", "col", "level"))

    def changes(self, old: int, new: int) -> DataFrame:
        """uri, change (added, removed, changed) between two generations; a document in both with
        one content is left out."""
        then = self.documents(old).groupBy("uri").agg(F.array_sort(F.collect_set("hash")).alias("before"))
        now = self.documents(new).groupBy("uri").agg(F.array_sort(F.collect_set("hash")).alias("after"))
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
        return then.join(now, "uri", "full").select("uri", change.alias("change")).where("change is not null")

    def compact(self) -> None:
        """Keeps the newest generation alone: a new one of its documents and of the facts of their
        contents; the older ones' folders go after it is whole."""
        numbers = self.generations()
        if not numbers:
            return
        n, docs = numbers[-1] + 1, self.documents()
        live = docs.select("hash").distinct()
        self._read("facts", FACTS, numbers).join(live, "hash", "left_semi").write.mode("overwrite").parquet(f"{self.path}/facts/g={n}")
        live.write.mode("overwrite").parquet(f"{self.path}/hashes/g={n}")
        docs.write.mode("overwrite").parquet(f"{self.path}/documents/g={n}")
        files = self.spark._jvm.org.apache.hadoop.fs
        for number in numbers:
            for table in ("documents", "facts", "hashes"):  # in this order: a generation without documents counts no more
                at = files.Path(f"{self.path}/{table}/g={number}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
