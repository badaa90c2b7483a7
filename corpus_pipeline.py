"""The training-data pipeline over `documents`: stages in order, each on what the one
before kept, each written as Parquet and read again.

A stage drops or rewrites whole rows of its own input. Ids to drop are few beside the
documents, so documents that a bitmap of the dropped ids rules out are passed on without
a shuffle, and only the others meet the ids themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, minhash, pieces, quality, substrings
from docloom.llm.catalogue import tokenizer_path
from docloom.llm.common import quoted, result, sieve, stored, table, unused


def _own(docs: DataFrame) -> list[str]:
    """The columns of documents, whatever their names are."""
    return [quoted(c) for c in docs.columns]


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """`docs` without the rows whose key is in `gone` (one stored column `key`, no nulls)."""
    name = unused("_gone", docs.columns)
    held = gone.withColumnRenamed("key", name)
    left = sieve(docs, key, gone).join(held, key == held[name], "left_anti")
    return sieve(docs, key, gone, "left_anti").unionByName(left)


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows that repeat id and text, the one with the least hash of all columns."""
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(_own(docs))))
    hashed = F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in docs.schema[at].dataType.simpleString() else F.col(c) for at, c in enumerate(_own(docs))))
    kept = docs.groupBy("doc_id", "text").agg(F.min_by(row, hashed).alias("row"))
    return kept.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good and not toxic."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("accepted").select(*_own(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near-duplicates; of rows that repeat
    id and text, the one with the least hash. Documents without an id stay; several texts of
    an id are judged each."""
    found = stored(minhash.near_duplicates(docs, percent=80).select("doc_id", "text_hash", "kept"))
    gone = stored(found.where("not kept").select(F.xxhash64("doc_id", "text_hash").alias("key")).distinct())
    left = _without(docs, F.xxhash64("doc_id", F.xxhash64("text")), gone)
    if found.where("doc_id is not null and kept").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return left
    return _one_of_each(left.where("doc_id is not null")).unionByName(left.where("doc_id is null"))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur again; a text without any stays as it is."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    out = substrings.remove_repeats(docs, carry=rest)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*_own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("n_hit > 0").select(F.xxhash64("doc_id", "text_hash").alias("key")).distinct())
    return _without(docs, F.xxhash64("doc_id", F.xxhash64("text")), gone)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each text that is left."""
    return pieces.encode(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("repeated passages", drop_passages),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

#: SQL can't express the first stage; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stores on its way goes when its documents are
    written, and these when the next stage's are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        then = result(stage, spark, docs, sf_dir)
        if before:
            before.drop()
        docs, before = then.df, then
    return STAGES[-1][1](spark, docs, sf_dir)
