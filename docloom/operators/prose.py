"""Prose quality of documents, in one pass over each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fx


def summary(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """The columns of `keep` and passive, weasel (hits), words, syllables, readability, grade of
    each row of `docs` (text). Nothing is shuffled, and each count is taken once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(*keep, F.size(fx.passive_hits(text)).alias("passive"), F.size(fx.weasel_hits(text)).alias("weasel"), fx.word_count(text).alias("words"), F.regexp_count(text, F.lit("[.!?]")).alias("stops"), fx.syllables(text).alias("syllables"))
    score = fx.reading_ease(F.col("words"), F.col("stops"), F.col("syllables"))
    scored = counted.withColumn("readability", score)
    return scored.select(*(c for c in scored.columns if c != "stops"), fx.grade(F.col("readability")).alias("grade"))
