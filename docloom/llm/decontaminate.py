"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

Each item gives windows of ten consecutive words (a shorter item is one window). The
shingles of a window are ordered by how rare they are over all documents; as a whole
window must be contained, a prefix of one shingle, the rarest, is necessary. Document
positions join on it; length and position bounds drop what can't hold the window, and
the window's words are compared exactly. DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stored, ascii_lower, quoted, sieve, split_join

#: Words of a window.
WINDOW = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
#: Benchmarks of at most so many bytes of text are broadcast (their windows hold ten
#: times that); larger ones are joined by shuffle.
BROADCAST_BYTES = 4_000_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; empty for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BREAKS), ""), F.array().cast("array<string>"))


def _at(array: str, start: str, k: int) -> str:
    return ", ".join(f"get({array}, {start} + {i})" for i in range(k))


def _key(array: str, start: str, left: str) -> str:
    """A shingle's key: the hash of the SHINGLE words from `start`, or of all `left` words if fewer.

    `left` bounds the words; the count goes into the hash, so that lengths never meet."""
    full = f"xxhash64({SHINGLE}, {_at(array, start, SHINGLE)})"
    short = "".join(f" WHEN {left} = {k} THEN xxhash64({k}, {_at(array, start, k)})" for k in range(1, SHINGLE))
    return f"CASE WHEN {left} >= {SHINGLE} THEN {full}{short} END"


def windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """win (words), items (distinct ids as strings, sorted), len: the distinct windows of all items."""
    own = items.select(F.col(quoted(id_col)).cast("string").alias("item"), words(F.col(quoted(text_col))).alias("ws")).where("size(ws) > 0")
    each = own.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - size + 1)))).select("item", F.slice("ws", F.col("at"), size).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("win"))


def _shingles(wins: DataFrame) -> DataFrame:
    """A row for each shingle of each window: key and offset."""
    return wins.withColumn("off", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("len") - SHINGLE)))).withColumn("key", F.expr(_key("win", "off", "len")))


def _positions(docs: DataFrame) -> DataFrame:
    """Each word position of each document with the keys of the shingles that start there."""
    return docs.withColumn("at", F.explode(F.sequence(F.lit(-1), F.size("ws") - 1)))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The id column, n_words, n_hit, items (ids of items with occurring windows, as sorted
    strings), spans (start and length of each occurrence), text_hash (xxhash64 of the
    text) for each row of `docs`.

    A null or wordless text has no words and no hit; a null or wordless item no window.
    Rows that repeat an id and text are judged once and returned as often as they are
    there; a null id is a value like another. Other columns are not read.
    """
    wins = Stored(windows(items, id_col=item_id, text_col=item_text, size=size)).df
    grams = Stored(_shingles(wins)).df
    small = (items.agg(F.sum(F.octet_length(quoted(item_text)))).first()[0] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), words(F.col(quoted(text_col))).alias("ws"))
    lens = [k for k in range(1, SHINGLE) if small is False or wins.where(F.col("len") == k).take(1)] + [SHINGLE]
    key = lambda k: F.expr(f"CASE WHEN at >= 0 AND at + {k} <= size(ws) THEN xxhash64({k}, {_at('ws', 'at', k)}) END")

    # how often each shingle of the benchmark is in the documents
    keys = grams.select("key").distinct()
    rows = _positions(base.select("ws"))
    rows = rows.select(key(SHINGLE).alias("key")) if lens == [SHINGLE] else rows.select(F.explode(F.array(*map(key, lens))).alias("key"))
    rows = rows.where("key is not null")
    rows = rows if small else sieve(rows, F.col("key"), keys)  # most places hold no shingle of the benchmark and stay where they are
    counts = rows.join(hint(keys), "key", "left_semi" if not small else "inner").groupBy("key").agg(F.count("*").alias("n"))
    counts = Stored(counts).df  # a row for each of the benchmark's shingles
    rare = grams.join(counts, "key", "left").groupBy("win", "items", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "key")).alias("p"))
    prefix = Stored(rare.where("p.n > 0").select("p.key", "p.off", "win", "items", "len")).df

    # candidates by prefix, then length and position bounds, then the words themselves
    ident = base.select("id", F.xxhash64("text").alias("hash"), "ws")
    spots = _positions(ident)
    spots = spots.withColumn("key", key(SHINGLE)) if lens == [SHINGLE] else spots.withColumn("key", F.explode(F.when(F.col("at") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*map(key, lens)))))
    fits = "at >= off AND at - off + len <= size(ws)"
    same = "slice(ws, greatest(at - off, 0) + 1, len) = win"
    if small:
        met = spots.where("at < 0 OR key IS NOT NULL").join(hint(prefix), "key", "left").where(f"at < 0 OR ({fits} AND {same})")
        met = met.select("id", "hash", F.when(F.col("at") < 0, F.size("ws")).alias("n_words"), (F.col("at") - F.col("off")).alias("start"), "len", "items")
    else:
        own = spots.where("key IS NOT NULL").select("id", "hash", "key", "at", F.size("ws").alias("n"))
        own = sieve(own, F.col("key"), prefix.select("key").distinct())
        cand = split_join(own, prefix, "key", counts).where("at >= off AND at - off + len <= n")
        texts = ident.groupBy("id", "hash").agg(F.first("ws").alias("ws"))
        true = cand.join(texts, cand["id"].eqNullSafe(texts["id"]) & (cand["hash"] == texts["hash"])).where(same).select(cand["id"], cand["hash"], F.lit(None).cast("int").alias("n_words"), (F.col("at") - F.col("off")).alias("start"), "len", "items")
        met = true.unionByName(ident.select("id", "hash", F.size("ws").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items")))
    found = met.groupBy("id", "hash").agg(
        F.coalesce(F.max("n_words"), F.lit(0)).alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("hit"), F.greatest(a["end"], s["start"] + s["len"]).alias("end")),
        lambda a: a["hit"],
    )
    out = found.withColumn("n_hit", covered)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "items", "spans", F.col("hash").alias("text_hash"))
