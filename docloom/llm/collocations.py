"""Phrase collocation mining: how often phrases of two or three words occur in each language, and
how much more often than their parts would have it.

A phrase that counts holds only words that are as frequent themselves. So words are numbered first
in blocks of text, each with a dictionary of its own; the blocks' word counts add up to those
of the corpus, and frequent words of a language get a number of 32 bits. Each block learns the
numbers of its own words; other words break a piece as punctuation does. Every phrase is a key of
12 bytes, three numbers of which the last may be 0. Keys are sorted where they are made, by the
ranks of their numbers, which fit into 64 bits together; they are run-length counted and cut into
ranges. Each range is a partition, radix sorted and counted as a whole in one task. Ranges are
quantiles of a sample; they bear on balance alone, not on results.

No dictionary is broadcast or held whole by a task, and no step depends on how large it is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Stored, quoted

#: Least occurrences of a phrase, most phrases of a language, and the per cent of a phrase's
#: occurrences within a longer one that make it superfluous.
LEAST, TOP, WITHIN = 10, 2000, 50
#: Words of a block (and what its last text holds beyond), most keys sorted at once, also those
#: of a range before they are counted.
BLOCK, KEYS = 1 << 19, 1 << 21
#: Words whose keys are made at once, and bits of a number's rank among those sorted together.
STEP, BITS = 1 << 17, 21
#: Bytes of keys that a task hands on at once.
OUT = 1 << 22
#: Blocks that keys are sampled from to cut ranges, and keys taken of each.
SAMPLED, TAKEN = 32, 2048

ENDS = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of one language: its words in order as places in its own dictionary, 0 where a piece
    ends; the dictionary from place 1 on, and each word's count."""
    from pyspark import TaskContext

    kinds = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        held: dict[str, tuple[dict, list, list]] = {}

        def start():
            own = defaultdict(count().__next__)
            own[b"."]  # has place 0; it can't be a word
            return own, [], [0]

        def block(lang):
            own, parts, _ = held.pop(lang)
            tokens = np.concatenate(parts)
            n = np.bincount(tokens, minlength=len(own))[1:]
            words = [w.decode() for w in own][1:]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((next(number), lang, tokens.tobytes(), words, n, int(n.sum())), kinds, strict=True)], schema=kinds)

        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                words = (text or "").encode().lower().translate(ENDS).replace(b"\n", b" . ").split()
                if not words:
                    continue
                own, parts, n = held.get(lang) or held.setdefault(lang, start())
                words.append(b".")
                parts.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                n[0] += len(words)
                if n[0] >= BLOCK:
                    yield block(lang)
        for lang in list(held):
            yield block(lang)

    return docs.mapInArrow(run, "block long, lang string, tokens binary, words array<string>, counts array<long>, total long")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys (a column each, the highest word first), by 16 bits at a time."""
    order = np.arange(keys.shape[1], dtype=np.uint32)
    for word in keys[::-1]:
        for shift in (0, 16):
            digit = (word >> np.uint32(shift)).astype(np.uint16)  # a stable sort of 16 bits is a radix sort
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs, or the sum of their `n`."""
    order = radix_order(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for word in keys:  # one at a time: all sorted keys are never held
        word = word[order]
        new[1:] |= word[1:] != word[:-1]
    starts = np.flatnonzero(new)
    sums = np.diff(starts, append=len(order)) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n
    return np.take(keys, order[starts], axis=1), sums


def phrases_of(ids: np.ndarray, begin: int | None = None) -> np.ndarray:
    """The keys of all two and three words in a row without a break (0) among them, of those that
    begin in the first `begin` places."""
    ok = ids > 0
    two = ok[:-1] & ok[1:]
    three = np.flatnonzero((two[:-1] & two[1:])[:begin])
    two = np.flatnonzero(two[:begin])
    pairs = np.stack([ids[two], ids[two + 1], np.zeros(len(two), ids.dtype)])
    return np.concatenate([pairs, np.stack([ids[three], ids[three + 1], ids[three + 2]])], axis=1)


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Keys and counts byte by byte, all first bytes first, which compresses well when sorted."""
    return np.vstack([keys, n.astype(np.uint32)]).astype(">u4", order="C").view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, 4, -1).transpose(0, 2, 1)).view(">u4")[:, :, 0].astype(np.uint32)
    return both[:3], both[3].astype(np.int64)


def _sorted(held: list[tuple[np.ndarray, np.ndarray]], size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, of `size` in all, in order and their counts, of pieces given as their
    distinct numbers and where each place has its number among them."""
    ids = np.unique(np.concatenate([np.zeros(1, np.uint32), *(own for own, _ in held)]))
    keys, end = np.empty(size, np.uint64), 0
    for own, at in held:
        a, b, c = phrases_of(np.searchsorted(ids, own).astype(np.uint64)[at], step)
        keys[end : (end := end + len(a))] = a << np.uint64(2 * BITS) | b << np.uint64(BITS) | c
    keys.sort()
    new = np.ones(size, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    n, keys = np.diff(starts, append=size), keys[starts]
    del starts
    mask = np.uint64((1 << BITS) - 1)
    out = np.empty((3, len(keys)), np.uint32)
    for word, shift in zip(out, (2 * BITS, BITS, 0), strict=True):
        word[:] = ids[keys >> np.uint64(shift) & mask]
    return out, n


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block at a time (tokens, own), of rows in order of blocks: the place and number of each of
    its frequent words, then its tokens. Blocks without frequent words are left out."""
    ats, ids = [], []
    for batch in batches:
        at, number, tokens = (batch.column(c) for c in ("at", "id", "tokens"))
        start = 0
        for end in np.flatnonzero(tokens.is_valid().to_numpy(zero_copy_only=False)).tolist():
            ats.append(at.slice(start, end - start))
            ids.append(number.slice(start, end - start))
            if sum(map(len, ats)):
                own = pa.StructArray.from_arrays([pa.concat_arrays(ats), pa.concat_arrays(ids)], ["at", "id"])
                yield pa.RecordBatch.from_arrays([tokens.slice(end, 1), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["tokens", "own"])
            ats, ids, start = [], [], end + 1
        if start < batch.num_rows:
            ats.append(at.slice(start))
            ids.append(number.slice(start))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted and counted phrases of blocks (tokens, own: place and number of its frequent words)."""
    step = min(STEP, KEYS // 2)
    held, distinct, n = [], 1, 0
    for batch in batches:
        for i in range(batch.num_rows):
            tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.int32)
            own = batch.column("own")[i].values
            numbers = np.zeros(int(tokens.max()) + 1, np.uint32)
            numbers[own.field("at").to_numpy()] = own.field("id").to_numpy().astype(np.uint32)
            for start in range(0, len(tokens), step):
                ids, at = np.unique(numbers[tokens[start : start + step + 2]], return_inverse=True)
                ok = ids[at] > 0
                two = ok[:-1] & ok[1:]
                more = int(np.count_nonzero(two[:step]) + np.count_nonzero((two[:-1] & two[1:])[:step]))
                if not more:
                    continue
                if n and (n + more > KEYS or distinct + len(ids) > 1 << BITS):
                    yield _sorted(held, n, step)
                    held, distinct, n = [], 1, 0
                held.append((ids, at.astype(np.int32)))
                distinct, n = distinct + len(ids), n + more
    if n:
        yield _sorted(held, n, step)


def _cut(keys: np.ndarray, borders: np.ndarray) -> list[int]:
    """Where in sorted keys each border's keys begin."""
    out = []
    for border in borders.T:
        low, up = 0, keys.shape[1]
        for word, x in zip(keys, border, strict=True):
            low, up = low + np.searchsorted(word[low:up], x, "left"), low + np.searchsorted(word[low:up], x, "right")
        out.append(int(low))
    return out


def _numbered(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id of words that occur `least` times or more; ids count from 1. The parts of
    the counted table are numbered one behind the other, so no row moves for it."""
    spark = words.sparkSession
    counted = Stored(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("mid", F.monotonically_increasing_id())).df
    sizes = sorted(counted.groupBy(F.shiftright("mid", 33).alias("part")).count().collect())  # a row a part
    ends = np.cumsum([r["count"] for r in sizes]).tolist()
    if ends and ends[-1] >= 1 << 32:
        raise ValueError("more frequent words than numbers of 32 bits")
    bases = spark.createDataFrame([(r["part"], e - r["count"]) for r, e in zip(sizes, ends, strict=True)], "part long, base long")
    return counted.join(F.broadcast(bases), F.shiftright("mid", 33) == F.col("part")).select("lang", "word", "f", (F.expr("base + (mid & 8589934591)") + 1).alias("id"))


def _grams(blocks: DataFrame, words: DataFrame, numbered: DataFrame, total: int, least: int) -> DataFrame:
    """a, b, c (0: none), n of the phrases that occur `least` times or more."""
    spark = blocks.sparkSession

    def joined(only):  # rows as _whole() takes them: a batch has few blocks, whatever a task has
        own = words.where(only).join(numbered, ["lang", "word"]).select("block", F.col("at").cast("long").alias("at"), "id", F.lit(None).cast("binary").alias("tokens"))
        none = F.lit(None).cast("long")
        rows = own.unionByName(blocks.where(only).select("block", none.alias("at"), none.alias("id"), "tokens"))
        return rows.repartition("block").sortWithinPartitions("block", F.col("at").asc_nulls_last()).select("at", "id", "tokens")

    def sample(batches):
        for keys, _ in _counted(_whole(batches)):
            took = keys[:, :: max(1, keys.shape[1] // TAKEN)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in took], ["a", "b", "c"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, -(-2 * total // KEYS))
    some = [r.block for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLED).collect()]
    seen = joined(F.col("block").isin(some)).mapInArrow(sample, "a long, b long, c long").toPandas().to_numpy(np.uint32).T
    borders = seen[:, radix_order(seen)][:, [seen.shape[1] * i // ranges for i in range(1, ranges)]] if seen.shape[1] else np.empty((3, 0), np.uint32)

    def cut(batches):
        def handed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["range", "data"])

        for keys, n in _counted(_whole(batches)):
            ends = [0, *_cut(keys, borders), keys.shape[1]]
            rows, size = [], 0
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    rows.append((i, _packed(keys[:, a:b], n[a:b])))
                    size += len(rows[-1][1])
                if size >= OUT:
                    yield handed(rows)
                    rows, size = [], 0
            if rows:
                yield handed(rows)
            del keys, n, rows  # before the next are sorted

    def add(batches):
        def whole(held):
            ends = np.cumsum([0, *(d.size // 16 for d in held)]).tolist()
            keys, n = np.empty((3, ends[-1]), np.uint32), np.empty(ends[-1], np.int64)
            for a, b, d in zip(ends, ends[1:], held, strict=False):
                keys[:, a:b], n[a:b] = _unpacked(d)
            keys, n = run_lengths(keys, n)
            often = n >= least
            return pa.RecordBatch.from_arrays([*(pa.array(k[often], pa.int64()) for k in keys), pa.array(n[often], pa.int64())], ["a", "b", "c", "n"])

        at, held = None, []
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != at and held:
                    yield whole(held)
                    held = []
                at = r
                held.append(data.as_buffer())
        if held:
            yield whole(held)

    made = joined(F.lit(True)).mapInArrow(cut, "range int, data binary")
    dealt = made.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    return dealt.mapInArrow(add, "a long, b long, c long, n long")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, within: int = WITHIN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by falling score,
    then falling count, then phrase in the order of its UTF-8 bytes.

    Texts are lower-cased in A-Z, cut into pieces at .,;:!? and line ends and these into words at
    spaces and tabs. A phrase has two or three words of one piece and occurs a times, at least
    `least`; cut after one of its words, its first part occurs l times and the rest r times, and the
    score of the cut, floor(1000000 * a * a / (l * r)), is the least of its cuts (of equal ones
    the first). n is the number of words of the language. A phrase is left out if `within` per
    cent of its occurrences, at least, may lie within one longer phrase. Numbers are exact.

    A null text has no words, a null language is `und`; repeated rows count each; other columns
    are not read; without phrases there are no rows."""
    rows = docs.select(F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text_col)).alias("text"))
    blocks = Stored(_blocks(rows)).df
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("block", "lang", (F.col("pos") + 1).alias("at"), F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    sizes = blocks.groupBy("lang").agg(F.sum("total").alias("n_words"))
    total = blocks.agg(F.sum("total")).first()[0] or 0
    numbered = Stored(_numbered(words, least)).df
    grams = Stored(_grams(blocks, words, numbered, total, least)).df

    def word(at, *more):
        return numbered.select(F.col("id").alias(at), F.col("word").alias(f"{at}_word"), F.col("f").alias(f"{at}_n"), *more)

    two, three = grams.where("c = 0").select("a", "b", "n"), grams.where("c > 0")
    longer = three.select("a", "b", "n").unionByName(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("most"))
    score = "cast(1000000 as decimal(7,0)) * cast(n as decimal(19,0)) * cast(n as decimal(19,0)) div (cast({} as decimal(19,0)) * cast({} as decimal(19,0)))"
    pairs = two.join(longer, ["a", "b"], "left").where(f"most is null or 100 * most < {within} * n")
    pairs = pairs.join(word("a", "lang"), "a").join(word("b"), "b")
    pairs = pairs.select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("n").alias("a"), F.col("a_n").alias("l"), F.col("b_n").alias("r"), F.expr(score.format("a_n", "b_n")).alias("score"))
    head, tail = two.withColumnRenamed("n", "ab_n"), two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc_n"))
    triples = three.join(head, ["a", "b"]).join(tail, ["b", "c"]).join(word("a", "lang"), "a").join(word("b"), "b").join(word("c"), "c")
    triples = triples.withColumn("first", F.expr(score.format("a_n", "bc_n"))).withColumn("second", F.expr(score.format("ab_n", "c_n"))).withColumn("k", F.col("first") <= F.col("second"))
    triples = triples.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("n").alias("a"), F.expr("if(k, a_n, ab_n)").alias("l"), F.expr("if(k, bc_n, c_n)").alias("r"), F.least("first", "second").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
