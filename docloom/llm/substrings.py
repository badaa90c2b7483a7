"""Substring dedup: words covered by a passage that occurs anywhere else are removed.

Every window of `size` words has one minimizer, the least hash among its k-grams, which
its content alone decides; so equal windows meet at equal minimizers. Windows in a row
with one minimizer form a run, whose context are the words they cover. A run whose
minimizer occurs once holds no repeat; one whose whole context occurs again is a repeat
throughout. What is left are contexts that share a minimizer but differ: these are the
reference shards. Each shard's suffix automaton, with occurrence counts, is built once;
the contexts are streamed through it for matching statistics, and the spans of at least
`size` words that occur twice or more are removed. Shards are routed to their contexts
rather than broadcast to all documents, as every document would otherwise meet every
shard, which is quadratic. A minimizer with more than SHARD differing contexts is
decided by exact counts of its windows instead, so that no task holds an unbounded shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Stored, WordHashes, map_slices, mix64, quoted, sieve
from docloom.llm.shingles import PLACES

#: Words of a passage, and of the k-grams that minimizers are chosen from.
SIZE, GRAM = 35, 8
#: Most differing contexts of a minimizer that make up one shard.
SHARD = 256
#: Least number of parts into which the occurrences of a context are dealt by document.
SALTS = 64
#: Rows of which one in CROWD of all repeated rows is a copy get their spans by broadcast.
CROWD = 256
#: Most windows of a document whose minimizers are found at once.
CHUNK = 1 << 19
BASE = np.uint64(0x5851F42D4C957F2D)


def _poly(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of w[i] * BASE**i and the powers of BASE's inverse, modulo 2**64."""
    n = len(w)
    up, down = np.full(n, BASE), np.full(n + 1, np.uint64(pow(int(BASE), -1, 2**64)))
    if n:
        up[0] = 1
    down[0] = 1
    return np.concatenate([[np.uint64(0)], np.cumsum(w * np.cumprod(up, dtype=np.uint64), dtype=np.uint64)]), np.cumprod(down, dtype=np.uint64)


def span_hashes(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words start..end-1 for each pair, from the words' hashes."""
    sums, down = _poly(w)
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def runs(w: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """h (minimizer), c (context hash), a and b (first and last window start) of each run."""
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        grams += w[i : i + len(grams)] * PLACES[i]
    grams = mix64(grams)
    span, low = size - k + 1, np.uint64((1 << 20) - 1)
    at = []
    for start in range(0, n, CHUNK):
        part = grams[start : min(n, start + CHUNK) + span - 1]
        v = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have * 2 <= span:
            v = np.minimum(v[:-have], v[have:])
            have *= 2
        if have < span:
            v = np.minimum(v[: len(part) - span + 1], v[span - have : len(part) - have + 1])
        at.append((v & low).astype(np.int64) + start)
    at = np.concatenate(at)
    a = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    b = np.concatenate([a[1:] - 1, [n - 1]])
    return grams[at[a]], span_hashes(w, a, b + size), a, b


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _runs_of(docs: DataFrame, kind: str, size: int, k: int) -> DataFrame:
    def make():
        hashes = WordHashes()

        def work(uids, texts, copies):
            own, times, parts = [], [], [[], [], [], []]
            for uid, text, m in zip(uids, texts, copies, strict=True):
                words = _words(text)
                if len(words) >= size:
                    found = runs(hashes(words), size, k)
                    own += [uid] * len(found[0])
                    times += [m] * len(found[0])
                    for p, f in zip(parts, found, strict=True):
                        p.append(f)
            h, c, a, b = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
            return [own, times, h.view(np.int64), c.view(np.int64), a.astype(np.int32), b.astype(np.int32)]

        return work

    return map_slices(docs.select("uid", "text", "m"), make, f"uid {kind}, m long, h long, c long, a int, b int")


class Automaton:
    """A suffix automaton of several word sequences with occurrence counts."""

    def __init__(self):
        self.next, self.link, self.len, self.count = [{}], [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.len, self.count
        last = 0
        for x in words:
            q = nxt[last].get(x)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                if q is None:
                    new = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    count.append(0)
                    p = last
                    while p >= 0 and x not in nxt[p]:
                        nxt[p][x] = new
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][x]
                        link[new] = q if length[q] == length[p] + 1 else self._split(p, q, x)
                    last = new
                else:
                    last = self._split(last, q, x)
            count[last] += weight

    def _split(self, p: int, q: int, x) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.count.append(0)
        link[q] = copy
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Adds up counts along suffix links."""
        length, link, count = self.len, self.link, self.count
        for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            if link[v] > 0:
                count[link[v]] += count[v]

    def repeats(self, words: list, size: int) -> list[int]:
        """Starts of the windows of `size` words that the sequences hold twice or more: the
        longest match behind each word is cut back to what occurs twice."""
        nxt, link, length, count = self.next, self.link, self.len, self.count
        v, have, out = 0, 0, []
        for i, x in enumerate(words):
            while v and x not in nxt[v]:
                v = link[v]
                have = length[v]
            if x in nxt[v]:
                v = nxt[v][x]
                have += 1
            while v and count[v] < 2:
                v = link[v]
                have = length[v]
            if have >= size:
                out.append(i - size + 1)
        return out


def _spans(starts: list[int], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], s + size
        else:
            out.append((s, s + size))
    return out


def _contexts(docs: DataFrame, wanted: DataFrame, kind: str, size: int) -> DataFrame:
    """The words of each wanted context (uid, h, a, b, n, hot); of hot ones each window alone."""
    by = wanted.groupBy("uid").agg(F.collect_list(F.struct("h", "a", "b", "n", "hot")).alias("own"))
    met = sieve(docs, F.col("uid"), wanted.select("uid")).join(by, "uid").select("uid", "text", "own")

    def make():
        hashes = WordHashes()

        def work(uids, texts, owns):
            out = [[] for _ in range(7)]
            for uid, text, own in zip(uids, texts, owns, strict=True):
                words = _words(text)
                w = hashes(words) if any(o["hot"] for o in own) else None
                for o in own:
                    a, b = o["a"], o["b"]
                    if o["hot"]:
                        at = np.arange(a, b + 1)
                        for s, g in zip(at.tolist(), span_hashes(w, at, at + size).view(np.int64).tolist(), strict=True):
                            for col, x in zip(out, (uid, o["h"], g, s, o["n"], True, None), strict=True):
                                col.append(x)
                    else:
                        for col, x in zip(out, (uid, o["h"], 0, a, o["n"], False, b" ".join(words[a : b + size]).decode("utf-8", "surrogatepass")), strict=True):
                            col.append(x)
            return out

        return work

    return map_slices(met, make, f"uid {kind}, h long, g long, a int, n long, hot boolean, words string", rows=64)


def _matched(contexts: DataFrame, kind: str, size: int) -> DataFrame:
    """uid, s, e: repeated spans of the contexts that stand alone, by the automaton of their shard."""
    import pyarrow as pa

    rows = contexts.where("not hot").select("h", "uid", "a", "n", "words")
    arrow_kind = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind]

    def run(batches):
        h, held, out = None, [], []

        def shard():
            if len(held) < 2 and (not held or held[0][2] < 2):
                return
            automaton = Automaton()
            split = [x[3].encode("utf-8", "surrogatepass").split() for x in held]
            for x, words in zip(held, split, strict=True):
                automaton.add(words, min(x[2], 2))
            automaton.finish()
            for x, words in zip(held, split, strict=True):
                if x[2] == 1:
                    out.extend((x[0], x[1] + s, x[1] + e) for s, e in _spans(automaton.repeats(words, size), size))

        def batch():
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["uid", "s", "e"])

        for got in batches:
            for start in range(0, got.num_rows, 1024):
                for key, uid, a, n, words in zip(*(c.to_pylist() for c in got.slice(start, 1024).columns), strict=True):
                    if key != h:
                        shard()
                        h, held = key, []
                    held.append((uid, a, n, words))
                if len(out) > 4096:
                    yield batch()
        shard()
        yield batch()

    return rows.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(run, f"uid {kind}, s int, e int")


def repeated_spans(docs: DataFrame, *, size: int = SIZE, k: int = GRAM) -> DataFrame:
    """uid, spans for those rows of `docs` (uid, text, m: how often the row occurs) that have
    repeated windows; the spans (s, e: words s to e - 1) may touch or overlap. No uid may be
    there twice."""
    kind = docs.schema["uid"].dataType.simpleString()
    all_runs = Stored(_runs_of(docs, kind, size, k)).df
    shared = all_runs.groupBy("h").agg(F.sum("m").alias("n")).where("n > 1").select("h")
    # a context that occurs twice within a part is repeated, so a common one needs no join; there
    # are as many parts as keep both a common context's part and what is left to join small
    n_runs = all_runs.count()
    salts = max(SALTS, int(n_runs**0.5))
    here = F.sum("m").over(Window.partitionBy("h", "c", F.pmod(F.xxhash64("uid"), F.lit(salts))))
    cand = Stored(sieve(all_runs, F.col("h"), shared, most=n_runs // 2).withColumn("here", here)).df  # and a few others, which total leaves out
    contexts = Stored(cand.groupBy("h", "c").agg(F.sum("m").alias("n"), F.min(F.struct("uid", "a", "b")).alias("o")).select("h", "c", "n", "o.*")).df
    groups = contexts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("g")).where("total > 1").select("h", "g", (F.col("g") > SHARD).alias("hot"))
    known = Stored(contexts.join(groups, "h")).df
    parts = Stored(_contexts(docs, known.where("g > 1"), kind, size)).df

    alone = cand.where("here = 1").join(known.where("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    whole = cand.where("here > 1").select("uid", "a", "b").unionByName(alone.select("uid", "a", "b")).select("uid", F.col("a").alias("s"), (F.col("b") + size).alias("e"))
    windows = parts.where("hot").groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g")
    counted = parts.where("hot and n = 1").join(windows, ["h", "g"], "left_semi").select("uid", F.col("a").alias("s"), (F.col("a") + size).alias("e"))
    spans = whole.unionByName(counted).unionByName(_matched(parts, kind, size))
    return spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """The id column, n_words, n_removed, kept (the other words, one space between) and the
    columns of `carry` for each row of `docs`. Words are what ASCII white space parts, unchanged.

    Every occurrence of a repeated passage is removed, the first too, and within one
    document as across documents. A null or blank text has no words. Repeated rows are
    occurrences like others and are returned each; rows of one id and text are looked at once,
    weighed by their number. Null ids are values like others.
    Other columns are not read.
    """
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), *(F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry)))
    more = base.columns[2:]
    kind = base.schema["id"].dataType.simpleString()
    single = kind in ("bigint", "string", "int") and base.groupBy("id").count().where("id is null or count > 1").isEmpty()
    keyed = base.withColumn("uid", F.col("id") if single else F.xxhash64("id", "text"))
    named = lambda df, spans: df.select("id", "text", spans.alias("spans"), *more)
    none, once, rest = F.lit(None).cast("array<struct<s:int,e:int>>"), F.lit(1).cast("long").alias("m"), keyed
    classes, out = keyed.select("uid", "text", once), None
    if not single:
        copies = Stored(keyed.groupBy("uid").agg(F.count("*").alias("m")).where("m > 1")).df
        each = sieve(keyed, F.col("uid"), copies.select("uid"), "left_anti").select("uid", "text", once)
        classes = each.unionByName(sieve(keyed, F.col("uid"), copies.select("uid")).groupBy("uid").agg(F.any_value("text").alias("text"), F.count("*").alias("m")))
    found = Stored(repeated_spans(classes, size=size, k=k)).df
    if not single:  # rows of which there are a great many copies stay where they are
        total = copies.agg(F.sum("m")).first()[0] or 0
        crowd = Stored(copies.where(F.col("m") * CROWD >= total).select("uid").join(found, "uid", "left")).df  # CROWD rows at most
        out = named(keyed.join(F.broadcast(crowd), "uid"), F.col("spans"))
        rest = keyed.join(F.broadcast(crowd.select("uid")), "uid", "left_anti")
    may = named(sieve(rest, F.col("uid"), found.select("uid")).join(found, "uid", "left"), F.col("spans"))
    met = may.unionByName(named(sieve(rest, F.col("uid"), found.select("uid"), "left_anti"), none))
    met = met.unionByName(out) if out is not None else met

    def make():
        def work(ids, texts, spans, *rest):
            n, gone, kept = [], [], []
            for text, own in zip(texts, spans, strict=True):
                words = _words(text)
                n.append(len(words))
                if own:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["s"] for x in own], 1)
                    np.add.at(edge, [x["e"] for x in own], -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stay)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            return [ids, n, gone, kept, *rest]

        return work

    fields = "".join(f", {c} {base.schema[c].dataType.simpleString()}" for c in more)
    out = map_slices(met, make, f"id {kind}, n_words long, n_removed long, kept string{fields}", rows=128)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *(F.col(a).alias(c) for a, c in zip(more, carry, strict=True)))
