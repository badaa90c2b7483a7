"""MinHash near-dedup with sequential Bayesian verification.

Rows with equal shingle sets form a class, represented by its least id. Bands of the
classes' signatures are candidate buckets. Signatures are compared in batches, a pair
dropped once the posterior probability that it reaches the similarity is under the chosen
miss probability; what is left is verified on the full shingle sets. First each bucket's
leader, its least id, is compared with its members. Buckets whose other members then lie
in several components are compared within, in blocks of bounded size, across components
only and each pair in the first band that it shares; found links merge components on
the way. So components are exact, and no pairs but links leave a block.
"""

from __future__ import annotations

from collections import OrderedDict
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stored, components, map_slices, mix64, quoted, split_join
from docloom.llm.shingles import ShingleSets

BANDS, ROWS = 28, 5  # of the signature; candidates use as many bands as bands_for() says
#: Hashes compared at once.
BATCH = 14
#: Chance, at most, that the posterior gives to a dropped pair's being similar enough.
MISS = 1e-6
#: Chance, at most, that a pair at the similarity shares no band.
UNSHARED = 2e-5
#: Members of a bucket that are compared at once; more are split into blocks of pairs of parts.
PART = 512
#: Shingles that a task remembers.
REMEMBERED = 2_000_000


def bands_for(percent: int) -> int:
    return min(BANDS, ceil(log(UNSHARED) / log(1 - (percent / 100) ** ROWS)))


class Sets:
    """Shingle sets by key, remembered up to REMEMBERED shingles, the last used longest."""

    def __init__(self, k: int):
        self.make, self.kept, self.size = ShingleSets(k), OrderedDict(), 0

    def __call__(self, key, text: str) -> np.ndarray:
        if (own := self.kept.get(key)) is not None:
            self.kept.move_to_end(key)
            return own
        self.kept[key] = own = self.make(text)
        self.size += len(own)
        while self.size > REMEMBERED and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1])
        return own


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, hash (xxhash64 of the text), n (shingles), k1 and k2 (fingerprint of the set), sig
    (BANDS * ROWS minima, 4 bytes each)."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = BANDS * ROWS

    def make():
        sets = ShingleSets(k)
        factor = mix64(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
        shift = mix64(np.arange(901, 901 + size, dtype=np.uint64))

        def work(ids, texts, hashes):
            n, k1, k2, sigs = [], [], [], []
            for text in texts:
                own = sets(text)
                low = np.full(size, np.uint64(2**64 - 1))
                for at in range(0, len(own), 512):
                    np.minimum(low, (own[at : at + 512, None] * factor + shift).min(0), out=low)
                n.append(len(own))
                k1.append(int(mix64(own).sum(dtype=np.uint64).astype(np.int64)))
                k2.append(int(mix64(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append((low >> np.uint64(32)).astype("<u4").tobytes())
            return [ids, hashes, n, k1, k2, sigs]

        return work

    return map_slices(docs.select(id_col, text_col, F.xxhash64(text_col)), make, f"id {kind}, hash long, n long, k1 long, k2 long, sig binary")


def needed(percent: int, size: int, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """Matches that a pair needs after each batch: the least m for which the posterior
    (uniform prior) that the similarity reaches `percent` is at least `miss`.

    P(J >= t | m of n) is the chance of at most m hits in n + 1 throws at t."""
    out = []
    t = percent / 100
    for n in range(batch, size + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def unpruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that no batch of their signatures rules out."""
    least = needed(percent, BANDS * ROWS)
    met = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def make():
        def work(a, b, sig_a, sig_b):
            x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), -1) for s in (sig_a, sig_b))
            alive, hits = np.arange(len(a)), np.zeros(len(a), int)
            for i, m in enumerate(least):
                hits = hits + (x[alive, i * BATCH : (i + 1) * BATCH] == y[alive, i * BATCH : (i + 1) * BATCH]).sum(1)
                alive, hits = alive[hits >= m], hits[hits >= m]
            return [[a[i] for i in alive], [b[i] for i in alive]]

        return work

    return map_slices(met.select("a", "b", "sig_a", "sig_b"), make, f"a {kind}, b {kind}", rows=4096)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    kind = pairs.schema["a"].dataType.simpleString()
    met = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def make():
        sets, plain = Sets(k), ShingleSets(k)

        def work(a, b, text_a, text_b):
            true = [i for i in range(len(a)) if reaches(sets(a[i], text_a[i]), plain(text_b[i]), percent)]
            return [[a[i] for i in true], [b[i] for i in true]]

        return work

    return map_slices(met.select("a", "b", "text_a", "text_b"), make, f"a {kind}, b {kind}", rows=64)


def _within(units: DataFrame, kind: str, percent: int, k: int) -> DataFrame:
    """The links (a, b) between members of different components of each block."""
    arrow_kind = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}.get(kind, pa.string())
    least = needed(percent, BANDS * ROWS)

    def block(rows: list, band: int, cross: bool, sets: Sets, out: list) -> None:
        names: dict = {}
        comp = np.array([names.setdefault(r[2], len(names)) for r in rows])
        if len(names) < 2:
            return
        part = np.array([r[0] for r in rows])
        sig = np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(len(rows), -1)
        for a in range(len(rows) - 1):
            at = a + 1 + np.flatnonzero((comp[a + 1 :] != comp[a]) & ((part[a + 1 :] != part[a]) if cross else True))
            hits = np.zeros(len(at), int)
            for i, m in enumerate(least):
                if not len(at):
                    break
                hits = hits + (sig[at, i * BATCH : (i + 1) * BATCH] == sig[a, i * BATCH : (i + 1) * BATCH]).sum(1)
                at, hits = at[hits >= m], hits[hits >= m]
            if band and len(at):
                before = (sig[at, : band * ROWS] == sig[a, : band * ROWS]).reshape(len(at), band, ROWS).all(2).any(1)
                at = at[~before]
            for b in at.tolist():
                if comp[a] != comp[b] and reaches(sets(rows[a][1], rows[a][4]), sets(rows[b][1], rows[b][4]), percent):
                    out.append((rows[a][1], rows[b][1]))
                    comp[comp == comp[b]] = comp[a]

    def run(batches):
        key, held, out, sets = None, [], [], Sets(k)

        def batch():
            cols = list(zip(*out, strict=True)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, arrow_kind) for c in cols], ["a", "b"])

        def close():
            if len(held) > 1:
                block(held, key[1], key[2] != key[3], sets, out)

        for got in batches:
            for start in range(0, got.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in got.slice(start, 256).columns), strict=True):
                    if row[:4] != key:
                        close()
                        key, held = row[:4], []
                    held.append(row[4:])
                if len(out) > 4096:
                    yield batch()
        close()
        yield batch()

    keys = ["bucket", "band", "i", "j"]
    return units.select(*keys, "part", "rep", "component", "sig", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The id column, n_shingles, component (least id reachable over links), kept, text_hash
    (xxhash64 of the text) for each row of `docs`. Linked are rows whose sets of k-word
    shingles have a Jaccard similarity of at least percent / 100.

    A null, empty or blank text has an empty set and is linked with nothing. Rows of one id
    are judged each by its own text. A null id is linked with nothing: its component is
    null and it is kept. Other columns are not read.
    """
    base = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    own = Stored(signatures(base, "id", "text", k)).df
    full = own.where("n > 0 and id is not null")
    classes = Stored(full.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "hash")).alias("o"), F.first("sig").alias("sig")).select("k1", "k2", "n", "o.*", "sig")).df
    # a class goes by its least id, or where one id leads several classes by their sets' hash
    single = classes.groupBy("id").count().where("count > 1").isEmpty()
    sigs = classes.withColumn("rep", F.col("id") if single else F.xxhash64("k1", "k2", "n"))
    kind = kind if single else "bigint"

    width = 4 * ROWS
    bands = sigs.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands_for(percent) - 1)))).select(F.expr(f"xxhash64(band, substring(sig, band * {width} + 1, {width}))").alias("bucket"), "band", "rep")
    shared = Stored(bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("lead")).where("size > 1")).df
    sizes = shared.select("bucket", F.col("size").alias("n"))
    members = Stored(split_join(bands, shared, "bucket", sizes).where("rep <> lead")).df  # a bucket's leader stands with each member
    both = members.select("rep").distinct().unionByName(members.select(F.col("lead").alias("rep")).distinct()).distinct()
    wanted = both.join(sigs.select("rep", "id", "hash"), "rep")
    texts = base.withColumn("hash", F.xxhash64("text")).join(wanted, ["id", "hash"]).select(F.col("rep").alias("id"), "text")
    if not own.where("id is not null").groupBy("id", "hash").count().where("count > 1").isEmpty():
        texts = texts.distinct()
    texts = Stored(texts).df

    pairs = members.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    links = Stored(verified(unpruned(pairs, sigs, percent), texts, percent, k)).df
    group = Stored(components(links)).df.withColumnRenamed("node", "rep")
    placed = members.select("bucket", "band", "rep").join(group, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = F.ceil(F.count("*") / PART).cast("int")
    unclear = placed.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("open"), parts.alias("parts")).where("open").select("bucket", "parts")
    met = split_join(placed, unclear, "bucket", sizes).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    rows = met.select("rep").distinct().join(sigs.select("rep", "sig"), "rep").join(texts.withColumnRenamed("id", "rep"), "rep")
    more = _within(units.join(Stored(rows).df, "rep"), kind, percent, k)
    group = Stored(components(links.unionByName(more))).df.withColumnRenamed("node", "rep")
    if not single:  # components go by their classes' least id again
        least = group.join(sigs.select("rep", "id"), "rep").groupBy("component").agg(F.min("id").alias("least"))
        group = group.join(least, "component").select("rep", F.col("least").alias("component"))

    reps = sigs.select("k1", "k2", "n", "rep", F.col("id").alias("least")).join(group, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "least").alias("component"))
    out = own.select("id", "hash", "n", "k1", "k2").join(reps, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.col("hash").alias("text_hash"))
