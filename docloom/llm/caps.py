"""Embedding near-dedup by spherical-cap filters.

Filter directions are a structured random product code: after a random rotation each
block of coordinates has its own small codebook, and a direction is one codeword of each
block. A vector is list-decoded to all directions whose inner product exceeds the
threshold, by branch and bound over the blocks. Vectors of one label that share a filter
are compared exactly. The code grows with the number of vectors, so that a filter holds
a bounded number of unrelated ones; crowded filters (near copies) are compared in blocks.
"""

from __future__ import annotations

from math import ceil
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stored, components, map_slices, quoted, split_join

#: Directions that a random vector is expected to exceed; more find more of the pairs.
FILTERS = 12
#: Members of a filter that are compared at once; more are split into blocks of pairs of parts.
PART = 768
#: Unrelated vectors that a filter is expected to hold.
HELD = 0.5


class ProductCode:
    """Directions for vectors of `dim` coordinates, fit for `n` of them."""

    def __init__(self, dim: int, n: int, expected: float = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed + dim)
        want = max(4096.0, expected * n / HELD)
        self.blocks = min(dim, 2 if want <= 4096**2 else 3 if want <= 4096**3 else 4)
        self.size = ceil(want ** (1 / self.blocks))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), self.blocks)
        self.books = []
        for p in self.parts:
            book = rng.standard_normal((len(p), self.size))
            self.books.append(book / np.linalg.norm(book, axis=0))
        self.least = NormalDist().inv_cdf(1 - expected / self.size**self.blocks) / dim**0.5 * self.blocks**0.5
        # the best direction of a vector that exceeds few, and what is within reach of it, count as well
        self.near = 0.03 * self.blocks**0.5

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of `unit` (vectors of length 1), sorted."""
        turned = unit @ self.turn
        scores = [turned[:, p] @ book for p, book in zip(self.parts, self.books, strict=True)]
        tops = np.stack([s.max(1) for s in scores], 1)
        out = []
        for i in range(len(unit)):
            best = tops[i].sum()
            least = min(self.least, best - self.near)
            sums, ids = np.zeros(1), np.zeros(1, np.int64)
            for j, s in enumerate(scores):
                rest = tops[i, j + 1 :].sum()
                own = np.flatnonzero(s[i] >= least - (best - tops[i, j]))
                total = sums[:, None] + s[i][own]
                a, b = np.nonzero(total + rest >= least)
                sums, ids = total[a, b], ids[a] * self.size + own[b]
            out.append(np.sort(ids))
        return out


def _doubles(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _decoded(classes: DataFrame, kind: str, total: int) -> DataFrame:
    """cid, label, dim, v (8 bytes a component), weight, filters."""

    def make():
        codes: dict[int, ProductCode] = {}

        def work(cid, label, dim, vectors, weight):
            filters: list = [None] * len(cid)
            raw = [np.asarray(v, np.float64) for v in vectors]
            for d in set(dim):
                at = [i for i, x in enumerate(dim) if x == d]
                if d not in codes:
                    codes[d] = ProductCode(d, total)
                x = np.stack([raw[i] for i in at])
                for i, own in zip(at, codes[d].decode(x / np.linalg.norm(x, axis=1, keepdims=True)), strict=True):
                    filters[i] = own
            return [cid, label, dim, [r.tobytes() for r in raw], weight, filters]

        return work

    return map_slices(classes.select("cid", "label", "dim", "v", "weight"), make, f"cid {kind}, label string, dim int, v binary, weight long, filters array<long>", rows=1024)


def _compared(units: DataFrame, kind: str, cosine: float) -> DataFrame:
    """cid, n (rows linked, each pair counted in the first filter it shares), root (a member of
    its component) from the members of each unit, sorted by unit."""
    arrow_kind = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[kind]

    def one(rows: list, out: list) -> None:
        if len(rows) < 2:
            return
        i, j = rows[0][2], rows[0][3]
        x = _doubles([r[6] for r in rows])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if i != j:
            part = np.array([r[4] for r in rows])
            linked &= part[:, None] != part[None, :]
        at = np.flatnonzero(linked.any(1))
        if not len(at):
            return
        linked = linked[np.ix_(at, at)]
        lists = [np.array(rows[k][8], np.int64) for k in at]
        lower = lists
        ids, where, n = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
        new = linked
        if (n > 1).any():
            col = np.cumsum(n > 1) - 1
            owner = np.repeat(np.arange(len(at)), [len(x) for x in lower])
            use = n[where] > 1
            has = np.zeros((len(at), int((n > 1).sum())), np.float32)
            has[owner[use], col[where[use]]] = 1
            new = linked & (has @ has.T == 0)
        weight = np.array([rows[k][7] for k in at], np.int64)
        counts = new @ weight
        root = np.arange(len(at))
        while True:
            then = np.minimum(root, np.where(linked, root[None, :], len(at)).min(1))
            if (then == root).all():
                break
            root = then
        out.extend((rows[at[k]][5], int(counts[k]), rows[at[root[k]]][5]) for k in range(len(at)) if counts[k] or root[k] != k)

    def run(batches):
        key, held, out = None, [], []

        def batch():
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], arrow_kind)], ["cid", "n", "root"])

        for got in batches:
            for start in range(0, got.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in got.slice(start, 1024).columns), strict=True):
                    if row[:4] != key:
                        one(held, out)
                        key, held = row[:4], []
                    held.append(row)
                if len(out) > 4096:
                    yield batch()
        one(held, out)
        yield batch()

    cols = ["label", "filter", "i", "j", "part", "cid", "v", "weight", "filters"]
    keys = ["label", "filter", "i", "j"]
    return units.select(*cols).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"cid {kind}, n long, root {kind}")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """The id column, n_links, component, kept for each row of `vectors`.

    Linked are vectors of equal, non-null label and equal length whose cosine, in double
    precision, is at least `cosine`; pairs are found with the probability that they
    share a filter, and none below `cosine` is linked. Equal vectors of one label are
    one class and linked with each other. Null, empty or zero vectors, those with null
    or non-finite components, and rows without an id are linked with nothing; a null
    id has a null component and is kept. Repeated rows count as vectors of their own.
    Other columns are not read.
    """
    id_col_, vector_col_, label_col_ = (quoted(c) for c in (id_col, vector_col, label_col))
    finite = F.forall(F.col(vector_col_), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.col(vector_col_), lambda x: x != 0)
    valid = F.col(id_col_).isNotNull() & F.col(label_col_).isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.select(F.col(id_col_).alias("id"), F.col(label_col_).cast("string").alias("label"), F.col(vector_col_).cast("array<double>").alias("v"), valid.alias("valid"))
    own = rows.where("valid")
    kind = rows.schema["id"].dataType.simpleString()
    single = kind in ("bigint", "string", "int") and own.groupBy("id").count().where("count > 1").isEmpty()
    kind = kind if single else "bigint"
    classes = own.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = Stored(classes.withColumn("cid", F.col("least") if single else F.xxhash64("label", "v")).withColumn("dim", F.size("v"))).df
    coded = Stored(_decoded(classes, kind, classes.count())).df

    held = coded.select("cid", F.concat("dim", F.lit(":"), "label").alias("label"), F.explode("filters").alias("filter"))
    sizes = Stored(held.groupBy("label", "filter").agg(F.count("*").alias("size")).where("size > 1")).df
    parts = F.ceil(F.col("size") / PART).cast("int")
    met = split_join(held, sizes, ["label", "filter"], sizes.withColumnRenamed("size", "n")).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cid", "label", "filter", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # a member brings the filters below this one, which tell what has been counted there
    units = units.join(coded.select("cid", "v", "weight", "filters"), "cid").withColumn("filters", F.expr("filter(filters, x -> x < filter)"))
    found = Stored(_compared(units, kind, cosine)).df

    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    group = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    placed = classes.join(links, "cid", "left").join(group.withColumnRenamed("node", "cid"), "cid", "left").withColumn("group", F.coalesce("component", "cid"))
    least = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("first")).withColumnRenamed("component", "group")
    placed = placed.join(least, "group", "left").select("label", "v", F.coalesce("first", "least").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))

    out = rows.where("valid").join(placed, ["label", "v"]).select("id", "n_links", "component")
    out = out.unionByName(rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
