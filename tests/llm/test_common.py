import random

from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, components, sieve


def expected(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(1)
    for edges in (
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 50)] + [(99, 98), (98, 97)],
        [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(5, 5), (None, 3), (7, None)],
        [],
    ):
        got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == expected(edges)


def test_components_of_strings(spark):
    edges = [("b", "a"), ("c", "b"), ("z", "y")]
    assert {x.node: x.component for x in components(spark.createDataFrame(edges, "a string, b string")).collect()} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_sieve_loses_no_row(spark):
    rows = spark.range(3000).withColumn("x", F.col("id"))
    keys = spark.range(0, 3000, 7).select(F.col("id").alias("k"))
    kept = {r.id for r in sieve(rows, F.col("id"), keys).collect()}
    assert kept >= set(range(0, 3000, 7)) and len(kept) < 600
    other = {r.id for r in sieve(rows, F.col("id"), keys, "left_anti").collect()}
    assert kept | other == set(range(3000)) and not kept & other


def test_ascii_lower(spark):
    texts = ["ABC xyz", "ÉCOLE Ab", "", None, "İ Σ Q"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t"))).collect()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert [r[0] for r in got] == [t and t.translate(table) for t in texts]
