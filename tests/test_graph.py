"""Reachability in parts and the reverse index in pages."""

import random

import pytest

from docloom.operators import graph as g


def depths(starts, links):
    to = {}
    for a, b in links:
        to.setdefault(a, []).append(b)
    depth, last = {s: 0 for s in starts}, list(starts)
    while last:
        then = []
        for a in last:
            for b in to.get(a, ()):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    then.append(b)
        last = then
    return depth


def test_a_chain_of_ten_thousand_documents(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(g, "in_order", lambda *a, f=g.in_order: rounds.append(1) or f(*a))
    chain = [(f"d{i:05d}", f"d{i + 1:05d}") for i in range(10_000)]
    got = g.reachable_in_parts(spark.createDataFrame([("d00000",)], "uri string"), spark.createDataFrame(chain, "uri string, to_uri string"), 2000)
    assert {r.uri: r.depth for r in got.collect()} == {f"d{i:05d}": i for i in range(10_001)}
    assert len(rounds) < 30


@pytest.mark.parametrize("seed, most", [(1, 15), (2, 60)])
def test_depths_are_exact_in_parts(spark, monkeypatch, seed, most):
    monkeypatch.setattr(g, "MERGE", 2)
    r = random.Random(seed)
    links = [(f"n{r.randrange(90):02d}", f"n{r.randrange(90):02d}") for _ in range(110)]
    starts = ["n00", "n45", "alone"]
    df = spark.createDataFrame([*links, *links[:9]], "uri string, to_uri string")
    got = g.reachable_in_parts(spark.createDataFrame([(s,) for s in [*starts, "n00", None]], "uri string"), df, most)
    rows = [tuple(x) for x in got.collect()]
    assert dict(rows) == depths(starts, links) and len(rows) == len(dict(rows))
    assert g.reachable_in_parts(spark.createDataFrame([], "uri string"), df, most).count() == 0


def test_pages_of_a_hot_id(spark):
    r = random.Random(4)
    refs = [("hot", f"u{r.randrange(40):02d}", i, r.randrange(9)) for i in range(3000)] + [("cold", "u1", 5, 2), ("cold", "u0", 7, 1), ("cold", "u0", 7, 1)] + [("same", "u", 1, 1)] * 250
    pages = g.reverse_pages(spark.createDataFrame(refs, "id string, uri string, ln int, col int"), 100)
    held = pages.collect()
    assert all(p.n == len(p.places) <= 100 and p.first == p.places[0] and p.last == p.places[-1] for p in held) and len({(p.id, p.page) for p in held}) == len(held)
    for name in ("hot", "cold", "same"):
        assert [tuple(x) for x in g.places(pages, name).collect()] == sorted(x[1:] for x in refs if x[0] == name)
