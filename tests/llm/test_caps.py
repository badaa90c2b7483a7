import numpy as np
import pytest

from docloom.llm import caps


def brute(rows, cosine=0.98):
    ok = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a].add(b)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((k, len(links[i]), min((rows[j][0] for j in seen), default=None) if k is not None else None))
    return sorted(out, key=str)


def rows():
    rng = np.random.default_rng(2)
    base = [rng.standard_normal(24) for _ in range(60)]
    out = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(150):  # near copies in groups, a large one first
        v = base[0 if i < 70 else i % 12]
        out.append((100 + i, (v + rng.standard_normal(24) * 0.11 * rng.random() * np.linalg.norm(v) / 5).tolist(), (0 if i < 70 else i % 12) % 3))
    out += [(300, base[0].tolist(), 0), (301, (base[0] * 7).tolist(), 0), (302, base[0].tolist(), 1), (303, base[0].tolist(), None)]
    out += [(310, None, 0), (311, [0.0] * 24, 0), (312, [float("nan")] + [1.0] * 23, 0), (313, [None] + [1.0] * 23, 0), (314, [float("inf")] + [1.0] * 23, 0), (315, [], 0), (316, base[1].tolist()[:10], 1), (None, base[0].tolist(), 0)]
    return out


@pytest.mark.parametrize("part", [768, 8])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(caps, "PART", part)
    own = [r for r in rows() if r[0] is not None]
    vectors = spark.createDataFrame([(*r, "x") for r in own], "vec_id long, embedding array<double>, label int, filter string")
    got = caps.near_duplicates(vectors).collect()
    assert sorted(((r.vec_id, r.n_links, r.component) for r in got), key=str) == brute(own)
    assert all(r.kept == (r.vec_id == r.component) for r in got)


def test_null_ids_are_linked_with_nothing(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, (tuple(r) for r in caps.near_duplicates(vectors).collect()))) == ["(1, 1, 1, True)", "(2, 1, 1, False)", "(None, 0, None, True)"]


def test_repeated_ids_count_as_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (2, [-1.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in caps.near_duplicates(vectors).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False)]


def test_recall_of_the_code():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)  # the hardest pairs
    for n in (5_000, 2_000_000):
        code = caps.ProductCode(64, n)
        met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y), strict=True)]
        assert np.mean(met) >= 0.97


def test_list_decoding_is_exhaustive():
    code = caps.ProductCode(12, 100, expected=3)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((20, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    turned = v @ code.turn
    scores = sum((turned[:, p] @ b)[(slice(None), *[slice(None) if j == i else None for j in range(code.blocks)])] for i, (p, b) in enumerate(zip(code.parts, code.books, strict=True)))
    for i, own in enumerate(code.decode(v)):
        flat = scores[i].ravel()
        least = min(code.least, flat.max() - code.near)
        assert set(own.tolist()) == set(np.flatnonzero(flat >= least - 1e-12).tolist()) or abs(flat - least).min() < 1e-9


def test_no_rows(spark):
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
