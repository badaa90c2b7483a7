import random

import pytest

from docloom.llm import minhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = [w for w in (text or "").translate(UPPER).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4) if ws else 0)}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def family(r, n, base=90, edits=14):
    own = [f"w{r.randint(0, 500)}" for _ in range(base)]
    for _ in range(n):
        copy = list(own)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(len(copy))] = f"e{r.randint(0, 10**6)}"
        yield " ".join(copy)


def corpus():
    r = random.Random(11)
    texts = [t for _ in range(8) for t in family(r, 14)] + list(family(r, 40, 60, 5))
    texts += [" ".join(f"u{r.randint(0, 9**6)}" for _ in range(50)) for _ in range(20)]
    texts += texts[:6] + [texts[3].upper(), texts[4].replace(" ", " \n")]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    return rows + [(2001, None), (2002, ""), (2003, " \n\t "), (2004, "one two"), (2005, "One two"), (2006, "x " * 30_000), (2007, "x x x x x"), rows[0], rows[0], (None, texts[0])]


@pytest.mark.parametrize("percent, part", [(85, 512), (80, 7)])
def test_against_brute_force(spark, monkeypatch, percent, part):
    monkeypatch.setattr(minhash, "PART", part)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").withColumnRenamed("n", "sig")
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component) for r in got), key=str) == brute(rows, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component) for r in got)


def test_pruning_bounds():
    least = minhash.needed(85, 140)
    assert least == sorted(least) and least[-1] < 0.85 * 140

    def tail(n, m):  # chance of at least m matches at similarity 0.85
        from math import comb

        return sum(comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(m, n + 1))

    assert all(tail(minhash.BATCH * (i + 1), m) > 1 - 1e-4 for i, m in enumerate(least))
    assert (1 - 0.85**minhash.ROWS) ** minhash.bands_for(85) <= minhash.UNSHARED


def test_string_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "a b c d e f"), ("a", "a b c d e f"), ("c", "z")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component) for r in minhash.near_duplicates(docs).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_several_texts_of_an_id(spark):
    a, z = [f"w{i}" for i in range(60)], [f"z{i}" for i in range(60)]
    b, y = [*a[:59], "edit"], [*z[:59], "edit"]
    rows = [(1, a), (2, b), (2, z), (3, y), (2, a), (4, ["alone"]), (2, b), (None, a)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (2, 1, False), (4, 4, True), (2, 1, False), (None, None, True)], key=str)
