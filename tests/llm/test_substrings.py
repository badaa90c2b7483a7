import random

import numpy as np
import pytest

from docloom.llm import substrings


def words(text):
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


def brute(rows, size=35):
    seen = {}
    split = [words(t) for _, t in rows]
    for ws in split:
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), ws in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(ws) - size + 1):
            if seen[tuple(ws[s : s + size])] > 1:
                gone.update(range(s, s + size))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    new = lambda n: [f"v{r.randint(0, 10**7)}" for _ in range(n)]
    passage, line = new(70), new(9)
    out = []
    for i in range(40):
        own = new(r.randint(0, 120))
        if i % 2:  # a shared passage behind and before words of its own
            at = r.randint(0, len(own))
            own[at:at] = passage[r.randint(0, 8) : 70 - r.randint(0, 8)]
        if i % 5 == 0:
            own += line + new(3) + line
        out.append(" ".join(own))
    base = new(150)
    for _ in range(12):  # near copies
        copy = list(base)
        for _ in range(r.randint(1, 4)):
            copy[r.randrange(150)] = f"q{r.randint(0, 10**7)}"
        out.append("\n".join(copy))
    out += [out[1], "a " * 200, " ".join(new(40) * 2), " ".join(base[:35]), " ".join(base[:34]), "Ünï code " * 30]
    rows = list(enumerate(out))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, " ".join(new(9000) + passage))]


@pytest.mark.parametrize("shard", [256, 3])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = substrings.remove_repeats(docs, carry=("spans",)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)
    assert {r.spans for r in got} == {"x"}


def test_repeated_and_null_ids(spark):
    r = random.Random(1)
    a, b = (" ".join(f"k{r.randint(0, 10**6)}" for _ in range(50)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b), (None, b), (None, "few words"), (2, "few words")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows)


def test_no_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_counts():
    r = random.Random(2)
    for _ in range(300):
        own = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
        weights = [r.choice((1, 1, 2)) for _ in own]
        automaton = substrings.Automaton()
        for ws, n in zip(own, weights, strict=True):
            automaton.add(ws, n)
        automaton.finish()
        for size in (1, 2, 3, 5):
            n = {}
            for ws, k in zip(own, weights, strict=True):
                for i in range(len(ws) - size + 1):
                    n[tuple(ws[i : i + size])] = n.get(tuple(ws[i : i + size]), 0) + k
            for ws in own:
                assert automaton.repeats(ws, size) == [i for i in range(len(ws) - size + 1) if n[tuple(ws[i : i + size])] > 1]


def test_equal_windows_have_equal_minimizers(monkeypatch):
    rng = np.random.default_rng(3)
    w = rng.integers(0, 2**63, 400).astype(np.uint64)
    w[300:360] = w[100:160]

    def at(start):
        h, _, a, b = substrings.runs(w, 35, 8)
        k = int(np.flatnonzero((a <= start) & (b >= start))[0])
        return h[k]

    assert all(at(100 + i) == at(300 + i) for i in range(26))
    whole = substrings.runs(w, 35, 8)
    monkeypatch.setattr(substrings, "CHUNK", 64)
    assert all((x == y).all() for x, y in zip(whole, substrings.runs(w, 35, 8), strict=True))


def test_many_copies_of_a_row(spark):
    """Copies are looked at once: the work grows with their number, not with its square."""
    r = random.Random(3)
    own = [f"v{r.randint(0, 10**7)}" for _ in range(1000)]
    rows = [(None, " ".join(own))] * 20_000 + [(5, " ".join(own[:30]))] * 300 + [(6, " ".join(own[100:160] + ["else"] * 3)), (7, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.n_words, x.n_removed, x.kept): x["count"] for x in substrings.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()}
    assert got == {(None, 1000, 1000, ""): 20_000, (5, 30, 0, " ".join(own[:30])): 300, (6, 63, 60, "else else else"): 1, (7, 2, 0, "one two"): 1}
