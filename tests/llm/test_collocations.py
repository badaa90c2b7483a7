import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import collocations


def expected(rows, least, top, within):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        longer = [b for (other, *q), b in f.items() if other == lang and len(p) == 2 and len(q) == 3 and b >= least and p in (q[:2], q[1:])]
        if any(100 * b >= within * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def rows_of(r, n):
    vocabulary = ["the", "The", "of", "a", "b", "c", "x-y", "é", "É", "c\x85d", "漢", "'s", "a\x1cb"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " ? ", "\x0b"]) for _ in range(r.randrange(40)))
    rows = [(r.choice(["en", "fr", None, "und"]), r.choice([text(), text(), None, "", " .,"])) for _ in range(n)]
    return rows + rows[:10]


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_counting(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows = rows_of(r, 150) + [("en", "new york city " * 40 + "old york. " * 25)]
    monkeypatch.setattr(collocations, "BLOCK", r.choice([50, 1 << 20]))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    odd = docs.selectExpr("*", "1 as block", "2 as words", "3 as a", "4 as n")
    for least, top, within in ((10, 2000, 50), (3, 7, 80)):
        got = collocations.collocations(odd, least=least, top=top, within=within)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == expected(rows, least, top, within)


def test_no_phrases(spark):
    for rows in ([], [("en", None)], [(None, "one two three")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(1)
    tokens = r.integers(0, 6, 5000).astype(np.int32)
    own = [{"at": i, "id": 10 * i} for i in range(1, 5)]
    batch = pa.RecordBatch.from_pylist([{"tokens": tokens.tobytes(), "own": own}])
    want = Counter()
    ids = [10 * t if t < 5 else 0 for t in tokens.tolist()]
    for i in range(len(ids)):
        for k in (2, 3):
            if len(p := ids[i : i + k]) == k and all(p):
                want[(*p, *[0] * (3 - k))] += 1
    for keys in (8, 1000, 1 << 22):
        monkeypatch.setattr(collocations, "KEYS", keys)
        got = Counter()
        for found, n in collocations._counted([batch]):
            got.update(dict(zip(map(tuple, found.T.tolist()), n.tolist(), strict=True)))
        assert got == want


def test_keys_are_sorted_cut_and_packed():
    r = np.random.default_rng(2)
    keys = r.integers(0, 1 << 32, (3, 4000), dtype=np.uint64).astype(np.uint32) >> r.integers(0, 31, (3, 4000)).astype(np.uint32)
    keys = np.concatenate([keys, keys[:, :900]], axis=1)
    found, n = collocations.run_lengths(keys)
    want = Counter(map(tuple, keys.T.tolist()))
    assert list(map(tuple, found.T.tolist())) == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
    back, m = collocations._unpacked(collocations._packed(found, n))
    assert (back == found).all() and (m == n).all()
    borders = found[:, ::500]
    assert collocations._cut(found, borders) == list(range(0, found.shape[1], 500))
    assert collocations.run_lengths(np.empty((3, 0), np.uint32))[0].shape == (3, 0)


def test_scores_are_exact_beyond_64_bits(spark):
    """a * a * 1000000 passes 2**63 from 3.1 million occurrences on."""
    docs = spark.range(40).selectExpr("'en' as lang", "repeat('p q. ', 100000) || 'p. q. ' as text")
    (got,) = collocations.collocations(docs).collect()
    a, n = 4_000_000, 4_000_040
    assert tuple(got) == ("en", 1, "p q", a, n, n, 2 * n, 1_000_000 * a * a // (n * n))


def test_counting_holds_few_keys(monkeypatch):
    """An executor of two tasks passed 3000 MB, as up to twice KEYS keys were sorted at once, and
    their sorted copies held beside them."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(collocations, "KEYS", 1 << 20)
    r = np.random.default_rng(3)
    own = [{"at": i, "id": i << 15} for i in range(1, 30001)]
    tokens = r.integers(1, 30001, (3, 500_000)).astype(np.int32)
    batch = pa.RecordBatch.from_pylist([{"tokens": t.tobytes(), "own": own} for t in tokens])
    sums = []
    tracemalloc.start()
    for _, n in collocations._counted([batch]):
        sums.append(int(n.sum()))
        del _, n
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sums) == 3 * (499_999 + 499_998) and max(sums) <= 1 << 20
    assert most < 64 << 20  # measured: 48 MiB, before 107


def test_blocks_come_one_at_a_time():
    import pyarrow as pa

    rows = [(1, 7, None), (2, 9, None), (None, None, b"ab"), (None, None, b"none of its words is frequent"), (5, 1 << 32, None), (None, None, b"c")]
    kind = pa.schema([("at", pa.int64()), ("id", pa.int64()), ("tokens", pa.binary())])
    for size in range(1, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + size], strict=True), kind, strict=True)], schema=kind) for i in range(0, 6, size)]
        got = [b.to_pylist() for b in collocations._whole(batches)]
        assert got == [[{"tokens": b"ab", "own": [{"at": 1, "id": 7}, {"at": 2, "id": 9}]}], [{"tokens": b"c", "own": [{"at": 5, "id": 1 << 32}]}]]


def test_keys_are_handed_on_in_small_batches(spark, monkeypatch):
    r = random.Random(5)
    rows = rows_of(r, 150)
    monkeypatch.setattr(collocations, "OUT", 1)
    monkeypatch.setattr(collocations, "KEYS", 64)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == expected(rows, 10, 2000, 50)
