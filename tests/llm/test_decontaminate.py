import re

import pytest

from docloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    out = []
    wins = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - 9) if ws else 0):
            wins.setdefault(tuple(ws[i : i + 10]), set()).add(str(item))
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for win, own in wins.items():
            for i in range(len(ws) - len(win) + 1):
                if tuple(ws[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= own
        out.append((doc, len(ws), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000))
ITEM = "The quick brown fox jumps over the lazy dog and runs away from École Straße today"
DOCS = [
    (1, "so: THE quick brown fox, jumps over the lazy dog and!! yes"),
    (2, None),
    (3, ""),
    (4, ",;. "),
    (5, ITEM + " " + ITEM),
    (5, ITEM + " " + ITEM),
    (None, "tiny item tiny item"),
    (7, LONG + " " + ITEM + " tail"),
    (8, "École ÉCOLE école over the lazy dog and runs away from École"),
    (10, "the the the the the the the the the the the the"),
]
ITEMS = [(1, ITEM), (10, ITEM), (2, "Tiny item"), (3, None), (4, "..."), (5, "solo"), (9, "the the the the the the the the the the the"), (9, "the the the the the the the the the the the")]


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, ws string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, win int")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got), key=str) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.contaminated(docs, items).collect()] == [(1, 3, 0)]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_large_form_with_a_word_in_every_row(spark, monkeypatch):
    """Beyond the bound only places that may hold a shingle of the benchmark are moved."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    docs = [(i, f"the number {i} the " + " ".join(f"v{i}x{k}" for k in range(40)) + (" one two three four five six" if i % 50 == 0 else "")) for i in range(400)]
    items = [(1, "the"), (2, "one two three four five six"), (3, "never in it at all")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect())
    assert got == sorted((i, 44 + 6 * (i % 50 == 0), 2 + 6 * (i % 50 == 0), "1,2" if i % 50 == 0 else "1") for i, _ in docs)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
