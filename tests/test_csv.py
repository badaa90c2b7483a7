"""Files that are parsed split by split: the records and numbers of one pass over the file."""

import csv
import random

import numpy as np
import pytest

from docloom.sources import tables


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def made_up(r, rows):
    cell = lambda: r.choice(["a", "", "b c", 'x"y', '"q"', '"two\nlines"', '"""', '"a, ""b"""', '"\n\n"', '"end" more', "é" * 9, '"' + "long\n" * r.randrange(60) + '"'])
    lines = []
    for _ in range(rows):
        own = [c if c != '"""' else '""""' for c in (cell() for _ in range(r.choice([1, 3])))]
        lines.append(",".join(own) + r.choice(["\n", "\n", "\n\n"]))
    return "".join(lines)


def expected(text):
    return [row for row in csv.reader(text.splitlines(keepends=True)) if row]


@pytest.mark.parametrize("many", [100_000, 0])
def test_splits_are_parsed_apart(spark, tmp_path, small_splits, monkeypatch, many):
    monkeypatch.setattr(tables, "BROADCAST_SPLITS", many)
    r = random.Random(6)
    want = {}
    for i in range(3):
        text = made_up(r, 60)
        (tmp_path / f"f{i}.csv").write_text(text)
        want |= {(i, n): row for n, row in enumerate(expected(text))}
    (tmp_path / "open.csv").write_text('a,b\n"never\nclosed,\n\nat all\n' + "x\n" * 200)
    (tmp_path / "empty.csv").write_text("\n\n")
    want |= {(9, n): row for n, row in enumerate(expected((tmp_path / "open.csv").read_text()))}
    rows = tables.read_csv(spark, str(tmp_path), tables.CsvOptions(flexible=True))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    got = {(int(x.table_id[-5]) if "/f" in x.table_id else 9, x.r): [c if c is not None else "" for c in x.cells] for x in rows.collect()}
    closed = lambda d: {k: v for k, v in d.items() if k != (9, 1)}
    assert closed(got) == closed(want) and rows.count() == len(want)
    assert "".join(got[9, 1]).startswith("never\nclosed,\n\nat all\nx")


def test_no_row_is_moved(spark, tmp_path, small_splits):
    (tmp_path / "t.csv").write_text("".join(f"{i},b\n" for i in range(300)))
    rows = tables.read_csv(spark, str(tmp_path), tables.CsvOptions(flexible=True))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and plan.count("Exchange") == plan.count("BroadcastExchange") and "Sort" not in plan
    assert sorted((x.r, x.cells[0]) for x in rows.collect()) == [(i, str(i)) for i in range(300)]


def test_states_of_lines():
    r = np.random.default_rng(3)
    for n in range(1, 40):
        out, inside = r.random((2, n)) < 0.5
        for before in (False, True):
            state, want = before, []
            for o, i in zip(out, inside, strict=True):
                state = bool(i if state else o)
                want.append(state)
            assert tables._states(before, out, inside).tolist() == want
