import datetime
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import catalogue, compaction


def plain_fit(sizes, room):
    held, out = [], []
    for x in sizes:
        g = next((i for i, h in enumerate(held) if h + x <= room), len(held))
        if g == len(held):
            held.append(0)
        held[g] += x
        out.append(g)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80), st.integers(1, 200))
def test_first_fit(sizes, room):
    assert compaction.first_fit(sizes, room) == plain_fit(sizes, room)
    falling = sorted(sizes, reverse=True)
    assert compaction.first_fit(falling, room) == plain_fit(falling, room)


def test_first_fit_of_many_files():
    r = random.Random(1)
    sizes = [r.randint(1, 999) for _ in range(3000)]
    assert compaction.first_fit(sizes, 1000) == plain_fit(sizes, 1000)


def local(path):
    return unquote(urlparse(path).path)


def expected(rows):
    """The final files of rows (id, arrived_at, value), by the contract's words."""
    share = lambda x: 1 + len(rows) // x
    day_of = lambda t: None if t is None else (t - datetime.datetime(1970, 1, 1)) // datetime.timedelta(days=1)
    per_day = Counter(day_of(t) for _, t, _ in rows)
    files = defaultdict(list)
    for i, t, v in rows:
        h = zlib.crc32(("" if i is None else str(i)).encode())
        files[day_of(t), h // 16 % (1 + per_day[day_of(t)] // share(200)), min(h % 4, h // 4 % 4)].append((i, t, v))
    none = datetime.datetime.min
    for own in files.values():
        own.sort(key=lambda x: (x[1] or none, x[0] is not None, x[0] or 0))
    out = []
    for day in per_day:
        own = sorted(((len(v), k[1], k[2]) for k, v in files.items() if k[0] == day), key=lambda x: (-x[0], x[1], x[2]))
        groups = [[x[1:]] for x in own if x[0] >= share(750)]
        few = [x for x in own if x[0] < share(750)]
        joined = defaultdict(list)
        for x, g in zip(few, plain_fit([x[0] for x in few], share(300)), strict=True):
            joined[g].append(x[1:])
        for g in [*groups, *joined.values()]:
            held = [r for k in g for r in files[day, *k]]
            ids = [r[0] for r in held if r[0] is not None]
            cents = sum(math.floor(100 * r[2] + 0.5) for r in held if r[2] is not None and math.isfinite(r[2]))
            digest = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in held).encode()).hexdigest()
            out.append((day, *g[0], len(held), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b in g), digest, len(g) > 1))
    return sorted(out, key=str)


COLUMNS = ("day", "lot", "piece", "n_rows", "min_id", "max_id", "cents", "sources", "ids_sha256", "rewritten")


def check(got, rows, names, id_name):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == expected(rows)
    folder = local(got[0]["path"]).split("/day=")[0].split("/_day=")[0]
    there = sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))
    assert there == sorted(local(r["path"]) for r in got)
    for r in got:
        held = pq.ParquetFile(local(r["path"])).read()
        assert held.column_names == names and r["columns"] == ",".join(names)
        ids = held.column(id_name).to_pylist()
        assert r["n_rows"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()
    return folder


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    clicks = spark.read.parquet(f"{folder}/clicks.parquet")
    rows = [tuple(r) for r in clicks.select("click_id", "arrived_at", "value").collect()]
    got = catalogue.op13_compaction(spark, folder).withColumnsRenamed({"min_click_id": "min_id", "max_click_id": "max_id"}).collect()
    check(got, rows, clicks.columns, "click_id")
    assert any(r.rewritten for r in got) and any(not r.rewritten for r in got)


def test_odd_rows_and_names(spark):
    r = random.Random(4)
    at = lambda: None if r.random() < 0.1 else datetime.datetime(1969, 12, 30) + datetime.timedelta(seconds=r.randrange(6 * 86400) if r.random() < 0.6 else 200)
    rows = [(r.choice([None, 7, r.randrange(500), r.randrange(500)]), at(), r.choice([None, 1.005, -2.5, float("nan"), float("inf"), 3.0])) for _ in range(900)]
    rows += rows[:40]
    odd = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double")
    odd = odd.withColumns({"day": F.lit("x"), "lot": F.lit(1), "path": F.lit("p"), "seq": F.lit(2), "a.b": F.lit(None).cast("string"), "_metadata": F.lit(3), "m": F.create_map(F.lit("k"), F.lit(1))})
    check(compaction.compacted(odd).collect(), rows, odd.columns, "click_id")


def test_untouched_files_stay_as_they_are(spark, tmp_path):
    clicks = spark.read.parquet("/root/testdata/sf0.001/clicks.parquet")
    layout = compaction.write_files(clicks, f"{tmp_path}/files")
    found = lambda: {os.path.join(d, f): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(f"{tmp_path}/files") for f in fs if f.endswith(".parquet")}
    before = found()
    groups = compaction.compact(layout).collect()
    after = found()
    alone = {local(g.path) for g in groups if g.of == 1}
    assert alone and len(alone) < len(after) < len(before)
    assert all(after[p] == before[p] for p in alone) and not (after.keys() - alone) & before.keys()


@pytest.mark.parametrize("n", [0, 1])
def test_tables_of_few_rows(spark, n):
    df = spark.createDataFrame([(5, datetime.datetime(2024, 1, 2), 1.0)], "click_id long, arrived_at timestamp_ntz, value double").limit(n)
    got = compaction.compacted(df).collect()
    assert [(r.day, r.sources, r.cents, r.rewritten) for r in got] == [(19724, "0-" + str(min(zlib.crc32(b"5") % 4, zlib.crc32(b"5") // 4 % 4)), 100, False)] * n
