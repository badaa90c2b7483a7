import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import factstore, grids, nesting, rules, spans, symbols
from docloom.operators import graph as g
from docloom.operators import lines as ln
from docloom.operators.editor import Session
from docloom.operators.outline import closing_delimiters, heading_tree


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("equal", [False, True])
def test_nearest_smaller_across_blocks(spark, ahead, equal):
    rnd = random.Random(1)
    rows = [(u, 3 * i + 1, rnd.choice([0, 1, 2, 3, 5, 9, None])) for u, n in (("a", 200), ("b", 7), (None, 40)) for i in range(n)]
    got = {(r.u, r.i): r.near for r in nesting.nearest_smaller(spark.createDataFrame(rows, "u string, i int, v int"), ["u"], "i", "v", ahead=ahead, equal=equal, block=16).collect()}
    assert len(got) == len(rows)
    for u, i, v in rows:
        met = [j for w, j, x in rows if w == u and (j > i if ahead else j < i) and None not in (v, x) and (x <= v if equal else x < v)]
        assert got[u, i] == ((min if ahead else max)(met) if met else None)


def test_one_document_of_many_headings_lies_in_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit("u").alias("uri"), F.col("id").alias("idx"), F.when(F.col("id") == 0, 1).otherwise(F.col("id") % 4 + 2).cast("int").alias("level"))
    tree = heading_tree(rows, bits=3)
    assert "Python" not in tree._jdf.queryExecution().toString() and "InArrow" not in tree._jdf.queryExecution().toString()
    parent = F.when(F.col("level") == 2, 0).otherwise(F.col("idx") - 1)
    assert tree.where("idx > 3").where(F.col("parent_idx") != parent).isEmpty() and tree.where("parent_idx is null").count() == 1
    assert heading_tree(rows.limit(0)).isEmpty()


def test_delimiters_of_any_length(spark):
    lns = spark.createDataFrame([("u", i, x) for i, x in enumerate(["----", "-----", "....", "----", "-" * 5000, "....", "----"])], "uri string, ln int, line string")
    assert sorted((r.ln, r.end_ln) for r in closing_delimiters(lns).collect()) == [(0, 1), (1, 4), (2, 5), (3, 4)]


def test_covering_equals_comparison(spark):
    rnd = random.Random(2)
    places = [(rnd.choice("ab"), rnd.randrange(0, 300)) for _ in range(60)] + [("a", None), ("a", -1), (None, 5), ("a", 2**31)]
    ranges = [(rnd.choice("ab"), s, s + rnd.randrange(0, 120), k) for k, s in enumerate(rnd.randrange(0, 250) for _ in range(80))] + [("a", 9, 8, 100), ("a", None, 9, 101), ("a", 0, 2**31, 102), (None, 0, 9, 103), ("a", 7, 7, 104)]
    found = spans.covering(spark.createDataFrame(places, "u string, at long"), spark.createDataFrame(ranges, "u string, s long, e long, k int"), ["u"], "at", "s", "e")
    want = sorted((u, at, k) for u, at in places for w, s, e, k in ranges if None not in (u, at, s) and u == w and at >= 0 and s <= at <= e)
    assert sorted((r.u, r.at, r.k) for r in found.collect()) == want and want


def test_symbol_index_equals_scan_on_a_hundred_queries(spark, tmp_path):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abİé😀c-1A ") for _ in range(rnd.randrange(0, 12))) for _ in range(500)] + ["x" * 3000, "same", "Same", "same"]
    syms = spark.createDataFrame([(x, f"u{i}") for i, x in enumerate(names)], "name string, uri string").cache()
    index = symbols.build(syms, str(tmp_path / "ix"), 8)
    again = symbols.SymbolIndex(spark, str(tmp_path / "ix"), 8)
    held = [(x, f"u{i}") for i, x in enumerate(names) if x]
    lows = {r.uri: r.low for r in syms.select("uri", F.lower("name").alias("low")).collect()}
    queries = ["", "a", "zzz", "SAME", "xxxx", "-1"] + [x[k : k + rnd.randrange(1, 6)] for x, k in zip(names[:94], [0, 1, 2] * 40, strict=False)]
    assert len(queries) == 100
    asked = [again.search(q).select(F.lit(i).alias("q"), "uri") for i, q in enumerate(queries)]
    got = {}
    for part in range(0, 100, 25):
        for r in ln.union_all(asked[part : part + 25]).collect():
            got.setdefault(r.q, []).append(r.uri)
    for i, q in enumerate(queries):
        assert sorted(got.get(i, [])) == sorted(u for _, u in held if q.lower() in lows[u]), q
    assert sorted(r.uri for r in index.search("same").collect()) == sorted(r.uri for r in g.search_symbols(syms, "same").collect())


def test_a_search_reads_its_own_parts_only(spark, tmp_path):
    syms = spark.range(3000).select(F.concat(F.lit("name-"), F.col("id")).alias("name"), F.col("id").cast("string").alias("uri"))
    index = symbols.build(syms, str(tmp_path / "ix"), 16)
    found = index.lists("me-2999")
    assert found[0][1] < 50 and found[-1] == ("me-", 3000)
    plan = index.candidates("me-2999")._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"PartitionFilters: \[isnotnull\(part#\d+\), \(part#\d+ = (\d+)\)\]", plan)
    assert len(read) == plan.count("FileScan") == len([1 for _, n in found if n <= 16 * found[0][1]]) and "gram,me-" not in plan
    assert [r.name for r in index.search("ME-2999").collect()] == ["name-2999"] and index.lists("qqqq")[0][1] == 0
    assert index.search("qqqq").isEmpty()
    assert [r.uri for r in Session(spark.createDataFrame([], "uri string, load_ord long, text string"), index=index).find_symbols("me-2998").collect()] == ["2998"]


def test_facts_are_parsed_once_a_content(spark, tmp_path):
    store = factstore.FactStore(spark, str(tmp_path / "facts"))
    texts = {"index.adoc": "= Home\n\n<<a>> <<b>>\n", "a.adoc": "[[a]]\n= A\n:status: Draft\n", "copy.adoc": "[[a]]\n= A\n:status: Draft\n", "b.adoc": "[[b]]\n= B\n", "none.adoc": None}
    docs = lambda t: spark.createDataFrame([(u, i, x) for i, (u, x) in enumerate(t.items())], "uri string, load_ord long, text string")
    assert store.generations() == [] and store.workspace().docs.isEmpty()
    assert store.update(docs(texts)) == factstore.Update(0, 4)  # two of one content
    assert store.update(docs(texts)).parsed == 0
    changed = {u: x for u, x in texts.items() if u != "b.adoc"} | {"a.adoc": "[[a]]\n= A\n\n<<c>>\n"}
    assert store.update(docs(changed)) == factstore.Update(2, 1)
    links = lambda ws: sorted(map(tuple, g.broken_links(ws).collect()))
    both = lambda ws: (links(ws), sorted(map(tuple, g.statistics(ws).collect())), sorted(map(tuple, rules.bridge().run(ws).collect())))
    want = both(g.Workspace(docs(changed)))
    assert both(store.workspace()) == want and want[0]
    assert links(store.workspace(0)) == links(g.Workspace(docs(texts)))
    assert sorted(map(tuple, store.changes(1, 2).collect())) == [("a.adoc", "changed"), ("b.adoc", "removed")]
    (tmp_path / "facts/documents/g=3").mkdir()  # a run that broke off
    assert store.generations() == [0, 1, 2] and store.update(docs(changed)).parsed == 0
    store.compact()
    assert len(store.generations()) == 1 and links(store.workspace()) == want[0]
    assert store.update(docs(texts)).parsed == 1  # the text that was let go


def test_deep_slices_number_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("k"), F.lit("x").alias("r0")).repartition(5)
    for start, end in ((0, 9), (500, 620), (990, 2000), (2000, 3000)):
        got = sorted((r.k, r.r) for r in grids.row_slice(rows, "k", start, end, top=5).collect())
        assert got == [(i, i) for i in range(start, min(end, 999) + 1)]
    assert grids.row_slice(rows.limit(0), "k", 0, 9, top=5).isEmpty()
