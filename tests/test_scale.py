"""Queries on tables that are larger than the given ones, and plans that do not rest on the
estimate of what a short row becomes."""

from pyspark.sql import functions as F

from docloom.operators import dual, nesting, outline, spans
from docloom.operators import lines as ln
from docloom.plans import catalogue, corpus, packages


def test_stamps_of_large_keys(spark, tmp_path):
    import duckdb

    keys = [0, 149_999, 977_632, 977_633, 2_224_001, 2_224_005, 8_999_995, 8_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    expected = sorted(con.execute(catalogue.oracle_sql()["stamps"]).fetchall())
    assert sorted(map(tuple, catalogue.queries()["stamps"](spark, str(tmp_path)).collect())) == expected


def joins(df) -> list[str]:
    """The joins of a plan, as they are planned before anything has run."""
    import re

    return re.findall(r"(\w+Join)\b", df._jdf.queryExecution().sparkPlan().toString())


def test_places_cut_to_intervals_are_not_broadcast(spark):
    places = spark.range(40).selectExpr("id % 2 as u", "id as at")
    ranges = spark.range(40).selectExpr("id % 2 as u", "id as s", "id + 5 as e", "id as k")
    met = spans.covering(places, ranges, ["u"], "at", "s", "e")
    assert joins(met) == ["SortMergeJoin"]
    expected = sorted((a, k) for a in range(40) for k in range(40) if a % 2 == k % 2 and k <= a <= k + 5)
    assert sorted((r["at"], r["k"]) for r in met.collect()) == expected


def test_places_meet_ranges_of_all_lengths(spark):
    places = spark.createDataFrame([("a", 0), ("a", 7), ("a", 2**32 - 1)], "u string, at long")
    ranges = spark.createDataFrame([("a", 0, 0, 1), ("a", 7, 7, 2), ("a", 0, 7, 3), ("a", 0, 2**32 - 1, 4), ("a", 8, 2**32 - 2, 5)], "u string, s long, e long, k int")
    for own in ([1], [1, 2], [3], [1, 2, 3], [1, 2, 3, 4, 5]):
        got = spans.covering(places, ranges.where(F.col("k").isin(own)), ["u"], "at", "s", "e").collect()
        expected = [(a, k) for a in (0, 7, 2**32 - 1) for k, s, e in ((1, 0, 0), (2, 7, 7), (3, 0, 7), (4, 0, 2**32 - 1), (5, 8, 2**32 - 2)) if k in own and s <= a <= e]
        assert sorted((r["at"], r["k"]) for r in got) == sorted(expected), own
    assert spans.covering(places, ranges.where("false"), ["u"], "at", "s", "e").count() == 0


def test_lines_are_not_broadcast(spark):
    docs = spark.createDataFrame([("u", 1, "= T\n----\nx\n----\n")], "uri string, load_ord long, text string")
    lns = ln.lines(docs)
    fences = lns.where("line = '----'").select("uri", F.col("ln").alias("start_ln"))
    met = outline.folds(lns).join(fences, ["uri", "start_ln"], "left_semi")
    assert set(joins(met)) == {"SortMergeJoin"}
    assert [(r.start_ln, r.end_ln) for r in met.collect()] == [(1, 3)]


def test_lint_reads_a_document_once(spark):
    texts = ["= T\n:slide-bullets: 1\n\n[.slide-only]\n== S\n\n* a\n* b\n", "[.document-only]\n== D\n\nsee <<x>>, <<y.adoc>>\n\n[.slide]\nimage::p.png[alt]\n", "= N\n:template: t\n:slide-bullets: no\n\n* 1\n* 2\n* 3\n* 4\n* 5\n* 6\n", "", None]
    docs = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "uri string, text string")
    found = dual.lint(docs)
    assert "MapInArrow" not in found._jdf.queryExecution().sparkPlan().toString()
    whole = dual.lint_blocks(dual.blocks(docs), dual.metadata(docs))
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and {r.code for r in found.collect()} >= {"DUAL001", "DUAL002", "DUAL005", "DUAL006", "DUAL007", "DUAL008"}


def test_rendered_rows_are_dealt_out_by_their_number(spark, tmp_path):
    spark.range(50_000).selectExpr("id as o_orderkey", "'F' as o_orderstatus").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    docs = corpus.decisions(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 3 and docs.count() == 50_000
    assert catalogue._dual(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert packages._packages(spark.range(5_000).selectExpr("string(id) as uri").coalesce(1), lambda row: {"a": "b"}).rdd.getNumPartitions() == 3


def test_pending_attributes_sort_marks_once(spark):
    text = "[a]\n----\n[b]\nx\n[c]\n----\n----\n== H\n----\n[d]\n== H\n----\n[[no]]\n[e]\n\n-----\n= T\n[f]\n= T\n----"
    lns = ln.lines(spark.createDataFrame([("u", 1, text), ("v", 2, "----\n[z]"), ("w", 3, "----")], "uri string, load_ord long, text string"))
    found = outline.pending_attributes(lns)
    assert sorted((r.uri, r.ln, r.attribute) for r in found.collect()) == [("u", 1, "a"), ("u", 5, "b"), ("u", 15, "e"), ("u", 19, "f")]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1


def test_nearest_smaller_sorts_once_a_digit(spark):
    import random

    rnd = random.Random(5)
    for bits in (1, 3, 4, 5, 9):
        vals = [rnd.randrange(1 << bits) for _ in range(150)]
        rows = spark.createDataFrame([("u", i, v) for i, v in enumerate(vals)], "u string, i int, v int")
        for equal in (False, True):
            found = nesting.nearest_smaller(rows, ["u"], "i", "v", equal=equal, bits=bits, block=16)
            smaller = lambda a, b: a <= b if equal else a < b  # noqa: B023, E731
            want = [max((j for j in range(i) if smaller(vals[j], v)), default=None) for i, v in enumerate(vals)]
            assert [r.near for r in sorted(found.collect(), key=lambda r: r.i)] == want, (bits, equal)
    plan = nesting.nearest_smaller(rows, ["u"], "i", "v", bits=9, block=16)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") <= 3 * 3 + 1  # its own stands on both sides of the join


def test_grades_count_each_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "en", "The cat sat. It ran."), (2, "en", None), (3, "en", "Incomprehensibilities notwithstanding, institutionalization")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()["grade_distribution"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_count") + plan.count("regexp_extract_all") <= 8
    assert {r.grade: r.n for r in found.collect()} == {"5th grade": 2, "College graduate": 1}
