"""Streams and reports."""

import json

from pyspark.sql import functions as F

from docloom.operators import contract, editor, outline, reports, rules
from docloom.operators import graph as g
from docloom.operators import lines as ln
from docloom.streaming import workspace

EVENTS = [("a", "open", "[[x]]", 1), ("b", "open", "<<y>>", 2), ("a", "change", "[[y]]", 3), ("b", "close", None, 4), ("c", "open", "z", 5), ("c", "delete", None, 6), ("a", "change", "late", 0)]


def test_latest(spark):
    events = spark.createDataFrame(EVENTS, "uri string, op string, text string, seq long")
    assert sorted(map(tuple, workspace.latest(events).collect())) == [("a", "[[y]]", 3), ("b", "<<y>>", 2)]


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "uri string, op string, text string, seq long"
    events = spark.createDataFrame(EVENTS, schema)
    for part in (EVENTS[:2], EVENTS[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = workspace.follow(spark.readStream.schema(schema).parquet(source), lambda docs: rules.broken_links(g.Workspace(docs)), out, str(tmp_path / "state"))
        query.processAllAvailable()
        query.stop()
    found = spark.read.parquet(out)
    assert [(r.uri, r.code) for r in found.collect()] == [("b", "WS001")]
    assert workspace.latest(events).count() == 2


def workspace_of(spark, **docs):
    return g.Workspace(spark.createDataFrame([(f"file:///{n}.adoc", i, t) for i, (n, t) in enumerate(docs.items())], "uri string, load_ord long, text string"))


def test_reports(spark, tmp_path):
    ws = workspace_of(spark, index="<<a.adoc#,x>> <<gone>>", a="[[a]]", b="x < y")
    found = rules.Registry().add("links", rules.broken_links).add("orphaned", rules.orphaned).run(ws)
    score = rules.score(found, ws.docs, 2)
    assert json.loads(reports.minimal_json(score).first()["json"]) == {"status": "passing", "errors": 0, "warnings": 2, "score": 0}
    assert json.loads(reports.diagnostic_json(found.where("code = 'WS001'")).first()["json"])["range"]["start"] == {"line": 0, "character": 16}
    text = {r.section: r.text for r in reports.markdown(found, score).collect()}
    assert "| score | 0 |" in text[""] and "**BRIDGE003** (warning)" in text["file:///b.adoc"]
    assert "<details>" in reports.markdown(found, score, compact=True).where("section <> ''").first()["text"]
    assert "#ffc107" in reports.html(found, score).where("section = ''").first()["text"]
    reports.write(reports.markdown(found, score), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).where("value = '# Compliance Report'").count() == 1
    assert {r.uri: r.n for r in reports.by_document(found).collect()} == {"file:///index.adoc": 1, "file:///b.adoc": 1}


def test_selections(spark):
    ws = workspace_of(spark, a="= T\n\none\ntwo\n\n== S\nx\n")
    cursors = spark.createDataFrame([("file:///a.adoc", 3)], "uri string, ln int")
    got = sorted((r.step, r.start_ln, r.end_ln) for r in editor.selections(ws.lines, outline.folds(ws.lines), cursors).collect())
    assert got == [(0, 3, 3), (1, 2, 3), (2, 0, 6)]


def test_closing_delimiters_and_classes(spark):
    ws = workspace_of(spark, a="----\nx\n-----\n....\n----\n====== h\n= t\n:a: b\n====")
    assert sorted((r.ln, r.end_ln) for r in outline.closing_delimiters(ws.lines).collect()) == [(0, 2)]
    got = [r["c"] for r in ws.lines.orderBy("ln").select(ln.line_class(ws.lines["line"]).alias("c")).collect()]
    assert got == ["delimiter", "other", "delimiter", "delimiter", "delimiter", "header6", "header1", "attribute", "delimiter"]


def test_completion_contexts(spark):
    texts = ["see <<ab", ":status: Dep", " :au", "[so", "plain", ":x:"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", editor.completion_context(F.col("t")).alias("c")).orderBy("i").collect()
    assert [tuple(r.c) for r in got] == [("xref", None, "ab"), ("value", "status", "Dep"), ("attribute", None, "au"), ("block", None, "so"), (None, None, None), ("value", "x", "")]


def test_heading_levels(spark):
    rows = spark.createDataFrame([("Heading3", None), ("heading2", None), ("X", 0), ("X", None), ("Heading1", 4)], "s string, o int")
    assert [r[0] for r in rows.select(contract.heading_level(F.col("s"), F.col("o"))).collect()] == [3, 2, 1, None, 5]


def test_views(spark):
    from docloom.operators import domains, dual, views

    docs = spark.createDataFrame([("u", "= T\n:slide-layout: L\n\n== A\n:slide-layout: M\n\n[.document]\ntext\n\n* x")], "uri string, text string")
    found, meta = dual.blocks(docs), dual.metadata(docs)
    shown = json.loads(views.dual_json(found, "slide").first()["json"])
    assert [b["kind"] for b in shown["blocks"]] == ["section", "bullets"] and shown["format"] == "slide"
    assert {r.idx: r.layout for r in views.slide_layout(found, meta).collect()} == {0: "M", 1: "L", 2: "L"}
    sheet = spark.createDataFrame([("u", "H2", "paragraph", 1, False), ("u", "H1", "paragraph", 0, False), ("u", "N", "paragraph", None, True), ("u", "G", "table", None, False)], "uri string, style_id string, type string, outline_level int, is_default boolean")
    assert views.style_config(sheet).first()["text"] == '[styles]\nheading1 = "H1"\nheading2 = "H2"\nparagraph = "N"\ntable = "G"\n'
    ws = workspace_of(spark, a="= ADR 1\n:status: Odd\n\n== Decision\n== Context\n== Consequences")
    bad = domains.adr_rules(ws)
    assert views.status_actions(bad).count() == 6
    assert tuple(views.issue_counts(bad).first())[1:] == (0, 1, 0, 1, True)
    assert [(r.name, r.editor_kind) for r in views.workspace_symbols(ws.symbols, "adr").collect()] == [("ADR 1", "file")]
    row = spark.createDataFrame([(95250, 9524, "media/A.PNG")], "w long, h long, p string").select(views.image_facts(F.col("w"), F.col("h"), F.col("p")).alias("i")).first()["i"]
    assert tuple(row) == (10, 0, "A.PNG", "png")


def test_a_batch_writes_a_file_for_each_part_and_none_for_nothing(spark, tmp_path):
    import glob

    kept = workspace.Kept(spark, str(tmp_path))
    schema = "uri string, seq long, op string, text string, sign int"
    rows = [(f"u{i}", 1, "change", f"[[a{i}]] <<a{i + 1}>>", 1) for i in range(400)]
    kept.apply(spark.createDataFrame(rows, schema).repartition(4), 0)
    kept.apply(spark.createDataFrame([("gone", 1, "delete", None, 0)], schema), 1)
    files = glob.glob(f"{tmp_path}/facts/batch=0/part=*/*.parquet")
    assert len(files) == len({f.split("/")[-2] for f in files}) > 1
    assert {n for log in workspace.LOGS for n, _ in kept._folders(log)} == {0}
    assert kept.documents().count() == 400 and [(r.uri, r.id) for r in kept.broken_links().collect()] == [("u399", "a400")]
    kept.apply(spark.createDataFrame([(*rows[0][:4], -1), ("u0", 2, "change", "[[a400]]", 1)], schema), workspace.Kept.FOLD - 2)
    kept.apply(spark.createDataFrame([], schema), workspace.Kept.FOLD - 1)
    assert (workspace.Kept.FOLD - 1, "base") in kept._folders("facts")
    assert kept.broken_links().count() == 0 and kept.definitions().count() == 400
