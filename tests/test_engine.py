"""Operators on small literals."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import codecs
from docloom.functions import text as fx
from docloom.operators import blocks, contract, diagrams, domains, dual, fixes, outline, plugins, rules, typst
from docloom.operators import graph as g
from docloom.operators import lines as ln
from docloom.sources import ranges


def ws(spark, **docs):
    rows = [(f"file:///w/{name.replace('_', '-')}.adoc", i, text) for i, (name, text) in enumerate(docs.items())]
    return g.Workspace(spark.createDataFrame(rows, "uri string, load_ord long, text string"))


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "docs, codes",
    [
        ({"adr_001": "[[adr-001]]\n= ADR 001\n:status: Accepted", "adr_002": "[[adr-002]]\n= ADR 002\n:supersedes: adr-001"}, ["BRIDGE001"]),
        ({"adr_001": "[[adr-001]]\n= ADR 001\n:status: Deprecated", "adr_002": ":supersedes: adr-001"}, []),
        ({"adr_001": "[[adr-001]]\n= ADR 001\n:status: superseded", "adr_002": ":supersedes: adr-001"}, []),
        ({"a": "[[adr-001]]\n:status: Accepted", "b": "[[adr-002]]\n:status: Accepted", "c": ":supersedes: adr-001, adr-002"}, ["BRIDGE001", "BRIDGE001"]),
        ({"a": "[[adr-001]]\nno status", "b": ":supersedes: adr-001,,"}, ["BRIDGE001"]),
        ({"adr_002": ":supersedes: adr-001"}, ["BRIDGE002"]),
    ],
)
def test_superseded_status(spark, docs, codes):
    assert sorted(r.code for r in rules.superseded_status(ws(spark, **docs)).collect()) == codes


def test_last_definition_of_an_id_counts(spark):
    w = ws(spark, a="[[x]] [[x]]", b="[[x]]")
    assert [(r.id, r.uri[-6:]) for r in w.definitions.collect()] == [("x", "b.adoc")]


def test_lines_and_places(spark):
    w = ws(spark, a="one [[a-1]] two [[é]]\r\n<<a-1>> <<b,label>> <<x/y.adoc#p,l>>\n\nlast\n", b="", c=None)
    assert sorted((r.uri[-6], r.ln, r.line) for r in w.lines.collect() if r.line is not None)[-1][1:] == (3, "last")
    assert sorted((r.id, r.ln, r.col) for r in w.all_definitions.collect()) == [("a-1", 0, 6), ("é", 0, 18)]
    assert sorted((r.id, r.ln, r.col) for r in w.references.collect()) == [("a-1", 1, 2), ("b", 1, 10)]
    assert [(r.path, r.col) for r in w.file_references.collect()] == [("x/y.adoc", 22)]


@pytest.mark.parametrize("small", [g.SMALL, 0])
def test_reachability_with_a_cycle_and_relative_paths(spark, monkeypatch, small):
    monkeypatch.setattr(g, "SMALL", small)
    w = ws(spark, index="<<sub/../b.adoc#,x>>", b="[[b]]\n<<c>>", c="[[c]]\n<<b>>", d="[[d]]", e="[[e]]\n<<d>>")
    assert sorted(r.uri[-6] for r in g.reachable_documents(w).collect()) == ["b", "c", "x"]
    assert sorted(r.uri[-6] for r in rules.orphaned(w).collect()) == ["d", "e"]
    assert rules.orphaned(ws(spark, a="[[a]]", b="x")).count() == 0
    got = rules.bridge().result(w).first()
    assert (got.documents, got.warnings, got.score, got.status) == (5, 2, 40, "passing_with_warnings")


def test_acceptance_score_of_250_records(spark):
    """48 undefined ids among 251 documents, nothing orphaned: score 71."""
    docs = {"index": "\n".join(f"<<adr-{n}.adoc#,x>>" for n in range(1, 251))}
    docs |= {f"adr_{n}": f"= ADR {n}\n:status: Accepted\n" + (f":supersedes: adr-{n - 5}\n" if n > 10 and n % 5 == 0 else "") for n in range(1, 251)}
    got = rules.bridge().result(ws(spark, **docs)).first()
    assert (got.documents, got.warnings, got.errors, got.score) == (251, 48, 0, 71)


def test_disabled_rules_are_not_planned(spark):
    r = rules.Registry().add("orphaned", rules.orphaned, None)
    assert r.run(ws(spark, index="", a="")).count() == 0


@pytest.mark.parametrize("levels, n", [((1, 2, 3), 0), ((1, 3), 1), ((2,), 1), ((1, 2, 1, 2), 0), ((1, 3, 5), 2)])
def test_heading_jumps(spark, levels, n):
    rows = spark.createDataFrame([("u", i, x) for i, x in enumerate(levels)], "uri string, idx int, level int")
    assert outline.hierarchy(rows).count() == n


def test_folds_and_sections(spark):
    w = ws(spark, a=":a: 1\n:b: 2\n\n= T\ntext\n== S\n----\ncode\n----\n== R\n\n")
    got = sorted((r.start_ln, r.end_ln, r.kind) for r in outline.folds(w.lines).collect())
    assert got == [(0, 1, "imports"), (3, 10, "region"), (5, 8, "region"), (6, 8, "region"), (9, 10, "region")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("[source,rust]\n----\nfn main() {}\n----", [("literal", None, "fn main() {}", "rust")]),
        ("= T\n:k: v\n\n== A\ntwo\nlines\n\n* x\n** y\n. z", [("heading", 1, "A", None), ("paragraph", None, "two lines", None), ("list_item", 0, "x", None), ("list_item", 1, "y", None), ("list_item", 0, "z", None)]),
        ("[mermaid]\n----\na\n\nb\n----", [("literal", None, "a", None), ("paragraph", None, "b", None), ("literal", None, "", None)]),
        ("image::p.png[Alt,width=3]", [("image", None, "p.png", None)]),
    ],
)
def test_blocks(spark, text, want):
    docs = spark.createDataFrame([("u", text)], "uri string, text string")
    assert [(r.kind, r.level, r.text, r.language) for r in sorted(blocks.blocks(docs).collect(), key=lambda r: r.idx)] == want


def test_table_rows():
    assert blocks.Reader.table_rows(["|a |b", "|1 |2", "|3", "|4"]) == [["a", "b"], ["1", "2"], ["3", "4"]]
    assert blocks.Reader.table_rows(["|a", "|b", "", "|c", "|d"]) == [["a", "b"], ["c", "d"]]


def test_inlines():
    assert [(p["kind"], p["text"], p["url"]) for p in blocks.inlines("a *b* _c_ `d` <<e,f>> <<g>> [[h]]!")] == [
        ("text", "a ", None), ("bold", "b", None), ("text", " ", None), ("italic", "c", None), ("text", " ", None), ("mono", "d", None), ("text", " ", None),
        ("link", "f", "#e"), ("text", " ", None), ("link", "g", "#g"), ("text", " ", None), ("anchor", "h", None), ("text", "!", None),
    ]
    assert blocks.inlines("") == [{"kind": "text", "text": "", "url": None}]


def test_diagrams(spark):
    text = "[mermaid]\n----\n----\n\n[mermaid]\n----\nwhat\nA[x --> B(y\n----\n\n[PlantUML]\n----\nA -> \"B\n----\n"
    got = sorted((r.code, r.ln) for r in diagrams.lint(ws(spark, a=text)).collect())
    assert got == [("DIAGRAM001", 0), ("DIAGRAM002", 5), ("DIAGRAM003", 6), ("DIAGRAM003", 6), ("DIAGRAM004", 11), ("DIAGRAM005", 12), ("DIAGRAM006", 11)]


def test_domains(spark):
    docs = ws(spark, a="= ADR-12\n:status: Proposed\n\n== Context\n== Decision\n", b="= RFC 7\n:category: informational\n== Abstract\n", c="plain", d="").docs
    assert {r.uri[-6]: (r.domain, round(r.score, 1)) for r in domains.choose(docs).collect()} == {"a": ("bridge", 1.0), "b": ("rfc", 1.0), "c": ("generic", 0.2), "d": ("generic", 0.1)}
    assert sorted(r.message for r in domains.adr_rules(g.Workspace(docs)).collect()) == ["Missing required ADR section: 'Consequences'"]
    assert domains.routed(g.Workspace(docs)).count() == 1


DUAL = """= Deck
:author: Me
:slide-bullets: 2
:custom: x

== Both
:slide-layout: Two

[.slide-only]
== Only slides

* one (not shown)
* two

* three

[.document]
A paragraph for <<somewhere>> readers.

[.slide]
* a

image::p.png[Alt,width=50%]

1. first
2. second

```sql
select 1
```
"""


def test_dual_documents(spark):
    docs = spark.createDataFrame([("u", DUAL)], "uri string, text string")
    found = sorted(dual.blocks(docs).collect(), key=lambda r: r.idx)
    assert [(r.kind, r.selector) for r in found] == [("section", "both"), ("section", "slide-only"), ("bullets", "both"), ("paragraph", "document"), ("bullets", "slide"), ("image", "both"), ("numbers", "both"), ("code", "both")]
    assert found[0].slide_layout == "Two" and found[5].width == "50%" and found[5].alt == "Alt" and found[6]["items"] == ["first", "second"] and found[7].language == "sql"
    meta = dual.metadata(docs).first()
    assert (meta.title, meta.author, meta.slide_bullets, meta.other) == ("Deck", "Me", 2, {"custom": "x"})
    slides = {r.idx: r for r in dual.for_format(dual.blocks(docs), dual.metadata(docs), "slide").collect()}
    assert set(slides) == {0, 1, 2, 4, 5, 6, 7} and slides[2]["items"] == ["one", "two"]
    assert sorted(r.code for r in dual.lint(docs).collect()) == ["DUAL001", "DUAL005", "DUAL006", "DUAL008"]


def test_selectors(spark):
    names = ["slide", ".Slide-Only", "if-slide-x", "if-document", "both", "other", ".document"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(dual.selector(F.col("n"))).collect()]
    assert got == ["slide", "slide-only", "if-slide", "if-document", "both", "both", "document"]


def test_contract(spark):
    anchors = spark.createDataFrame([("_Toc1", "intro", "x"), ("_Toc2", "intro", "x"), ("_Toc3", "Bad_ID", None)], "bookmark string, semantic_id string, original_bookmark string")
    styles = spark.createDataFrame([("H1", "heading", 0), ("H2", "", 10), ("H3", "body", None)], "style_id string, role string, heading_level int")
    links = spark.createDataFrame([("l1", True, None, None), ("l2", False, None, "a")], "link_id string, is_external boolean, url string, anchor_target string")
    got = sorted((r.severity, r.element) for r in contract.validate(anchors, styles, links).collect())
    assert got == [("error", "H1"), ("error", "H2"), ("error", "H2"), ("error", "_Toc2"), ("error", "_Toc3"), ("error", "l1"), ("warning", "_Toc3"), ("warning", "intro")]
    one = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    more = contract.validate(anchors, styles.limit(0), links, found_styles=one("style_id", "H9"), found_bookmarks=one("bookmark", "_Hlk1", "_Toc1", "_x"), references=one("semantic_id", "intro", "gone"))
    got = sorted((r.severity, r.element) for r in more.where("phase = 'completeness'").collect())
    assert got == [("error", "gone"), ("warning", "H9"), ("warning", "_x"), ("warning", "paragraph_styles"), ("warning", "paragraph_styles")]
    assert [(r.bookmark, r.back) for r in contract.round_trip(anchors).collect()] == [("_Toc2", "_Toc1")]


@pytest.mark.parametrize("text, want", [("A1:C10", (0, 9, 0, 2)), ("A:C", (0, None, 0, 2)), ("1:10", (0, 9, 0, None)), ("b2", (1, 1, 1, 1)), ("*", (0, None, 0, None)), ("", (0, None, 0, None)), ("AA1", (0, 0, 26, 26)), ("7", (6, 6, 0, None))])
def test_ranges(text, want):
    spec = ranges.parse(text)
    assert (spec.r0, spec.r1, spec.c0, spec.c1) == want


@pytest.mark.parametrize("text", ["A1:C", "A0", "1A", "A1:B2:C3", "A1:3", "$"])
def test_bad_ranges(text):
    with pytest.raises(ranges.InvalidRange):
        ranges.parse(text)


def test_strict_ranges_and_rows():
    with pytest.raises(ranges.InvalidRange):
        ranges.parse_strict("A:C")
    assert ranges.parse_rows("2:5") == (1, 4) and ranges.parse_rows("3") == (2, 2) and ranges.parse_rows("*") == (0, None)
    with pytest.raises(ranges.InvalidRange):
        ranges.parse_rows("0")
    assert [ranges.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_text_functions(spark):
    assert one(spark, fx.readability(F.col("t")), t="") == 100.0
    assert [x for x in one(spark, fx.passive_hits(F.col("t")), t="this needed work. It was Opened, is red.")] == ["needed", "opened"]
    assert one(spark, fx.heading_slug(F.col("t")), t="1.2 Purpose and Scope") == "purpose-and-scope"
    assert one(spark, fx.text_slug(F.col("t")), t="!!") is None
    assert one(spark, fx.slide_text(F.col("t")), t="a (b (c) d) e ) f (open") == "a e f"
    assert one(spark, fx.slide_text(F.col("t")), t="word " * 30) == " ".join(["word"] * 16) + "..."
    assert [one(spark, fx.serial_to_iso(F.col("s")), s=float(s)) for s in (1, 59, 60, 61, 44927, 0)] == ["1900-01-01", "1900-02-28", "1900-02-28", "1900-03-01", "2023-01-01", None]
    assert one(spark, fx.serial_to_iso(F.col("s")), s=44927.5) == "2023-01-01T12:00:00"
    assert one(spark, fx.normal_path(F.col("a"), F.col("b")), a="file:///x/y/z.adoc", b="../q/./r.adoc") == "file:///x/q/r.adoc"
    assert one(spark, fx.offset_line(F.col("t"), F.lit(4)), t="ab\ncd\ne") == 1


def test_rename_keeps_labels(spark):
    w = ws(spark, a="[[x]]\n<<x,the label>> <<x-y>> <<x>>")
    assert sorted(r.new_line for r in fixes.rename_edits(w, "x", "z").collect()) == ["<<z,the label>> <<x-y>> <<z>>", "[[z]]"]


def test_lists_and_paragraph_islands(spark):
    w = ws(spark, a="one\ntwo\n\n* a\n* b\n. c\n\n* d")
    assert sorted((r.ln, r.list_type, r.list) for r in ln.list_items(w.lines).collect()) == [(3, "unordered", 1), (4, "unordered", 1), (5, "ordered", 2), (7, "unordered", 3)]
    assert sorted((r.first_ln, r.text) for r in ln.paragraphs(w.lines).collect())[0] == (0, "one two")


def test_user_rules(spark):
    def broken(doc):
        raise KeyError("x")

    def counts(doc):
        yield f"{len(doc['blocks'])} blocks of {doc['title']}"
        yield {"message": "m", "severity": "odd", "code": 7}

    docs = spark.createDataFrame([("u", "= T\n\nIt was done.\n\nFine.")], "uri string, text string")
    got = plugins.run(docs, {"passive": plugins.no_passive_voice, "broken": broken, "counts": counts}).collect()
    assert [(r.rule, r.code, r.severity, r.message) for r in got] == [("passive", "STYLE001", "warning", "Passive voice detected"), ("broken", "PLUGIN", "error", "Rule failed: KeyError: 'x'"), ("counts", None, "warning", "2 blocks of T"), ("counts", "7", "warning", "m")]
    assert got[0].context == "It was done."

    def endless(doc):
        while True:
            pass

    def slow(doc):
        import time

        time.sleep(60)

    def many(doc):
        return [f"m{i}" for i in range(20_000)]

    got = plugins.run(docs, {"endless": endless, "slow": slow, "many": many}, steps=50_000, seconds=1.0).collect()
    assert [r.message for r in got[:2]] == ["Rule failed: RuleError: endless: more than 50000 steps", "Rule failed: RuleError: slow: more than 1 seconds"]
    assert len(got) == 20_002


def test_codecs(spark):
    row = spark.createDataFrame([("graph TD; A-->B", "a/b.PNG")], "s string, p string")
    got = row.select(codecs.decode_source(codecs.encode_source(F.col("s"))).alias("back"), codecs.diagram_url("http://k/", F.lit("mermaid"), F.lit("svg"), F.col("s")).alias("url"), codecs.file_media_type(F.col("p")).alias("m"), codecs.media_type(F.lit("x")).alias("n"), codecs.file_name(F.col("p")).alias("f")).first()
    assert got.back == "graph TD; A-->B" and got.url.startswith("http://k/mermaid/svg/") and "=" not in got.url
    assert (got.m, got.n, got.f) == ("image/png", "application/octet-stream", "b.PNG")


def test_typst(spark):
    docs = spark.createDataFrame([("u", '= A "T"\n:author: Me\n\n== H\n\ntext\n\n* a\n. b\n\n[source,sql]\n----\nx\n----\n\n|===\n|c |d\n|===\n')], "uri string, text string")
    found, heads = blocks.blocks(docs), blocks.document_headers(docs)
    assert typst.transpile(found, heads).first()["text"] == '#set document(title: "A \\"T\\"")\n== H\n\ntext\n\n- a\n\n+ b\n\n```sql\nx\n```\n\n#table(columns: 2, [c], [d])\n'
    assert typst.transpile(found, heads, "t.typ").first()["text"].startswith('#import "t.typ": template\n#show: template.with(title: "A \\"T\\"", author: "Me")')


def test_an_index_holds_the_same_relations(spark):
    w = ws(spark, a="[[a]] [[b-1]]\n= T\n:k: v\n:k: w\nx <<a,l>> <<c>> <<d/e.adoc#,l>>\n== S [[é]]", b=":flag:\n[[a]]\n", c="plain")
    one = w.indexed()
    for name in ("all_definitions", "definitions", "references", "file_references", "attributes", "symbols", "headers"):
        assert sorted(map(str, getattr(w, name).collect())) == sorted(map(str, getattr(one, name).collect())), name


def test_chains_are_followed_to_their_end(spark):
    rows = [(k, k - 1 if k else None) for k in range(70)] + [(100, 101), (101, 100)]
    got = g.resolve_chain(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()
    assert sorted((r.ancestor, r.depth) for r in got if r.k == 69) == [(a, 69 - a) for a in range(70)]
    assert sorted((r.k, r.ancestor, r.depth) for r in got if r.k >= 100) == [(100, 100, 0), (100, 101, 1), (101, 100, 1), (101, 101, 0)]
    assert len(got) == 70 * 71 // 2 + 4
