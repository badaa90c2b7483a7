"""The queries over the test tables and the synthetic workspace, each with its DuckDB SQL.

What is expected of the workspace is told from the keys of the tables it was rendered
from, never by reading the text again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators import blocks, contract, diagrams, domains, dual, editor, fixes, grids, outline, prose, reports, rules, slides
from docloom.operators import graph as g
from docloom.operators import lines as ln
from docloom.plans import corpus
from docloom.plans.corpus import read
from docloom.sources import ooxml, tables
from docloom.sources.ranges import RangeSpec
from docloom.store import shared_dir
from docloom.streaming import workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from docloom.plans import indexes, packages, small  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


READABILITY = r"""
WITH w AS (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT *, len(ws) AS n, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS sentences,
  list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))))) AS syl FROM w),
r AS (SELECT *, CASE WHEN n = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * n / sentences - CAST(84.6 AS DOUBLE) * syl / n)) END AS score FROM s)
"""
GRADE = "CASE WHEN score >= 90 THEN '5th grade' WHEN score >= 80 THEN '6th grade' WHEN score >= 70 THEN '7th grade' WHEN score >= 60 THEN '8th-9th grade' WHEN score >= 50 THEN '10th-12th grade' WHEN score >= 30 THEN 'College' ELSE 'College graduate' END"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
PASSIVE = LINES + ", p AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(lower(line), '{a}([^\\s.,]*ed)[\\s.,]', 1)) AS verb FROM l" for a in fx.AUXILIARIES) + "), h AS (SELECT doc_id, verb FROM p WHERE length(verb) > 3)"


def _as_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), F.col("doc_id").alias("load_ord"), "text")


def _passive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(fx.passive_hits(F.col("text"))).alias("verb"))


@query(READABILITY + "SELECT lang, count(*) AS n_docs, round(avg(score), 4) AS avg_score, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(syl) AS BIGINT) AS n_syllables FROM r GROUP BY lang")
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prose.summary(read(spark, sf_dir, "documents"), "lang")
    return own.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg("readability"), 4).alias("avg_score"), F.sum("words").cast("long").alias("n_words"), F.sum("syllables").cast("long").alias("n_syllables"))


@query(READABILITY + f", {PASSIVE}, c AS (SELECT doc_id, count(*) AS passive FROM h GROUP BY doc_id) SELECT r.doc_id, coalesce(passive, 0) AS passive, round(score, 3) AS readability, {GRADE} AS grade FROM r LEFT JOIN c USING (doc_id)")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prose.summary(read(spark, sf_dir, "documents"), "doc_id")
    return own.select("doc_id", F.col("passive").cast("long").alias("passive"), F.round("readability", 3).alias("readability"), "grade")


@query(READABILITY + f"SELECT {GRADE} AS grade, count(*) AS n FROM r GROUP BY ALL")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.summary(read(spark, sf_dir, "documents")).groupBy("grade").agg(F.count("*").alias("n"))


@query(f"WITH {PASSIVE} SELECT doc_id, verb, count(*) AS n FROM h GROUP BY ALL")
def passive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passive(spark, sf_dir).groupBy("doc_id", "verb").agg(F.count("*").alias("n"))


@query(r"WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents) SELECT doc_id, word, count(*) AS n FROM t WHERE word IN ('the', 'that', 'was', 'very') GROUP BY ALL")
def weasel_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.weasel_hits(F.col("text"), ("the", "that", "was", "very"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(trim(regexp_replace(p_name, '^[0-9.]+', ''))), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS heading_slug,
 nullif(trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '-'), '') AS text_slug,
 trim(regexp_replace(lower(p_brand || ': ' || p_name), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS title_id FROM part""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_brand", F.lit(": "), "p_name")
    return read(spark, sf_dir, "part").select("p_partkey", fx.heading_slug(F.col("p_name")).alias("heading_slug"), fx.text_slug(F.col("p_type")).alias("text_slug"), fx.title_id(title).alias("title_id"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", fx.content_hash(F.col("text"), "sha256:").alias("hash"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS bare FROM conversations)
SELECT conv_id, turn, CASE WHEN length(bare) <= 80 THEN bare WHEN strpos(substr(bare, 1, 80), ' ') > 0 THEN regexp_replace(substr(bare, 1, 80), ' [^ ]*$', '') || '...' ELSE substr(bare, 1, 80) || '...' END AS slide FROM t""")
def slide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", fx.slide_text(F.col("text")).alias("slide"))


@query("SELECT conv_id, turn, length(text) > 200 AS needs_notes, CASE WHEN length(text) > 80 THEN 'Key points: ' || text END AS notes FROM conversations")
def speaker_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    para, none = F.lit("paragraph"), F.lit(None).cast("array<string>")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", fx.needs_notes(para, F.col("text"), F.lit(0)).alias("needs_notes"), fx.speaker_notes(para, F.col("text"), none).alias("notes"))


@query("SELECT p_partkey, r FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) WHERE r BETWEEN 10 AND 99")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.row_slice(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 10, 99).select("p_partkey", F.col("r").cast("long").alias("r"))


@query("SELECT p_partkey, coalesce(p_name, '') AS c0, coalesce(p_type, '') AS c1, '' AS c2 FROM part")
def col_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("cells"))
    own = grids.projected(rows, [0, 2, 7])
    return own.select("p_partkey", *(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)))


@query("""WITH g AS (SELECT l_orderkey AS k, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS c FROM lineitem GROUP BY 1), w AS (SELECT k % 100 AS t, max(len(c)) AS w FROM g GROUP BY 1)
SELECT k, len(c) AS own, w AS width, array_to_string(list_concat(c, list_transform(range(w - len(c)), lambda i: '')), '|') AS row FROM g JOIN w ON t = k % 100""")
def grid_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("v")))), lambda x: x["v"])
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(cells.alias("cells")).withColumn("table_id", F.col("k") % 100).withColumn("own", F.size("cells").cast("long"))
    return grids.padded(rows).select("k", "own", F.size("cells").cast("long").alias("width"), F.array_join("cells", "|").alias("row"))


@query("""WITH c AS (SELECT CAST(l_orderkey AS INT) AS r, l_linenumber AS c, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
g AS (SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT unnest(range(0, (SELECT max(r) + 1 FROM c))) AS r), range(1, 5) b(c)) SELECT g.r, g.c, coalesce(CAST(c.v AS VARCHAR), '') AS v FROM g LEFT JOIN c ON c.r = g.r AND c.c = g.c""")
def dense_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns B to E of all rows, gaps filled."""
    cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("r"), F.col("l_linenumber").alias("c")).agg(F.sum("l_quantity").cast("long").cast("string").alias("v"))
    return grids.dense(cells.withColumn("table_id", F.lit("t")), RangeSpec("columns", c0=1, c1=4)).select("r", "c", "v")


@query("""SELECT o_orderkey, CASE WHEN k >= 702 THEN chr(CAST(65 + (k - 702) // 676 AS INT)) || chr(CAST(65 + (k - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (k - 702) % 26 AS INT))
 WHEN k >= 26 THEN chr(CAST(64 + k // 26 AS INT)) || chr(CAST(65 + k % 26 AS INT)) ELSE chr(CAST(65 + k AS INT)) END AS letters, k AS back FROM (SELECT o_orderkey, o_orderkey % 16384 AS k FROM orders)""")
def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "orders").select("o_orderkey", fx.column_letters(F.col("o_orderkey") % 16384).alias("letters"))
    return own.withColumn("back", fx.column_index(F.col("letters")).cast("long"))


@query("""SELECT o_orderkey, strftime(CASE WHEN s >= 60 THEN DATE '1899-12-30' + CAST(s AS INT) ELSE DATE '1899-12-31' + CAST(s AS INT) END, '%Y-%m-%d') || CASE WHEN f > 0 THEN strftime(TIMESTAMP '2000-01-01' + to_seconds(CAST(f * 3600 AS BIGINT)), 'T%H:%M:%S') ELSE '' END AS iso
 FROM (SELECT o_orderkey, o_orderkey % 50000 + 1 AS s, o_orderkey % 24 AS f FROM orders)""")
def excel_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.col("o_orderkey") % 50000 + 1 + (F.col("o_orderkey") % 24) / 24.0
    return read(spark, sf_dir, "orders").select("o_orderkey", fx.serial_to_iso(serial).alias("iso"))


@query("SELECT o_orderkey, round(e / 9525.0, 4) AS px, round(e / 914400.0, 4) AS inches, round(e / 12700.0, 4) AS pt, round(e / 360000.0, 4) AS cm FROM (SELECT o_orderkey, o_orderkey * 1000 AS e FROM orders)")
def emu_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (F.col("o_orderkey") * 1000).cast("double")
    return read(spark, sf_dir, "orders").select("o_orderkey", *(fx.from_emu(e, u).alias(n) for u, n in (("px", "px"), ("in", "inches"), ("pt", "pt"), ("cm", "cm"))))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html_text,
 replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS json_text FROM pages""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", fx.escape_html(F.col("html")).alias("html_text"), fx.escape_json(F.col("html")).alias("json_text"))


HEADINGS = "h AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS idx, unnest(l) AS level FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<h([1-6])', 1), lambda x: CAST(x AS INT)) AS l FROM pages))"


def _html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.regexp_extract_all("html", F.lit("<h([1-6])"), F.lit(1))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("uri"), F.posexplode(levels).alias("idx", "level")).select("uri", (F.col("idx") + 1).cast("long").alias("idx"), F.col("level").cast("int").alias("level"))


@query(f"WITH {HEADINGS}, p AS (SELECT *, lag(level, 1, 0) OVER (PARTITION BY page_id ORDER BY idx) AS before FROM h) SELECT page_id AS uri, idx, before, level FROM p WHERE level > before + 1")
def heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.heading_jumps(_html_headings(spark, sf_dir))


@query(f"WITH {HEADINGS} SELECT page_id AS uri, idx, level, (SELECT max(p.idx) FROM h p WHERE p.page_id = h.page_id AND p.idx < h.idx AND p.level < h.level) AS parent_idx FROM h")
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.heading_tree(_html_headings(spark, sf_dir), bits=3)


@query(f"WITH {HEADINGS} SELECT page_id AS uri, idx, level, (SELECT min(p.idx) FROM h p WHERE p.page_id = h.page_id AND p.idx > h.idx AND p.level <= h.level) AS next_idx FROM h")
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.section_ends(_html_headings(spark, sf_dir), bits=3)


def _geography(spark: SparkSession, sf_dir: str) -> g.Workspace:
    return g.Workspace(corpus.geography(spark, sf_dir))


def _decisions(spark: SparkSession, sf_dir: str) -> g.Workspace:
    return g.Workspace(corpus.decisions(spark, sf_dir))


GEO_DEFS = """SELECT 'region-' || r_regionkey AS id, 'file:///work/geo/region-' || r_regionkey || '.adoc' AS uri FROM region
 UNION ALL SELECT 'nation-' || n_nationkey, 'file:///work/nation/nation-' || n_nationkey || '.adoc' FROM nation
 UNION ALL SELECT 'supplier-' || s_suppkey, 'file:///work/supplier/supplier-' || s_suppkey || '.adoc' FROM supplier"""
GEO_REFS = """SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc' AS uri, 'supplier-' || n_nationkey AS id FROM nation
 UNION ALL SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', 'supplier-' || (2 * s_suppkey + 25) FROM supplier WHERE s_acctbal >= 0
 UNION ALL SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', 'supplier-' || (2 * s_suppkey + 26) FROM supplier WHERE s_acctbal >= 0"""
GEO_FILES = """SELECT 'file:///work/index.adoc' AS uri, 'file:///work/geo/region-' || r_regionkey || '.adoc' AS to_uri FROM region
 UNION ALL SELECT 'file:///work/geo/region-' || n_regionkey || '.adoc', 'file:///work/nation/nation-' || n_nationkey || '.adoc' FROM nation"""
GEO = f"d AS ({GEO_DEFS}), r AS ({GEO_REFS}), f AS ({GEO_FILES}), e AS (SELECT r.uri, d.uri AS to_uri FROM r JOIN d USING (id) UNION SELECT uri, to_uri FROM f), reach(uri) AS (SELECT 'file:///work/index.adoc' UNION SELECT e.to_uri FROM reach JOIN e USING (uri))"
GEO_DOCS = "(SELECT 'file:///work/index.adoc' AS uri UNION ALL SELECT uri FROM d)"


@query(f"SELECT id, uri, 0 AS ln, 2 AS col FROM ({GEO_DEFS})")
def anchor_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).definitions.select("id", "uri", "ln", "col")


@query(f"SELECT uri, id, count(*) AS n FROM ({GEO_REFS}) GROUP BY ALL")
def xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).references.groupBy("uri", "id").agg(F.count("*").alias("n"))


@query("SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc' AS uri, 4 AS ln, 7 AS col, 'supplier-' || (2 * s_suppkey + 25) AS id FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', 4, CAST(16 + length('supplier-' || (2 * s_suppkey + 25)) AS INT), 'supplier-' || (2 * s_suppkey + 26) FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc', 4, 6, 'supplier-' || n_nationkey FROM nation")
def xref_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).references.select("uri", "ln", "col", "id")


@query(GEO_FILES)
def file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.resolved_files(_geography(spark, sf_dir)).select("uri", "to_uri")


@query("""SELECT 'file:///work/index.adoc' AS uri, 'Index' AS name, 1 AS level UNION ALL SELECT 'file:///work/geo/region-' || r_regionkey || '.adoc', r_name, 2 FROM region
 UNION ALL SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc', n_name, 3 FROM nation UNION ALL SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', s_name, 4 FROM supplier""")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.headers(_geography(spark, sf_dir).lines).select("uri", "name", "level")


@query("""SELECT 'file:///work/index.adoc' AS uri, 'author' AS name, 'docs' AS value UNION ALL SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc', 'region', CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def doc_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir).attributes


@query("SELECT s_name AS name, 'header3plus' AS kind FROM supplier WHERE contains(lower(s_name), '1') UNION ALL SELECT 'supplier-' || s_suppkey, 'anchor' FROM supplier WHERE contains(CAST(s_suppkey AS VARCHAR), '1') UNION ALL SELECT 'nation-' || n_nationkey, 'anchor' FROM nation WHERE contains(CAST(n_nationkey AS VARCHAR), '1') UNION ALL SELECT 'region-' || r_regionkey, 'anchor' FROM region WHERE contains(CAST(r_regionkey AS VARCHAR), '1') UNION ALL SELECT n_name, 'header2' FROM nation WHERE contains(lower(n_name), '1') UNION ALL SELECT r_name, 'header1' FROM region WHERE contains(lower(r_name), '1')")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.search_symbols(_geography(spark, sf_dir).symbols, "1").select("name", "kind")


@query(f"WITH d AS ({GEO_DEFS}), r AS ({GEO_REFS}) SELECT uri, 'WS001' AS code, 'Broken reference: ''' || id || ''' is not defined' AS message FROM r WHERE id NOT IN (SELECT id FROM d)")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.broken_links(_geography(spark, sf_dir)).select("uri", "code", "message")


@query(f"WITH r AS ({GEO_REFS}) SELECT id, count(*) AS n, min(uri) AS first_uri FROM r GROUP BY id")
def reverse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reverse_index(_geography(spark, sf_dir)).select("id", "n", F.get("places", F.lit(0))["uri"].alias("first_uri"))


@query(f"WITH RECURSIVE {GEO} SELECT uri FROM reach")
def reachable_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.reachable_documents(_geography(spark, sf_dir)).select("uri")


@query(f"WITH RECURSIVE {GEO} SELECT uri, 'BRIDGE003' AS code, 'warning' AS severity FROM {GEO_DOCS} WHERE uri NOT IN (SELECT uri FROM reach)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.orphaned(_geography(spark, sf_dir)).select("uri", "code", "severity")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT 'supplier-' || (l_suppkey % 500) AS uri, 'supplier-' || ((l_suppkey * 7 + l_partkey % 3) % 500) AS to_uri FROM lineitem),
r(uri, depth) AS (SELECT 'supplier-1', 0 UNION SELECT l.to_uri, r.depth + 1 FROM r JOIN l ON l.uri = r.uri WHERE r.depth < 40)
SELECT uri, min(depth) AS depth FROM r GROUP BY uri""")
def reachable_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths over links between suppliers, in parts of a few hundred links."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    name = lambda k: F.concat(F.lit("supplier-"), (k % 500).cast("string"))
    links = read(spark, sf_dir, "lineitem").select(name(s).alias("uri"), name(s * 7 + p % 3).alias("to_uri")).distinct()
    return g.reachable_in_parts(spark.createDataFrame([("supplier-1",)], "uri string"), links, 300)


@query("SELECT CAST(client_id AS VARCHAR) AS id, count(*) AS n, min(click_id) AS first_ln, max(click_id) AS last_ln, true AS bounded FROM (SELECT DISTINCT client_id, click_id FROM clicks WHERE client_id IS NOT NULL AND click_id IS NOT NULL) GROUP BY client_id")
def reverse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as references to clients, of whom a few have a great many: the directory of pages."""
    refs = read(spark, sf_dir, "clicks").where("client_id is not null and click_id is not null").select(F.col("client_id").cast("string").alias("id"), F.lit("file:///clicks").alias("uri"), F.col("click_id").alias("ln"), F.lit(0).alias("col")).distinct()
    pages = g.reverse_pages(refs, 50)
    held = F.max(F.greatest("n", F.size("places"))) <= 50
    return pages.groupBy("id").agg(F.sum("n").alias("n"), F.min("first.ln").alias("first_ln"), F.max("last.ln").alias("last_ln"), held.alias("bounded"))


@query(f"WITH RECURSIVE {GEO}, o AS (SELECT count(*) AS w FROM {GEO_DOCS} WHERE uri NOT IN (SELECT uri FROM reach)), n AS (SELECT count(*) AS n FROM {GEO_DOCS}) SELECT n AS documents, 0 AS errors, w AS warnings, 0 AS infos, CAST(round(greatest(0.0, least(100.0, 100.0 * (n * 2 - 3 * w) / (n * 2)))) AS INT) AS score, CASE WHEN w > 0 THEN 'passing_with_warnings' ELSE 'passing' END AS status FROM o, n")
def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.bridge().result(_geography(spark, sf_dir))


@query(f"WITH d AS ({GEO_DEFS}), r AS ({GEO_REFS}) SELECT (SELECT count(*) + 1 FROM d) AS documents, (SELECT count(DISTINCT id) FROM d) AS definitions, (SELECT count(*) FROM r) AS refs, (SELECT 2 * count(*) + 1 FROM d) AS symbols")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.statistics(_geography(spark, sf_dir))


ADR = """a AS (SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS note, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'Maybe' WHEN o_orderstatus = 'F' THEN 'Accepted' WHEN o_orderstatus = 'O' THEN 'Deprecated' ELSE 'Superseded' END AS status FROM orders),
u AS (SELECT *, 'file:///work/adr/adr-' || k || '.adoc' AS uri FROM a)"""


@query(f"""WITH {ADR}, c AS (SELECT u.uri, u.k - 1 AS t, b.k IS NULL AS missing, CASE WHEN b.note THEN NULL ELSE b.status END AS status FROM u LEFT JOIN u b ON b.k = u.k - 1 WHERE u.k % 5 = 0 AND NOT u.note)
SELECT uri, CASE WHEN missing THEN 'BRIDGE002' ELSE 'BRIDGE001' END AS code, CASE WHEN missing OR status IS NULL THEN 'warning' ELSE 'error' END AS severity FROM c WHERE missing OR status IS NULL OR status NOT IN ('Deprecated', 'Superseded')""")
def supersedes_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.superseded_status(_decisions(spark, sf_dir)).select("uri", "code", "severity")


@query(f"""WITH {ADR}, p AS (SELECT uri, CASE WHEN note THEN 0 ELSE CASE WHEN status IS NULL THEN 0 WHEN status = 'Maybe' THEN 2 ELSE 3 END + CASE WHEN k % 7 = 0 THEN 2 ELSE 3 END END AS points FROM u)
SELECT uri, CASE WHEN points > 2 THEN 'bridge' ELSE 'generic' END AS domain, CASE WHEN points > 2 THEN round(points / 10.0, 1) ELSE 0.2 END AS score FROM p""")
def domain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.choose(corpus.decisions(spark, sf_dir)).withColumn("score", F.round(F.least(F.lit(1.1), "score"), 1))


@query(f"WITH {ADR} SELECT uri, 'ADR001' AS code, 'Missing required ADR section: ''Consequences''' AS message FROM u WHERE NOT note AND k % 7 = 0 UNION ALL SELECT uri, 'ADR002', 'Invalid status value ''Maybe''. Expected one of: Draft, Proposed, Accepted, Rejected, Deprecated, Superseded' FROM u WHERE NOT note AND status = 'Maybe'")
def adr_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.adr_rules(_decisions(spark, sf_dir)).select("uri", "code", "message")


@query(f"WITH {ADR} SELECT code, severity, count(*) AS n FROM (SELECT 'ADR001' AS code FROM u WHERE NOT note AND k % 7 = 0 UNION ALL SELECT 'ADR002' FROM u WHERE NOT note AND status = 'Maybe'), (SELECT unnest(['error', 'hint']) AS severity) GROUP BY ALL")
def adr_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of decision records, once as errors and once as hints."""
    ws = _decisions(spark, sf_dir)
    return domains.adr_rules(ws, "error").unionByName(domains.adr_rules(ws, "hint")).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {ADR} SELECT status, count(*) AS n FROM u WHERE NOT note AND status IS NOT NULL GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).attribute("status").groupBy("status").agg(F.count("*").alias("n"))


PART_URI = "'file:///work/part/part-' || p_partkey || '.adoc'"


@query(f"""SELECT {PART_URI} AS uri, 'DIAGRAM003' AS code, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1
 UNION ALL SELECT {PART_URI}, 'DIAGRAM001', 1 FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT {PART_URI}, 'DIAGRAM002', 1 FROM part WHERE p_partkey % 3 = 2
 UNION ALL SELECT {PART_URI}, 'DIAGRAM006', 1 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT {PART_URI}, 'DIAGRAM004', 1 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT {PART_URI}, 'DIAGRAM005', 1 FROM part WHERE p_partkey % 2 = 1""")
def diagram_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.lint(g.Workspace(corpus.sheets(spark, sf_dir))).groupBy("uri", "code").agg(F.count("*").alias("n"))


@query(f"""SELECT {PART_URI} AS uri, 'heading' AS kind, 2 AS n FROM part UNION ALL SELECT {PART_URI}, 'list_item', len(string_split(p_name, ' ')) FROM part
 UNION ALL SELECT {PART_URI}, 'table', 1 FROM part UNION ALL SELECT {PART_URI}, 'literal', 3 FROM part""")
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(corpus.sheets(spark, sf_dir), strict=False).groupBy("uri", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT {PART_URI} AS uri, 'size|' || p_size || '/type|' || p_type AS cells FROM part")
def block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks.blocks(corpus.sheets(spark, sf_dir)).where("kind = 'table'")
    return own.select("uri", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("cells"))


@query(f"SELECT {PART_URI} AS uri, 'sql' AS language, 'select ' || p_partkey AS text FROM part")
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(corpus.sheets(spark, sf_dir)).where("kind = 'literal' and language is not null").select("uri", "language", "text")


@query(f"SELECT {PART_URI} AS uri, 'DOC101' AS code, 'Section level jump detected (Level 1 -> Level 3). Missing Level 2?' AS message FROM part WHERE p_partkey % 4 = 0")
def heading_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks.blocks(corpus.sheets(spark, sf_dir)).where("kind = 'heading'")
    return outline.hierarchy(own).select("uri", "code", "message")


@query(f"SELECT {PART_URI} AS uri, unnest(range(0, len(string_split(p_name, ' ')))) AS pos, unnest(string_split(p_name, ' ')) AS text FROM part")
def list_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ln.list_items(ln.lines(corpus.sheets(spark, sf_dir)))
    pos = F.row_number().over(Window.partitionBy("uri", "list").orderBy("ln")) - 1
    return items.select("uri", pos.cast("long").alias("pos"), "text")


@query(f"SELECT {PART_URI} AS uri, count(*) * 0 + 2 AS n_sections, 'Part ' || p_partkey AS title, p_brand AS brand FROM part GROUP BY p_partkey, p_brand")
def document_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.size(F.filter("blocks", lambda b: b["kind"] == "heading")).cast("long")
    docs = blocks.documents(corpus.sheets(spark, sf_dir)).select("uri", heads.alias("n_sections"), "title", F.try_element_at("attributes", F.lit("brand")).alias("brand"))
    return docs.where("n_sections > 0")


@query("SELECT 1 AS passes, count(*) AS n, count(*) AS same FROM part")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written from their blocks have the same blocks when they are read again."""
    cols = ["idx", "kind", "level", "text", "style_id", "language", "list_type"]
    digest = F.transform("blocks", lambda b: F.xxhash64(*(F.coalesce(b[c].cast("string"), F.lit("\0")) for c in cols), F.coalesce(F.to_json(b["rows"]), F.lit("\0"))))
    first = blocks.documents(corpus.sheets(spark, sf_dir), strict=False).where(F.size("blocks") > 0)
    written = first.select("uri", blocks.generated(F.col("blocks")).alias("text"), digest.alias("h"))
    again = blocks.documents(written, strict=False, keep=("h",)).select("h", digest.alias("h2"))
    return again.agg(F.lit(1).alias("passes"), F.count("*").alias("n"), F.count_if(F.col("h") == F.col("h2")).alias("same"))


@query("WITH o AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS items FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(items[1:CASE WHEN l_orderkey % 3 = 0 THEN 2 WHEN l_orderkey % 3 = 1 THEN 3 ELSE 5 END], ',') AS shown FROM o")
def bullet_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("v")))), lambda x: x["v"])
    k = F.col("l_orderkey") % 3
    own = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("items"))
    return own.select("l_orderkey", F.array_join(dual.bullet_limit(F.col("items"), F.when(k == 0, 2), F.when(k == 1, 3)), ",").alias("shown"))


@query("SELECT event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_heading FROM events")
def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type").alias("head"))
    rows = events.join(kind).withColumn("heading", F.when(F.col("event_type") == F.col("head"), F.col("event_id"))).withColumn("at", F.struct("ts", "event_id"))
    return outline.last_heading(rows, "user_id", "at", "heading").select("event_id", "last_heading")


@query("SELECT s_nationkey AS role, min(s_name) AS style_id FROM supplier GROUP BY 1")
def canonical_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.canonical(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("role"), F.col("s_name").alias("style_id")), "role", "style_id")


@query("SELECT s_nationkey AS semantic_id, count(*) AS n, min(s_name) AS canonical, array_to_string(list(s_name ORDER BY s_name), ',') AS members FROM supplier GROUP BY 1 HAVING count(*) > 1")
def dup_semantic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("semantic_id"), F.col("s_name").alias("bookmark"))
    return contract.duplicates(own, "semantic_id", "bookmark").withColumn("members", F.array_join("members", ","))


@query("WITH s AS (SELECT p_partkey, p_type || ' ' || p_size AS style_id FROM part) SELECT DISTINCT style_id FROM s WHERE style_id NOT IN (SELECT style_id FROM s WHERE p_partkey % 50 = 0)")
def style_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(" "), "p_size").alias("style_id"))
    return contract.uncovered(styles.select("style_id").distinct(), "style_id", styles.where("p_partkey % 50 = 0").select("style_id"))


@query("WITH a AS (SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS k, 'new ' || s_name AS v FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k")
def contract_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return contract.merged(own.where("k % 2 = 0"), own.where("k % 3 = 0").withColumn("v", F.concat(F.lit("new "), "v")), "k")


@query(f"WITH RECURSIVE {GEO}, o AS (SELECT count(*) AS w FROM {GEO_DOCS} WHERE uri NOT IN (SELECT uri FROM reach)), n AS (SELECT count(*) AS n FROM {GEO_DOCS}) SELECT '{{\"status\":\"passing\",\"errors\":0,\"warnings\":' || w || ',\"score\":' || CAST(round(greatest(0.0, least(100.0, 100.0 * (n * 2 - 3 * w) / (n * 2)))) AS INT) || '}}' AS json FROM o, n")
def compliance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.minimal_json(rules.bridge().result(_geography(spark, sf_dir)))


@query(f"WITH {ADR} SELECT uri, 'warning[ADR002]: Invalid status value ''Maybe''. Expected one of: Draft, Proposed, Accepted, Rejected, Deprecated, Superseded' || chr(10) || '  --> ' || uri || ':3:10' AS text FROM u WHERE NOT note AND status = 'Maybe'")
def diagnostic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.diagnostic_text(domains.adr_rules(_decisions(spark, sf_dir)).where("code = 'ADR002'"))


@query(f"""WITH d AS ({GEO_DEFS}), r AS ({GEO_REFS}), b AS (SELECT uri, count(*) AS n FROM r WHERE id NOT IN (SELECT id FROM d) GROUP BY uri) SELECT uri, n FROM b""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_document(rules.broken_links(_geography(spark, sf_dir))).select("uri", "n")


@query(f"""WITH {ADR}, c AS (SELECT DISTINCT b.k, b.status FROM u JOIN u b ON b.k = u.k - 1 WHERE u.k % 5 = 0 AND NOT u.note AND NOT b.note AND b.status IN ('Accepted', 'Maybe'))
SELECT 'file:///work/adr/adr-' || k || '.adoc' AS uri, 2 AS ln, 9 AS col, CAST(9 + length(status) AS INT) AS end_col, 'Deprecated' AS new_text FROM c""")
def status_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _decisions(spark, sf_dir)
    return fixes.status_edits(rules.superseded_status(ws), ws).select("uri", "ln", "col", "end_col", "new_text")


@query(f"WITH RECURSIVE {GEO} SELECT 'file:///work/index.adoc' AS uri, '* <<' || substr(uri, length('file:///work/') + 1) || '#,' || regexp_replace(regexp_extract(uri, '[^/]*$'), '\\.[^.]*$', '') || '>>' || chr(10) AS new_text FROM {GEO_DOCS} WHERE uri NOT IN (SELECT uri FROM reach)")
def orphan_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _geography(spark, sf_dir)
    return fixes.orphan_edits(rules.orphaned(ws), ws).select("uri", "new_text")


@query("SELECT 'file:///work/supplier/supplier-30.adoc' AS uri, '[[vendor-30]]' AS new_line FROM supplier WHERE s_suppkey = 30 UNION ALL SELECT 'file:///work/supplier/supplier-2.adoc', 'Then <<supplier-29>> and <<vendor-30,the other>>.' FROM supplier WHERE s_suppkey = 2 AND s_acctbal >= 0")
def rename_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.rename_edits(_geography(spark, sf_dir), "supplier-30", "vendor-30").select("uri", "new_line")


@query("SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc' AS uri, 4 AS first_ln, 4 AS last_ln, CASE WHEN s_acctbal >= 0 THEN 'Then <<supplier-' || (2 * s_suppkey + 25) || '>> and <<supplier-' || (2 * s_suppkey + 26) || ',the other>>.' ELSE 'The end.' END AS text FROM supplier UNION ALL SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', 0, 2, '[[supplier-' || s_suppkey || ']] ==== ' || s_name || ' :nation: ' || s_nationkey FROM supplier"
    " UNION ALL SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc', 0, 2, '[[nation-' || n_nationkey || ']] === ' || n_name || ' :region: ' || n_regionkey FROM nation UNION ALL SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc', 4, 4, 'See <<supplier-' || n_nationkey || ',its supplier>>.' FROM nation"
    " UNION ALL SELECT 'file:///work/geo/region-' || r_regionkey || '.adoc', 0, 1, '[[region-' || r_regionkey || ']] == ' || r_name FROM region UNION ALL SELECT 'file:///work/geo/region-' || n_regionkey || '.adoc', 3, CAST(2 + count(*) AS INT), string_agg(l, ' ' ORDER BY l) FROM (SELECT n_regionkey, '<<../nation/nation-' || n_nationkey || '.adoc#,' || n_name || '>>' AS l FROM nation) GROUP BY n_regionkey"
    " UNION ALL SELECT 'file:///work/index.adoc', 0, 1, '= Index :author: docs' UNION ALL SELECT 'file:///work/index.adoc', 3, CAST(2 + count(*) AS INT), string_agg(l, ' ' ORDER BY l) FROM (SELECT '<<geo/region-' || r_regionkey || '.adoc#,' || r_name || '>>' AS l FROM region)")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.paragraphs(_geography(spark, sf_dir).lines)


@query(f"""SELECT {PART_URI} AS uri, count(*) AS n FROM (SELECT p_partkey, unnest(range(0, 3)) FROM part) GROUP BY p_partkey""")
def delimiter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outline.folds(ln.lines(corpus.sheets(spark, sf_dir)))
    fences = outline.closing_delimiters(ln.lines(corpus.sheets(spark, sf_dir)))
    return own.join(fences.withColumnRenamed("ln", "start_ln"), ["uri", "start_ln", "end_ln"]).groupBy("uri").agg(F.count("*").alias("n"))


@query(f"SELECT {PART_URI} AS uri, 'source,sql' AS attribute, 1 AS n FROM part UNION ALL SELECT {PART_URI}, 'mermaid', 1 FROM part UNION ALL SELECT {PART_URI}, 'plantuml', 1 FROM part")
def pending_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.pending_attributes(ln.lines(corpus.sheets(spark, sf_dir))).groupBy("uri", "attribute").agg(F.count("*").alias("n"))


@query("SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc' AS uri, 'supplier-' || s_suppkey AS id, s_name AS title, 4 AS level FROM supplier UNION ALL SELECT 'file:///work/nation/nation-' || n_nationkey || '.adoc', 'nation-' || n_nationkey, n_name, 3 FROM nation UNION ALL SELECT 'file:///work/geo/region-' || r_regionkey || '.adoc', 'region-' || r_regionkey, r_name, 2 FROM region")
def anchor_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.anchor_sections(_geography(spark, sf_dir).lines).select("uri", "id", "title", "level")


@query(f"""WITH {ADR}, scored AS (SELECT *, (CASE WHEN status IS NULL THEN 0 WHEN status = 'Maybe' THEN 2 ELSE 3 END + CASE WHEN k % 7 = 0 THEN 2 ELSE 3 END) > 2 AS bridge FROM u WHERE NOT note),
t AS (SELECT k, 'anchor' AS element, 'variable' AS type FROM u UNION ALL SELECT k, 'header', 'class' FROM u
 UNION ALL SELECT k, 'header', 'class' FROM u WHERE NOT note UNION ALL SELECT k, 'header', 'class' FROM u WHERE NOT note UNION ALL SELECT k, 'header', 'class' FROM u WHERE NOT note AND k % 7 <> 0
 UNION ALL SELECT k, 'attribute_name', CASE WHEN bridge THEN 'enum' ELSE 'property' END FROM scored WHERE status IS NOT NULL UNION ALL SELECT k, 'attribute_value', CASE WHEN bridge AND status <> 'Maybe' THEN 'enumMember' ELSE 'string' END FROM scored WHERE status IS NOT NULL
 UNION ALL SELECT k, 'attribute_name', 'property' FROM scored WHERE k % 5 = 0 UNION ALL SELECT k, 'attribute_value', 'string' FROM scored WHERE k % 5 = 0)
SELECT element, type, count(*) AS n FROM t GROUP BY ALL""")
def semantic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.decisions(spark, sf_dir)
    return editor.tokens(ln.lines(docs), domains.choose(docs)).groupBy("element", "type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id - lag(user_id, 1, 0) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS d_line FROM events")
def token_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("uri"), F.col("user_id").alias("ln"), F.col("event_id").alias("col"))
    return outline.token_deltas(rows).select(F.col("col").alias("event_id"), "d_line")


@query("SELECT p_partkey, 'status' AS kind, 'Deprecated' AS label FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'attribute', unnest(['author', 'area']) FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'block', unnest(['source', 'sidebar']) FROM part WHERE p_partkey % 3 = 2")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("uri"), F.when(k == 0, ":status: dep").when(k == 1, ":a").otherwise("[s").alias("prefix"), F.when(k == 1, "rfc").otherwise("bridge").alias("domain"))
    return editor.completions(rows).withColumnRenamed("uri", "p_partkey")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS word, 0 AS start FROM part")
def word_at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    lns = part.select(F.col("p_partkey").alias("uri"), F.lit(0).alias("ln"), F.col("p_name").alias("line"))
    return editor.word_at(lns, lns.select("uri", "ln", F.lit(1).alias("col"))).select(F.col("uri").alias("p_partkey"), "word", "start")


@query("WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type <> 'view') SELECT CAST(user_id AS VARCHAR) AS uri, event_id AS seq, event_type AS text FROM e WHERE k = 1 AND event_type <> 'click'")
def doc_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "delete").when(F.col("event_type") == "view", "close").otherwise("change")
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uri"), op.alias("op"), F.col("event_type").alias("text"), F.col("event_id").alias("seq"))
    return workspace.latest(events).select("uri", "seq", "text")


KEPT_SQL = """
WITH e AS (SELECT DISTINCT client_id, seq, change_id, op FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL AND op IS NOT NULL),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1),
d AS (SELECT 'file:///work/client-' || client_id || '.adoc' AS uri, 'client-' || client_id AS id, 'client-' || (client_id * 7 + seq) % 1000 AS refers FROM l WHERE op <> 'D'),
b AS (SELECT uri, refers AS id FROM d WHERE refers NOT IN (SELECT id FROM d)),
n AS (SELECT (SELECT count(*) FROM d) AS docs, (SELECT count(*) FROM b) AS broken)
SELECT 'broken' AS kind, uri, id FROM b
UNION ALL SELECT 'definition', uri, id FROM d
UNION ALL SELECT 'score', CAST(docs AS VARCHAR) || ' documents, ' || broken || ' warnings', CAST(CAST(round(greatest(0.0, 100.0 * (docs - 3 * broken) / docs)) AS INT) AS VARCHAR) FROM n WHERE docs > 0
"""


@query(KEPT_SQL)
def workspace_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of clients as events of documents that refer to each other, dealt out of order
    over three runs of one streaming query; what it keeps of links, definitions and score."""
    folder = f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex}"
    c, n = F.col("client_id").cast("string"), F.col("seq") * 1_000_000_000 + F.col("change_id")
    text = F.concat(F.lit("[[client-"), c, F.lit("]]\n= Client\n\nSee <<client-"), ((F.col("client_id") * 7 + F.col("seq")) % 1000).cast("string"), F.lit(">>.\n"))
    events = read(spark, sf_dir, "client_changes").select(F.concat(F.lit("file:///work/client-"), c, F.lit(".adoc")).alias("uri"), F.when(F.col("op") == "D", "delete").when(F.col("op").isNotNull(), "change").alias("op"), text.alias("text"), n.alias("seq"), F.pmod(F.xxhash64("change_id"), F.lit(3)).alias("run"))
    for run in range(3):
        events.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{folder}/events")
        source = spark.readStream.schema(events.drop("run").schema).parquet(f"{folder}/events")
        workspace.maintain(source, f"{folder}/kept", f"{folder}/state", once=True).awaitTermination()
    kept = workspace.Kept(spark, f"{folder}/kept")
    score = kept.score().where("documents > 0").select(F.lit("score").alias("kind"), F.concat(F.col("documents"), F.lit(" documents, "), F.col("warnings"), F.lit(" warnings")).alias("uri"), F.col("score").cast("string").alias("id"))
    links = kept.broken_links().select(F.lit("broken").alias("kind"), "uri", "id")
    return links.unionByName(kept.definitions().select(F.lit("definition").alias("kind"), "uri", "id")).unionByName(score)


@query("SELECT 'file:///work/part/part-' || p_partkey || '.adoc' AS uri, CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 2 END AS parent_gap FROM part")
def symbol_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ln.headers(ln.lines(corpus.sheets(spark, sf_dir))).select("uri", F.col("ln").alias("idx"), "level")
    tree = outline.heading_tree(heads).join(heads.select("uri", F.col("idx").alias("parent_idx"), F.col("level").alias("parent_level")), ["uri", "parent_idx"])
    return tree.groupBy("uri").agg(F.sum(F.col("level") - F.col("parent_level")).cast("int").alias("parent_gap"))


@query("SELECT s_suppkey AS k, g AS ancestor, d AS depth FROM (WITH RECURSIVE c(k, a, d) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT c.k, c.a // 2, c.d + 1 FROM c WHERE c.a > 0 AND c.a // 2 <> c.a) SELECT k AS s_suppkey, a AS g, d FROM c)")
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.floor(F.col("s_suppkey") / 2).alias("p"))
    return g.resolve_chain(rows, "k", "p")


@query("SELECT s_suppkey AS element, min(s_nationkey) AS n FROM supplier GROUP BY 1")
def style_auto_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier")
    styles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("style_id"))
    candidates = supplier.select(F.col("s_suppkey").alias("element"), F.explode(F.array(F.struct(F.lit("none").alias("name"), F.lit(0).alias("prio")), F.struct(F.col("s_nationkey").cast("string").alias("name"), F.lit(1).alias("prio")), F.struct(F.lit("0").alias("name"), F.lit(2).alias("prio")))).alias("c")).select("element", "c.*")
    return contract.auto_map(styles, candidates).select("element", F.col("style_id").cast("int").alias("n"))


@query("""WITH a AS (SELECT s_suppkey, s_nationkey % 12 AS lvl, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'r' END AS role FROM supplier)
SELECT severity, message, count(*) AS n FROM (SELECT 'error' AS severity, 'Bookmark name ''' || s_suppkey || ' x'' is not a valid XML NCName' AS message FROM a WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'error', 'Semantic ID ''Id_' || s_suppkey || ''' must match pattern [a-z0-9][a-z0-9-]*' FROM a WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'error' AS severity, 'Heading level ' || lvl || ' is out of range [1,9]' AS message FROM a WHERE lvl NOT BETWEEN 1 AND 9 UNION ALL SELECT 'error', 'Role must not be empty' FROM a WHERE role = ''
 UNION ALL SELECT 'warning', 'Missing original_bookmark - round-trip restoration may fail' FROM a WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'error', 'External hyperlink must have a URL' FROM a WHERE s_suppkey % 5 = 0) GROUP BY ALL""")
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = read(spark, sf_dir, "supplier")
    anchors = own.select(F.when(k % 7 == 0, F.concat(k, F.lit(" x"))).otherwise(F.concat(F.lit("_b"), k)).alias("bookmark"), F.concat(F.when(k % 6 == 0, "Id_").otherwise("id-"), k).alias("semantic_id"), F.when(k % 4 != 0, F.concat(F.lit("_Toc"), k)).alias("original_bookmark"))
    styles = own.select(k.cast("string").alias("style_id"), F.when(k % 10 == 0, "").otherwise("r").alias("role"), (F.col("s_nationkey") % 12).alias("heading_level"))
    links = own.select(k.cast("string").alias("link_id"), F.lit(True).alias("is_external"), F.when(k % 5 != 0, "http://x").alias("url"), F.lit(None).cast("string").alias("anchor_target"))
    return contract.validate(anchors, styles, links).groupBy("severity", "message").agg(F.count("*").alias("n"))


@query(f"SELECT {PART_URI} AS uri, 1 AS number, 'title' AS layout_hint, 'Part ' || p_partkey AS title, 0 AS n FROM part UNION ALL SELECT {PART_URI}, 2, 'section', 'List', len(string_split(p_name, ' ')) + CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE 0 END FROM part UNION ALL SELECT {PART_URI}, 3, 'content', 'Next', 4 FROM part WHERE p_partkey % 4 <> 0")
def deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = slides.slides_within(blocks.documents(corpus.sheets(spark, sf_dir), strict=False))
    return made.select("uri", "number", "layout_hint", "title", F.size("content").cast("long").alias("n"))


def _dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dual document for each order: a title (but every 10th), a bullet limit by key, a
    section for slides or documents only, and as many bullets as the key's last digit."""
    k = F.col("o_orderkey")
    bullets = F.array_join(F.transform(F.sequence(F.lit(1), k % 10 + 1), lambda i: F.concat(F.lit("* item "), i, F.lit(" (aside)"))), "\n")
    text = F.concat(
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("= Order "), k, F.lit("\n"))), F.lit(":slide-bullets: "), k % 4 + 2, F.lit("\n\n"),
        F.when(k % 3 == 0, "[.slide-only]\n== Short\n\n").when(k % 3 == 1, "[.document-only]\n== Long\n\n").otherwise("== Both\n\n"), bullets, F.lit("\n\n[.document]\nSee <<annex>> and <<file.adoc>>.\n"),
    )
    return corpus.spread(read(spark, sf_dir, "orders").select("o_orderkey")).select(F.concat(F.lit("d"), k).alias("uri"), text.alias("text"))


@query("""WITH o AS (SELECT 'd' || o_orderkey AS uri, o_orderkey AS k FROM orders)
SELECT code, count(*) AS n FROM (SELECT 'DUAL001' AS code FROM o WHERE k % 3 = 0 UNION ALL SELECT 'DUAL002' FROM o WHERE k % 3 = 1 UNION ALL SELECT 'DUAL005' FROM o UNION ALL SELECT 'DUAL006' FROM o WHERE k % 10 + 1 > k % 4 + 2
 UNION ALL SELECT 'DUAL007' FROM o WHERE k % 10 = 0 UNION ALL SELECT 'DUAL008' FROM o WHERE k % 3 = 0) GROUP BY ALL""")
def dual_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual.lint(_dual(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT 'd' || o_orderkey AS uri, array_to_string(list_transform(range(1, least(o_orderkey % 10 + 1, o_orderkey % 4 + 2) + 1), lambda i: 'item ' || i), ',') AS shown FROM orders")
def dual_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _dual(spark, sf_dir)
    own = dual.for_format(dual.blocks(docs), dual.metadata(docs), "slide")
    return own.where("kind = 'bullets'").select("uri", F.array_join("items", ",").alias("shown"))


@query("SELECT selector, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'slide-only' WHEN o_orderkey % 3 = 1 THEN 'document-only' ELSE 'both' END AS selector FROM orders) GROUP BY ALL")
def selector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual.blocks(_dual(spark, sf_dir)).where("kind = 'section'").groupBy("selector").agg(F.count("*").alias("n"))


@query("SELECT s_name AS bookmark, CASE s_suppkey % 5 WHEN 0 THEN 'toc' WHEN 1 THEN 'reference' WHEN 2 THEN 'highlight' WHEN 3 THEN 'internal' ELSE 'user' END AS kind FROM supplier")
def bookmark_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    name = F.concat(F.when(k == 0, "_Toc").when(k == 1, "_Ref").when(k == 2, "_Hlk").when(k == 3, "_x").otherwise("x"), "s_name")
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("bookmark"), fx.bookmark_class(name).alias("kind"))


@query("SELECT p_partkey, p_type || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'csv' ELSE 'adoc' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'A1:B' || p_size END AS range, p_partkey % 2 = 0 AS is_data, p_partkey % 3 = 0 AS header FROM part")
def include_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    attrs = F.concat_ws(",", F.when(k % 2 == 0, F.concat(F.lit("Range=A1:B"), "p_size")), F.when(k % 3 == 0, "header"))
    line = F.concat(F.lit("include::"), "p_type", F.when(k % 2 == 0, ".csv").otherwise(".adoc"), F.lit("["), attrs, F.lit("]"))
    rows = read(spark, sf_dir, "part").select(k.alias("uri"), F.lit(1).alias("ln"), line.alias("line"))
    return tables.includes(rows).select(F.col("uri").alias("p_partkey"), "path", "range", "is_data", "header")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'section' WHEN n_nationkey % 3 = 1 THEN 'image' ELSE 'custom' END AS layout FROM nation")
def layout_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    name = F.when(k == 0, "Sezione 1").when(k == 1, "Picture x").otherwise("Other")
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ooxml.layout_type(name).alias("layout"))
