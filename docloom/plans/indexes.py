"""Queries of what is kept between runs or looked up by place: the symbol index, facts by content,
nested structure across blocks, ranges around places."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import dual, factstore, grids, nesting, outline, rules, spans, symbols
from docloom.operators import graph as g
from docloom.operators import lines as ln
from docloom.plans import corpus
from docloom.plans.catalogue import GEO_DEFS, GEO_DOCS, GEO_FILES, GEO_REFS, query
from docloom.plans.corpus import read
from docloom.store import shared_dir

SEARCHES = ("lier-12", "AFR", "1", "ion-2", "no such name")
NAMES = """SELECT 'region-' || r_regionkey AS name, 'anchor' AS kind FROM region UNION ALL SELECT r_name, 'header1' FROM region
 UNION ALL SELECT 'nation-' || n_nationkey, 'anchor' FROM nation UNION ALL SELECT n_name, 'header2' FROM nation
 UNION ALL SELECT 'supplier-' || s_suppkey, 'anchor' FROM supplier UNION ALL SELECT s_name, 'header3plus' FROM supplier
 UNION ALL SELECT 'Index', 'title'"""


@query(f"SELECT q, name, kind FROM ({NAMES}), (SELECT unnest({list(SEARCHES)}) AS q) WHERE contains(lower(name), lower(q))")
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several searches by an index of the workspace's symbols: three characters and more, one
    character, and a name that is not there."""
    index = symbols.build(g.Workspace(corpus.geography(spark, sf_dir)).symbols, f"{shared_dir(spark)}/symbols-{uuid.uuid4().hex}", parts=16)
    return ln.union_all([index.search(q).select(F.lit(q).alias("q"), "name", "kind") for q in SEARCHES])


@query("""WITH e AS (SELECT event_id, user_id % 5 AS k, event_id * 7919 % 1000 AS v FROM events)
SELECT a.event_id, max(b.event_id) AS before, (SELECT min(c.event_id) FROM e c WHERE c.k = a.k AND c.event_id > a.event_id AND c.v <= a.v) AS behind
FROM e a LEFT JOIN e b ON b.k = a.k AND b.event_id < a.event_id AND b.v < a.v GROUP BY a.event_id, a.k, a.v""")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups of many blocks: of each row the nearest one before of a smaller value, and the
    nearest one behind of a value that is not greater."""
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("k"), (F.col("event_id") * 7919 % 1000).alias("v"))
    first = nesting.nearest_smaller(rows, ["k"], "event_id", "v", bits=10, block=64).withColumnRenamed("near", "before")
    return nesting.nearest_smaller(first, ["k"], "event_id", "v", ahead=True, equal=True, bits=10, block=64).select("event_id", "before", F.col("near").alias("behind"))


@query("""WITH p AS (SELECT DISTINCT o_custkey % 10 AS k, o_orderkey AS at FROM orders), r AS (SELECT l_suppkey % 10 AS k, l_orderkey AS s, l_orderkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT p.at, count(*) AS n, CAST(sum(r.e - r.s) AS BIGINT) AS size FROM p JOIN r ON r.k = p.k AND p.at BETWEEN r.s AND r.e GROUP BY p.at""")
def covering_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that cover a place, in ten groups that many places and many ranges share."""
    places = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("k"), F.col("o_orderkey").alias("at")).distinct()
    ranges = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("k"), F.col("l_orderkey").alias("s"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("e"))
    return spans.covering(places, ranges, ["k"], "at", "s", "e").groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("size"))


KEPT_FACTS = f"""WITH RECURSIVE gone AS (SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc' AS uri FROM supplier WHERE s_suppkey % 50 = 9),
d AS (SELECT * FROM ({GEO_DEFS}) WHERE uri NOT IN (SELECT uri FROM gone)),
more AS (SELECT 'file:///work/supplier/supplier-' || s_suppkey || '.adoc' AS uri, 'lost-' || s_suppkey % 3 AS id FROM supplier WHERE s_suppkey % 50 = 7),
r AS (SELECT * FROM ({GEO_REFS}) WHERE uri NOT IN (SELECT uri FROM gone) UNION ALL SELECT uri, id FROM more),
e AS (SELECT r.uri, d.uri AS to_uri FROM r JOIN d USING (id) UNION SELECT uri, to_uri FROM ({GEO_FILES})),
reach(uri) AS (SELECT 'file:///work/index.adoc' UNION SELECT e.to_uri FROM reach JOIN e USING (uri))
SELECT 'broken' AS kind, uri, id FROM r WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'warnings', CAST(count(*) AS VARCHAR), NULL FROM {GEO_DOCS} WHERE uri NOT IN (SELECT uri FROM reach)
UNION ALL SELECT 'parsed', CAST((SELECT count(*) FROM more) AS VARCHAR), NULL
UNION ALL SELECT CASE WHEN s_suppkey % 50 = 7 THEN 'changed' ELSE 'removed' END, 'file:///work/supplier/supplier-' || s_suppkey || '.adoc', NULL FROM supplier WHERE s_suppkey % 50 IN (7, 9)"""


@query(KEPT_FACTS)
def kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second generation of the workspace in which some documents changed and some are gone:
    broken links and score from kept facts, how many texts were parsed, and what changed."""
    store = factstore.FactStore(spark, f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}")
    docs = corpus.geography(spark, sf_dir)
    old = store.update(docs)
    k = F.when(F.col("uri").contains("/supplier/"), F.col("load_ord") - 100000)
    lost = F.concat(F.col("text"), F.lit("\nSee <<lost-"), (k % 3).cast("string"), F.lit(">>.\n"))
    new = store.update(docs.where((F.coalesce(k, F.lit(0)) % 50) != 9).withColumn("text", F.when(k % 50 == 7, lost).otherwise(F.col("text"))))
    ws = store.workspace()
    none = F.lit(None).cast("string")
    parsed = spark.createDataFrame([("parsed", str(new.parsed), None)], "kind string, uri string, id string")
    warnings = rules.bridge().result(ws).select(F.lit("warnings").alias("kind"), F.col("warnings").cast("string").alias("uri"), none.alias("id"))
    changes = store.changes(old.generation, new.generation).select(F.col("change").alias("kind"), "uri", none.alias("id"))
    return ln.union_all([g.broken_links(ws).select(F.lit("broken").alias("kind"), "uri", "id"), warnings, parsed, changes])


FENCES = """WITH p AS (SELECT 'file:///work/part/part-' || p_partkey || '.adoc' AS uri, len(string_split(p_name, ' ')) AS n, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END AS d, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END AS u FROM part)
SELECT uri, CAST(14 + n AS INT) AS start_ln, CAST(16 + n AS INT) AS end_ln FROM p UNION ALL SELECT uri, CAST(19 + n AS INT), CAST(20 + n + d AS INT) FROM p UNION ALL SELECT uri, CAST(23 + n + d AS INT), CAST(24 + n + d + u AS INT) FROM p"""


@query(FENCES)
def fence_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fenced blocks of each part's document by their lines: odd delimiters with the next ones."""
    lns = ln.lines(corpus.sheets(spark, sf_dir))
    fences = lns.where("line = '----'").select("uri", F.col("ln").alias("start_ln"))
    return outline.folds(lns).join(fences, ["uri", "start_ln"], "left_semi").select("uri", "start_ln", "end_ln")


@query(FENCES + " UNION ALL SELECT uri, CAST(16 + n AS INT), CAST(19 + n AS INT) FROM p UNION ALL SELECT uri, CAST(20 + n + d AS INT), CAST(23 + n + d AS INT) FROM p")
def fence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delimiter line with the next one of its sign that is as long."""
    return outline.closing_delimiters(ln.lines(corpus.sheets(spark, sf_dir))).select("uri", F.col("ln").alias("start_ln"), "end_ln")


SELECTORS, FORMATS = ("both", "slide", "slide-only", "if-slide", "document", "document-only", "if-document"), ("slide", "pptx", "document", "docx", "html")


@query(f"""WITH p AS (SELECT p_partkey, {list(SELECTORS)}[p_partkey % 7 + 1] AS s, {list(FORMATS)}[p_partkey % 5 + 1] AS f FROM part)
SELECT p_partkey, s = 'both' OR (f IN ('slide', 'pptx') AND s IN ('slide', 'slide-only', 'if-slide')) OR (f IN ('document', 'docx') AND s IN ('document', 'document-only', 'if-document')) AS shown FROM p""")
def selector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part's selector shows in its format, both by key."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values)).cast("int"))
    own = read(spark, sf_dir, "part").select("p_partkey", pick(SELECTORS).alias("s"), pick(FORMATS).alias("f"))
    shown = F.lit(False)
    for f in FORMATS:
        shown = F.when(F.col("f") == f, dual.matches(F.col("s"), f)).otherwise(shown)
    return own.select("p_partkey", shown.alias("shown"))


@query("SELECT o_orderkey, CAST(r AS BIGINT) AS r FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 500 AND 1200")
def deep_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from far inside a table by their numbers in order."""
    return grids.row_slice(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, 1200, top=100).select("o_orderkey", F.col("r").cast("long").alias("r"))
