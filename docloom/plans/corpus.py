"""A synthetic AsciiDoc workspace rendered from the test tables, so that what extractors
and rules find can be told from the tables' keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "file:///work"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes documents of.
ROWS = 20_000


def spread(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """The rows dealt over so many tasks that each has about `most`. A table of short rows is few
    splits of its file, however much work the documents are that its rows become; their number
    comes from the file's footers, and the rows are moved before they are made documents."""
    parts = -(-rows.count() // most)
    return rows.repartition(parts) if parts > 1 else rows


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index -> regions by file; regions -> nations by file; each nation -> the supplier of
    its key; a supplier s of non-negative balance -> suppliers 2 s + 25 and 2 s + 26 by id,
    where the ids may dangle."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    link = lambda path, label: F.concat(F.lit("<<"), path, F.lit("#,"), label, F.lit(">>"))
    pages = F.array_join(F.array_sort(F.collect_list(link(F.concat(F.lit("geo/region-"), F.col("r_regionkey"), F.lit(".adoc")), F.col("r_name")))), "\n")
    index = region.agg(F.concat(F.lit("= Index\n:author: docs\n\n"), pages, F.lit("\n")).alias("text")).select(F.lit(f"{ROOT}/index.adoc").alias("uri"), F.lit(0).cast("long").alias("load_ord"), "text")
    nations = nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(link(F.concat(F.lit("../nation/nation-"), F.col("n_nationkey"), F.lit(".adoc")), F.col("n_name")))), "\n").alias("links"))
    regions = region.join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.concat(F.lit(f"{ROOT}/geo/region-"), F.col("r_regionkey"), F.lit(".adoc")).alias("uri"),
        (F.col("r_regionkey") + 1).cast("long").alias("load_ord"),
        F.concat(F.lit("[[region-"), F.col("r_regionkey"), F.lit("]]\n== "), F.col("r_name"), F.lit("\n\n"), F.coalesce("links", F.lit("")), F.lit("\n")).alias("text"),
    )
    nation_pages = nation.select(
        F.concat(F.lit(f"{ROOT}/nation/nation-"), F.col("n_nationkey"), F.lit(".adoc")).alias("uri"),
        (F.col("n_nationkey") + 1000).cast("long").alias("load_ord"),
        F.concat(F.lit("[[nation-"), F.col("n_nationkey"), F.lit("]]\n=== "), F.col("n_name"), F.lit("\n:region: "), F.col("n_regionkey"), F.lit("\n\nSee <<supplier-"), F.col("n_nationkey"), F.lit(",its supplier>>.\n")).alias("text"),
    )
    s = F.col("s_suppkey")
    more = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("Then <<supplier-"), 2 * s + 25, F.lit(">> and <<supplier-"), 2 * s + 26, F.lit(",the other>>.\n"))).otherwise("The end.\n")
    suppliers = supplier.select(
        F.concat(F.lit(f"{ROOT}/supplier/supplier-"), s, F.lit(".adoc")).alias("uri"),
        (s + 100000).alias("load_ord"),
        F.concat(F.lit("[[supplier-"), s, F.lit("]]\n==== "), F.col("s_name"), F.lit("\n:nation: "), F.col("s_nationkey"), F.lit("\n\n"), more).alias("text"),
    )
    return index.unionByName(regions).unionByName(nation_pages).unionByName(suppliers)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision record for each order: its status follows the order's (F accepted, O
    deprecated, P superseded; every 11th key none, every 13th an unknown one); every 5th
    key supersedes the one before it; every 7th lacks Consequences, and every 17th is no
    record but a note."""
    k = F.col("o_orderkey")
    status = F.when(k % 11 == 0, "").when(k % 13 == 0, ":status: Maybe\n").when(F.col("o_orderstatus") == "F", ":status: Accepted\n").when(F.col("o_orderstatus") == "O", ":status: Deprecated\n").otherwise(":status: Superseded\n")
    supersedes = F.when(k % 5 == 0, F.concat(F.lit(":supersedes: adr-"), k - 1, F.lit("\n"))).otherwise("")
    record = F.concat(F.lit("[[adr-"), k, F.lit("]]\n= ADR "), k, F.lit(": order\n"), status, supersedes, F.lit("\n== Context\n\nThe order was placed.\n\n== Decision\n\nShip it.\n"), F.when(k % 7 == 0, "").otherwise("\n== Consequences\n\nNone.\n"))
    note = F.concat(F.lit("[[adr-"), k, F.lit("]]\n= Note\n\nPlain text.\n"))
    own = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    return own.select(F.concat(F.lit(f"{ROOT}/adr/adr-"), k, F.lit(".adoc")).alias("uri"), k.alias("load_ord"), F.when(k % 17 == 0, note).otherwise(record).alias("text"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part: a list of its words, a table, a literal and a diagram with
    planted defects by key."""
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    items = F.array_join(F.transform(words, lambda w: F.concat(F.lit("* "), w)), "\n")
    diagram = F.when(k % 3 == 0, F.lit("graph TD\nA(x --> B")).when(k % 3 == 1, F.lit("")).otherwise(F.lit("chart\nA[1] --> B[2]"))
    uml = F.when(k % 2 == 0, F.lit("@startuml\nA -> B : \"x\n@enduml")).otherwise(F.lit("A -> B"))
    text = F.concat(
        F.lit("= Part "), k, F.lit("\n:brand: "), F.col("p_brand"), F.lit("\n\n== List\n\n"), items, F.lit("\n\n"),
        F.when(k % 4 == 0, "==== Deep\n\n").otherwise("=== Next\n\n"),
        F.lit("|===\n|size |"), F.col("p_size"), F.lit("\n|type |"), F.col("p_type"), F.lit("\n|===\n\n[source,sql]\n----\nselect "), k, F.lit("\n----\n\n[mermaid]\n----\n"), diagram, F.lit("\n----\n\n[plantuml]\n----\n"), uml, F.lit("\n----\n"),
    )
    own = spread(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    return own.select(F.concat(F.lit(f"{ROOT}/part/part-"), k, F.lit(".adoc")).alias("uri"), k.alias("load_ord"), text.alias("text"))
