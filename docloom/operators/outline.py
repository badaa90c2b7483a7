"""Order within a document: heading jumps, heading trees, fold ranges, blocks, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import lines as ln
from docloom.operators.nesting import bits_of, nearest_smaller
from docloom.operators.rules import diagnostics


def heading_jumps(headings: DataFrame, uri: str = "uri", order: str = "idx", level: str = "level") -> DataFrame:
    """uri, idx, before, level of headings more than one level below the one before (0 at a
    document's start)."""
    w = Window.partitionBy(uri).orderBy(order)
    return headings.withColumn("before", F.lag(level, 1, 0).over(w)).where(F.col(level) > F.col("before") + 1).select(F.col(uri).alias("uri"), F.col(order).alias("idx"), "before", F.col(level).alias("level"))


def hierarchy(headings: DataFrame) -> DataFrame:
    """DOC101 for each heading jump."""
    return jump_diagnostics(heading_jumps(headings))


def jumps_within(docs: DataFrame) -> DataFrame:
    """What `heading_jumps` gives of documents with an array of blocks, by lines: no shuffle."""
    heads = F.filter("blocks", lambda b: b["kind"] == "heading")
    each = docs.select("uri", heads.alias("_h")).select("uri", "_h", F.posexplode("_h").alias("_i", "_b"))
    before = F.when(F.col("_i") > 0, F.get("_h", F.col("_i") - 1)["level"]).otherwise(0)
    return each.select("uri", F.col("_b.ln").alias("idx"), before.alias("before"), F.col("_b.level").alias("level")).where("level > before + 1")


def jump_diagnostics(jumps: DataFrame) -> DataFrame:
    message = F.when(F.col("before") == 0, F.format_string("Document starts at heading level %d (expected level 1). Consider starting with a level 1 heading.", "level")).otherwise(F.format_string("Section level jump detected (Level %d -> Level %d). Missing Level %d?", "before", "level", F.col("before") + 1))
    return diagnostics(jumps, "DOC101", "warning", message, F.col("idx"))


def _levels(headings: DataFrame, uri: str, order: str, level: str) -> DataFrame:
    return headings.select(F.col(uri).alias("uri"), F.col(order).alias("idx"), F.col(level).cast("int").alias("level"))


def heading_tree(headings: DataFrame, uri: str = "uri", order: str = "idx", level: str = "level", bits: int | None = None) -> DataFrame:
    """uri, idx, level, parent_idx: the parent is the nearest heading before of a smaller
    level, whatever the levels (from 0; of at most `bits` bits). A heading without a level has no
    parent and is none's."""
    return nearest_smaller(_levels(headings, uri, order, level), ["uri"], "idx", "level", bits=bits).withColumnRenamed("near", "parent_idx")


def section_ends(headings: DataFrame, uri: str = "uri", order: str = "idx", level: str = "level", bits: int | None = None) -> DataFrame:
    """uri, idx, level, next_idx: the next heading of the same or a smaller level, or null."""
    return nearest_smaller(_levels(headings, uri, order, level), ["uri"], "idx", "level", ahead=True, equal=True, bits=bits).withColumnRenamed("near", "next_idx")


def folds(lns: DataFrame) -> DataFrame:
    """uri, start_ln, end_ln, kind: attribute groups of two lines or more, header sections with
    content, and each odd delimiter with the even one after it."""
    seen = lns.select("uri", "ln", ln.line_class(F.col("line")).alias("class"))
    size = seen.groupBy("uri").agg(F.max("ln").alias("last_ln"))
    groups = ln.islands(seen.where("class = 'attribute'"), F.lit("attribute"), ["uri"], "ln")
    attrs = groups.groupBy("uri", "island").agg(F.min("ln").alias("start_ln"), F.max("ln").alias("end_ln")).where("end_ln > start_ln").select("uri", "start_ln", "end_ln", F.lit("imports").alias("kind"))
    heads = seen.where(F.col("class").startswith("header")).select("uri", F.col("ln").alias("idx"), F.substring("class", 7, 1).cast("int").alias("level"))
    ends = section_ends(heads, bits=3).join(size, "uri").select("uri", F.col("idx").alias("start_ln"), F.coalesce(F.col("next_idx") - 1, "last_ln").alias("end_ln"), F.lit("region").alias("kind")).where("end_ln > start_ln")
    w = Window.partitionBy("uri").orderBy("ln")
    fences = seen.where("class = 'delimiter'").withColumn("k", F.row_number().over(w)).withColumn("end_ln", F.lead("ln").over(w)).where("k % 2 = 1 and end_ln is not null")
    return ln.union_all([attrs, ends, fences.select("uri", F.col("ln").alias("start_ln"), "end_ln", F.lit("region").alias("kind"))])


def closing_delimiters(lns: DataFrame) -> DataFrame:
    """uri, ln, end_ln: for each delimiter the next line of its sign that is at least as long."""
    bare = F.trim("line")
    own = lns.where(bare.rlike(ln.DELIMITER)).select("uri", F.substring(bare, 1, 1).alias("sign"), "ln", F.length(bare).alias("size"))
    bits = bits_of(own, "size")
    found = nearest_smaller(own.withColumn("short", F.lit((1 << bits) - 1) - F.col("size")), ["uri", "sign"], "ln", "short", ahead=True, equal=True, bits=bits)
    return found.where("near is not null").select("uri", "ln", F.col("near").alias("end_ln"))


def last_heading(rows: DataFrame, uri: str, order: str, heading: str) -> DataFrame:
    """The rows with the heading that stands last at or before each (as-of)."""
    w = Window.partitionBy(uri).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("last_heading", F.last(heading, ignorenulls=True).over(w))


def anchor_sections(lns: DataFrame) -> DataFrame:
    """uri, id, title, level, ln: an anchor line names the header on the next line that isn't
    blank; any other has level 0 and no title."""
    full = lns.where(F.trim("line") != "")
    w = Window.partitionBy("uri").orderBy("ln")
    after = F.lead("line").over(w)
    own = full.withColumn("_next", after).withColumn("_anchor", F.regexp_extract(F.trim("line"), r"(?U)^\[\[([\w-]+)\]\]$", 1)).where("_anchor <> ''")
    level = F.length(F.regexp_extract("_next", ln.HEADER, 1))
    return own.select("uri", F.col("_anchor").alias("id"), F.nullif(F.regexp_extract("_next", ln.HEADER, 2), F.lit("")).alias("title"), F.coalesce(level, F.lit(0)).alias("level"), "ln")


def pending_attributes(lns: DataFrame) -> DataFrame:
    """uri, ln, attribute: each opening `----` fence with the first `[...]` line that stands
    between it and the fence or header before."""
    line = F.col("line")
    fence = line.rlike(r"^-{4,}$")
    attr = F.when(line.rlike(r"^\[[^\[].*\]$"), F.expr("substring(line, 2, length(line) - 2)"))
    marks = lns.select("uri", "ln", fence.alias("_fence"), line.rlike(r"^={2,} ").alias("_head"), attr.alias("_attr")).where("_fence or _head or _attr is not null")
    # of these alone: a fence's attribute is the last that began a run, if a run ends before the fence
    w = Window.partitionBy("uri").orderBy("ln")
    seen = marks.withColumn("_follows", F.coalesce(F.lag(F.col("_attr").isNotNull()).over(w), F.lit(False)))
    begun = F.last(F.when(~F.col("_follows"), F.col("_attr")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("attribute", begun).where("_fence and _follows").select("uri", "ln", "attribute")


def token_deltas(tokens: DataFrame) -> DataFrame:
    """uri, ln, col, d_line, d_start: each token's place against the one before it."""
    w = Window.partitionBy("uri").orderBy("ln", "col")
    d_line = F.col("ln") - F.lag("ln", 1, 0).over(w)
    return tokens.withColumn("d_line", d_line).withColumn("d_start", F.when(F.col("d_line") == 0, F.col("col") - F.lag("col", 1, 0).over(w)).otherwise(F.col("col"))).select("uri", "ln", "col", "d_line", "d_start")


def symbol_kind(level) -> Column:
    out = F.lit("module")
    for k, name in ((2, "namespace"), (3, "class"), (4, "interface"), (5, "enum"), (6, "struct")):
        out = F.when(level == k, name).otherwise(out)
    return out
