"""Lines of documents and what a line alone yields: anchors, references, headers,
attributes, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The markup's patterns of anchors, references, headers and attributes.
ANCHOR = r"(?U)\[\[([\w-]+)\]\]"
XREF = r"(?U)<<([\w-]+)(?:,[^>]*)?>?>"
FILE_XREF = r"(?U)<<([^#,>\s]+\.adoc)(?:#[^,>]*)?(?:,[^>]*)?\s*>>"
HEADER = r"(?U)^(=+)\s+(.+)$"
ATTRIBUTE = r"(?U)^:([\w-]+):\s*(.*)$"
#: Fixed value: the markup's delimiter lines.
DELIMITER = r"^(-{4,}|\.{4,}|={4,}|\*{4,}|_{4,})$"


def split_lines(text: Column) -> Column:
    """The lines of a text; CR LF counts as one break and a last break opens no line."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame) -> DataFrame:
    """uri, load_ord, ln (from 0), line. Joins of them are merge joins (unless a side is broadcast
    by a hint): Spark's estimate is of the rows that the documents come from, too small to
    broadcast their lines by."""
    return docs.select("uri", "load_ord", F.posexplode(split_lines(F.col("text"))).alias("ln", "line")).hint("merge")


def _places(pattern: str, shift: int) -> Column:
    """Array of (name, col) of a pattern's matches in `line`: each is looked for behind the one
    before it."""
    at = F.expr("aggregate(_whole, named_struct('from', 1, 'cols', cast(array() as array<int>)), (a, m) -> named_struct('from', locate(m, line, a.from) + length(m), 'cols', array_append(a.cols, locate(m, line, a.from) - 1)), a -> a.cols)".replace("_whole", f"regexp_extract_all(line, {_quoted(pattern)}, 0)"))
    return F.transform(F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("name"), at.alias("col")), lambda x: F.struct(x["name"].alias("name"), (x["col"] + shift).alias("col")))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(lns: DataFrame, pattern: str, name: str, shift: int) -> DataFrame:
    each = lns.where(F.col("line").rlike(pattern)).select("uri", "load_ord", "ln", F.explode(_places(pattern, shift)).alias("_m"))
    return each.select(F.col("_m.name").alias(name), "uri", "load_ord", "ln", F.col("_m.col").alias("col"))


FACT = "array<struct<kind:string,name:string,value:string,col:int,level:int>>"


def facts(lns: DataFrame) -> DataFrame:
    """uri, load_ord, ln, kind, name, value, col, level of all that lines yield, in one pass:
    anchors, references, file references, headers and attributes."""
    none = F.array().cast(FACT)
    fact = lambda kind, name, value, col, level: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("string").alias("value"), col.cast("int").alias("col"), level.cast("int").alias("level"))
    null = F.lit(None)

    def matched(kind: str, pattern: str) -> Column:
        return F.when(F.col("line").rlike(pattern), F.transform(_places(pattern, 2), lambda x: fact(kind, x["name"], null, x["col"], null)).cast(FACT)).otherwise(none)

    line = F.col("line")
    head = F.when(line.rlike(HEADER), F.array(fact("header", F.regexp_extract(line, HEADER, 2), null, F.lit(0), F.length(F.regexp_extract(line, HEADER, 1)))).cast(FACT)).otherwise(none)
    attr = F.when(line.rlike(ATTRIBUTE), F.array(fact("attribute", F.regexp_extract(line, ATTRIBUTE, 1), F.trim(F.regexp_extract(line, ATTRIBUTE, 2)), F.lit(0), null)).cast(FACT)).otherwise(none)
    found = F.concat(matched("anchor", ANCHOR), matched("reference", XREF), matched("file", FILE_XREF), head, attr)
    may = line.contains("[[") | line.contains("<<") | line.startswith("=") | line.startswith(":")
    return lns.where(may).select("uri", "load_ord", "ln", F.explode(found).alias("_f")).select("uri", "load_ord", "ln", "_f.*")


def anchors(lns: DataFrame) -> DataFrame:
    """id, uri, load_ord, ln, col of every `[[id]]`; col is where the id starts."""
    return _matches(lns, ANCHOR, "id", 2)


def references(lns: DataFrame) -> DataFrame:
    """id, uri, load_ord, ln, col of every `<<id>>` or `<<id,label>>`; one closing sign will do."""
    return _matches(lns, XREF, "id", 2)


def file_references(lns: DataFrame) -> DataFrame:
    """path, uri, load_ord, ln, col of every `<<path.adoc#part,label>>`."""
    return _matches(lns, FILE_XREF, "path", 2)


def headers(lns: DataFrame) -> DataFrame:
    """uri, load_ord, ln, name, level (the number of equals signs)."""
    hit = lns.where(F.col("line").rlike(HEADER))
    return hit.select("uri", "load_ord", "ln", F.regexp_extract("line", HEADER, 2).alias("name"), F.length(F.regexp_extract("line", HEADER, 1)).alias("level"))


def attributes(lns: DataFrame) -> DataFrame:
    """uri, name, value: attribute lines anywhere in a document; the last of a name counts."""
    return last_attributes(_attribute_lines(lns))


def last_attributes(hit: DataFrame) -> DataFrame:
    return hit.groupBy("uri", "name").agg(F.max_by("value", "ln").alias("value"))


def _attribute_lines(lns: DataFrame) -> DataFrame:
    return lns.where(F.col("line").rlike(ATTRIBUTE)).select("uri", "ln", F.regexp_extract("line", ATTRIBUTE, 1).alias("name"), F.trim(F.regexp_extract("line", ATTRIBUTE, 2)).alias("value"))


def attribute_map(attrs: DataFrame) -> DataFrame:
    return attrs.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))


def symbols(lns: DataFrame) -> DataFrame:
    """uri, name, ln, level (0 for anchors), kind: anchors and headers, in order of lines with
    anchors first."""
    return symbols_of(anchors(lns), headers(lns))


def symbols_of(found: DataFrame, heads: DataFrame) -> DataFrame:
    kind = F.when(F.col("level") == 1, "title").when(F.col("level") == 2, "header1").when(F.col("level") == 3, "header2").otherwise("header3plus")
    own = found.select("uri", F.col("id").alias("name"), "ln", F.lit(0).alias("level"), F.lit("anchor").alias("kind"), "col")
    return own.unionByName(heads.select("uri", "name", "ln", "level", kind.alias("kind"), F.lit(-1).alias("col")))


def line_class(line: Column) -> Column:
    """header1 to header6, attribute, delimiter or other, in this order."""
    bare = F.trim(line)
    head = F.length(F.regexp_extract(bare, r"(?U)^(={1,6})\s+\S", 1))
    return (
        F.when(bare == "", "other")
        .when(head > 0, F.concat(F.lit("header"), head.cast("string")))
        .when(bare.rlike(r"(?U)^:\w[\w-]*:{1,2}\s"), "attribute")
        .when(bare.rlike(DELIMITER), "delimiter")
        .otherwise("other")
    )


def islands(rows: DataFrame, kind: Column, keys: list[str], order: str) -> DataFrame:
    """Numbers maximal runs of neighbouring rows of one kind: adds kind and island."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("kind", kind)
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")) | (F.lag(order).over(w) != F.col(order) - 1), F.lit(True))
    return marked.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def paragraphs(lns: DataFrame) -> DataFrame:
    """uri, first_ln, last_ln, text: neighbouring lines that aren't blank, joined by blanks."""
    marked = islands(lns, F.when(F.trim("line") == "", "blank").otherwise("text"), ["uri"], "ln").where("kind = 'text'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", F.trim("line").alias("line")))), lambda x: x["line"]), " ")
    return marked.groupBy("uri", "island").agg(F.min("ln").alias("first_ln"), F.max("ln").alias("last_ln"), text.alias("text")).drop("island")


UNORDERED, ORDERED = r"(?U)^(\*+)\s+(.*)$", r"(?U)^(\.+)\s+(.*)$"


def list_items(lns: DataFrame) -> DataFrame:
    """uri, ln, list_type, level (from 0), text, list: items, with neighbouring ones of a type
    numbered as one list."""
    kind = F.when(F.col("line").rlike(UNORDERED), "unordered").when(F.col("line").rlike(ORDERED), "ordered")
    own = lns.withColumn("list_type", kind).where("list_type is not null")
    marked = islands(own, F.col("list_type"), ["uri"], "ln")
    pattern = r"(?U)^[*.]+\s+(.*)$"
    return marked.select("uri", "ln", "list_type", (F.length(F.regexp_extract("line", r"^([*.]+)", 1)) - 1).alias("level"), F.trim(F.regexp_extract("line", pattern, 1)).alias("text"), F.col("island").alias("list"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
