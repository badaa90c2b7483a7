"""Style contracts as keyed tables: lookups, duplicates, merges, coverage, validation.

Anchors are (bookmark, semantic_id, anchor_type, target_heading, original_bookmark), styles
(style_id, role, heading_level, is_list, based_on), links (link_id, is_external, url,
anchor_target, original_rel_id, original_anchor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.lines import union_all


def canonical(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The alphabetically first value of each key (role to style, level to style, ...)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def duplicates(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, canonical, members of keys that several rows claim."""
    own = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("canonical"), F.array_sort(F.collect_list(value)).alias("members"))
    return own.where("n > 1")


def repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The second and later rows of each key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("occurrence > 1")


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The union of two keyed tables in which the right one's row of a key replaces the left one's."""
    a, b = left.alias("a"), right.alias("b").withColumn("_there", F.lit(True))
    columns = [F.when(F.col("_there"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in left.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *columns)


def uncovered(found: DataFrame, key: str, *maps: DataFrame) -> DataFrame:
    """Found keys that no map knows (each map's first column)."""
    known = union_all([m.select(F.col(m.columns[0]).alias(key)) for m in maps])
    return found.join(known, key, "left_anti")


def valid_semantic_id(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9][a-z0-9-]*$")


def valid_ncname(c: Column) -> Column:
    return c.rlike(r"^[\p{L}_][\p{L}\p{N}._-]*$")


ISSUE = "phase string, severity string, element string, message string"


def _issues(df: DataFrame, phase: str, severity: str, element: str, message: Column) -> DataFrame:
    return df.select(F.lit(phase).alias("phase"), F.lit(severity).alias("severity"), F.col(element).cast("string").alias("element"), message.alias("message"))


def validate_schema(anchors: DataFrame, styles: DataFrame, links: DataFrame) -> DataFrame:
    """Phase 1: levels, roles, ids and what a link needs."""
    level = F.col("heading_level")
    return union_all(
        [
            _issues(styles.where(level.isNotNull() & ~level.between(1, 9)), "schema", "error", "style_id", F.format_string("Heading level %d is out of range [1,9]", level)),
            _issues(styles.where("coalesce(role, '') = ''"), "schema", "error", "style_id", F.lit("Role must not be empty")),
            _issues(anchors.where(~valid_semantic_id(F.col("semantic_id"))), "schema", "error", "bookmark", F.format_string("Semantic ID '%s' must match pattern [a-z0-9][a-z0-9-]*", "semantic_id")),
            _issues(anchors.where("original_bookmark is null"), "schema", "warning", "bookmark", F.lit("Missing original_bookmark - round-trip restoration may fail")),
            _issues(links.where("is_external and url is null"), "schema", "error", "link_id", F.lit("External hyperlink must have a URL")),
            _issues(links.where("not is_external and anchor_target is null"), "schema", "warning", "link_id", F.lit("Internal hyperlink has no anchor target")),
        ]
    )


def validate_invariants(anchors: DataFrame) -> DataFrame:
    """Phase 2: ids that several bookmarks share, names, original bookmarks used again."""
    twice = anchors.groupBy("semantic_id").agg(F.count("*").alias("n"), F.min("bookmark").alias("canonical")).where("n > 1")
    again = repeats(anchors.where("original_bookmark is not null"), "original_bookmark", "bookmark")
    return union_all(
        [
            _issues(twice, "invariant", "warning", "semantic_id", F.format_string("Semantic ID '%s' maps to %d bookmarks (will use '%s')", "semantic_id", "n", "canonical")),
            _issues(anchors.where(~valid_ncname(F.col("bookmark"))), "invariant", "error", "bookmark", F.format_string("Bookmark name '%s' is not a valid XML NCName", "bookmark")),
            _issues(again, "invariant", "error", "bookmark", F.format_string("Original bookmark '%s' is referenced by multiple anchors", "original_bookmark")),
        ]
    )


def validate_completeness(styles: DataFrame, anchors: DataFrame | None = None, found_styles: DataFrame | None = None, found_bookmarks: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Phase 3: a contract without styles or without headings, and, where they are given,
    styles (style_id) and bookmarks (bookmark) that a document holds but nothing maps, and
    references (semantic_id) that no anchor resolves. Highlights need no mapping."""
    size = styles.agg(F.count("*").alias("n"), F.count("heading_level").alias("heads")).withColumn("element", F.lit("paragraph_styles"))
    out = [
        _issues(size.where("n = 0"), "completeness", "warning", "element", F.lit("No paragraph style mappings defined")),
        _issues(size.where("heads = 0"), "completeness", "warning", "element", F.lit("No heading style mappings defined")),
    ]
    if found_styles is not None:
        out.append(_issues(uncovered(found_styles.select("style_id").distinct(), "style_id", styles.select("style_id")), "completeness", "warning", "style_id", F.format_string("Style '%s' found in document but has no mapping", "style_id")))
    if found_bookmarks is not None:
        own = found_bookmarks.select("bookmark").distinct().where("not startswith(bookmark, '_Hlk')")
        out.append(_issues(uncovered(own, "bookmark", anchors.select("bookmark")), "completeness", "warning", "bookmark", F.format_string("Bookmark '%s' found in document but has no anchor mapping", "bookmark")))
    if references is not None:
        lost = uncovered(references.select("semantic_id").distinct(), "semantic_id", anchors.select("semantic_id"))
        out.append(_issues(lost, "completeness", "error", "semantic_id", F.format_string("Anchor '%s' referenced but not resolvable from contract", "semantic_id")))
    return union_all(out)


def validate_round_trip(anchors: DataFrame) -> DataFrame:
    """Phase 4: each bookmark has one id, and each id leads back to its canonical bookmark,
    which `canonical` defines; what is left to break is a bookmark that maps to several ids."""
    several = anchors.groupBy("bookmark").agg(F.countDistinct("semantic_id").alias("n")).where("n > 1")
    return _issues(several, "round_trip", "error", "bookmark", F.format_string("Forward lookup of '%s' is not unique: %d ids", "bookmark", "n"))


def validate(anchors: DataFrame, styles: DataFrame, links: DataFrame, **found: DataFrame) -> DataFrame:
    """phase, severity, element, message of all four phases of a contract; `found` is what
    validate_completeness takes besides."""
    return union_all([validate_schema(anchors, styles, links), validate_invariants(anchors), validate_completeness(styles, anchors, **found), validate_round_trip(anchors)])


def lookup(rows: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """key, value for each asked key: its row's value, null without one (forward lookups)."""
    return keys.join(rows.select(key, value), key, "left")


def round_trip(anchors: DataFrame) -> DataFrame:
    """bookmark, semantic_id, back for anchors whose reverse lookup leads to another bookmark."""
    back = canonical(anchors, "semantic_id", "bookmark").withColumnRenamed("bookmark", "back")
    return anchors.join(back, "semantic_id").where("back <> bookmark").select("bookmark", "semantic_id", "back")


def heading_level(style_id: Column, outline: Column) -> Column:
    """The outline level plus one, else the number that a HeadingN style bears."""
    return F.coalesce(outline + 1, F.nullif(F.regexp_extract(style_id, r"^[Hh]eading(\d+)$", 1), F.lit("")).try_cast("int"))


def auto_map(styles: DataFrame, candidates: DataFrame) -> DataFrame:
    """element, style_id: for each element the style of the first candidate name (by prio)
    that a sheet holds."""
    met = candidates.join(styles, F.lower(candidates["name"]) == F.lower(styles["style_id"]))
    return met.groupBy("element").agg(F.min_by("style_id", "prio").alias("style_id"))


def slide_contract(layouts: DataFrame, most: int) -> DataFrame:
    """Layout indices of a slide contract (name, layout_index) that are not within 1 and `most`."""
    return layouts.where(~F.col("layout_index").between(1, most)).select("name", "layout_index", F.format_string("Layout index %d of '%s' is out of range 1-" + str(most), "layout_index", "name").alias("message"))
