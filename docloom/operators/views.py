"""Small derived views: dual blocks as JSON, style settings, counts, image facts, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators import domains, dual


def dual_json(found: DataFrame, fmt: str) -> DataFrame:
    """uri, json: the blocks that a format shows, with selector, kind and line, in order."""
    own = found.where(dual.matches(F.col("selector"), fmt))
    block = F.struct("idx", F.col("source_line").alias("line"), "selector", "kind", "text", "items")
    return own.groupBy("uri").agg(F.to_json(F.struct(F.lit(fmt).alias("format"), F.array_sort(F.collect_list(block)).alias("blocks"))).alias("json"))


def slide_layout(found: DataFrame, meta: DataFrame) -> DataFrame:
    """uri, idx, layout: a block's own layout, else the document's default."""
    return found.join(meta.select("uri", F.col("slide_layout").alias("_default")), "uri", "left").select("uri", "idx", F.coalesce("slide_layout", "_default").alias("layout"))


def style_config(sheet: DataFrame) -> DataFrame:
    """uri, text: the TOML lines of a style sheet's headings by level, paragraph and first table style."""
    heads = sheet.where("outline_level is not null").groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("outline_level", "style_id"))), lambda s: F.concat(F.lit("heading"), (s["outline_level"] + 1).cast("string"), F.lit(' = "'), s["style_id"], F.lit('"\n'))), "").alias("heads"))
    rest = sheet.groupBy("uri").agg(F.max(F.when(F.col("is_default") & (F.col("type") == "paragraph"), F.col("style_id"))).alias("para"), F.min(F.when(F.col("type") == "table", F.col("style_id"))).alias("table"))
    line = lambda key, col: F.when(F.col(col).isNotNull(), F.concat(F.lit(f'{key} = "'), col, F.lit('"\n'))).otherwise("")
    return rest.join(heads, "uri", "left").select("uri", F.concat(F.lit("[styles]\n"), F.coalesce("heads", F.lit("")), line("paragraph", "para"), line("table", "table")).alias("text"))


def include_counts(found: DataFrame) -> DataFrame:
    """uri, data, other: includes of tables and of documents."""
    return found.groupBy("uri").agg(F.count_if("is_data").alias("data"), F.count_if(~F.col("is_data")).alias("other"))


def issue_counts(found: DataFrame) -> DataFrame:
    """uri, errors, warnings, infos, issues (without infos), is_valid."""
    n = lambda *s: F.count_if(F.col("severity").isin(*s))
    own = found.groupBy("uri").agg(n("error", "fatal").alias("errors"), n("warning").alias("warnings"), n("info", "hint").alias("infos"))
    return own.withColumn("issues", F.col("errors") + F.col("warnings")).withColumn("is_valid", F.col("errors") == 0)


def is_error(severity: Column) -> Column:
    return severity.isin("error", "fatal")


def image_facts(width_emu: Column, height_emu: Column, path: Column) -> Column:
    """Pixel sizes (cut off), file name and ending of an image."""
    cut = lambda c: F.floor(c / 9525).cast("int")
    return F.struct(cut(width_emu).alias("width"), cut(height_emu).alias("height"), F.substring_index(path, "/", -1).alias("name"), F.lower(fx.extension(path)).alias("extension"))


def status_actions(found: DataFrame) -> DataFrame:
    """uri, ln, col, end_col, new_text: the replacements that an invalid status (ADR002) has."""
    return found.where("code = 'ADR002'").select("uri", "ln", "col", "end_col", F.explode(F.array(*map(F.lit, domains.STATUSES))).alias("new_text"))


def is_notes(title: Column) -> Column:
    return F.coalesce(F.lower(title) == "notes", F.lit(False))


def is_slides(role: Column) -> Column:
    return F.coalesce(role == "slides", F.lit(False))


def workspace_symbols(symbols: DataFrame, query: str) -> DataFrame:
    """uri, ln, name, editor_kind of the symbols that a query finds."""
    from docloom.operators.graph import search_symbols

    kind = F.when(F.col("kind") == "anchor", "key").when(F.col("kind") == "title", "file").when(F.col("kind") == "header1", "module").when(F.col("kind") == "header2", "class").otherwise("method")
    return search_symbols(symbols, query).select("uri", "ln", "name", kind.alias("editor_kind"))
