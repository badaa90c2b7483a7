"""Typst markup from blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fx


def transpile(found: DataFrame, headers: DataFrame, template: str | None = None) -> DataFrame:
    """uri, text: a head with the title (and the author, where a template is named), then the
    blocks in order."""
    item = F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(0))), F.when(F.col("list_type") == "ordered", "+ ").otherwise("- "), "text", F.lit("\n"))
    width = F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(1))
    cells = F.array_join(F.transform(F.flatten("rows"), lambda c: F.concat(F.lit("["), c, F.lit("]"))), ", ")
    body = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("="), F.col("level") + 1), F.lit(" "), "text", F.lit("\n")))
        .when(F.col("kind") == "list_item", item)
        .when(F.col("kind") == "literal", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n```\n")))
        .when(F.col("kind") == "table", F.concat(F.lit("#table(columns: "), width.cast("string"), F.lit(", "), cells, F.lit(")\n")))
        .when(F.col("kind") == "image", F.concat(F.lit('#image("'), fx.escape_typst(F.col("text")), F.lit('")\n')))
        .otherwise(F.concat("text", F.lit("\n")))
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", body.alias("body")))), lambda x: x["body"])
    text = found.groupBy("uri").agg(F.array_join(parts, "\n").alias("body"))
    title = fx.escape_typst(F.col("title"))
    if template is None:
        head = F.when(F.col("title").isNotNull(), F.concat(F.lit('#set document(title: "'), title, F.lit('")\n'))).otherwise("")
    else:
        author = fx.escape_typst(F.coalesce(F.try_element_at("attributes", F.lit("author")), F.lit("")))
        head = F.concat(F.lit(f'#import "{template}": template\n#show: template.with(title: "'), F.coalesce(title, F.lit("Untitled")), F.lit('", author: "'), author, F.lit('")\n\n'))
    return headers.join(text, "uri", "left").select("uri", F.concat(head, F.coalesce("body", F.lit(""))).alias("text"))
