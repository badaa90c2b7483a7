"""Slides from the blocks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Titles and colours of admonitions.
ADMONITIONS = {"note": ("Note", "3B82F6"), "tip": ("Tip", "22C55E"), "important": ("Important", "8B5CF6"), "warning": ("Warning", "F59E0B"), "caution": ("Caution", "EF4444")}


def slides(blocks: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """uri, number (from 1), layout_hint, title, subtitle, content (kind and text in order).

    A heading of level 1 or 2 starts a slide; one of level 3 is the subtitle of the slide it
    stands in, or starts one at the beginning; deeper ones are content. Blocks before the
    first slide are dropped. With `headers` (uri, title, attributes) a document's title is
    a slide of its own.
    """
    level = F.when(F.col("kind") == "heading", F.col("level"))
    w = Window.partitionBy("uri").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    main = F.max((level <= 2).cast("int")).over(w)
    third = F.coalesce(F.sum((level == 3).cast("int")).over(w), F.lit(0))
    starts = F.coalesce((level <= 2) | ((level == 3) & (F.coalesce(main, F.lit(0)) == 0) & (third == 1)), F.lit(False))
    cut = blocks.withColumn("_starts", starts).withColumn("_slide", F.sum(F.col("_starts").cast("int")).over(w)).where("_slide > 0")
    content = F.filter(F.array_sort(F.collect_list(F.when(~F.col("_starts") & ~F.coalesce(level == 3, F.lit(False)), F.struct("idx", F.when(F.col("kind") == "heading", "paragraph").otherwise(F.col("kind")).alias("kind"), "text")))), lambda x: x.isNotNull())
    made = cut.groupBy("uri", "_slide").agg(
        F.max(F.when(F.col("_starts"), F.col("text"))).alias("title"),
        F.max_by(F.when(~F.col("_starts") & (level == 3), F.col("text")), F.when(~F.col("_starts") & (level == 3), F.col("idx"))).alias("subtitle"),
        F.max(F.when(F.col("_starts"), F.when(F.col("level") == 2, "content").otherwise("section"))).alias("layout_hint"),
        F.transform(content, lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("content"),
    )
    if headers is not None:
        first = headers.where("title is not null").select("uri", F.lit(0).cast("long").alias("_slide"), "title", F.coalesce(F.try_element_at("attributes", F.lit("description")), F.try_element_at("attributes", F.lit("subtitle"))).alias("subtitle"), F.lit("title").alias("layout_hint"), F.array().cast("array<struct<kind:string,text:string>>").alias("content"))
        made = made.unionByName(first)
    number = F.row_number().over(Window.partitionBy("uri").orderBy("_slide"))
    return made.select("uri", number.alias("number"), "layout_hint", "title", "subtitle", "content")


def slides_within(docs: DataFrame) -> DataFrame:
    """What `slides` gives of documents with title, attributes and an array of blocks (of
    `blocks.documents`), each from its own row: no shuffle."""
    head = lambda b, level: (b["kind"] == "heading") & (b["level"] == level)
    main = lambda b: (b["kind"] == "heading") & (b["level"] <= 2)
    first = lambda rows: F.get(rows, F.lit(0))["idx"]
    third = first(F.filter("blocks", lambda b: head(b, 3)))
    alone = F.when(third < F.coalesce(first(F.filter("blocks", main)), F.size("blocks")), third)  # starts a slide
    met = docs.withColumn("_alone", F.coalesce(alone, F.lit(-1)))
    met = met.withColumn("_starts", F.filter("blocks", lambda b: main(b) | (b["idx"] == F.col("_alone"))))

    def slide(s, i):
        after = F.coalesce(F.get("_starts", i + 1)["idx"], F.size("blocks"))
        own = F.slice("blocks", s["idx"] + 2, after - s["idx"] - 1)
        content = F.transform(F.filter(own, lambda b: ~head(b, 3)), lambda b: F.struct(F.when(b["kind"] == "heading", "paragraph").otherwise(b["kind"]).alias("kind"), b["text"].alias("text")))
        subtitle = F.try_element_at(F.filter(own, lambda b: head(b, 3)), F.lit(-1))["text"]
        return F.struct(F.when(s["level"] == 2, "content").otherwise("section").alias("layout_hint"), s["text"].alias("title"), subtitle.alias("subtitle"), content.alias("content"))

    named = lambda name: F.try_element_at("attributes", F.lit(name))
    none = F.array().cast("array<struct<kind:string,text:string>>")
    top = F.array(F.struct(F.lit("title").alias("layout_hint"), F.col("title"), F.coalesce(named("description"), named("subtitle")).alias("subtitle"), none.alias("content")))
    made = F.transform("_starts", slide)
    every = F.when(F.col("title").isNotNull(), F.concat(top, made)).otherwise(made)
    return met.select("uri", F.posexplode_outer(every).alias("_i", "_s")).where("_s is not null").select("uri", (F.col("_i") + 1).alias("number"), "_s.*")


def notes_text(content: Column) -> Column:
    return F.array_join(F.transform(content, lambda c: c["text"]), "\n")


def admonition(kind: Column, part: int) -> Column:
    """The default title (0) or colour (1) of an admonition."""
    out = F.lit(None).cast("string")
    for name, values in ADMONITIONS.items():
        out = F.when(F.lower(kind) == name, values[part]).otherwise(out)
    return out
