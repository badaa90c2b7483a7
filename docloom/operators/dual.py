"""Documents that are slides and documents at once: blocks with selectors, their choice
and shortening for a format, their rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators.lines import union_all
from docloom.operators.perdoc import per_document
from docloom.operators.rules import diagnostics
from docloom.store import stored

BLOCKS = "uri string, idx int, selector string, kind string, level int, text string, items array<string>, language string, path string, alt string, width string, slide_path string, slide_layout string, slide_bullets int, slide_style string, document_style string, source_line int"
META = "uri string, title string, author string, date string, template string, slide_master string, slide_layout string, slide_bullets int, document_template string, document_style string, other map<string,string>"
#: Attributes with a place of their own, in META's order.
ROUTES = ("author", "date", "template", "slide-master", "slide-layout", "slide-bullets", "document-template", "document-style")
#: Which selectors a format shows.
SHOWN = {
    "slide": ("both", "slide", "slide-only", "if-slide"),
    "pptx": ("both", "slide", "slide-only", "if-slide"),
    "document": ("both", "document", "document-only", "if-document"),
    "docx": ("both", "document", "document-only", "if-document"),
    "html": ("both",),
}
ATTR = re.compile(r"^:([\w-]+):\s*(.*)$")
MACRO = re.compile(r"(image|include)::([^\[]+)\[([^\]]*)\]")
BULLET, NUMBER = re.compile(r"^[*-] (.*)$"), re.compile(r"^(?:\.|\d[^.]*?\.|\d.*?\.) (.*)$")
BREAKS = ("==", "* ", "- ", ". ", "[.", "----", "```", "image::", "include::")


def selector(annotation: Column) -> Column:
    """The selector that an annotation means; `both` for unknown ones."""
    name = F.regexp_replace(F.lower(F.trim(annotation)), r"^\.", "")
    return F.when(name.isin("slide", "slide-only", "document", "document-only"), name).when(F.lower(F.trim(annotation)).startswith("if-slide"), "if-slide").when(F.lower(F.trim(annotation)).startswith("if-document"), "if-document").otherwise("both")


def _selector(text: str) -> str:
    name = text.strip().lower()
    for start in ("if-slide", "if-document"):
        if name.startswith(start):
            return start
    return name.removeprefix(".") if name.removeprefix(".") in ("slide", "slide-only", "document", "document-only") else "both"


def _whole(value: str) -> int | None:
    return int(value) if re.fullmatch(r"\+?\d+", value) else None


def _read(text: str) -> tuple[str | None, dict[str, str], list[dict]]:
    lines = [line.strip() for line in text.replace("\r\n", "\n").split("\n")]
    raw = text.replace("\r\n", "\n").split("\n")
    title, attrs, i = None, {}, 0
    while i < len(lines) and (not lines[i] or lines[i].startswith(":") or (title is None and lines[i].startswith("= "))):
        if lines[i].startswith("= "):
            title = lines[i][2:]
        elif hit := ATTR.match(lines[i]):
            attrs[hit[1]] = hit[2].strip()
        i += 1
    found: list[dict] = []
    chosen, marked = "both", False
    while i < len(lines):
        line, start = lines[i], i
        own = {"selector": chosen, "source_line": i + 1}
        chosen, was_marked, marked = "both", marked, False
        numbered = line.startswith(". ") or line[:1].isascii() and line[:1].isdigit()
        if line.startswith("[.") and line.endswith("]") and not was_marked:
            chosen, marked = _selector(line[1:-1]), True
            i += 1
            continue
        if line.startswith(("==", "= ")):
            level = len(line) - len(line.lstrip("="))
            own |= {"kind": "section", "level": level, "text": line[level:].strip()}
            i += 1
            while i < len(lines) and (hit := ATTR.match(lines[i])):
                if hit[1] == "slide-bullets":
                    own["slide_bullets"] = _whole(hit[2].strip())
                elif hit[1] in ("slide-layout", "slide-style", "document-style"):
                    own[hit[1].replace("-", "_")] = hit[2].strip()
                i += 1
        elif BULLET.match(line):
            items = []
            while i < len(lines) and ((hit := BULLET.match(lines[i])) or (not lines[i] and i + 1 < len(lines) and BULLET.match(lines[i + 1]))):
                items += [hit[1]] if hit else []
                i += 1
            own |= {"kind": "bullets", "items": items}
        elif numbered and not was_marked:
            items = []
            while i < len(lines) and (lines[i].startswith(". ") or lines[i][:1].isdigit() and ". " in lines[i]):
                items.append(lines[i].split(". ", 1)[1])
                i += 1
            i = max(i, start + 1)
            own |= {"kind": "numbers", "items": items} if items else {}
        elif line.startswith(("----", "```")) and not was_marked:
            end = next((j for j in range(i + 1, len(lines)) if lines[j] == line or (line.startswith("```") and lines[j] == "```")), len(lines))
            own |= {"kind": "code", "language": (line[3:].strip() or None) if line.startswith("```") else None, "text": "\n".join(raw[i + 1 : end])}
            i = end + 1
        elif line.startswith(("image::", "include::")) and not was_marked:
            i += 1
            if hit := MACRO.search(line):
                own |= {"kind": hit[1], "path": hit[2]}
                if hit[1] == "image":
                    parts = [p.strip() for p in hit[3].split(",")]
                    named = dict(p.split("=", 1) for p in parts if "=" in p)
                    plain = next((p for p in parts if "=" not in p), None)
                    own |= {"width": named.get("width"), "alt": named["alt"].strip('"') if "alt" in named else plain}
        elif line:
            while i < len(lines) and lines[i] and not lines[i].startswith(BREAKS):
                i += 1
            own |= {"kind": "paragraph", "text": " ".join(lines[start:i])} if i > start else {}
            i = max(i, start + 1)
        else:
            i += 1
        if "kind" in own:
            found.append(own)
    return title, attrs, found


def blocks(docs: DataFrame) -> DataFrame:
    names = [f.split(" ")[0] for f in BLOCKS.split(", ")][2:]

    def parse(uri: str, text: str) -> Iterator[tuple]:
        for idx, own in enumerate(_read(text)[2]):
            yield (uri, idx, *(own.get(n) for n in names))

    return per_document(docs, parse, BLOCKS)


def _meta(uri: str, title: str | None, attrs: dict) -> tuple:
    routed = [attrs.get(r) for r in ROUTES]
    routed[5] = _whole(routed[5]) if routed[5] is not None else None
    return (uri, title, *routed, [(k, v) for k, v in attrs.items() if k not in ROUTES])


def metadata(docs: DataFrame) -> DataFrame:
    """Title and routed attributes; slide bullets that are no number are null."""

    def parse(uri: str, text: str) -> Iterator[tuple]:
        title, attrs, _ = _read(text)
        yield _meta(uri, title, attrs)

    return per_document(docs, parse, META)


#: Columns of `blocks` and `metadata` that rules look at.
LINTED = ("kind", "selector", "text", "items", "path", "width", "slide_path", "slide_bullets", "source_line")
OF_META = ("title", "template", "slide_bullets")


def parsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rules look at of `blocks` and `metadata`, from one reading of each document, stored."""
    kinds = dict(f.strip().split(" ", 1) for f in BLOCKS.split(", "))
    order = [n for n in kinds if n in LINTED]
    schema = "uri string, is_meta boolean, " + ", ".join(f"{n} {kinds[n]}" for n in order) + ", title string, template string"

    def parse(uri: str, text: str) -> Iterator[tuple]:
        title, attrs, found = _read(text)
        own = _meta(uri, title, attrs)
        yield (uri, True, *(own[7] if n == "slide_bullets" else None for n in order), title, own[4])
        for block in found:
            yield (uri, False, *(block.get(n) for n in order), None, None)

    both = stored(per_document(docs, parse, schema)).hint("merge")
    return both.where("not is_meta").select("uri", *order), both.where("is_meta").select("uri", *OF_META)


def matches(selector_col: Column, fmt: str) -> Column:
    return selector_col.isin(list(SHOWN[fmt]))


def selector_matrix(spark) -> DataFrame:
    """The truth table: selector, format, shown."""
    every = sorted({s for own in SHOWN.values() for s in own})
    return spark.createDataFrame([(s, f, s in own) for f, own in SHOWN.items() for s in every], "selector string, format string, shown boolean")


def bullet_limit(items: Column, own: Column, default: Column) -> Column:
    return F.slice(items, F.lit(1), F.coalesce(own, default, F.lit(5)))


def for_format(found: DataFrame, meta: DataFrame, fmt: str) -> DataFrame:
    """The blocks that a format shows; for slides with shortened text, limited bullets and
    images of a width."""
    own = found.where(matches(F.col("selector"), fmt))
    if fmt not in ("slide", "pptx"):
        return own
    own = own.join(meta.select("uri", F.col("slide_bullets").alias("_default")), "uri", "left")
    items = F.transform(bullet_limit(F.col("items"), F.col("slide_bullets"), F.col("_default")), lambda x: fx.slide_text(x))
    return own.withColumn("items", F.when(F.col("kind") == "bullets", items).otherwise(F.col("items"))).withColumn("text", F.when(F.col("kind") == "paragraph", fx.slide_text(F.col("text"))).otherwise(F.col("text"))).withColumn("width", F.when(F.col("kind") == "image", F.coalesce("width", F.lit("80%"))).otherwise(F.col("width"))).withColumn("path", F.coalesce("slide_path", "path")).drop("_default")


def lint(docs: DataFrame) -> DataFrame:
    """DUAL001 to DUAL008 of each document. Source lines give no slide path, so 003 needs
    blocks that got one since."""
    return lint_blocks(*parsed(docs))


def lint_blocks(found: DataFrame, meta: DataFrame) -> DataFrame:
    """DUAL001 to DUAL008 of blocks and the metadata of their documents."""
    section = lambda s: F.count_if((F.col("kind") == "section") & (F.col("selector") == s))
    per = meta.join(found.groupBy("uri").agg(section("slide-only").alias("slides"), section("document-only").alias("docs"), F.bool_or(F.col("selector").isin("slide", "slide-only")).alias("shown")), "uri", "left").na.fill(0, ["slides", "docs"]).na.fill(False, ["shown"])
    line = F.col("source_line")
    images = found.where("kind = 'image' and selector in ('slide', 'slide-only') and width is null")
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"<<([^<]*?)>>"), F.lit(1)), lambda x: F.substring_index(x, ",", 1))
    refs = found.where("kind = 'paragraph'").select("uri", "source_line", F.explode(ids).alias("id")).where("id <> '' and not contains(id, '.')")
    many = found.where(matches(F.col("selector"), "slide") & (F.col("kind") == "bullets")).join(meta.select("uri", F.col("slide_bullets").alias("_default")), "uri").withColumn("most", F.coalesce("slide_bullets", "_default", F.lit(5))).where(F.size("items") > F.col("most"))
    return union_all(
        [
            diagnostics(per.where("slides > 0 and docs = 0"), "DUAL001", "warning", F.lit("Slide-only sections have no corresponding document sections")),
            diagnostics(per.where("docs > 0 and slides = 0"), "DUAL002", "info", F.lit("Document-only sections exist without slide summaries")),
            diagnostics(found.where("kind = 'image' and slide_path = path"), "DUAL003", "info", F.format_string("slide_path is same as path for image '%s'", "path"), line),
            diagnostics(images, "DUAL004", "warning", F.format_string("Slide image '%s' has no width specified", "path"), line),
            diagnostics(refs, "DUAL005", "warning", F.format_string("Cross-reference '%s' may not be defined", "id"), line),
            diagnostics(many, "DUAL006", "warning", F.format_string("Bullet list has %d items but slide limit is %d", F.size("items"), "most"), line),
            diagnostics(per.where("title is null"), "DUAL007", "warning", F.lit("Document has no title")),
            diagnostics(per.where("shown and template is null"), "DUAL008", "info", F.lit("Slide content exists but no template specified")),
        ]
    )
