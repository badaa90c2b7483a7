"""Blocks of AsciiDoc documents: headings, paragraphs, lists, tables, literals.

A document is first cut into regions by a scan over its lines, then each region is turned
into rows. `strict` keeps the reading in which a blank line ends a literal block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.perdoc import per_document, per_document_rows

BLOCKS = "uri string, idx int, kind string, level int, text string, style_id string, language string, list_type string, ln int, rows array<array<string>>"
#: Attribute lines that belong to blocks and are no content.
BLOCK_ATTRIBUTES = frozenset(
    "slide-layout slide-bullets slide-master slide-notes slide-transition slide-background document-style document-class "
    "source-highlighter icons icon caption title id role options cols frame grid width height align float language".split()
)
ATTR = re.compile(r"^:+([^:]+):(.*)$")
HEAD = re.compile(r"^(={2,}) (.*)$")
FENCE = re.compile("-{4,}")
ITEM = re.compile(r"^(\*+|\.+) (.*)$")
IMAGE = re.compile(r"^image::([^\[]+)\[(.*)\]$")
SPANS = re.compile(r"(?P<bold>\*[^*]+\*)|(?P<italic>_[^_]+_)|(?P<mono>`[^`]+`)|(?P<xref><<[^,>]+,[^>]+>>|<<[^>]+>>)|(?P<anchor>\[\[[^\]]+\]\])")


def attribute_line(line: str) -> tuple[str, str] | None:
    hit = ATTR.match(line) if line.startswith(":") else None
    return (hit[1].strip(), hit[2].strip()) if hit and hit[1].strip() else None


class Reader:
    """The scan over a document's lines. `open` is the kind of region that lines are going
    into, with the lines held so far."""

    def __init__(self, strict: bool):
        self.strict, self.open, self.held, self.at = strict, None, [], 0
        self.pending: list[str] = []
        self.out: list[tuple] = []
        self.title, self.attributes, self.in_header = None, {}, True

    def emit(self, kind: str, ln: int, level=None, text=None, style=None, language=None, list_type=None, rows=None) -> None:
        self.out.append((len(self.out), kind, level, text, style, language, list_type, ln, rows))

    def close(self) -> None:
        kind, held, ln = self.open, self.held, self.at
        self.open, self.held = None, []
        if kind == "paragraph":
            self.emit("paragraph", ln, text=" ".join(held))
        elif kind == "list":
            for at, sign, text in held:
                self.emit("list_item", at, level=len(sign) - 1, text=text.strip(), list_type="unordered" if sign[0] == "*" else "ordered")
        elif kind == "literal":
            first = self.pending[0] if self.pending else ""
            self.pending = []
            source = first.startswith("source")
            language = first.split(",", 1)[1].strip() if source and "," in first else None
            self.emit("literal", ln, text="\n".join(held), style=None if source or not first else first, language=language)
        elif kind == "table":
            self.emit("table", ln, rows=self.table_rows(held))

    @staticmethod
    def table_rows(held: list[str]) -> list[list[str]]:
        """Rows of cell lines: the first line of several cells sets the width at which rows
        are full; a blank line ends a row."""
        width, row, rows = 0, [], []
        for line in held:
            if not line:
                rows, row = rows + [row] * bool(row), []
                continue
            cells = [c.strip() for c in line[1:].split("|")]
            width = width or (len(cells) if len(cells) > 1 else 0)
            row = row + cells
            if width and len(row) >= width:
                rows, row = [*rows, row], []
        return rows + [row] * bool(row)

    def begin(self, kind: str, ln: int) -> None:
        if self.open != kind:
            self.close()
            self.open, self.at = kind, ln

    def line(self, ln: int, line: str) -> None:
        if self.in_header and line.startswith("= "):
            self.title = line[2:].strip()
            return
        if line[:1] == ":":
            own = attribute_line(line)
            if own and ": " in line:
                if self.in_header:
                    self.attributes[own[0]] = own[1]
                    return
                if own[0].lower() in BLOCK_ATTRIBUTES:
                    return
            if line[-1] == ":":
                return
        bare = line.strip()
        blank = not bare
        self.in_header = False
        if self.open == "literal" and not (blank and self.strict):
            if line[:4] == "----" and FENCE.fullmatch(line):
                self.close()
            else:
                self.held.append(line)
        elif self.open == "table":
            if bare == "|===":
                self.close()
            elif blank or line.startswith("|"):
                self.held.append("" if blank else line)
        elif blank:
            self.close()
        else:
            self.content(ln, line, bare)

    def content(self, ln: int, line: str, bare: str) -> None:
        if bare == "|===" or line[:4] == "----" and FENCE.fullmatch(line):
            self.close()
            self.open, self.at = ("table" if bare == "|===" else "literal"), ln
        elif line[0] == "[" and line[-1] == "]" and "[[" not in line:
            self.pending.append(line[1:-1])
        elif line[0] == "=" and (hit := HEAD.match(line)):
            self.close()
            self.pending = []
            self.emit("heading", ln, level=len(hit[1]) - 1, text=hit[2].strip())
        elif line[0] in "*." and (hit := ITEM.match(line)):
            if self.open == "list" and self.held[-1][1][0] != hit[1][0]:
                self.close()
            self.begin("list", ln)
            self.held.append((ln, hit[1], hit[2]))
        elif bare[0] == "i" and (hit := IMAGE.match(bare)):
            self.close()
            alt = next((a.strip() for a in hit[2].split(",") if a.strip() and "=" not in a), None)
            self.emit("image", ln, text=hit[1], style=alt)
        elif bare.startswith("include::"):
            self.close()
            self.emit("include", ln, text=bare)
        else:
            self.begin("paragraph", ln)
            self.held.append(bare)


def read(text: str, strict: bool = True) -> Reader:
    reader = Reader(strict)
    for ln, line in enumerate(text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []):
        reader.line(ln, line)
    reader.close()
    return reader


def blocks(docs: DataFrame, strict: bool = True) -> DataFrame:
    """The blocks of each document, numbered from 0."""

    def parse(uri: str, text: str) -> Iterator[tuple]:
        yield from ((uri, *row) for row in read(text, strict).out)

    return per_document(docs, parse, BLOCKS)


def document_headers(docs: DataFrame) -> DataFrame:
    """uri, title, attributes of each document's header."""

    def parse(uri: str, text: str) -> Iterator[tuple]:
        own = read(text)
        yield uri, own.title, list(own.attributes.items())

    return per_document(docs, parse, "uri string, title string, attributes map<string,string>")


#: The fields of `BLOCKS` within a document.
FIELDS = BLOCKS.split(", ", 1)[1]


def documents(docs: DataFrame, strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """uri, title, attributes, blocks (an array in order, an index is a place in it) of each document,
    from one reading of it, and columns of `docs` that are kept. What is asked of one document
    alone needs no shuffle of blocks then."""

    def parse(text: str) -> tuple:
        own = read(text, strict)
        return own.title, list(own.attributes.items()), own.out

    types = ", ".join(f.replace(" ", ":", 1) for f in FIELDS.split(", "))
    return per_document_rows(docs, parse, f"title string, attributes map<string,string>, blocks array<struct<{types}>>", ("uri", *keep))


def inlines(text: str) -> list[dict]:
    """The formatted parts of a text in order; the leftmost pattern wins, none nests."""
    out, at = [], 0
    for hit in SPANS.finditer(text):
        if hit.start() > at:
            out.append({"kind": "text", "text": text[at : hit.start()], "url": None})
        kind, own = hit.lastgroup, hit[0]
        if kind == "xref":
            target, _, label = own[2:-2].partition(",")
            out.append({"kind": "link", "text": label or target, "url": f"#{target}"})
        elif kind == "anchor":
            out.append({"kind": "anchor", "text": own[2:-2], "url": None})
        else:
            out.append({"kind": kind, "text": own[1:-1], "url": None})
        at = hit.end()
    if at < len(text) or not text:
        out.append({"kind": "text", "text": text[at:], "url": None})
    return out


def with_inlines(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the inlines of a text column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<struct<kind:string,text:string,url:string>>")
    def parse(texts):
        return texts.map(lambda t: inlines(t) if t is not None else None)

    return rows.withColumn("inlines", parse(F.col(text)))


def plain_text(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] != "anchor"), lambda p: p["text"]), "")


def _body(of: Callable[[str], Column]) -> Column:
    """A block as text, by its fields."""
    sign = F.when(of("list_type") == "unordered", "*").otherwise(".")
    fence = F.concat(F.when(of("language").isNotNull(), F.concat(F.lit("[source,"), of("language"), F.lit("]\n"))).when(of("style_id").isNotNull(), F.concat(F.lit("["), of("style_id"), F.lit("]\n"))).otherwise(""), F.lit("----\n"), of("text"), F.lit("\n----"))
    table = F.concat(F.lit("|===\n"), F.array_join(F.transform(of("rows"), lambda r: F.concat(F.lit("|"), F.array_join(r, " |"))), "\n"), F.lit("\n|==="))
    return (
        F.when(of("kind") == "heading", F.concat(F.repeat(F.lit("="), of("level") + 1), F.lit(" "), of("text")))
        .when(of("kind") == "list_item", F.concat(F.repeat(sign, of("level") + 1), F.lit(" "), of("text")))
        .when(of("kind") == "literal", fence)
        .when(of("kind") == "table", table)
        .when(of("kind") == "image", F.concat(F.lit("image::"), of("text"), F.lit("["), F.coalesce(of("style_id"), F.lit("")), F.lit("]")))
        .otherwise(of("text"))
    )


def generate(found: DataFrame) -> DataFrame:
    """uri, text: documents written again from their blocks, one blank line between blocks."""
    body = _body(F.col)
    parts = F.array_sort(F.collect_list(F.struct("idx", body.alias("body"), (F.col("kind") == "list_item").alias("item"), "list_type")))
    return found.groupBy("uri").agg(_joined(parts).alias("text"))


def _joined(parts: Column) -> Column:
    """Blocks as text (idx, body, item, list_type) with one blank line between them."""
    return F.aggregate(
        parts,
        F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("list")),
        lambda a, p: F.struct(F.concat(a["text"], F.when(a["text"] == "", "").when(p["item"] & (a["list"] == p["list_type"]), "\n").otherwise("\n\n"), p["body"]).alias("text"), F.when(p["item"], p["list_type"]).alias("list")),
        lambda a: a["text"],
    )


def generated(found: Column) -> Column:
    """The text of a document's blocks (an array, as of `documents`), as `generate` writes it."""
    return _joined(F.transform(found, lambda b: F.struct(b["idx"].alias("idx"), _body(b.getField).alias("body"), (b["kind"] == "list_item").alias("item"), b["list_type"].alias("list_type"))))
