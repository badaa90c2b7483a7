"""Word and PowerPoint packages as relations. Each archive is read once on an executor;
what follows from its parts are DataFrame operations."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from io import BytesIO
from itertools import batched
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators.lines import union_all

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
#: Fixed value: ids of heading styles.
HEADING = re.compile(r"[Hh]eading([0-9]+)")
#: Parts of font names that stand for fixed pitch.
MONOSPACE = ("mono", "courier", "consolas", "menlo", "source code")
RUN = "struct<text:string,bold:boolean,italic:boolean,mono:boolean,rid:string,anchor:string>"
BLOCKS = f"uri string, idx int, kind string, style_id string, num_id int, ilvl int, runs array<{RUN}>, bookmarks array<string>, comment_ids array<string>, images array<struct<rid:string,width_emu:long,height_emu:long,alt:string>>, rows array<array<string>>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """uri, content of package files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "content")


def per_archive(files: DataFrame, parse: Callable[[str, ZipFile], Iterator[tuple]], schema: str, most: int = 1024) -> DataFrame:
    """The rows that `parse(uri, archive)` yields, `most` at a time, whatever archives they are of;
    what is no archive yields none. Joins of them are merge joins, as those of lines are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = files.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(struct)

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                uri, content = (c[i].as_py() for c in batch.columns)
                try:
                    with ZipFile(BytesIO(content or b"")) as z:
                        yield from parse(uri, z)
                except BadZipFile:
                    pass

    def run(batches):
        for rows in batched(each(batches), most):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("uri", "content").mapInArrow(run, struct).hint("merge")


def parts(files: DataFrame) -> DataFrame:
    """uri, path, bytes of each part."""
    return per_archive(files, lambda uri, z: ((uri, n, z.read(n)) for n in z.namelist()), "uri string, path string, bytes binary", 16)


def embedded(all_parts: DataFrame, prefix: str) -> DataFrame:
    """Parts below a container's folder, with the hash that a manifest keeps of them."""
    return all_parts.where(F.col("path").startswith(prefix)).select("uri", F.expr(f"substring(path, {len(prefix) + 1})").alias("name"), F.sha2("bytes", 256).alias("hash"), F.decode("bytes", "UTF-8").alias("text"))


def drifted(stored: DataFrame, now: DataFrame) -> DataFrame:
    """uri, name of embedded parts whose hash differs from the one given."""
    return stored.join(now.select("uri", "name", F.col("hash").alias("now")), ["uri", "name"]).where("hash <> now").select("uri", "name")


def _xml(z: ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


#: Elements of the format whose content is not part of the text as it stands:
#: what was deleted or moved away, and properties as they were before a change.
GONE = {W + t for t in ("del", "moveFrom", "pPrChange", "rPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "numberingChange")}
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
SIGNS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", A + "br": "\n"}


class _Body:
    """The blocks of a document's body from its parse events, whatever containers they stand in.

    Containers (content controls, insertions, smart tags and the like) are looked through. A
    text box's or shape's paragraphs are blocks behind the paragraph that holds it, or lines of the
    table cell it stands in, as those of a table within a cell are. Of alternatives for several
    readers the first is taken. Nothing is held but what is open."""

    def __init__(self):
        self.tags: list[str] = []
        self.skip = 0  # depth below an element that is left out
        self.paragraphs: list[dict] = []
        self.runs: list[dict] = []
        self.links: list[tuple] = []
        self.tables: list[dict] = []
        self.images: list[dict] = []
        self.choices: list[bool] = []
        self.boxes: list[list[tuple]] = []
        self.depth: list[tuple[int, int]] = []  # paragraphs and tables that were open where a box began
        self.marks: tuple[list, list] = ([], [])  # bookmarks and comments between blocks
        self.out: list[tuple] = []  # kind and content of finished blocks

    def start(self, tag: str, get) -> None:
        parent = self.tags[-1] if self.tags else ""
        self.tags.append(tag)
        if self.skip:
            self.skip += 1
            return
        if tag in GONE or tag == MC + "Fallback" and self.choices and self.choices[-1]:
            self.skip = 1
        elif tag == MC + "AlternateContent":
            self.choices.append(False)
        elif tag == MC + "Choice" and self.choices:
            self.choices[-1] = True
        elif tag == W + "p" or tag == A + "p":
            if tag == W + "p" or W + "txbxContent" not in self.tags:
                marks, self.marks = self.marks, ([], [])
                self.paragraphs.append({"style_id": None, "num_id": None, "ilvl": None, "runs": [], "images": [], "bookmarks": marks[0], "comment_ids": marks[1], "section": False, "boxes": []})
        elif tag in (W + "r", A + "r") and self.paragraphs:
            self.runs.append({"text": [], "bold": False, "italic": False, "mono": False})
        elif tag == W + "hyperlink":
            self.links.append((get(R + "id"), get(W + "anchor")))
        elif tag == W + "tbl":
            self.tables.append({"rows": [], "inner": []})
        elif tag == W + "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag == W + "tc" and self.tables and self.tables[-1]["rows"]:
            self.tables[-1]["rows"][-1].append([])
        elif tag == W + "drawing" and self.paragraphs:
            self.images.append({"rid": None, "width_emu": None, "height_emu": None, "alt": None})
        elif tag == W + "txbxContent":
            self._open_box()
        elif tag.endswith(("}wsp", "}sp", "}cxnSp")):
            self._open_box()
        elif tag in SIGNS and self.runs and parent in (W + "r", A + "r", A + "p"):
            self.runs[-1]["text"].append(SIGNS[tag])
        else:
            self._property(tag, parent, get)

    def _property(self, tag: str, parent: str, get) -> None:
        number = lambda v: int(v) if v is not None and v.lstrip("-").isdigit() else None
        own = self.paragraphs[-1] if self.paragraphs else None
        on = get(W + "val", "1") not in ("0", "false", "none")
        if tag == W + "bookmarkStart":
            (own["bookmarks"] if own else self.marks[0]).append(get(W + "name"))
        elif tag == W + "commentRangeStart":
            (own["comment_ids"] if own else self.marks[1]).append(get(W + "id"))
        elif self.images and tag == WP + "extent":
            self.images[-1] |= {k: number(get(c)) for k, c in (("width_emu", "cx"), ("height_emu", "cy"))}
        elif self.images and tag == WP + "docPr":
            self.images[-1]["alt"] = get("descr")
        elif self.images and tag == A + "blip" and self.images[-1]["rid"] is None:
            self.images[-1]["rid"] = get(R + "embed")
        elif self.runs and parent == W + "rPr" and len(self.tags) > 2 and self.tags[-3] == W + "r":
            if tag == W + "rFonts":
                name = (get(W + "ascii") or get(W + "hAnsi") or "").lower()
                self.runs[-1]["mono"] = any(m in name for m in MONOSPACE)
            elif tag in (W + "b", W + "i"):
                self.runs[-1]["bold" if tag == W + "b" else "italic"] = on
        elif self.runs and tag == A + "rPr":
            self.runs[-1] |= {"bold": get("b") in ("1", "true"), "italic": get("i") in ("1", "true")}
        elif own and parent == W + "pPr" and tag == W + "pStyle":
            own["style_id"] = get(W + "val")
        elif own and parent == W + "pPr" and tag == W + "sectPr":
            own["section"] = True
        elif own and parent == W + "numPr" and tag in (W + "numId", W + "ilvl"):
            own["num_id" if tag == W + "numId" else "ilvl"] = number(get(W + "val"))

    def end(self, tag: str, text: str | None) -> None:
        self.tags.pop()
        if self.skip:
            self.skip -= 1
            return
        if tag in (W + "t", A + "t") and self.runs:
            self.runs[-1]["text"].append(text or "")
        elif tag in (W + "r", A + "r") and self.runs:
            run = self.runs.pop()
            run["text"] = "".join(run["text"])
            rid, anchor = self.links[-1] if self.links else (None, None)
            if run["text"]:
                self.paragraphs[-1]["runs"].append(run | {"rid": rid, "anchor": anchor})
        elif tag == W + "hyperlink" and self.links:
            self.links.pop()
        elif tag == W + "drawing" and self.images:
            image = self.images.pop()
            if image["rid"] is not None:
                self.paragraphs[-1]["images"].append(image)
        elif tag == MC + "AlternateContent" and self.choices:
            self.choices.pop()
        elif tag == W + "txbxContent" or tag.endswith(("}wsp", "}sp", "}cxnSp")):
            self._close_box()
        elif tag == W + "p" or tag == A + "p" and W + "txbxContent" not in self.tags and self.paragraphs:
            own = self.paragraphs.pop()
            if tag == A + "p" and not own["runs"]:
                return
            self._emit("paragraph", own)
        elif tag == W + "tbl" and self.tables:
            self._emit("table", self.tables.pop())

    def _open_box(self) -> None:
        """A shape holds paragraphs of its own; what is open around it waits."""
        self.boxes.append([])
        self.depth.append((len(self.paragraphs), len(self.tables)))

    def _close_box(self) -> None:
        found = self.boxes.pop()
        held = self.depth.pop()[0]
        if held:
            self.paragraphs[held - 1]["boxes"] += found
        elif self.boxes:
            self.boxes[-1] += found
        else:
            self.out += found

    def _emit(self, kind: str, own: dict) -> None:
        blocks = [(kind, own)]
        if kind == "paragraph":
            blocks += [("section_break", None)] * own["section"] + own.pop("boxes")
        tables = self.depth[-1][1] if self.depth else 0
        if len(self.tables) > tables:  # within a cell
            table = self.tables[-1]
            cell = table["rows"][-1][-1] if table["rows"] and table["rows"][-1] else None
            for k, b in blocks:
                if k == "paragraph":
                    table["inner"].append(b)
                    lines = ["".join(r["text"] for r in b["runs"])]
                elif k == "table":
                    table["inner"] += b["inner"]
                    lines = ["\n".join(c) for row in b["rows"] for c in row]
                else:
                    lines = []
                if cell is not None:
                    cell += lines
        elif self.boxes:
            self.boxes[-1] += blocks
        else:
            self.out += blocks


def _body_blocks(stream) -> Iterator[tuple[str, dict | None]]:
    body, open_, inside = _Body(), [], 0
    for event, el in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            open_.append(el)
            if inside:
                body.start(el.tag, el.get)
            inside += el.tag == W + "body"
            continue
        inside -= el.tag == W + "body"
        if inside:
            body.end(el.tag, el.text)
        open_.pop()
        if open_:
            open_[-1].remove(el)  # nothing that was read is held
        yield from body.out
        body.out.clear()


def word_blocks(files: DataFrame) -> DataFrame:
    """The blocks of a Word document's body, in order: paragraphs, tables, section breaks. The
    index of a table counts once, for comments as for text. Text of content controls, tracked
    insertions, text boxes and shapes is text like other text, deleted text is none (see
    `_Body`); a document is read as a stream."""

    return per_archive(files, _word_rows, BLOCKS)


def _word_rows(uri: str, z: ZipFile) -> Iterator[tuple]:
    if "word/document.xml" not in z.namelist():
        return
    with z.open("word/document.xml") as stream:
        for idx, (kind, b) in enumerate(_body_blocks(stream)):
            if kind == "paragraph":
                yield uri, idx, kind, b["style_id"], b["num_id"], b["ilvl"], b["runs"], b["bookmarks"], b["comment_ids"], b["images"], None
            elif kind == "table":
                rows = [["\n".join(cell) for cell in row] for row in b["rows"]]
                inner = b["inner"]
                yield uri, idx, kind, None, None, None, [r for p in inner for r in p["runs"]], [m for p in inner for m in p["bookmarks"]], [c for p in inner for c in p["comment_ids"]], [], rows
            else:
                yield uri, idx, kind, None, None, None, [], [], [], [], None


def styles(files: DataFrame) -> DataFrame:
    """uri, style_id, name, type, based_on, next, priority, outline_level, is_default."""

    return per_archive(files, _style_rows, "uri string, style_id string, name string, type string, based_on string, next string, priority int, outline_level int, is_default boolean")


def _style_rows(uri: str, z: ZipFile) -> Iterator[tuple]:
    root = _xml(z, "word/styles.xml")
    for s in root.iter(W + "style") if root is not None else ():
        get = lambda path: (found.get(W + "val") if (found := s.find(path)) is not None else None)  # noqa: B023, E731
        number = [int(v) if v is not None and v.isdigit() else None for v in (get(W + "uiPriority"), get(f"{W}pPr/{W}outlineLvl"))]
        yield uri, s.get(W + "styleId"), get(W + "name"), s.get(W + "type"), get(W + "basedOn"), get(W + "next"), *number, s.get(W + "default") in ("1", "true")


def relationships(files: DataFrame, part: str = "word/_rels/document.xml.rels") -> DataFrame:
    """uri, rid, target, type, external of a part's relationships."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        root = _xml(z, part)
        for r in root if root is not None else ():
            yield uri, r.get("Id"), r.get("Target"), (r.get("Type") or "").rsplit("/", 1)[-1], r.get("TargetMode") == "External"

    return per_archive(files, parse, "uri string, rid string, target string, type string, external boolean")


def added_relationships(rels: DataFrame, new: DataFrame) -> DataFrame:
    """Relationships (uri, rid, target, type, external) with new ones (uri, pos, target, type) of
    documents behind them: their ids count on from the highest number, in order of pos.
    A hyperlink to the web is external."""
    free = next_relationship_id(rels).select("uri", F.expr("cast(substring(rid, 4) as int)").alias("_free"))
    met = new.join(free, "uri", "left")
    number = F.coalesce("_free", F.lit(1)) + F.row_number().over(Window.partitionBy("uri").orderBy("pos")) - 1
    external = F.col("type").contains("hyperlink") & F.col("target").startswith("http")
    return rels.unionByName(met.select("uri", F.concat(F.lit("rId"), number.cast("string")).alias("rid"), "target", "type", external.alias("external")))


#: Name spaces of relationship parts and of their types.
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def relationships_xml(rels: DataFrame) -> DataFrame:
    """uri, xml: a document's relationships part, in order of the numbers of their ids."""
    mode = F.when(F.col("external"), ' TargetMode="External"').otherwise("")
    line = F.concat(F.lit('  <Relationship Id="'), fx.escape_xml(F.col("rid")), F.lit(f'" Type="{TYPES}'), fx.escape_xml(F.col("type")), F.lit('" Target="'), fx.escape_xml(F.col("target")), F.lit('"'), mode, F.lit("/>\n"))
    order = F.coalesce(F.expr("try_cast(substring(rid, 4) as int)"), F.lit(2**31 - 1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("n"), "rid", line.alias("line")))), lambda x: x["line"]), "")
    return rels.groupBy("uri").agg(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="{PACKAGE}">\n'), body, F.lit("</Relationships>")).alias("xml"))


ELEMENT = "struct<type:string,source:string,hash:string,description:string>"
MANIFEST = f"struct<version:string,generator:string,generated_at:string,elements:map<string,{ELEMENT}>>"


def manifests(elements: DataFrame, generated_at: Column, generator: str = "docloom") -> DataFrame:
    """uri, json: the manifest of a document's elements (uri, id, type, source, hash,
    description), without what is null."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct("type", "source", "hash", "description")))))
    own = elements.groupBy("uri").agg(entry.alias("elements"))
    return own.select("uri", F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(generator).alias("generator"), generated_at.alias("generated_at"), "elements"), {"ignoreNullFields": "true"}).alias("json"))


def read_manifests(rows: DataFrame) -> DataFrame:
    """uri, id, type, source, hash, description of the elements of manifests (uri, json); one
    that is no manifest has none."""
    own = rows.select("uri", F.from_json("json", MANIFEST).alias("m")).where("m.elements is not null")
    return own.select("uri", F.explode("m.elements").alias("id", "e")).select("uri", "id", "e.*")


def element_of(elements: Column, name: Column) -> Column:
    """An element of a manifest's map, null without it."""
    return F.try_element_at(elements, name)


def with_element(elements: Column, name: Column, element: Column) -> Column:
    """The map with an element put in, or in place of the one of that name."""
    return F.map_concat(without_element(elements, name), F.create_map(name, element))


def without_element(elements: Column, name: Column) -> Column:
    return F.map_filter(elements, lambda k, _: k != name)


def next_relationship_id(rels: DataFrame) -> DataFrame:
    """uri, rid that a new relationship gets: one more than the highest number."""
    n = F.expr("try_cast(substring(rid, 4) as int)")
    return rels.groupBy("uri").agg(F.concat(F.lit("rId"), (F.coalesce(F.max(F.when(F.col("rid").rlike("^rId[0-9]+$"), n)), F.lit(0)) + 1).cast("string")).alias("rid"))


def comments(files: DataFrame) -> DataFrame:
    """uri, comment_id, text, language (of a text that begins with `Language:`)."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        root = _xml(z, "word/comments.xml")
        for c in root.iter(W + "comment") if root is not None else ():
            yield uri, c.get(W + "id"), "\n".join("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p"))

    out = per_archive(files, parse, "uri string, comment_id string, text string")
    return out.withColumn("language", F.nullif(F.trim(F.regexp_extract("text", r"^Language:\s*([^\n]*)", 1)), F.lit("")))


PROPERTIES = ("title", "creator", "subject", "keywords", "revision", "created", "modified")


def core_properties(files: DataFrame) -> DataFrame:
    """uri, title, author, subject, keywords, revision, created, modified."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        root = _xml(z, "docProps/core.xml")
        own = {el.tag.rsplit("}", 1)[-1]: el.text for el in (root if root is not None else ())}
        yield uri, *(own.get(p) for p in PROPERTIES)

    return per_archive(files, parse, "uri string, " + ", ".join(f"{'author' if p == 'creator' else p} string" for p in PROPERTIES))


def metadata_header(props: DataFrame) -> DataFrame:
    """uri, header: title line, author and the day of the last change."""
    lines = F.array(F.concat(F.lit("= "), "title"), F.concat(F.lit(":author: "), "author"), F.concat(F.lit(":revdate: "), F.substring_index("modified", "T", 1)))
    return props.select("uri", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("header"))


def run_text(run: Column) -> Column:
    """A run's text between the signs of its format; bold italics are closed in order."""
    t = run["text"]
    return F.when(run["bold"] & run["italic"], F.concat(F.lit("*_"), t, F.lit("_*"))).when(run["bold"], F.concat(F.lit("*"), t, F.lit("*"))).when(run["italic"], F.concat(F.lit("_"), t, F.lit("_"))).when(run["mono"], F.concat(F.lit("`"), t, F.lit("`"))).otherwise(t)


def merged_runs(runs: Column) -> Column:
    """Neighbouring runs of one format and link as one run."""
    same = lambda a, b: (a["bold"] == b["bold"]) & (a["italic"] == b["italic"]) & (a["mono"] == b["mono"]) & a["rid"].eqNullSafe(b["rid"]) & a["anchor"].eqNullSafe(b["anchor"])
    last = lambda done: F.get(done, F.size(done) - 1)
    joined = lambda done, r: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last(done).withField("text", F.concat(last(done)["text"], r["text"]))))
    return F.aggregate(runs, F.array().cast(f"array<{RUN}>"), lambda done, r: F.when((F.size(done) > 0) & same(last(done), r), joined(done, r)).otherwise(F.concat(done, F.array(r))))


def plain_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def is_code(runs: Column) -> Column:
    """All of a paragraph's text is of fixed pitch, and it has several lines."""
    full = F.filter(runs, lambda r: r["text"] != "")
    return (F.size(full) > 0) & F.forall(full, lambda r: r["mono"]) & F.exists(full, lambda r: r["text"].contains("\n"))


def heading_levels(sheet: DataFrame) -> DataFrame:
    """uri, style_id, level of heading styles: the outline level plus one, else the number
    of a HeadingN name."""
    level = F.coalesce(F.col("outline_level") + 1, F.expr("try_cast(nullif(regexp_extract(style_id, '^[Hh]eading(\\\\d+)$', 1), '') as int)"))
    return sheet.withColumn("level", level).where("level is not null").select("uri", "style_id", "level")


def to_asciidoc(blocks: DataFrame, sheet: DataFrame, rels: DataFrame, notes: DataFrame, props: DataFrame) -> DataFrame:
    """uri, text: headings, code with its comment's language, lists, tables, images, links and
    section breaks, below the metadata header."""
    url = rels.groupBy("uri").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("rid", "target")))).alias("targets"))
    langs = blocks.select("uri", "idx", F.posexplode("comment_ids").alias("pos", "comment_id")).join(notes.where("language is not null").select("uri", "comment_id", "language"), ["uri", "comment_id"]).groupBy("uri", "idx").agg(F.min_by("language", "pos").alias("language"))
    met = blocks.join(heading_levels(sheet), ["uri", "style_id"], "left").join(langs, ["uri", "idx"], "left").join(url, "uri", "left")
    target = lambda r: F.coalesce(F.try_element_at("targets", r["rid"]), F.concat(F.lit("#"), r["anchor"]))
    linked = lambda r: F.when(r["rid"].isNotNull() | r["anchor"].isNotNull(), F.concat(F.lit("link:"), F.coalesce(target(r), F.lit("")), F.lit("["), r["text"], F.lit("]"))).otherwise(run_text(r))
    text = F.trim(F.array_join(F.transform(merged_runs(F.col("runs")), linked), ""))
    image = F.array_join(F.transform("images", lambda i: F.concat(F.lit("image::media/"), F.substring_index(F.coalesce(F.try_element_at("targets", i["rid"]), F.lit("image")), "/", -1), F.lit("["), F.array_join(F.filter(F.array(i["alt"], F.concat(F.lit("width="), F.round(i["width_emu"] / 9525).cast("int").cast("string")), F.concat(F.lit("height="), F.round(i["height_emu"] / 9525).cast("int").cast("string"))), lambda x: x.isNotNull()), ","), F.lit("]"))), "\n")
    styled = F.lower(F.coalesce("style_id", F.lit(""))).rlike("code|source")
    fence = F.concat(F.lit("[source"), F.coalesce(F.concat(F.lit(","), "language"), F.lit("")), F.lit("]\n----\n"), F.trim(plain_text(F.col("runs"))), F.lit("\n----"))
    item = F.concat(F.repeat(F.when(F.col("num_id") == 2, ".").otherwise("*"), F.coalesce("ilvl", F.lit(0)) + 1), F.lit(" "), text)
    table = F.concat(F.lit('[options="header"]\n|===\n'), F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("|"), c)), " ")), "\n"), F.lit("\n|==="))
    body = (
        F.when(F.col("kind") == "section_break", "'''")
        .when(F.col("kind") == "table", table)
        .when(F.col("level").isNotNull() & (text != ""), F.concat(F.repeat(F.lit("="), F.col("level") + 1), F.lit(" "), text))
        .when(styled | is_code(F.col("runs")), fence)
        .when(F.col("num_id").isNotNull() & (text != ""), item)
        .when(F.size("images") > 0, F.concat_ws("\n", F.nullif(text, F.lit("")), image))
        .otherwise(F.nullif(text, F.lit("")))
    )
    rows = met.select("uri", "idx", body.alias("body"), (F.col("num_id").isNotNull() & F.col("level").isNull()).alias("item")).where("body is not null")
    out = F.aggregate(
        F.array_sort(F.collect_list(F.struct("idx", "body", "item"))),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("item")),
        lambda a, b: F.struct(F.concat(a["text"], F.when(a["text"] == "", "").when(a["item"] & b["item"], "\n").otherwise("\n\n"), b["body"]).alias("text"), b["item"].alias("item")),
        lambda a: a["text"],
    )
    own = rows.groupBy("uri").agg(out.alias("body")).join(metadata_header(props), "uri", "left")
    return own.select("uri", F.concat_ws("\n\n", F.nullif("header", F.lit("")), "body").alias("text"))


def anchors(blocks: DataFrame, sheet: DataFrame) -> DataFrame:
    """bookmark, semantic_id, anchor_type, target_heading, original_bookmark for each bookmark but
    highlights; its heading is the last one at or before it."""
    met = blocks.join(heading_levels(sheet), ["uri", "style_id"], "left")
    heading = F.when(F.col("level").isNotNull(), plain_text(F.col("runs")))
    w = Window.partitionBy("uri").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return _anchors(met.withColumn("heading", F.last(heading, ignorenulls=True).over(w)).select("uri", "heading", F.explode("bookmarks").alias("bookmark")))


def anchors_of(files: DataFrame) -> DataFrame:
    """What `anchors` gives of Word documents, from one reading of each. A body streams by, with its
    styles and the last heading at hand, so nothing is shuffled."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        levels = {s[1] for s in _style_rows(uri, z) if s[7] is not None or (n := HEADING.fullmatch(s[1] or "")) and int(n[1]) < 1 << 31}
        heading = None
        for block in _word_rows(uri, z):
            if block[3] is not None and block[3] in levels:
                heading = "".join(r["text"] for r in block[6])
            yield from ((uri, heading, bookmark) for bookmark in block[7])

    return _anchors(per_archive(files, parse, "uri string, heading string, bookmark string"))


def _anchors(each: DataFrame) -> DataFrame:
    """Anchors of bookmarks (uri, heading, bookmark)."""
    kind = fx.bookmark_class(F.col("bookmark"))
    own = each.withColumn("anchor_type", kind).where("anchor_type not in ('highlight', 'internal')")
    semantic = F.coalesce(F.nullif(fx.heading_slug(F.col("heading")), F.lit("")), fx.text_slug(F.col("bookmark")))
    return own.select("uri", "bookmark", semantic.alias("semantic_id"), "anchor_type", F.col("heading").alias("target_heading"), F.col("bookmark").alias("original_bookmark"))


def hyperlinks(blocks: DataFrame, rels: DataFrame) -> DataFrame:
    """link_id (numbered in order), is_external, url, anchor_target, original_rel_id,
    original_anchor of links, those in tables too."""
    each = blocks.select("uri", "idx", F.posexplode("runs").alias("pos", "run")).where("run.rid is not null or run.anchor is not null")
    before = F.lag(F.struct("idx", "run.rid", "run.anchor")).over(Window.partitionBy("uri").orderBy("idx", "pos"))
    each = each.withColumn("_before", before).where(~F.struct("idx", "run.rid", "run.anchor").eqNullSafe(F.col("_before")))
    number = F.row_number().over(Window.partitionBy("uri").orderBy("idx", "pos"))
    met = each.withColumn("n", number).join(rels.select("uri", "rid", "target"), (each["uri"] == rels["uri"]) & (F.col("run.rid") == rels["rid"]), "left")
    return met.select(each["uri"], F.concat(F.lit("link"), "n").alias("link_id"), F.col("run.rid").isNotNull().alias("is_external"), F.col("target").alias("url"), F.col("run.anchor").alias("anchor_target"), F.col("run.rid").alias("original_rel_id"), F.col("run.anchor").alias("original_anchor"))


#: For each element the style names that serve it, the best first.
CANDIDATES = {
    "list_bullet": ("list bullet", "list paragraph", "listbullet", "listparagraph"),
    "list_number": ("list number", "listnumber", "list paragraph"),
    "code_block": ("code", "codeblock", "source code", "verbatim", "html preformatted", "no spacing", "nospacing"),
    "table": ("table grid", "tablegrid", "grid table 1 light", "plain table 1", "gridtable1light", "plaintable1"),
}
#: The styles of elements that nothing serves.
FALLBACK = {"heading": "Heading1", "paragraph": "Normal", "code_block": "Normal", "list_bullet": "ListBullet", "list_number": "ListNumber", "table": "TableGrid", "table_header": "TableGrid", "admonition": "Normal"}


def style_map(sheet: DataFrame) -> DataFrame:
    """uri, element, style_id: headings by outline level, the default paragraph style, then by
    candidate names (of style or id), else the fallback."""
    spark = sheet.sparkSession
    heads = sheet.where("outline_level is not null").groupBy("uri", F.concat(F.lit("heading"), F.least(F.lit(9), F.col("outline_level") + 1)).alias("element")).agg(F.max("style_id").alias("style_id"))
    para = sheet.where("type = 'paragraph' and (is_default or lower(name) = 'normal')").groupBy("uri").agg(F.max_by("style_id", F.struct("is_default", "style_id")).alias("style_id")).select("uri", F.lit("paragraph").alias("element"), "style_id")
    names = spark.createDataFrame([(e, n, i) for e, own in CANDIDATES.items() for i, n in enumerate(own)], "element string, name string, prio int")
    named = sheet.select("uri", "style_id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("style_id")))).alias("name")).join(F.broadcast(names), "name").groupBy("uri", "element").agg(F.min_by("style_id", "prio").alias("style_id"))
    found = union_all([heads, para, named])
    rest = spark.createDataFrame([(e if e != "heading" else "heading1", s) for e, s in FALLBACK.items()], "element string, fallback string")
    every = sheet.select("uri").distinct().crossJoin(F.broadcast(rest))  # eight rows a document
    return every.join(found, ["uri", "element"], "full").select("uri", "element", F.coalesce("style_id", "fallback").alias("style_id"))


#: Layout names by what they contain, the first rule that fits.
LAYOUTS = (
    ("title", ("title slide", "titolo")), ("section", ("section", "sezione")), ("two_column", ("two", "due")), ("comparison", ("comparison", "confronto")),
    ("blank", ("blank", "vuoto")), ("title_only", ("title only",)), ("image", ("picture", "immagine")), ("content", ("content", "contenuto")),
)
#: Layout types of the file format.
LAYOUT_TYPES = {"title": "ctrTitle", "content": "obj", "section": "secHead", "two_column": "twoObj", "comparison": "twoTxTwoObj", "title_only": "titleOnly", "blank": "blank", "image": "picTx", "caption": "objTx"}


def layout_type(name: Column) -> Column:
    out = F.lit("custom")
    for kind, words in reversed(LAYOUTS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(name).contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def slide_layouts(files: DataFrame) -> DataFrame:
    """uri, layout_index (the number that a part's name bears), name, layout, placeholders (idx,
    type) of a presentation template; a center-title placeholder makes a title layout."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        for part in z.namelist():
            number = re.fullmatch(r"ppt/slideLayouts/slideLayout(\d+)\.xml", part)
            index = int(number[1]) if number else 0
            if not index:
                continue
            root = _xml(z, part)
            common = root.find(P + "cSld")
            marks = [{"idx": int(ph.get("idx", "0")), "type": ph.get("type", "body")} for ph in root.iter(P + "ph")]
            yield uri, index, (common.get("name") if common is not None else None) or f"Layout {index}", marks

    out = per_archive(files, parse, "uri string, layout_index int, name string, placeholders array<struct<idx:int,type:string>>")
    centre = F.exists("placeholders", lambda p: p["type"] == "ctrTitle")
    return out.withColumn("layout", F.when(centre, "title").otherwise(layout_type(F.col("name"))))


def themes(files: DataFrame) -> DataFrame:
    """uri, name, major_font, minor_font of a template's first theme; defaults where it is silent."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        root = _xml(z, "ppt/theme/theme1.xml")
        font = lambda kind: (found.get("typeface") if root is not None and (found := root.find(f".//{A}{kind}/{A}latin")) is not None else None)
        yield uri, (root.get("name") if root is not None else None) or "Default", font("majorFont") or "Calibri Light", font("minorFont") or "Calibri"

    return per_archive(files, parse, "uri string, name string, major_font string, minor_font string")


def layout_code(layout: Column) -> Column:
    """The file format's name of a layout type, null for custom ones."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LAYOUT_TYPES.items() for x in pair)), layout)


def layout_of_code(code: Column) -> Column:
    """The layout type that a name of the file format means; custom for unknown ones."""
    back = {**{v: k for k, v in LAYOUT_TYPES.items()}, "title": "title"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in back.items() for x in pair)), code), F.lit("custom"))


#: Placeholder types of the file format.
PLACEHOLDERS = {"title": "title", "center_title": "ctrTitle", "subtitle": "subTitle", "body": "body", "object": "obj", "date_time": "dt", "footer": "ftr", "slide_number": "sldNum", "chart": "chart", "table": "tbl", "diagram": "dgm", "media": "media", "picture": "pic"}


def placeholder_code(kind: Column) -> Column:
    """The file format's name of a placeholder; empty for other ones."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair)), kind), F.lit(""))


def placeholder_of_code(code: Column) -> Column:
    back = {v: k for k, v in PLACEHOLDERS.items()}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in back.items() for x in pair)), code), F.lit("other"))


def slide_size(files: DataFrame) -> DataFrame:
    """uri, width, height in EMU; 9144000 by 6858000 where a file doesn't say."""

    def parse(uri: str, z: ZipFile) -> Iterator[tuple]:
        root = _xml(z, "ppt/presentation.xml")
        size = root.find(P + "sldSz") if root is not None else None
        yield uri, *((int(size.get("cx")), int(size.get("cy"))) if size is not None else (9144000, 6858000))

    return per_archive(files, parse, "uri string, width long, height long")


def layout_for(rows: DataFrame, layouts: DataFrame, hint: str = "layout_hint") -> DataFrame:
    """Rows (uri, hint) with the first layout of the hinted type, else the content layout."""
    first = layouts.groupBy("uri", "layout").agg(F.min("layout_index").alias("layout_index"))
    plain = first.where("layout = 'content'").select("uri", F.col("layout_index").alias("_default"))
    return rows.join(first.withColumnRenamed("layout", hint), ["uri", hint], "left").join(plain, "uri", "left").withColumn("layout_index", F.coalesce("layout_index", "_default", F.lit(1))).drop("_default")
