"""Diagram blocks and their lint rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import graph as g
from docloom.operators.perdoc import per_document
from docloom.operators.rules import diagnostics

SCHEMA = "uri string, start_ln int, end_ln int, type string, content string"
#: First words of Mermaid diagrams, without dashes and underscores.
MERMAID = (
    "graph flowchart sequencediagram classdiagram statediagram erdiagram journey gantt pie quadrantchart "
    "requirementdiagram gitgraph mindmap timeline zenuml sankey xychart block"
).split()
#: Diagram types with their service names and file extensions.
TYPES = (
    ("mermaid", "mermaid", "mmd"), ("plantuml", "plantuml", "puml"), ("graphviz", "graphviz", "dot"), ("ditaa", "ditaa", "ditaa"), ("d2", "d2", "d2"),
    ("blockdiag", "blockdiag", "blockdiag"), ("seqdiag", "seqdiag", "seqdiag"), ("actdiag", "actdiag", "actdiag"), ("nwdiag", "nwdiag", "nwdiag"), ("c4plantuml", "c4plantuml", "c4"),
    ("svgbob", "svgbob", "bob"), ("vega", "vega", "vega"), ("vegalite", "vegalite", "vl"), ("wavedrom", "wavedrom", "wavedrom"), ("bytefield", "bytefield", "bytefield"),
    ("erd", "erd", "erd"), ("nomnoml", "nomnoml", "nomnoml"), ("pikchr", "pikchr", "pikchr"),
)
START = re.compile(r"\[(mermaid|plantuml)\]", re.I)


def diagram_blocks(docs: DataFrame) -> DataFrame:
    """Blocks that a `[mermaid]` or `[plantuml]` line (or a Markdown fence of that name)
    announces: the lines between the next two fences, or to the document's end."""

    def parse(uri: str, text: str) -> Iterator[tuple]:
        lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n") if text else []
        fences = [i for i, line in enumerate(lines) if line.startswith("----")] + [len(lines)] * 2
        at = 0
        for i, line in enumerate(lines):
            kind = START.search(line)
            name = kind[1].lower() if kind else next((n for n in ("mermaid", "plantuml") if line.startswith("```" + n)), None)
            if i < at or not name:
                continue
            first, last = [f for f in fences if f > i][:2] if i + 1 <= len(lines) else (len(lines),) * 2
            yield uri, i, last, name, "\n".join(lines[first + 1 : last])
            at = last + 1

    return per_document(docs, parse, SCHEMA)


def lint(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """DIAGRAM001 to DIAGRAM006: empty, of unknown type, unbalanced in a line, without its
    start or end, with an odd number of quotes in a line. All of a block are told at once."""
    bare = F.regexp_replace("content", r"^\s+|\s+$", "")
    found = diagram_blocks(ws.docs).withColumn("bare", F.trim(bare))
    name = F.when(F.col("type") == "mermaid", "Mermaid").otherwise("PlantUML")
    full, start = F.col("bare") != "", F.col("start_ln")
    mermaid, uml = full & (F.col("type") == "mermaid"), full & (F.col("type") == "plantuml")
    word = F.regexp_extract(F.lower("bare"), r"^(\S+)", 1)
    known = F.regexp_replace(word, "[-_]", "").rlike("^(" + "|".join(MERMAID) + ")")
    hit = lambda code, message, at, end: F.struct(F.lit(code).alias("code"), message.alias("message"), at.cast("int").alias("ln"), end.cast("int").alias("end_col"))
    none = F.array().cast("array<struct<code:string,message:string,ln:int,end_col:int>>")
    where = lambda condition, hits: F.when(condition, hits).otherwise(none)
    count = lambda line, sign: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))
    each = F.transform(F.split("bare", "\n"), lambda line, off: F.struct(line.alias("line"), off.alias("off")))

    def bad(condition, code: str, message: str) -> Column:
        return F.transform(F.filter(each, lambda x: condition(x["line"])), lambda x: hit(code, F.lit(message), start + 1 + x["off"], F.length(x["line"])))

    hits = [
        where(~full, F.array(hit("DIAGRAM001", F.format_string("Empty %s diagram block", name), start, F.lit(10)))),
        where(mermaid & ~known, F.array(hit("DIAGRAM002", F.format_string("Unknown Mermaid diagram type: '%s'. Expected one of: graph, flowchart, sequenceDiagram, classDiagram, etc.", word), start + 1, F.length(word)))),
    ]
    for pair, what in (("()", "parentheses"), ("[]", "brackets"), ("{}", "braces")):
        hits.append(where(mermaid, bad(lambda line, pair=pair: count(line, pair[0]) != count(line, pair[1]), "DIAGRAM003", f"Unbalanced {what} in Mermaid diagram")))
    hits.append(where(uml & ~F.lower("bare").contains("@startuml"), F.array(hit("DIAGRAM004", F.lit("PlantUML diagram should start with @startuml"), start + 1, F.lit(10)))))
    hits.append(where(uml & ~F.lower("bare").contains("@enduml"), F.array(hit("DIAGRAM005", F.lit("PlantUML diagram should end with @enduml"), F.greatest(F.lit(0), F.col("end_ln") - 1), F.lit(10)))))
    hits.append(where(uml, bad(lambda line: count(line, '"') % 2 != 0, "DIAGRAM006", "Unclosed quote in PlantUML diagram")))
    every = found.select("uri", F.explode_outer(F.concat(*hits)).alias("_d")).where("_d is not null").select("uri", "_d.*")
    return diagnostics(every, F.col("code"), severity, F.col("message"), F.col("ln"), 0, F.col("end_col"))


def types(spark) -> DataFrame:
    """The dimension table of diagram types: type, service_name, extension."""
    return spark.createDataFrame(list(TYPES), "type string, service_name string, extension string")


def rendered(sources: DataFrame, renderers: list[tuple[str, list[str]]]) -> DataFrame:
    """The first renderer of the list that supports each source's type, as `renderer`."""
    pick = F.coalesce(*(F.when(F.col("type").isin(kinds), F.lit(name)) for name, kinds in renderers))
    return sources.withColumn("renderer", pick)


def image_format(data: Column) -> Column:
    """png or svg by its first bytes or tags, else null."""
    head = F.hex(F.substring(data, 1, 8))
    text = F.decode(data, "UTF-8")
    return F.when(head == "89504E470D0A1A0A", "png").when(text.contains("<svg") | text.contains("<?xml"), "svg")
