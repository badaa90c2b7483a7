"""Edits that follow from diagnostics, and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import domains
from docloom.operators import graph as g
from docloom.operators import lines as ln

EDITS = ("uri", "ln", "col", "end_col", "new_text", "title")


def status_edits(found: DataFrame, ws: g.Workspace) -> DataFrame:
    """For each BRIDGE001 the edit that sets the superseded document's first status line to
    Deprecated; other codes have no such edit."""
    ids = found.where("code = 'BRIDGE001'").select(F.col("subject").alias("id")).distinct()
    to = ids.join(ws.definitions.select("id", "uri"), "id")
    pattern = r"^:status:\s*(.*)$"
    lines = ws.lines.where(F.col("line").rlike(pattern)).groupBy("uri").agg(F.min_by(F.struct("ln", "line"), "ln").alias("at")).select("uri", "at.*")
    value = F.regexp_extract("line", pattern, 1)
    start = F.length("line") - F.length(value)
    return to.join(lines, "uri").select("uri", "ln", start.alias("col"), F.length("line").alias("end_col"), F.lit("Deprecated").alias("new_text"), F.format_string("Mark '%s' as Deprecated", "id").alias("title"))


def orphan_edits(found: DataFrame, ws: g.Workspace) -> DataFrame:
    """For each BRIDGE003 a reference to the orphan at the end of the first index document, in
    the form that reachability follows."""
    index = ws.docs.where(g.is_entry_point(F.col("uri"))).orderBy("load_ord").limit(1).select(F.col("uri").alias("index_uri"), F.size(ln.split_lines(F.col("text"))).alias("ln"))
    name = F.substring_index("uri", "/", -1)
    own = found.where("code = 'BRIDGE003'").select("uri").join(F.broadcast(index))  # one row
    rel = F.when(F.expr("startswith(uri, regexp_replace(index_uri, '[^/]*$', ''))"), F.expr("substring(uri, length(regexp_replace(index_uri, '[^/]*$', '')) + 1)")).otherwise(name)
    return own.select(F.col("index_uri").alias("uri"), "ln", F.lit(0).alias("col"), F.lit(0).alias("end_col"), F.concat(F.lit("* <<"), rel, F.lit("#,"), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(">>\n")).alias("new_text"), F.format_string("Link '%s' from the index", name).alias("title"))


def section_edits(found: DataFrame) -> DataFrame:
    """For each ADR001 the edit that adds the section at the document's end."""
    name = F.col("subject")
    return found.where("code = 'ADR001'").select("uri", "ln", F.lit(0).alias("col"), F.lit(0).alias("end_col"), F.concat(F.lit("\n== "), name, F.lit("\n\n")).alias("new_text"), F.format_string("Add section '%s'", name).alias("title"))


def section_inserts(ws: g.Workspace) -> DataFrame:
    """For each section that a decision record lacks, by the older rules, the edit that inserts
    its template behind the last line that is not blank; where several are missing also one
    edit for all of them, which is preferred."""
    def text(section):
        return F.concat(F.lit("\n== "), section, F.lit("\n\n// TODO: "), domains.described(section), F.lit("\n"))

    edit = lambda new, title, preferred: F.struct(new.alias("new_text"), title.alias("title"), F.lit(preferred).alias("preferred"))
    each = F.transform("lacking", lambda x: edit(text(x["section"]), F.concat(F.lit("Insert '"), x["section"], F.lit("' section")), False))
    every = F.array(edit(F.array_join(F.transform("lacking", lambda x: text(x["section"])), ""), F.lit("Insert all missing ADR sections"), True))
    edits = F.when(F.size("lacking") > 1, F.concat(each, every)).otherwise(each)
    rows = domains.old_lacking(ws).select("uri", "ln", F.explode_outer(edits).alias("_e")).where("_e is not null")
    return rows.select("uri", "ln", F.lit(0).alias("col"), F.lit(0).alias("end_col"), "_e.*")


def fixes(found: DataFrame, ws: g.Workspace) -> DataFrame:
    """All edits by rule code; BRIDGE002 has none."""
    return ln.union_all([status_edits(found, ws), orphan_edits(found, ws), section_edits(found)])


def rename_edits(ws: g.Workspace, old: str, new: str) -> DataFrame:
    """uri, ln, line, new_line of all lines that define or name an id; labels are kept."""
    q = "(?<![\\w-])" + "".join("\\" + c if not c.isalnum() and c not in "-_" else c for c in old) + "(?![\\w-])"
    hit = ws.lines.where(F.col("line").rlike(rf"(?U)(\[\[|<<){q}"))
    done = F.regexp_replace("line", rf"(?U)(\[\[|<<){q}", "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))
    return hit.select("uri", "ln", "line", done.alias("new_line"))


def can_rename(ws: g.Workspace, new: str) -> DataFrame:
    """The definitions that a new id would clash with."""
    return ws.definitions.where(F.col("id") == new)
