"""Report sinks: compliance as JSON, Markdown and HTML, diagnostics as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fx

#: Colours of the dashboard by status.
COLOURS = {"failing": "#dc3545", "passing_with_warnings": "#ffc107", "passing": "#28a745"}


def minimal_json(score: DataFrame) -> DataFrame:
    """One row, json: status (warnings don't count), errors, warnings, score."""
    status = F.when(F.col("errors") > 0, "failing").otherwise("passing")
    return score.select(F.to_json(F.struct(status.alias("status"), "errors", "warnings", "score")).alias("json"))


def diagnostic_json(found: DataFrame) -> DataFrame:
    """uri, json of each diagnostic, without its nulls."""
    return found.select("uri", F.to_json(_placed(), _NO_NULLS).alias("json"))


_NO_NULLS = {"ignoreNullFields": "true"}


def _placed() -> Column:
    place = F.struct(F.struct(F.col("ln").alias("line"), F.col("col").alias("character")).alias("start"), F.struct(F.col("ln").alias("line"), F.col("end_col").alias("character")).alias("end"))
    return F.struct("code", "severity", "message", "uri", place.alias("range"))


def diagnostic_text(found: DataFrame) -> DataFrame:
    """uri, text: `severity[code]: message` and the place below it."""
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit("["), "code", F.lit("]"))).otherwise("")
    return found.select("uri", F.concat("severity", code, F.lit(": "), "message", F.lit("\n  --> "), "uri", F.lit(":"), F.col("ln") + 1, F.lit(":"), F.col("col") + 1).alias("text"))


def _ordered(found: DataFrame, body: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("uri", "ln", "code", body.alias("body")))), lambda x: x["body"])


def by_document(found: DataFrame) -> DataFrame:
    """uri, n, json: a document's diagnostics as one JSON array in order of place; the unit of a
    written report, so that no report has to fit into one task. One document's have to."""
    own = found.select("uri", "ln", "col", F.to_json(_placed(), _NO_NULLS).alias("json"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ln", "col", "json"))), lambda x: x["json"])
    return own.groupBy("uri").agg(F.count("*").alias("n"), F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("json"))


def markdown(found: DataFrame, score: DataFrame, compact: bool = False) -> DataFrame:
    """section, text rows of a Markdown report: a summary table, then a part for each document."""
    head = F.concat(F.lit("# Compliance Report\n\n| Metric | Value |\n|---|---|\n"), *(F.concat(F.lit(f"| {n} | "), F.col(n).cast("string"), F.lit(" |\n")) for n in ("documents", "errors", "warnings", "infos", "score", "status")))
    line = F.concat(F.lit("- **"), "code", F.lit("** ("), "severity", F.lit("): "), "message", F.lit("\n"))
    parts = found.groupBy("uri").agg(F.array_join(_ordered(found, line), "").alias("body"), F.count("*").alias("n"))
    text = F.concat(F.lit("<details><summary>"), "uri", F.lit("</summary>\n\n"), "body", F.lit("</details>\n")) if compact else F.concat(F.lit("## "), "uri", F.lit("\n\n"), "body")
    return score.select(F.lit("").alias("section"), head.alias("text")).unionByName(parts.select(F.col("uri").alias("section"), text.alias("text")))


def json_report(found: DataFrame, score: DataFrame, at: Column) -> DataFrame:
    """section, text rows of a JSON report that is well-formed when they follow each other in
    order: stamp, status and summary, then each document's violations with their places."""
    status = F.when(F.col("errors") > 0, "failing").when(F.col("warnings") > 0, "passing_with_warnings").otherwise("passing")
    summary = F.struct(F.col("documents").alias("total_documents"), "errors", "warnings", F.col("infos").alias("info"), F.col("score").alias("compliance_score"))
    head = F.concat(F.regexp_replace(F.to_json(F.struct(at.alias("timestamp"), status.alias("status"), summary.alias("summary"))), r"\}$", ""), F.lit(',"violations":['))
    place = lambda ln, col: F.struct(F.col(ln).alias("line"), F.col(col).alias("character"))
    one = F.to_json(F.struct("code", "severity", "message", F.struct("uri", F.struct(place("ln", "col").alias("start"), place("ln", "end_col").alias("end")).alias("range")).alias("location")))
    parts = found.groupBy("uri").agg(F.array_join(_ordered(found, one), ",\n").alias("text"))
    first = found.agg(F.min("uri").alias("_first"))  # one row
    each = parts.join(F.broadcast(first)).select(F.col("uri").alias("section"), F.concat(F.when(F.col("uri") == F.col("_first"), "").otherwise(","), "text").alias("text"))
    return score.select(F.lit("").alias("section"), head.alias("text")).unionByName(each).unionByName(score.select(F.lit(LAST).alias("section"), F.lit("]}").alias("text")))


#: Sorts behind every URI.
LAST = "\U0010ffff"
#: What the dashboard says of a status, and the colours of severities.
TITLES = {"failing": "FAILING", "passing_with_warnings": "PASSING (with warnings)", "passing": "PASSING"}
BADGES = {"error": "#dc3545", "warning": "#ffc107", "info": "#17a2b8"}
STYLE = "body{font:16px sans-serif;max-width:60rem;margin:2rem auto}.cards{display:flex;gap:1rem}.card{flex:1;padding:1rem;border:1px solid #ccc}.card b{display:block;font-size:2rem}.badge{padding:.2rem .6rem;color:#fff}.found{border-left:4px solid;padding:.4rem 1rem;margin:.6rem 0}.place{color:#666;font-family:monospace}"


def html(found: DataFrame, score: DataFrame, described: dict[str, str] | None = None, at: Column | None = None) -> DataFrame:
    """section, text rows of an HTML dashboard in order: counts, score and status in the colour
    of the worst severity; each document's violations with badge, message and place (lines
    and columns from 1); the active rules and the stamp. Messages are escaped."""
    by = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(""))
    colour = by(COLOURS, F.col("status"))
    card = lambda value, label, style: F.concat(F.lit('<div class="card"><b style="color:'), style, F.lit('">'), value, F.lit(f"</b>{label}</div>"))
    cards = F.concat(card(F.col("documents").cast("string"), "Documents", F.lit("#000")), card(F.col("errors").cast("string"), "Errors", F.lit(BADGES["error"])), card(F.col("warnings").cast("string"), "Warnings", F.lit(BADGES["warning"])), card(F.concat(F.col("score").cast("string"), F.lit("%")), "Compliance Score", colour))
    none = F.when(F.col("errors") + F.col("warnings") + F.col("infos") == 0, "<p>All compliance checks passed!</p>\n").otherwise("")
    head = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Compliance Dashboard</title><style>{STYLE}</style></head><body>\n<h1>Compliance Dashboard</h1>\n<div class="cards">'), cards, F.lit('</div>\n<p><span class="badge" style="background:'), colour, F.lit('">'), by(TITLES, F.col("status")), F.lit("</span></p>\n<h2>Violations</h2>\n"), none)
    badge = by(BADGES, F.col("severity"))
    line = F.concat(F.lit('<div class="found" style="border-color:'), badge, F.lit('"><code>'), "code", F.lit('</code> <span class="badge" style="background:'), badge, F.lit('">'), F.upper("severity"), F.lit("</span><div>"), fx.escape_html(F.col("message")), F.lit('</div><div class="place">'), fx.escape_html(F.substring_index("uri", "/", -1)), F.lit(":"), (F.col("ln") + 1).cast("string"), F.lit(":"), (F.col("col") + 1).cast("string"), F.lit("</div></div>\n"))
    parts = found.groupBy("uri").agg(F.array_join(_ordered(found, line), "").alias("text"))
    escaped = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    rules = "".join(f"<li><code>{escaped(code)}</code> {escaped(text)}</li>\n" for code, text in (described or {}).items())
    tail = F.concat(F.lit("<h2>Active Rules</h2>\n" + (f"<ul>\n{rules}</ul>" if rules else "<p>No rules configured.</p>") + "\n<footer>"), F.coalesce(F.concat(F.lit("Generated at "), at), F.lit("")) if at is not None else F.lit(""), F.lit("</footer></body></html>"))
    return score.select(F.lit("").alias("section"), head.alias("text")).unionByName(parts.select(F.col("uri").alias("section"), "text")).unionByName(score.select(F.lit(LAST).alias("section"), tail.alias("text")))


def write(rows: DataFrame, path: str) -> None:
    """The rows' text as files below a folder, in order of sections."""
    rows.repartitionByRange("section").sortWithinPartitions("section").select("text").write.text(path)
