"""Document kinds: detection scores, the choice among them, and their rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import graph as g
from docloom.operators.lines import split_lines, union_all
from docloom.operators.rules import SCHEMA, diagnostics

#: States of a decision record, categories of a request for comments, sections.
STATUSES = ("Draft", "Proposed", "Accepted", "Rejected", "Deprecated", "Superseded")
CATEGORIES = ("standards-track", "informational", "experimental", "best-current-practice", "historic")
ADR_SECTIONS = ("Context", "Decision", "Consequences")
RFC_SECTIONS = ("Abstract",)
ADR_PURPOSES = {
    "Context": "Describes the forces at play, including technological, political, social, and project-specific factors.",
    "Decision": "Describes our response to these forces, the decision we've made.",
    "Consequences": "Describes the resulting context, after applying the decision.",
}
ADR_TITLE, RFC_TITLE = r"(?i)^=\s*ADR[\s\-]?\d+", r"(?i)^=\s*RFC\s*\d+"


def has_section(text: Column, name: str) -> Column:
    return text.contains(f"== {name}")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_adr(text: Column, statuses=STATUSES) -> Column:
    """By title, by a status anywhere, or by a Decision with Context or Consequences."""
    sections = has_section(text, "Decision") & (has_section(text, "Context") | has_section(text, "Consequences"))
    return text.rlike(ADR_TITLE) | text.rlike(r"(?i):status:\s*(" + "|".join(statuses) + ")") | sections


def is_rfc(text: Column) -> Column:
    known = text.contains(":category:") & _any([F.lower(text).contains(c) for c in CATEGORIES])
    return text.rlike(RFC_TITLE) | known | (has_section(text, "Abstract") & (has_section(text, "Security Considerations") | has_section(text, "IANA Considerations")))


def is_adr_by_old_rule(text: Column) -> Column:
    """The older detection, which does not know the status Proposed."""
    return is_adr(text, tuple(s for s in STATUSES if s != "Proposed"))


def _points(parts: list[tuple[Column, int]]) -> Column:
    """Tenths that hold, ten at most, as a score."""
    total = F.lit(0)
    for condition, tenths in parts:
        total = total + F.when(condition, tenths).otherwise(0)
    return F.least(F.lit(10), total) / 10.0


def scores(text: Column) -> dict[str, Column]:
    """Each domain's score of a text, in the order in which ties are settled."""
    status = text.contains(":status:")
    known = _any([F.lower(text).contains(f":status: {s.lower()}") for s in STATUSES])
    adr = [(text.rlike(ADR_TITLE), 5), (status, 2), (status & known, 1)] + [(has_section(text, s), 1) for s in ADR_SECTIONS]
    category = text.contains(":category:")
    rfc = [(text.rlike(RFC_TITLE), 5), (category, 2), (category & _any([F.lower(text).contains(c) for c in CATEGORIES]), 2)]
    rfc += [(has_section(text, s), 1) for s in ("Abstract", "Security Considerations", "IANA Considerations")]
    return {"bridge": _points(adr), "rfc": _points(rfc), "generic": F.when(text == "", 0.1).otherwise(0.2)}


def choose(docs: DataFrame) -> DataFrame:
    """uri, domain, score among the standard domains."""
    return standard().choose(docs)


def _missing(docs: DataFrame, sections: tuple[str, ...], code: str, what: str, severity: str) -> DataFrame:
    absent = F.filter(F.array(*(F.when(~has_section(F.col("text"), s), s) for s in sections)), lambda x: x.isNotNull())
    last = F.greatest(F.lit(0), F.size(F.split("text", "\n")) - 1)
    each = docs.select("uri", last.alias("last"), F.explode(absent).alias("section"))
    return diagnostics(each, code, severity, F.format_string(f"Missing required {what} section: '%s'", "section"), F.col("last"), subject="section")


def _invalid(lns: DataFrame, name: str, known: tuple[str, ...], code: str, what: str, severity: str) -> DataFrame:
    value = F.regexp_extract(F.trim("line"), rf"^:{name}:\s*(\S+)", 1)
    own = lns.select("uri", "ln", "line", value.alias("value")).where((F.col("value") != "") & ~F.lower("value").isin([k.lower() for k in known]))
    at = F.instr("line", F.col("value")) - 1
    return diagnostics(own, code, severity, F.format_string(f"Invalid {what} '%s'. Expected one of: {', '.join(known)}", "value"), F.col("ln"), at, at + F.length("value"), "value")


def adr_rules(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """ADR001 for each section that a decision record lacks, ADR002 for a status out of the list."""
    return _missing(ws.docs.where(is_adr(F.col("text"))), ADR_SECTIONS, "ADR001", "ADR", severity).unionByName(_invalid(ws.lines, "status", STATUSES, "ADR002", "status value", severity))


def rfc_rules(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """RFC001 for a missing abstract, RFC002 for a category out of the list."""
    return _missing(ws.docs.where(is_rfc(F.col("text"))), RFC_SECTIONS, "RFC001", "RFC", severity).unionByName(_invalid(ws.lines, "category", CATEGORIES, "RFC002", "category", severity))


def described(section: Column) -> Column:
    """What a section of a decision record is for."""
    out = F.lit("Description here.")
    for name, text in ADR_PURPOSES.items():
        out = F.when(F.lower(section) == name.lower(), text).otherwise(out)
    return out


def old_missing(ws: g.Workspace) -> DataFrame:
    """uri, section, rank, ln: sections that a decision record lacks by the older rules: a header
    of any level counts, whose whole title is the section's name in any case. ln is the line
    behind the last one that is not blank."""
    each = old_lacking(ws).select("uri", F.explode_outer("lacking").alias("_l"), "ln")
    return each.where("_l is not null").select("uri", "_l.section", "_l.rank", "ln")


def old_lacking(ws: g.Workspace) -> DataFrame:
    """uri, lacking (rank, section in order; empty where nothing is or the document is no
    decision record), ln, as `old_missing` has them. Each document is judged by its own row and
    none is filtered out here, as a filter would move to where the rows were not dealt out yet."""
    lines = split_lines(F.col("text"))
    own = ws.docs.select("uri", is_adr_by_old_rule(F.col("text")).alias("_adr"), F.transform(lines, lambda x: F.trim(x)).alias("_lines"))
    titles = F.transform(F.filter("_lines", lambda x: x.startswith("=")), lambda x: F.lower(F.regexp_extract(x, r"^=+\s+(.+)$", 1)))
    last = F.array_max(F.transform("_lines", lambda x, i: F.when(x != "", i + 1)))
    asked = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("section")) for i, s in enumerate(ADR_SECTIONS)))
    met = own.select("uri", "_adr", titles.alias("_titles"), F.coalesce(last, F.lit(0)).alias("ln"))
    return met.select("uri", F.filter(asked, lambda s: F.col("_adr") & ~F.array_contains("_titles", F.lower(s["section"]))).alias("lacking"), "ln")


def old_adr_rules(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """ADR001 by whole titles, as the older validator has it."""
    return diagnostics(old_missing(ws), "ADR001", severity, F.format_string("Missing required ADR section: '%s'. %s", "section", described(F.col("section"))), F.col("ln"), subject="section")


def old_rules(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """What the older validator reports: ADR001 of decision records, and DOM001 for a status
    out of the list in any document."""
    return old_adr_rules(ws, severity).unionByName(_invalid(ws.lines, "status", STATUSES, "DOM001", "status value", severity))


@dataclass(frozen=True)
class Domain:
    """A kind of document: its score of a text, its rules over a workspace, its attributes."""

    name: str
    score: Callable[[Column], Column]
    rules: Callable[..., DataFrame] | None = None
    attributes: tuple[str, ...] = ()


class Domains:
    """Kinds of documents in the order in which ties are settled, and the one that is left."""

    def __init__(self, own: list[Domain], fallback: Domain):
        self.own, self.fallback = list(own), fallback

    def register(self, domain: Domain) -> Domains:
        self.own.append(domain)
        return self

    def get(self, name: str) -> Domain | None:
        """A registered domain, else the fallback by its name, else none."""
        return next((d for d in [*self.own, self.fallback] if d.name == name), None)

    def choose(self, docs: DataFrame) -> DataFrame:
        """uri, domain, score: the highest score above 0.2, the first domain among equals, else
        the fallback with its own."""
        text = F.coalesce(F.col("text"), F.lit(""))
        ranked = [F.struct(F.when(c > 0.2, c).otherwise(0.0).alias("score"), F.lit(-i).alias("order"), F.lit(d.name).alias("name")) for i, d in enumerate(self.own) for c in [d.score(text)]]
        none = F.struct(F.lit(0.0).alias("score"), F.lit(1).alias("order"), F.lit("").alias("name"))
        out = docs.select("uri", F.greatest(none, none, *ranked).alias("best"), self.fallback.score(text).alias("plain"))
        hit = F.col("best.score") > 0
        return out.select("uri", F.when(hit, F.col("best.name")).otherwise(self.fallback.name).alias("domain"), F.when(hit, F.col("best.score")).otherwise(F.col("plain")).alias("score"))

    def validate(self, ws: g.Workspace, least: float = 0.5) -> DataFrame:
        """The diagnostics of each document's domain where its score is above `least`."""
        chosen = self.choose(ws.docs).where(F.col("score") > least)
        found = [d.rules(ws).join(chosen.where(F.col("domain") == d.name).select("uri"), "uri", "left_semi") for d in [*self.own, self.fallback] if d.rules]
        return union_all(found) if found else ws.docs.sparkSession.createDataFrame([], SCHEMA)


def standard() -> Domains:
    """Decision records, requests for comments, and what is neither."""
    own = lambda name: lambda text: scores(text)[name]
    return Domains([Domain("bridge", own("bridge"), adr_rules), Domain("rfc", own("rfc"), rfc_rules)], Domain("generic", own("generic")))


def routed(ws: g.Workspace) -> DataFrame:
    """Diagnostics of the chosen domain where its score is above one half; documents that get
    none from it fall back to the older rules."""
    by = standard().validate(ws)
    rest = old_rules(ws).join(by.select("uri").distinct(), "uri", "left_anti")
    return by.unionByName(rest)


def token_type(element: Column, value: Column, domain: Column) -> Column:
    """The type of a semantic token, by element and domain; null for other elements."""
    adr_value = F.when(F.lower(value).isin([s.lower() for s in STATUSES]), "enumMember").otherwise("string")
    rfc_value = F.when(F.lower(value).isin(list(CATEGORIES)), "keyword").otherwise("string")
    name = F.when((domain == "bridge") & (value == "status"), "enum").when((domain == "rfc") & (value == "category"), "keyword").when((domain == "rfc") & value.isin("obsoletes", "updates"), "variable").otherwise("property")
    return (
        F.when(element == "header", "class")
        .when(element == "attribute_name", name)
        .when(element == "attribute_value", F.when(domain == "bridge", adr_value).when(domain == "rfc", rfc_value).otherwise("string"))
        .when(element.isin("xref", "anchor"), "variable")
    )
