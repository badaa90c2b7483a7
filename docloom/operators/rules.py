"""Rules that yield diagnostics, their registry, their union and the compliance score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators import graph as g
from docloom.operators.lines import union_all
from docloom.settings import Settings, severity

COLUMNS = ("uri", "code", "severity", "message", "ln", "col", "end_col", "subject")
SCHEMA = "uri string, code string, severity string, message string, ln int, col int, end_col int, subject string"


def diagnostics(df: DataFrame, code: Column | str, severity: Column | str, message: Column, ln: Column | int = 0, col: Column | int = 0, end_col: Column | int | None = None, subject: Column | str | None = None) -> DataFrame:
    """COLUMNS of each row; the subject is what a diagnostic is about (an id, a section), for
    those who mend it."""
    lit = lambda x: F.lit(x) if x is None or isinstance(x, (str, int)) else x
    about = F.col(subject) if isinstance(subject, str) else lit(subject)
    return df.select("uri", lit(code).alias("code"), lit(severity).alias("severity"), message.alias("message"), lit(ln).cast("int").alias("ln"), lit(col).cast("int").alias("col"), lit(col if end_col is None else end_col).cast("int").alias("end_col"), about.cast("string").alias("subject"))


def superseded_status(ws: g.Workspace, severity: str = "error") -> DataFrame:
    """BRIDGE001 where a superseded document is neither deprecated nor superseded (a warning
    where it has no status), BRIDGE002 where its id is not defined."""
    claims = ws.attribute("supersedes").select("uri", F.explode(fx.id_list(F.col("supersedes"))).alias("id"))
    to = ws.definitions.select("id", F.col("uri").alias("def_uri"))
    status = ws.attribute("status").select(F.col("uri").alias("def_uri"), "status")
    met = claims.join(to, "id", "left").join(status, "def_uri", "left")
    missing = F.col("def_uri").isNull()
    bad = met.where(missing | F.col("status").isNull() | ~F.lower("status").isin("deprecated", "superseded"))
    message = (
        F.when(missing, F.format_string("Document claims to supersede '%s' but that ID is not defined in the workspace", "id"))
        .when(F.col("status").isNull(), F.format_string("Superseded document '%s' has no :status: attribute; it must be Deprecated or Superseded", "id"))
        .otherwise(F.format_string("Superseded document '%s' has status '%s' but must be Deprecated or Superseded", "id", "status"))
    )
    return diagnostics(bad, F.when(missing, "BRIDGE002").otherwise("BRIDGE001"), F.when(missing | F.col("status").isNull(), "warning").otherwise(severity), message, subject="id")


def orphaned(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """BRIDGE003: documents that no entry point leads to."""
    name = F.substring_index("uri", "/", -1)
    return diagnostics(g.orphans(ws), "BRIDGE003", severity, F.format_string("Orphaned document: '%s' is not reachable from any entry point (index.adoc, README.adoc)", name))


def broken_links(ws: g.Workspace, severity: str = "warning") -> DataFrame:
    """WS001: references to ids that nothing defines, each once."""
    return link_diagnostics(g.broken_links(ws), severity)


def link_diagnostics(bad: DataFrame, severity: str = "warning") -> DataFrame:
    """WS001 of broken links (uri, id, ln, col)."""
    return diagnostics(bad, "WS001", severity, F.format_string("Broken reference: '%s' is not defined", "id"), F.col("ln"), F.col("col"), F.col("col") + F.length("id"), "id")


def passive_voice(ws: g.Workspace, severity: str = "info") -> DataFrame:
    hits = ws.lines.select("uri", "ln", F.explode(fx.passive_hits(F.col("line"))).alias("verb"))
    return diagnostics(hits, "QUALITY001", severity, F.format_string("Passive voice detected: '%s'. Consider using active voice.", "verb"), F.col("ln"), subject="verb")


def weasel_words(ws: g.Workspace, severity: str = "info", words: tuple[str, ...] = fx.WEASEL_WORDS) -> DataFrame:
    hits = ws.lines.select("uri", "ln", F.explode(fx.weasel_hits(F.col("line"), words)).alias("word"))
    return diagnostics(hits, "QUALITY002", severity, F.format_string("Weasel word detected: '%s'. Consider removing for stronger writing.", "word"), F.col("ln"), subject="word")


@dataclass
class Registry:
    """Rules by name: each takes a workspace and a severity and returns diagnostics. A
    severity of None leaves a rule out of the plan."""

    rules: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    severities: dict[str, str | None] = field(default_factory=dict)
    texts: set[str] = field(default_factory=set)

    def add(self, name: str, rule: Callable[..., DataFrame], severity: str | None = "warning", *, texts: bool = False) -> Registry:
        """`texts` tells of a rule that looks at lines or texts alone, not at what an index holds."""
        self.rules[name], self.severities[name] = rule, severity
        self.texts = self.texts - {name} | ({name} if texts else set())
        return self

    def run(self, ws: g.Workspace) -> DataFrame:
        """The diagnostics of all rules that are on, repeated ones kept. The texts are scanned
        once for what several rules need."""
        if len([n for n, s in self.severities.items() if s and n not in self.texts]) > 1:
            ws = ws.indexed()
        on = [rule(ws, severity=self.severities[name]) for name, rule in self.rules.items() if self.severities[name]]
        return union_all(on) if on else ws.docs.sparkSession.createDataFrame([], SCHEMA)

    def result(self, ws: g.Workspace) -> DataFrame:
        return score(self.run(ws), ws.docs, len(self.rules))


def bridge(settings: Settings = Settings()) -> Registry:
    """The rules of the compliance audit, by their severities; those that are left out count as
    rules of the score none the less."""
    own = settings.bridge
    return Registry().add("superseded_status", superseded_status, severity(own.superseded_status)).add("orphaned", orphaned, severity(own.orphans))


def quality(settings: Settings = Settings()) -> Registry:
    """The rules of writing, with a settings' own words; none where it turns them off."""
    on = "info" if settings.plugins.writing_quality else None
    words = settings.plugins.custom_weasel_words
    return Registry().add("passive_voice", passive_voice, on, texts=True).add("weasel_words", lambda ws, severity="info": weasel_words(ws, severity, words), on if words else None, texts=True)


def score(found: DataFrame, docs: DataFrame, n_rules: int) -> DataFrame:
    """One row: documents, errors, warnings, infos, score between 0 and 100, status.

    checks are documents times rules; an error weighs 10, a warning 3, an info 1."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    total = found.agg(n("error"), n("warning"), n("info")).join(docs.agg(F.count("*").alias("documents")))  # one row each
    checks = (F.col("documents") * n_rules).cast("double")
    weight = F.col("errors") * 10 + F.col("warnings") * 3 + F.col("infos")
    value = F.when(checks <= 0, 100).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (checks - weight) / checks))).cast("int"))
    status = F.when(F.col("errors") > 0, "failing").when(F.col("warnings") > 0, "passing_with_warnings").otherwise("passing")
    return total.select("documents", "errors", "warnings", "infos", value.alias("score"), status.alias("status"))
