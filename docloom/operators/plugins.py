"""User-written rules: a Python function over one document's blocks, run on the executors,
with its results coerced to diagnostics. Kinds of documents are registered in domains.Domains,
tabular sources in sources.connector."""

from __future__ import annotations

import re
import signal
import sys
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame

from docloom.operators import blocks
from docloom.operators import graph as g
from docloom.operators.perdoc import per_document

RESULTS = "uri string, rule string, code string, severity string, message string, help string, suggestion string, file string, context string"
SEVERITIES = ("hint", "info", "warning", "error", "fatal")
#: What gives passive voice away to a script.
PASSIVE = ("was ", "were ", "is being", "are being", "has been", "have been", "had been", "will be ", "being ", "been ")
_PASSIVE = re.compile("|".join(map(re.escape, PASSIVE)))

Rule = Callable[[dict], Iterable[dict | str]]


class ComplianceRule(Protocol):
    """A rule over a workspace, as rules.Registry takes it."""

    def __call__(self, ws: g.Workspace, severity: str) -> DataFrame: ...


class RuleError(ValueError):
    pass


def contains_ci(text: str, part: str) -> bool:
    return part.lower() in text.lower()


def has_passive_pattern(text: str) -> bool:
    return _PASSIVE.search(text.lower()) is not None  # one step of a rule, not one for each pattern


def diagnostic(message: str, severity: str = "warning", code: str | None = None, **more: str) -> dict:
    return {"message": message, "severity": severity, "code": code, **more}


def coerced(rule: str, item: dict | str) -> tuple:
    """A result's fields: a message is required, the severity is a warning unless known."""
    item = {"message": item} if isinstance(item, str) else item
    if not item.get("message"):
        raise RuleError(f"{rule}: a result has no message")
    severity = str(item.get("severity") or "warning").lower()
    text = lambda k: None if item.get(k) is None else str(item[k])
    return rule, text("code"), severity if severity in SEVERITIES else "warning", text("message"), text("help"), text("suggestion"), text("file"), text("context")


class Limits:
    """Stops a rule that takes more than so many steps (lines run, its calls counted too) or
    seconds on one document. Steps are counted by tracing, seconds by an alarm, which also
    ends what runs within one call; either raises RuleError where the rule stands.

    To begin and end tracing makes Python instrument all code that is running, so it is done once
    for many documents, `within()`; between rules nothing is counted."""

    def __init__(self, steps: int, seconds: float):
        self.steps, self.seconds, self.left, self.name = steps, seconds, None, ""

    def _trace(self, frame, event, arg):
        left = self.left
        if left is None:
            return None
        if event == "line" or event == "call":
            if left <= 0:
                raise RuleError(f"{self.name}: more than {self.steps} steps")
            self.left = left - 1
        return self._trace

    def _alarm(self, *_):
        raise RuleError(f"{self.name}: more than {self.seconds:g} seconds")

    @contextmanager
    def within(self) -> Iterator[None]:
        timed = threading.current_thread() is threading.main_thread()
        before = sys.gettrace()
        handler = signal.signal(signal.SIGALRM, self._alarm) if timed else None
        self.timed = timed
        try:
            sys.settrace(self._trace)
            yield
        finally:
            sys.settrace(before)
            if timed:
                signal.signal(signal.SIGALRM, handler)

    def results(self, name: str, rule: Rule, doc: dict) -> list[dict | str]:
        """A rule's results, within `within()`."""
        self.name = name
        if sys.gettrace() != self._trace:  # it ends where it raises, and a rule may end it
            sys.settrace(self._trace)
        try:
            if self.timed:
                signal.setitimer(signal.ITIMER_REAL, self.seconds)
            self.left = self.steps
            return list(rule(doc))
        finally:
            self.left = None
            if self.timed:
                signal.setitimer(signal.ITIMER_REAL, 0)


def run(docs: DataFrame, rules: dict[str, Rule], steps: int = 100_000, seconds: float = 10.0) -> DataFrame:
    """The diagnostics of each rule on each document. A rule gets title, attributes and blocks;
    its results count once it is through. One that fails, or takes more than `steps` or
    `seconds` on a document, is a diagnostic of its own and the other rules go on."""

    names = ("idx", "kind", "level", "text", "style_id", "language", "list_type", "ln", "rows")
    limits = Limits(steps, seconds)

    def parse(uri: str, own: blocks.Reader) -> Iterator[tuple]:
        doc = {"uri": uri, "title": own.title, "attributes": own.attributes, "blocks": [dict(zip(names, b, strict=True)) for b in own.out]}
        for name, rule in rules.items():
            try:
                found = [coerced(name, item) for item in limits.results(name, rule, doc)]
            except Exception as e:  # a user's rule may do anything
                found = [coerced(name, diagnostic(f"Rule failed: {type(e).__name__}: {e}", "error", "PLUGIN"))]
            yield from ((uri, *f) for f in found)

    return per_document(docs, parse, RESULTS, read=blocks.read, around=limits.within)


def no_passive_voice(doc: dict) -> Iterator[dict]:
    """The sample rule: paragraphs with a passive pattern."""
    for block in doc["blocks"]:
        if block["kind"] == "paragraph" and has_passive_pattern(block["text"]):
            yield diagnostic("Passive voice detected", code="STYLE001", help="Consider using active voice for clearer writing", context=block["text"])
