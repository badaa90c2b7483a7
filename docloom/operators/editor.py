"""What an editor asks of a document: tokens, completions, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import blocks, diagrams, domains, fixes, outline, rules
from docloom.operators import graph as g
from docloom.operators import lines as ln
from docloom.operators.spans import covering
from docloom.operators.symbols import SymbolIndex
from docloom.settings import Settings

#: Token types in the order of the legend.
LEGEND = ("class", "enum", "enumMember", "keyword", "property", "string", "variable")
ATTRIBUTES = {"bridge": ("status", "author", "date", "version", "decision-drivers", "considered-options", "outcome", "supersedes"), "rfc": ("category", "author", "date", "area", "workgroup", "obsoletes", "updates"), "generic": ("author", "date", "version", "toc", "icons")}
VALUES = {"status": domains.STATUSES, "category": domains.CATEGORIES}
BLOCK_KINDS = ("source", "example", "sidebar", "quote", "verse", "NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION", "mermaid", "plantuml")


def legend_index(kind: Column) -> Column:
    """A token type's place in the legend, that of variable for unknown ones."""
    at = F.array_position(F.array(*map(F.lit, LEGEND)), kind)
    return F.when(at > 0, at - 1).otherwise(len(LEGEND) - 1).cast("int")


def tokens(lns: DataFrame, chosen: DataFrame) -> DataFrame:
    """uri, ln, col, len, element, type: a line is a header, else an attribute's name and
    value, else begins with an anchor. `chosen` has each document's domain."""
    met = lns.join(chosen.select("uri", "domain"), "uri", "left").withColumn("domain", F.coalesce("domain", F.lit("generic")))
    head, attr, anchor = F.col("line").rlike(ln.HEADER), F.col("line").rlike(ln.ATTRIBUTE), F.col("line").rlike(r"(?U)^\[\[[\w-]+\]\]")
    name, value = F.regexp_extract("line", ln.ATTRIBUTE, 1), F.trim(F.regexp_extract("line", ln.ATTRIBUTE, 2))
    part = lambda element, col, text: F.struct(F.lit(element).alias("element"), col.cast("int").alias("col"), text.alias("value"))
    none = F.array().cast("array<struct<element:string,col:int,value:string>>")
    found = (
        F.when(head, F.array(part("header", F.lit(0), F.col("line"))))
        .when(attr & (value != ""), F.array(part("attribute_name", F.lit(1), name), part("attribute_value", F.length("line") - F.length(F.regexp_replace("line", r"^:[^:]+:\s*", "")), value)))
        .when(attr, F.array(part("attribute_name", F.lit(1), name)))
        .when(anchor, F.array(part("anchor", F.lit(2), F.regexp_extract("line", ln.ANCHOR, 1))))
        .otherwise(none)
    )
    each = met.select("uri", "ln", "domain", F.explode(found).alias("t")).select("uri", "ln", "domain", "t.*")
    kind = domains.token_type(F.col("element"), F.col("value"), F.col("domain"))
    return each.select("uri", "ln", "col", F.length("value").alias("len"), "element", kind.alias("type"))


def completion_context(before: Column) -> Column:
    """What a line's beginning asks for: struct of kind (xref, value, attribute, block or
    null), name (of the attribute) and prefix; the first of these that fits."""
    bare = F.ltrim(before)
    patterns = (("xref", before, r"(?U)()<<([\w-]*)$"), ("value", bare, r"(?U)^:([\w-]+):\s*(\S*)$"), ("attribute", bare, r"(?U)^():([\w-]*)$"), ("block", bare, r"(?U)^()\[([\w-]*)$"))
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("kind"), none.alias("name"), none.alias("prefix"))
    for kind, text, p in reversed(patterns):
        found = F.struct(F.lit(kind).alias("kind"), F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("name"), F.regexp_extract(text, p, 2).alias("prefix"))
        out = F.when(text.rlike(p), found).otherwise(out)
    return out


def completions(prefixes: DataFrame) -> DataFrame:
    """uri, kind, label of what may follow a line's beginning (uri, prefix, domain): values of a
    status or category, else attribute names, else block kinds, else nothing."""
    bare = F.trim("prefix")
    lists = F.array().cast("array<string>")
    kind = F.lit(None).cast("string")
    kind = F.when(bare.startswith("["), "block").otherwise(kind)
    kind = F.when(bare.startswith(":") & ~bare.contains(": "), "attribute").otherwise(kind)
    for name in VALUES:
        kind = F.when(bare.startswith(f":{name}:"), name).otherwise(kind)
    own = prefixes.withColumn("kind", kind)
    names = lists
    for domain, attrs in ATTRIBUTES.items():
        names = F.when(F.col("domain") == domain, F.array(*map(F.lit, attrs))).otherwise(names)
    lists = F.when(F.col("kind") == "attribute", names).when(F.col("kind") == "block", F.array(*map(F.lit, BLOCK_KINDS))).otherwise(lists)
    for name, values in VALUES.items():
        lists = F.when(F.col("kind") == name, F.array(*map(F.lit, values))).otherwise(lists)
    typed = F.regexp_replace(bare, r"^(:[a-z]+:\s*|[:\[])", "")
    return own.select("uri", "kind", F.explode(lists).alias("label"), typed.alias("typed")).where(F.lower("label").startswith(F.lower("typed"))).drop("typed")


def xref_completions(anchors: DataFrame, prefix: str) -> DataFrame:
    return anchors.where(F.col("id").startswith(prefix))


def word_at(lns: DataFrame, cursors: DataFrame) -> DataFrame:
    """uri, ln, col, word, start, end for cursors (uri, ln, col) on an ASCII word."""
    met = cursors.join(lns.select("uri", "ln", "line"), ["uri", "ln"])
    before = F.regexp_extract(F.expr("substring(line, 1, col)"), r"([A-Za-z0-9_]*)$", 1)
    after = F.regexp_extract(F.expr("substring(line, col + 1)"), r"^([A-Za-z0-9_]*)", 1)
    return met.select("uri", "ln", "col", F.concat(before, after).alias("word"), (F.col("col") - F.length(before)).alias("start"), (F.col("col") + F.length(after)).alias("end")).where("word <> ''")


def selections(lns: DataFrame, folds: DataFrame, cursors: DataFrame) -> DataFrame:
    """uri, ln, start_ln, end_ln, step: from a cursor line outwards: its line, paragraph, the
    folds around it by size, the document; ranges equal to the one before are left out."""
    last = lns.groupBy("uri").agg(F.max("ln").alias("end_ln"))
    para = ln.paragraphs(lns).select("uri", F.col("first_ln").alias("start_ln"), F.col("last_ln").alias("end_ln"))
    ranges = para.unionByName(folds.select("uri", "start_ln", "end_ln")).unionByName(last.select("uri", F.lit(0).alias("start_ln"), "end_ln"))
    ranges = ranges.join(cursors.select("uri").distinct(), "uri", "left_semi")
    met = covering(cursors.select("uri", "ln").distinct(), ranges, ["uri"], "ln", "start_ln", "end_ln").unionByName(cursors.select("uri", "ln", F.col("ln").alias("start_ln"), F.col("ln").alias("end_ln")))
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("uri", "ln").orderBy(F.col("end_ln") - F.col("start_ln"), "start_ln")) - 1
    return met.distinct().withColumn("step", step)


#: What can be renamed at a cursor, in the order in which it is looked for: a name stands in
#: the first group, behind so many signs. Definitions stand at a line's beginning only.
TARGETS = (("section_id", r"(?U)\[\[([\w-]+)\]\]", 2), ("reference", r"(?U)<<([\w-]+)(?:,[^>]*)?\s*>>", 2), ("attribute", r"(?U)^\s*:([\w-]+):", None), ("attribute_usage", r"(?U)\{([\w-]+)\}", 1))


def _at_cursor(lns: DataFrame, cursors: DataFrame) -> DataFrame:
    return cursors.select("uri", "ln", "col").join(lns.select("uri", "ln", "line"), ["uri", "ln"])


def _spans(pattern: str, shift: int | None) -> Column:
    """Array of (name, start, end, from, to) of a pattern's matches in `line`: the name's place
    and the whole match's."""
    whole = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
    places = F.expr(f"aggregate(regexp_extract_all(line, {ln._quoted(pattern)}, 0), named_struct('from', 1, 'cols', cast(array() as array<int>)), (a, m) -> named_struct('from', locate(m, line, a.from) + length(m), 'cols', array_append(a.cols, locate(m, line, a.from) - 1)), a -> a.cols)")
    name = F.regexp_extract_all("line", F.lit(pattern), F.lit(1))

    def span(x: Column) -> Column:
        start = x["at"] + (F.lit(shift) if shift is not None else F.instr(x["whole"], ":"))
        return F.struct(x["name"].alias("name"), start.cast("int").alias("start"), (start + F.length(x["name"])).cast("int").alias("end"), x["at"].cast("int").alias("from"), (x["at"] + F.length(x["whole"])).cast("int").alias("to"))

    return F.transform(F.arrays_zip(name.alias("name"), whole.alias("whole"), places.alias("at")), span)


def rename_targets(lns: DataFrame, cursors: DataFrame) -> DataFrame:
    """uri, ln, col, kind, name, start, end of what a cursor (uri, ln, col) that stands on a
    name could rename: an id, a reference, an attribute's definition or use."""
    found = F.lit(None).cast("struct<kind:string,name:string,start:int,end:int>")
    for kind, pattern, shift in reversed(TARGETS):
        hit = F.get(F.filter(_spans(pattern, shift), lambda x: (x["start"] <= F.col("col")) & (F.col("col") < x["end"])), F.lit(0))
        found = F.when(hit.isNotNull(), F.struct(F.lit(kind).alias("kind"), hit["name"].alias("name"), hit["start"].alias("start"), hit["end"].alias("end"))).otherwise(found)
    return _at_cursor(lns, cursors).select("uri", "ln", "col", found.alias("_f")).where("_f is not null").select("uri", "ln", "col", "_f.*")


def inline_at(lns: DataFrame, cursors: DataFrame) -> DataFrame:
    """uri, ln, col, start, end of the inline element at a cursor: a reference's id if the cursor
    stands on it, else the whole reference; else the whole use of an attribute."""
    on = lambda spans, a, b: F.get(F.filter(spans, lambda x: (x[a] <= F.col("col")) & (F.col("col") < x[b])), F.lit(0))
    refs, uses = _spans(*TARGETS[1][1:]), _spans(*TARGETS[3][1:])
    place = lambda x, a, b: F.when(x.isNotNull(), F.struct(x[a].alias("start"), x[b].alias("end")))
    found = F.coalesce(place(on(refs, "start", "end"), "start", "end"), place(on(refs, "from", "to"), "from", "to"), place(on(uses, "from", "to"), "from", "to"))
    return _at_cursor(lns, cursors).select("uri", "ln", "col", found.alias("_f")).where("_f is not null").select("uri", "ln", "col", "_f.*")


def placed(found: DataFrame, ws: g.Workspace) -> DataFrame:
    """uri, code, severity, message, start_ln, start_col, end_ln, end_col of diagnostics (uri,
    code, severity, message, and line and column from 1, or start and end as character
    offsets, or block as the index of a block; what is not known is null). Line and column
    count before offsets, and these before the block; without any the place is the start.

    A block is a line that begins with `=`, or one that is not blank behind a blank line."""
    from pyspark.sql import Window

    offset = found.where("(line is null or col is null) and start is not null").join(ws.docs.select("uri", "text"), "uri")
    from docloom.functions import text as fx

    at = lambda c: [fx.offset_line(F.col("text"), F.least(F.col(c), F.length("text"))), fx.offset_column(F.col("text"), F.least(F.col(c), F.length("text")))]
    head = ["uri", "code", "severity", "message"]
    place = lambda a, b, c, d: [x.cast("int").alias(n) for x, n in zip((a, b, c, d), ("start_ln", "start_col", "end_ln", "end_col"), strict=True)]
    by_line = found.where("line is not null and col is not null").select(*head, *place(F.greatest(F.lit(0), F.col("line") - 1), F.greatest(F.lit(0), F.col("col") - 1), F.greatest(F.lit(0), F.col("line") - 1), F.col("col")))
    by_offset = offset.select(*head, *place(*at("start"), *at("end")))
    rest = found.where("(line is null or col is null) and start is null")
    own = ws.lines.withColumn("_before", F.lag("line").over(Window.partitionBy("uri").orderBy("ln")))
    bare = F.trim("line")
    starts = own.where((bare != "") & (bare.startswith("=") | ((F.col("ln") > 0) & (F.trim("_before") == ""))))
    numbered = starts.select("uri", (F.row_number().over(Window.partitionBy("uri").orderBy("ln")) - 1).alias("block"), F.col("ln").alias("_ln"), F.length("line").alias("_end"))
    zero = F.lit(0)
    by_block = rest.join(numbered, ["uri", "block"], "left").select(*head, *place(F.coalesce("_ln", zero), zero, F.coalesce("_ln", zero), F.coalesce("_end", zero)))
    return ln.union_all([by_line, by_offset, by_block])


def diagnostics(ws: g.Workspace, settings: Settings = Settings()) -> DataFrame:
    """All that an editor shows of a workspace's documents: structure, writing, diagrams. What
    settings turn off is not planned."""
    structure = outline.jump_diagnostics(outline.jumps_within(blocks.documents(ws.docs)))
    found = [structure, rules.quality(settings).run(ws)]
    if settings.plugins.diagrams:
        found.append(diagrams.lint(ws))
    return ln.union_all(found)


class Session:
    """The open documents of an editor and what it asks of them: each request is a query over
    the documents that it names, planned anew, so nothing is kept that could grow stale. An
    index of symbols may serve searches instead; these then know the documents it was built of."""

    def __init__(self, docs: DataFrame, settings: Settings = Settings(), index: SymbolIndex | None = None):
        self.docs, self.settings, self.index = docs, settings, index

    def with_settings(self, settings: Settings) -> Session:
        """The session under other settings; diagnostics() then judges all documents again."""
        return Session(self.docs, settings, self.index)

    def workspace(self, *uris: str) -> g.Workspace:
        return g.Workspace(self.docs.where(F.col("uri").isin(*uris)) if uris else self.docs)

    def diagnostics(self, *uris: str) -> DataFrame:
        return diagnostics(self.workspace(*uris), self.settings)

    def folding(self, uri: str) -> DataFrame:
        return outline.folds(self.workspace(uri).lines)

    def symbols(self, uri: str) -> DataFrame:
        return self.workspace(uri).symbols

    def find_symbols(self, query: str) -> DataFrame:
        return self.index.search(query) if self.index else g.search_symbols(self.workspace().symbols, query)

    def selection(self, cursors: DataFrame) -> DataFrame:
        lns = g.Workspace(self.docs.join(cursors.select("uri").distinct(), "uri", "left_semi")).lines
        return selections(lns, outline.folds(lns), cursors)

    def can_rename(self, cursors: DataFrame) -> DataFrame:
        return rename_targets(self.workspace().lines, cursors)

    def rename(self, old: str, new: str) -> DataFrame:
        return fixes.rename_edits(self.workspace(), old, new)

    def complete(self, uri: str, before: str) -> DataFrame:
        """Labels that may follow a line's beginning: ids for a reference, else by domain."""
        ws = self.workspace(uri)
        context = ws.docs.select(completion_context(F.lit(before)).alias("c")).select("c.*")
        ids = self.workspace().all_definitions.select(F.lit(uri).alias("uri"), F.lit("xref").alias("kind"), F.col("id").alias("label")).distinct()
        wanted = context.where("kind = 'xref'").select(F.col("prefix").alias("_p"))
        by_id = ids.join(F.broadcast(wanted), F.col("label").startswith(F.col("_p"))).drop("_p")  # one row at most
        asked = domains.choose(ws.docs).select("uri", F.lit(before).alias("prefix"), "domain")
        return by_id.unionByName(completions(asked).select("uri", "kind", "label"))

    def actions(self, uri: str) -> DataFrame:
        """Edits offered for one document: missing sections and values out of a list."""
        from docloom.operators import views

        ws = self.workspace(uri)
        statuses = views.status_actions(domains.old_rules(ws).withColumn("code", F.when(F.col("code") == "DOM001", "ADR002").otherwise("")))
        own = fixes.section_inserts(ws)
        return own.unionByName(statuses.select("uri", "ln", "col", "end_col", "new_text", F.format_string("Change status to '%s'", "new_text").alias("title"), (F.col("new_text") == "Draft").alias("preferred")))

    def tokens(self, uri: str) -> DataFrame:
        ws = self.workspace(uri)
        return tokens(ws.lines, domains.choose(ws.docs))
