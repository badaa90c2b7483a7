"""The workspace graph as relations: definitions, references, reachability, statistics.

Definitions are joined by id and documents by URI, both shuffled: either grows with the
workspace. Reachability follows links within ranges of URIs and exchanges what leaves them.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as fx
from docloom.operators import lines as ln
from docloom.operators.perdoc import in_order
from docloom.store import stored

#: The ends of URIs at which reading starts.
ENTRY_POINTS = ("index.adoc", "readme.adoc", "index.asciidoc", "readme.asciidoc", "readme.md", "index.md")

#: Links that one task may hold (two URIs each) when it follows them all.
SMALL = 200_000
#: Rounds after which the depths known so far are brought together.
MERGE = 8


@dataclass
class Workspace:
    """The relations of a set of documents (uri, load_ord, text). Each is found by a scan of
    the texts; `indexed()` scans them once for all and keeps what it found."""

    docs: DataFrame
    facts: DataFrame | None = None

    def indexed(self) -> Workspace:
        return self if self.facts is not None else Workspace(self.docs, stored(ln.facts(self.lines)))

    def _kind(self, kind: str) -> DataFrame:
        return self.facts.where(F.col("kind") == kind)

    @cached_property
    def lines(self) -> DataFrame:
        return ln.lines(self.docs)

    @cached_property
    def all_definitions(self) -> DataFrame:
        return ln.anchors(self.lines) if self.facts is None else self._kind("anchor").select(F.col("name").alias("id"), "uri", "load_ord", "ln", "col")

    @cached_property
    def definitions(self) -> DataFrame:
        """id, uri, ln, col: of several definitions of an id the last loaded counts."""
        last = F.max_by(F.struct("uri", "ln", "col"), F.struct("load_ord", "ln", "col")).alias("at")
        return self.all_definitions.groupBy("id").agg(last).select("id", "at.*")

    @cached_property
    def references(self) -> DataFrame:
        return ln.references(self.lines).drop("load_ord") if self.facts is None else self._kind("reference").select(F.col("name").alias("id"), "uri", "ln", "col")

    @cached_property
    def file_references(self) -> DataFrame:
        return ln.file_references(self.lines).drop("load_ord") if self.facts is None else self._kind("file").select(F.col("name").alias("path"), "uri", "ln", "col")

    @cached_property
    def headers(self) -> DataFrame:
        return ln.headers(self.lines) if self.facts is None else self._kind("header").select("uri", "load_ord", "ln", "name", "level")

    @cached_property
    def attributes(self) -> DataFrame:
        return ln.attributes(self.lines) if self.facts is None else ln.last_attributes(self._kind("attribute"))

    @cached_property
    def symbols(self) -> DataFrame:
        return ln.symbols_of(self.all_definitions, self.headers)

    def attribute(self, name: str) -> DataFrame:
        return self.attributes.where(F.col("name") == name).select("uri", F.col("value").alias(name))


def is_entry_point(uri: Column) -> Column:
    out = F.lit(False)
    for end in ENTRY_POINTS:
        out = out | F.lower(uri).endswith(end)
    return out


def resolved(ws: Workspace) -> DataFrame:
    """Each reference with the place of its definition, null where there is none."""
    to = ws.definitions.select("id", F.col("uri").alias("def_uri"), F.col("ln").alias("def_ln"))
    return ws.references.join(to, "id", "left")


def broken_links(ws: Workspace) -> DataFrame:
    """References whose id no document defines: uri, id, ln, col."""
    return ws.references.join(ws.definitions.select("id"), "id", "left_anti").select("uri", "id", "ln", "col")


def reverse_index(ws: Workspace) -> DataFrame:
    """id, n, places (uri, ln, col in order)."""
    return ws.references.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("uri", "ln", "col"))).alias("places"))


#: Most places of a page of the reverse index.
PAGE = 10_000


def reverse_pages(references: DataFrame, page: int | None = None) -> DataFrame:
    """id, page, n, first, last, places (uri, ln, col in order) of references (id, uri, ln, col):
    the reverse index in pages of at most `page` places. An id of more is dealt by a hash of the
    place into as many pages as it takes, so no task or list holds all of a hot id."""
    most = page or PAGE
    many = references.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most // 2).select("id", F.ceil(F.col("n") * 2 / most).alias("deals"))
    dealt = references.join(many, "id", "left").withColumn("deals", F.coalesce("deals", F.lit(1)).cast("long"))
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("uri", "ln", "col"), F.col("deals")))
    nth = F.row_number().over(Window.partitionBy("id", "deal").orderBy("uri", "ln", "col")) - 1
    paged = dealt.withColumn("page", F.col("deal") + F.col("deals") * F.floor(nth / most))  # over `most` of one deal go on
    place = F.struct("uri", "ln", "col")
    return paged.groupBy("id", "page").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"), F.array_sort(F.collect_list(place)).alias("places"))


def places(pages: DataFrame, name: str) -> DataFrame:
    """uri, ln, col of an id's references in order, merged from its pages."""
    own = pages.where(F.col("id") == name).select(F.explode("places").alias("p")).select("p.*")
    return own.orderBy("uri", "ln", "col")


def resolved_files(ws: Workspace) -> DataFrame:
    """uri, to_uri: file references that lead to a document of the workspace."""
    to = ws.file_references.select("uri", fx.normal_path(F.col("uri"), F.col("path")).alias("to_uri")).distinct()
    return to.join(ws.docs.select(F.col("uri").alias("to_uri")), "to_uri", "left_semi").select("uri", "to_uri")


def edges(ws: Workspace) -> DataFrame:
    """uri, to_uri: a document leads to those that it names by id or by file."""
    by_id = resolved(ws).where("def_uri is not null").select("uri", F.col("def_uri").alias("to_uri"))
    return by_id.unionByName(resolved_files(ws)).where("uri <> to_uri").distinct()


def _reachable_at_once(starts: DataFrame, links: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        to: dict[str, list[str]] = {}
        depth: dict[str, int] = {}
        for batch in batches:
            for uri, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if target is None:
                    depth[uri] = 0
                else:
                    to.setdefault(uri, []).append(target)
        last = list(depth)
        while last:
            then = []
            for uri in last:
                for target in to.get(uri, ()):
                    if target not in depth:
                        depth[target] = depth[uri] + 1
                        then.append(target)
            last = then
        yield pa.RecordBatch.from_arrays([pa.array(list(depth), pa.string()), pa.array(list(depth.values()), pa.int32())], ["uri", "depth"])

    rows = links.unionByName(starts.select("uri", F.lit(None).cast("string").alias("to_uri")).distinct())
    return rows.repartition(1).mapInArrow(run, "uri string, depth int")


def _reach_within(bounds: list[str]):
    """Follows the links of a part (rows: kind, uri, to_uri, depth) from what has come in as far as
    they lead to smaller depths. Rows of a part are its links (0), the depths known so far (1) and
    those that have come in (2), in this order. Yields each document reached anew and, for links
    that leave the part, where they lead."""

    def step(key, rows):
        to: dict[str, list[str]] = {}
        depth: dict[str, int] = {}
        fresh: dict[int, list[str]] = {}
        for kind, uri, target, d in rows:
            if kind == 0:
                to.setdefault(uri, []).append(target)
            elif d < depth.get(uri, d + 1):
                depth[uri] = d
                if kind == 2:
                    fresh.setdefault(d, []).append(uri)
        out: dict[str, int] = {}
        reached: set[str] = set()
        d = min(fresh, default=0)
        while fresh:
            for uri in fresh.pop(d, ()):
                if depth[uri] != d or uri in reached:
                    continue
                reached.add(uri)
                for target in to.get(uri, ()):
                    if bisect_right(bounds, target) != key[0]:
                        out[target] = min(d + 1, out.get(target, d + 1))
                    elif d + 1 < depth.get(target, d + 2):
                        depth[target] = d + 1
                        fresh.setdefault(d + 1, []).append(target)
            d += 1
        yield from ((*key, True, uri, depth[uri]) for uri in reached)
        yield from ((bisect_right(bounds, uri), False, uri, d) for uri, d in out.items())

    return step


def reachable_in_parts(starts: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """uri, depth as `reachable` gives them, over links without nulls. Documents lie in parts,
    ranges of URIs with about `most` links each, so that folders stay
    together. A part follows its own links to their end at once; only what leads to other parts
    is exchanged, and a part is looked at again only when something has come in."""
    links = stored(links)
    parts = max(1, -(-links.count() // most))
    ranged = links.select("uri").repartitionByRange(parts, "uri").groupBy(F.spark_partition_id().alias("p")).agg(F.min("uri").alias("low"))
    bounds = sorted(r.low for r in ranged.collect())[1:]  # one for each part

    @F.pandas_udf("int")
    def part(uris: pd.Series) -> pd.Series:
        return uris.map(lambda uri: bisect_right(bounds, uri))

    placed = stored(links.withColumn("part", part("uri")).repartition("part").sortWithinPartitions("part"))
    coming = stored(starts.where("uri is not null").select("uri").distinct().select(part("uri").alias("part"), "uri", F.lit(0).alias("depth")))
    none = F.lit(None)
    known: list[DataFrame] = []
    while active := [r.part for r in coming.select("part").distinct().collect()]:  # numbers of parts
        rows = placed.where(F.col("part").isin(active)).select("part", F.lit(0).alias("kind"), "uri", "to_uri", none.cast("int").alias("depth"))
        for kind, seen in [*((1, x) for x in known), (2, coming)]:
            rows = rows.unionByName(seen.where(F.col("part").isin(active)).select("part", F.lit(kind).alias("kind"), "uri", none.cast("string").alias("to_uri"), "depth"))
        found = stored(in_order(rows, ["part"], ["kind"], _reach_within(bounds), "part int, own boolean, uri string, depth int"))
        known.append(found.where("own").select("part", "uri", "depth"))
        coming = stored(found.where("not own").groupBy("part", "uri").agg(F.min("depth").alias("depth")))
        if len(known) == MERGE:
            known = [stored(ln.union_all(known).groupBy("part", "uri").agg(F.min("depth").alias("depth")))]
    return ln.union_all(known).groupBy("uri").agg(F.min("depth").alias("depth")) if known else coming.select("uri", "depth")


def reachable(starts: DataFrame, links: DataFrame) -> DataFrame:
    """uri, depth (the least number of links) of all that can be reached from `starts` (uri) over
    `links` (uri, to_uri); cycles end. Links with a null end lead nowhere.

    Of at most SMALL links one task takes all steps. More are cut into parts of about so many;
    the rounds then are as many as a shortest path changes parts, not as it has links."""
    links = stored(links.where("uri is not null and to_uri is not null").select("uri", "to_uri"))
    return _reachable_at_once(starts, links) if links.count() <= SMALL else reachable_in_parts(starts, links, max(SMALL, 1))


def reachable_documents(ws: Workspace) -> DataFrame:
    """uri, depth of what entry points lead to. The texts are scanned once, for an index."""
    ws = ws.indexed()
    return reachable(ws.docs.where(is_entry_point(F.col("uri"))), edges(ws))


def orphans(ws: Workspace) -> DataFrame:
    """uri of documents that no entry point leads to; none where there is no entry point."""
    entries = ws.docs.where(is_entry_point(F.col("uri"))).select("uri")
    if entries.isEmpty():
        return ws.docs.select("uri").limit(0)
    return ws.docs.where(~is_entry_point(F.col("uri"))).select("uri").join(reachable(entries, edges(ws)), "uri", "left_anti")


def statistics(ws: Workspace) -> DataFrame:
    """One row: documents, definitions (distinct ids), refs, symbols."""
    ws = ws.indexed()
    n = lambda df, agg, name: df.agg(agg.alias(name))
    out = n(ws.docs, F.count("*"), "documents")
    for df, agg, name in ((ws.all_definitions, F.countDistinct("id"), "definitions"), (ws.references, F.count("*"), "refs"), (ws.symbols.where("name <> ''"), F.count("*"), "symbols")):
        out = out.join(n(df, agg, name))  # one row each
    return out


def search_symbols(syms: DataFrame, query: str) -> DataFrame:
    """Symbols whose name holds the query, whatever the case; all but nameless ones for an
    empty query."""
    return syms.where((F.col("name") != "") & F.lower("name").contains(query.lower()))


def resolve_chain(parents: DataFrame, key: str, parent: str) -> DataFrame:
    """key, ancestor, depth over a parent column, to each chain's end; a cycle ends at its
    first repeat, and parents that are no keys are no ancestors. Each step doubles the
    distance that is known, so a chain takes as many steps as its length has bits."""
    base = stored(parents.select(F.col(key).alias("k"), F.col(parent).alias("m")))
    known = stored(base.select("k").where("k is not null").distinct().select("k", F.col("k").alias("ancestor"), F.lit(0).alias("depth")))
    jump = stored(base.where("k <> m").join(known.select(F.col("k").alias("m")), "m", "left_semi").select("k", "m").distinct())
    n, distance = known.count(), 1
    while not jump.isEmpty():
        more = jump.join(known.withColumnRenamed("k", "m"), "m").select("k", "ancestor", F.col("depth") + distance)
        known = stored(known.union(more).groupBy("k", "ancestor").agg(F.min("depth").alias("depth")))
        before, n = n, known.count()
        if n == before:
            break
        jump = stored(jump.join(jump.select(F.col("k").alias("m"), F.col("m").alias("then")), "m").select("k", F.col("then").alias("m")).distinct())
        distance *= 2
    return known.select(F.col("k").alias(key), "ancestor", "depth")
