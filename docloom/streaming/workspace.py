"""A workspace that follows a stream of document events (uri, op, text, seq): opens,
changes and saves replace a document, closes keep it, deletes remove it.

State is held by document: its last number and text, and after a delete its number until the
watermark has passed. Each batch says which texts go and which come. What these define and
refer to are rows with a sign, and so are links that break or mend by it, other documents' links
too: `Kept` adds them to logs in the shared folder, and a relation is what its log sums up to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docloom.operators import lines as ln
from docloom.operators import rules
from docloom.store import scope, stored

WRITES = ("open", "change", "save", "upsert")
CHANGE = "uri string, seq long, op string, text string, sign int"
CHANGED = Row("uri", "seq", "op", "text", "sign")
#: The class that keeps state; of Spark's own the one that has timers.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(events: DataFrame) -> DataFrame:
    """Batch form: uri, text, seq of each document's last write, without documents whose last
    event is a delete. max_by keeps one row a document before the shuffle."""
    own = events.where(F.col("op").isin(*WRITES, "delete"))
    last = own.groupBy("uri").agg(F.max_by(F.struct("op", "text", "seq"), "seq").alias("e"))
    return last.where("e.op <> 'delete'").select("uri", "e.text", "e.seq")


class _Document(StatefulProcessor):
    """The newest event of a document counts; one that an earlier batch outdates changes nothing."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "seq long, op string, text string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()  # none where nothing is kept; each call of the state is a message
        seq, op, text = before or (None, None, None)
        at = 0
        for row in rows:
            at = max(at, row.ms or 0)
            if seq is None or row.seq > seq:
                seq, op, text = row.seq, row.op, row.text
        if before and seq == before[0]:
            return
        if before and before[1] != "delete":
            yield CHANGED(key[0], *before, -1)
        elif before:  # only a delete has a timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if op == "delete":
            text = None
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), at) + self.keep_ms)
        self.last.update((seq, op, text))
        yield CHANGED(key[0], seq, op, text, 1 if op != "delete" else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(events: DataFrame, *, at_col: str = "at", keep: str = "1 hour") -> DataFrame:
    """Streaming form: uri, seq, op, text, sign for each batch and document whose newest event
    changed: the text that goes (-1) and the one that comes (1); a delete is a row of sign 0.

    `at_col` is when an event arrived (now, where there is no such column). A deleted
    document's number is kept until the watermark, which is `keep` behind the last arrival, is
    `keep` past the delete's own; an event that the delete outdates has to come before that. Events without a
    uri or number, or of another op, are none."""
    timed = events if at_col in events.columns else events.withColumn(at_col, F.current_timestamp())
    own = timed.where(F.col("op").isin(*WRITES, "delete") & F.col("uri").isNotNull() & F.col("seq").isNotNull()).withWatermark(at_col, keep)
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    arrived = F.unix_millis(F.col(at_col).cast("timestamp")).alias("ms")
    return own.select("uri", "seq", "op", "text", arrived, at_col).groupBy("uri").transformWithState(_Document(ms), CHANGE, "Update", "EventTime")


@contextmanager
def _provider(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for what is started within."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


def _start(changed: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool):
    with _provider(changed.sparkSession):
        writer = changed.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def follow(events: DataFrame, validate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that validates the changed documents of each batch, each alone, and writes their
    diagnostics below `path`, a folder for each batch, so that a repeated batch replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        docs = batch.where("sign = 1").select("uri", F.col("seq").alias("load_ord"), "text")
        validate(docs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(changes(events), each, checkpoint, False)


def maintain(events: DataFrame, path: str, checkpoint: str, *, once: bool = False, **kw):
    """Starts a query that keeps the workspace below `path` up to date (see `Kept`); `once` ends
    it when all events that there are have been taken."""
    kept = Kept(events.sparkSession, path)
    return _start(changes(events, **kw), kept.apply, checkpoint, once)


#: Columns of each log; one more has the sign.
LOGS = {
    "documents": "uri string, load_ord long",
    "facts": "kind string, id string, uri string, load_ord long, ln int, col int, part int",
    "broken": "uri string, id string, ln int, col int",
}


class Kept:
    """The kept relations: documents, definitions, references and broken links.

    Each is a log of rows with a sign, a folder for each batch. A batch is written anew when it is
    repeated, and reads what the batches before it left alone. Every FOLD batches a log is summed up
    in one folder; what that replaces goes one fold later. Facts lie in PARTS parts by their id, so
    that a batch reads only the parts of ids that it touches.
    """

    FOLD, PARTS = 16, 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, log: str) -> list[tuple[int, str]]:
        """Number and kind (base, batch) of a log's complete folders."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{log}")
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
        done = lambda n: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"{n}/_SUCCESS"))
        return sorted((int(n.split("=")[1]), n.split("=")[0]) for n in names if "=" in n and done(n))

    def _log(self, log: str, before: int | None = None) -> DataFrame:
        """The rows of the last base and the batches behind it, of those before `before`."""
        there = [f for f in self._folders(log) if before is None or f[0] < before]
        base = max((n for n, kind in there if kind == "base"), default=-1)
        paths = [f"{self.path}/{log}/{kind}={n}" for n, kind in there if (kind == "base" and n == base) or (kind == "batch" and n > base)]
        kinds = f"{LOGS[log]}, sign long"
        if not paths:
            return self.spark.createDataFrame([], kinds)
        parts = [self.spark.read.schema(kinds).parquet(p) for p in paths]
        return ln.union_all(parts)

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*(c for c in rows.columns if c != "sign")).agg(F.sum("sign").alias("sign")).where("sign <> 0")

    def _now(self, log: str) -> DataFrame:
        return self._sum(self._log(log)).where("sign > 0").drop("sign")

    def documents(self) -> DataFrame:
        """uri, load_ord (the number of the last write)."""
        return self._now("documents")

    def definitions(self) -> DataFrame:
        """id, uri, ln, col: of several definitions of an id the last written counts."""
        last = F.max_by(F.struct("uri", "ln", "col"), F.struct("load_ord", "ln", "col")).alias("at")
        return self._now("facts").where("kind = 'anchor'").groupBy("id").agg(last).select("id", "at.*")

    def references(self) -> DataFrame:
        """id, uri, ln, col."""
        return self._now("facts").where("kind = 'reference'").select("id", "uri", "ln", "col")

    def broken_links(self) -> DataFrame:
        """uri, id, ln, col of references to what no document defines."""
        return self._now("broken").select("uri", "id", "ln", "col")

    def score(self) -> DataFrame:
        """The compliance score of the broken links."""
        return rules.score(rules.link_diagnostics(self.broken_links()), self.documents(), 1)

    def _write(self, rows: DataFrame, log: str, kind: str, number: int) -> None:
        parted = log == "facts"  # a part of a batch is one file
        writer = (rows.repartition("part") if parted else rows).write.mode("overwrite")
        (writer.partitionBy("part") if parted else writer).parquet(f"{self.path}/{log}/{kind}={number}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of `changes`; one without any (a stream ends with such) leaves no folders."""
        with scope():
            changed = stored(batch.where("sign <> 0").select("uri", F.col("seq").alias("load_ord"), "text", F.col("sign").cast("long").alias("sign")))
            if not changed.isEmpty():
                self._take(changed, number)
        if number % self.FOLD == self.FOLD - 1:
            self.fold(number)

    def _take(self, changed: DataFrame, number: int) -> None:
        self._write(self._sum(changed.select("uri", "load_ord", "sign")), "documents", "batch", number)
        one = lambda sign: ln.facts(ln.lines(changed.where(F.col("sign") == sign))).where("kind in ('anchor', 'reference')").withColumn("sign", F.lit(sign).cast("long"))
        order = F.when(F.col("kind") == "anchor", F.col("load_ord")).alias("load_ord")  # of a reference it bears on nothing
        part = F.pmod(F.xxhash64("name"), F.lit(self.PARTS)).cast("int").alias("part")
        found = one(-1).unionByName(one(1)).select("kind", F.col("name").alias("id"), "uri", order, "ln", "col", part, "sign")
        facts = stored(self._sum(found))
        self._write(facts, "facts", "batch", number)
        self._write(self._links(facts, number), "broken", "batch", number)

    def _links(self, facts: DataFrame, number: int) -> DataFrame:
        """Links that a batch's facts break (sign 1) or mend (-1), of all documents."""
        touched = [r.part for r in facts.select("part").distinct().collect()]  # PARTS at most
        old = self._log("facts", number).where(F.col("part").isin(touched))
        ids = facts.select("id").distinct()
        defined = lambda rows, name: rows.where("kind = 'anchor'").groupBy("id").agg(F.sum("sign").alias(name))
        status = ids.join(defined(old.join(ids, "id", "left_semi"), "had"), "id", "left").join(defined(facts, "more"), "id", "left")
        had = F.coalesce("had", F.lit(0))
        status = stored(status.select("id", (had > 0).alias("was"), (had + F.coalesce("more", F.lit(0)) > 0).alias("is")))
        links = lambda rows: rows.where("kind = 'reference'").select("uri", "id", "ln", "col", "sign")
        lost, found, still = (status.where(x).select("id") for x in ("was and not is", "is and not was", "not is and not was"))
        before = stored(self._sum(links(old).join(status.where("was <> is").select("id"), "id", "left_semi")))
        own = links(facts)
        breaks = before.join(lost, "id", "left_semi").unionByName(own.join(lost.unionByName(still), "id", "left_semi"))
        mends = before.join(found, "id", "left_semi").withColumn("sign", -F.col("sign"))
        return self._sum(breaks.unionByName(mends)).select("uri", "id", "ln", "col", "sign")

    def fold(self, number: int) -> None:
        """Sums up each log as far as batch `number` and drops what the fold before replaced."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for log in LOGS:
            there = self._folders(log)
            last = max((n for n, kind in there if kind == "base" and n < number), default=-1)
            self._write(self._sum(self._log(log, number + 1)), log, "base", number)
            for n, kind in there:
                if n < last or n == last and kind == "batch":
                    at = jvm.Path(f"{self.path}/{log}/{kind}={n}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
