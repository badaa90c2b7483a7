"""A workspace that is kept up to date: after each batch it is what all events so far make it."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from docloom.operators import graph as g
from docloom.operators import rules
from docloom.streaming import workspace

SCHEMA = "uri string, op string, text string, seq long"


def made_up(r, n):
    """Events of few documents, so that ids are defined twice, lost and found again."""
    out = []
    for seq in range(n):
        text = "\n".join(r.choice(["[[i{}]]", "See <<i{}>>.", "<<i{}, x>> and <<i{}>>", "plain {}"]).format(r.randrange(6), r.randrange(6)) for _ in range(r.randrange(5)))
        op = r.choice(["open", "change", "save", "delete", "close"])
        out.append((f"file:///d{r.randrange(7)}.adoc", op, None if op in ("delete", "close") else text, seq))
    return out


def test_after_each_batch_it_equals_a_recompute(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace.Kept, "FOLD", 2)
    r = random.Random(11)
    events = made_up(r, 90)
    r.shuffle(events)  # late ones too
    events += [(None, "open", "[[x]]", 1), ("file:///d1.adoc", "open", "[[x]]", None), ("file:///d1.adoc", "odd", "[[x]]", 10**6)]
    kept = workspace.Kept(spark, str(tmp_path / "kept"))
    assert kept.broken_links().count() == 0
    for start, end in ((0, 30), (30, 60), (60, 93)):
        spark.createDataFrame(events[start:end], SCHEMA).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        workspace.maintain(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "state"), once=True).awaitTermination()
        good = [e for e in events[:end] if e[0] and e[3] is not None]
        ws = g.Workspace(workspace.latest(spark.createDataFrame(good, SCHEMA)).withColumnRenamed("seq", "load_ord"))
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(kept.broken_links()) == rows(g.broken_links(ws))
        assert rows(kept.definitions()) == rows(ws.definitions.select("id", "uri", "ln", "col"))
        assert rows(kept.references()) == rows(ws.references.select("id", "uri", "ln", "col"))
        assert rows(kept.documents()) == rows(ws.docs.select("uri", "load_ord"))
        assert rows(kept.score()) == rows(rules.score(rules.broken_links(ws), ws.docs, 1))


def test_links_of_other_documents_break_and_mend(spark, tmp_path):
    kept, path = workspace.Kept(spark, str(tmp_path)), str(tmp_path)

    def batch(n, *rows):
        kept.apply(spark.createDataFrame(rows, workspace.CHANGE), n)
        return sorted((x.uri, x.id) for x in kept.broken_links().collect())

    a, b, twice = "[[one]]", "<<one>> <<two>>", "[[one]]\n[[one]]"
    assert batch(0, ("a", 1, "open", a, 1), ("b", 2, "open", b, 1)) == [("b", "two")]
    assert batch(1, ("a", 1, "open", a, -1), ("a", 3, "delete", None, 0)) == [("b", "one"), ("b", "two")]
    assert batch(2, ("c", 4, "open", twice, 1)) == [("b", "two")]
    assert batch(2, ("c", 4, "open", twice, 1)) == [("b", "two")]  # a batch that is repeated
    assert batch(3, ("c", 4, "open", twice, -1), ("c", 5, "save", a + " <<two>>", 1)) == [("b", "two"), ("c", "two")]
    assert batch(4, ("d", 6, "open", "[[two]]", 1), ("b", 2, "open", b, -1)) == []
    assert batch(5) == []
    assert kept.documents().count() == 2 and path


def test_numbers_of_deleted_documents_end(spark, tmp_path):
    """A late event is outdated by a delete until the watermark has passed it for good."""
    schema = SCHEMA + ", at timestamp"
    day = datetime(2024, 1, 1)
    batches = [
        [("a", "open", "[[x]]", 5, day), ("z", "open", "", 1, day)],
        [("a", "delete", None, 6, day + timedelta(minutes=1))],
        [("a", "change", "late", 4, day + timedelta(minutes=2))],
        [("z", "save", "later", 2, day + timedelta(days=2))],
        [("z", "save", "later still", 3, day + timedelta(days=4)), ("b", "delete", None, 1, day + timedelta(days=4))],
    ]
    state = defaultdict(list)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = workspace.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "state"), once=True, keep="1 hour")
        query.awaitTermination()
        state[n] = {x.uri for x in spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "last").load().selectExpr("key.uri").collect()}
        assert {x.uri for x in workspace.Kept(spark, str(tmp_path / "kept")).documents().collect()} == ({"a", "z"} if n == 0 else {"z"})
    assert "a" in state[2] and state[4] == {"z", "b"}
