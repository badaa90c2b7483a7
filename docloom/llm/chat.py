"""Chat formatting: transcripts are parsed into role turns by a hidden Markov model over
speaker markers and line features, then rendered in one canonical form.

A state is a role at the first line of a turn or at a later one. A row whose role is given is
one turn of that role, whatever its text says: its states are known, and they part the
lines of unknown role before it from those behind. No turn goes on into the next row. All
probabilities are counted over the
lines of rows with a role, on top of a few prior counts.

Rows are sorted by conversation and place over range partitions, so that a conversation may
lie in many tasks, and cut into blocks of a bounded number of lines. Where the states around
a block are known it is decoded alone. Others are chained: the max-plus product of a block's
steps is a small matrix; the products of a partition's blocks make up one of the partition,
these are chained over a conversation's partitions, and the states found at their ends lead
back to those of the blocks.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Stored, quoted

#: The roles that lines are told apart by, and one for all speakers of other names.
ROLES = ("system", "user", "assistant", "other")
OTHER = ROLES.index("other")
#: Speaker names and the roles they stand for (fixed values).
ALIASES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "bot", "ai", "gpt", "chatgpt", "model", "answer", "agent"),
}
ROLE = {name: i for i, r in enumerate(ROLES) for name in ALIASES.get(r, ())}
MARKER = re.compile(r"\s*(?:[\[<*#|]{1,4}\s*)?(" + "|".join(sorted(ROLE, key=len, reverse=True)) + r")(?:\s*[\]>*|]{1,4}\s*:?|\s*:)\s*", re.I)
BREAK = re.compile("\r?\n")
#: Lines of a block; a longer row is a block by itself.
BLOCK = 512
N = 2 * len(ROLES)  # states: role r begins at 2 r, goes on at 2 r + 1
SIZES = 8
#: Prior counts of (no marker, marker of the state's role, marker of another one) where a turn
#: begins or goes on, at a row's first line, which always begins one, and at a later one.
PRIOR = {"begin": ((4.0, 4.0, 0.2), (0.2, 8.0, 0.05)), "on": ((0.0, 0.0, 0.0), (4.0, 0.05, 0.05))}
#: What stands before a conversation's first row, before a row of a role that isn't known,
#: and before a partition's first row.
OPENS, UNKNOWN, UNSEEN = -1, -2, -3


def role_of(name: Column) -> Column:
    """The index of the role that a speaker's name stands for, OTHER for a name that stands for
    none of them, null without a name (one without a letter is none)."""
    out = F.when(name.rlike(r"\p{L}"), F.lit(OTHER))
    for i, r in enumerate(ROLES[:OTHER]):
        out = F.when(F.lower(F.trim(name)).isin(*ALIASES[r]), F.lit(i)).otherwise(out)
    return out


def features(text: str) -> tuple[list[str], list[int], list[int]]:
    """The lines of a text, the role that each one's marker names (-1: none) and its kind (length
    and question mark)."""
    lines = BREAK.split(text)
    cues = [ROLE[hit[1].lower()] if (hit := MARKER.match(line)) else -1 for line in lines]
    kinds = [2 * min(SIZES - 1, (len(line) + 1).bit_length() - 1) + line.rstrip().endswith("?") for line in lines]
    return lines, cues, kinds


def _records(rows, schema: pa.Schema, most: int = 256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches, most: int = 256):
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, most).columns), strict=True)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _mapped(df: DataFrame, f, ddl: str, most: int = 256) -> DataFrame:
    """`f` over the rows of each partition, as tuples."""
    schema = _arrow(df.sparkSession, ddl)
    return df.mapInArrow(lambda batches: _records(f(_rows(batches, most)), schema, most), ddl)


def blocks(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, part, block (in order of part and block), prev (role of the row before, or one of
    OPENS, UNKNOWN, UNSEEN), ends (whether its conversation ends with it, as far as the
    partition shows), rows: a row for each block, of rows of one conversation in order."""
    kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    base = rows.select(F.col(quoted(conv_col)).alias("conv"), F.col(quoted(turn_col)).alias("turn"), role_of(F.col(quoted(role_col))).alias("given"), F.when(role_of(F.col(quoted(role_col))) == OTHER, F.col(quoted(role_col))).alias("name"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    each = base.withColumn("tie", F.xxhash64("given", "name", "text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("tie").asc(), F.col("row").asc()]
    ranged = each.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "given", "name", "text")

    def place(found):
        from pyspark import TaskContext

        part, block, prev = TaskContext.get().partitionId(), 0, UNSEEN
        for conv, group in groupby(found, key=lambda r: r[0]):
            held, n, first = [], 0, prev
            for _, turn, given, name, text in group:
                _, cues, kinds = features(text)
                if held and n + len(cues) > BLOCK:
                    yield conv, part, block, first, False, held
                    block, held, n, first = block + 1, [], 0, prev
                held.append({"turn": turn, "given": given, "name": name, "prev": prev, "text": text, "cues": cues, "kinds": kinds})
                n += len(cues)
                prev = UNKNOWN if given is None else given
            yield conv, part, block, first, True, held
            block, prev = block + 1, OPENS

    row = f"struct<turn:{turn_kind},given:int,name:string,prev:int,text:string,cues:array<int>,kinds:array<int>>"
    return _mapped(ranged, place, f"conv {kind}, part int, block int, prev int, ends boolean, rows array<{row}>")


def _edges(seen: DataFrame) -> DataFrame:
    """conv, part, prev, given of each partition's first row, with what really stands before it:
    the last row of the partition before. One row for each partition meets the others."""
    head = seen.where("block = 0").select("part", "conv", F.get("rows", F.lit(0))["given"].alias("given"))
    tail = seen.groupBy("part").agg(F.max_by(F.struct("conv", F.element_at("rows", -1)["given"].alias("given")), "block").alias("last"))
    both = head.join(tail, "part").withColumn("before", F.lag("last").over(Window.orderBy("part")))
    same = F.col("before").isNotNull() & F.col("before.conv").eqNullSafe(F.col("conv"))
    return both.select("conv", "part", F.when(same, F.coalesce("before.given", F.lit(UNKNOWN))).otherwise(F.lit(OPENS)).alias("prev"), "given")


def learn(seen: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from the rows of a role: start (N), step (N x N), sign (begin or on x
    first or later line x sort of marker), kind (N x 2 SIZES); each but `sign`, which has
    PRIOR, with one added to its counts."""
    n = len(ROLES)
    rows = seen.select(F.explode("rows").alias("r")).select("r.*").where("given is not null")
    pairs = rows.where(F.col("prev") != UNSEEN).groupBy("prev", "given").count().unionByName(_edges(seen).where("given is not null").groupBy("prev", "given").count())
    turn, first, kind = np.ones((n, n)), np.ones(n), np.ones((N, 2 * SIZES))
    for r in pairs.groupBy("prev", "given").agg(F.sum("count").alias("n")).collect():  # n * n + 2 n rows at most
        if r["prev"] == OPENS:
            first[r["given"]] += r["n"]
        elif r["prev"] >= 0:
            turn[r["prev"], r["given"]] += r["n"]
    lines = rows.select("given", F.posexplode(F.arrays_zip("cues", "kinds")).alias("at", "x"))
    sort = F.when(F.col("x.cues") < 0, 0).when(F.col("x.cues") == F.col("given"), 1).otherwise(2)
    counts = lines.groupBy("given", F.least("at", F.lit(1)).alias("later"), sort.alias("sort"), F.col("x.kinds").alias("kind")).count().collect()  # 36 SIZES rows at most
    sign = np.array([PRIOR["begin"], PRIOR["on"]])
    rows_of, lines_of = np.ones(n), np.full(n, 2.0)
    for r in counts:
        sign[r["later"], r["later"], r["sort"]] += r["count"]  # a row begins at its first line and goes on after it
        kind[2 * r["given"] + r["later"], r["kind"]] += r["count"]
        lines_of[r["given"]] += r["count"]
        rows_of[r["given"]] += r["count"] * (1 - r["later"])
    begin = rows_of / lines_of  # how often a role's line is the last of its turn
    start, step = np.full(N, -np.inf), np.full((N, N), -np.inf)
    start[::2] = np.log(first / first.sum())
    to = np.log(turn / turn.sum(1, keepdims=True) * begin[:, None])
    for a in range(n):
        for own in (2 * a, 2 * a + 1):
            step[own, ::2] = to[a]
            step[own, 2 * a + 1] = np.log(1 - begin[a])
    with np.errstate(divide="ignore"):
        sign = np.log(sign / sign.sum((1, 2), keepdims=True))
    return {"start": start, "step": step, "sign": sign, "kind": np.log(kind / kind.sum(1, keepdims=True))}


def emissions(model: dict, rows: list[dict]) -> np.ndarray:
    """Log probability of each line of the rows in each state. Lines of a row with a role have
    that role's states alone."""
    state = np.arange(N)
    role, on = state // 2, state % 2
    out = []
    for row in rows:
        cues, kinds = np.array(row["cues"]), np.array(row["kinds"])
        n = len(cues)
        if row["given"] is not None:
            e = np.full((n, N), -np.inf)
            e[:1, 2 * row["given"]] = 0
            e[1:, 2 * row["given"] + 1] = 0
        else:
            sort = np.where(cues[:, None] < 0, 0, np.where(cues[:, None] == role, 1, 2))
            e = model["kind"][:, kinds].T + model["sign"][on, np.minimum(np.arange(n), 1)[:, None], sort]
            e[:, role == OTHER] = -np.inf  # who has no name speaks in one of the roles
        out.append(e)
    return np.concatenate(out)


def _begin(model: dict, prev: int) -> np.ndarray | None:
    """Log probability of the first state behind what stands before a block, None where that
    isn't known. The last line of a row with a role goes on, but that one of a single line
    begins, which makes no difference for what follows."""
    if prev == OPENS:
        return model["start"]
    return model["step"][2 * prev + 1] if prev >= 0 else None


def _product(model: dict, e: np.ndarray, begin: np.ndarray | None) -> np.ndarray:
    """Best log probability of a block's lines from each state before it (any one where the
    first state's are known) to each at its end."""
    m = (model["step"] if begin is None else np.tile(begin, (N, 1))) + e[0]
    for x in e[1:]:
        m = (m[:, :, None] + model["step"][None]).max(1) + x
    return m


def viterbi(model: dict, e: np.ndarray, begin: np.ndarray, end: int | None) -> list[int]:
    """The best states of lines, given the log probability of the first state, and the last."""
    v = begin + e[0]
    back = []
    for x in e[1:]:
        to = v[:, None] + model["step"]
        back.append(to.argmax(0))
        v = to.max(0) + x
    at = int(v.argmax()) if end is None else end
    path = [at]
    for b in reversed(back):
        path.append(at := int(b[at]))
    return path[::-1]


def _joined(products: list[np.ndarray]) -> np.ndarray:
    m = products[0]
    for then in products[1:]:
        m = (m[:, :, None] + then[None]).max(1)
    return m


def _chained(v: np.ndarray, products: list[np.ndarray], end: int | None) -> list[tuple[int, int]]:
    """The states before and at the end of each of some products in a row, from the log
    probability of the state before them to the state at their end."""
    back = []
    for m in products:
        to = v[:, None] + m
        back.append(to.argmax(0))
        v = to.max(0)
    at = int(v.argmax()) if end is None else end
    out = []
    for b in reversed(back):
        before = int(b[at])
        out.append((before, at))
        at = before
    return out[::-1]


def _bounds(model: dict, open_: DataFrame, kind: str) -> DataFrame:
    """part, block, before, end of open blocks (conv, part, block, prev, rows): the states that
    the best path of their whole conversation has there."""

    def multiply(found):
        for conv, part, block, prev, rows in found:
            yield conv, part, block, _product(model, emissions(model, rows), _begin(model, prev)).ravel().tolist()

    ones = Stored(_mapped(open_.select("conv", "part", "block", "prev", "rows"), multiply, f"conv {kind}, part int, block int, m array<double>", 64)).df
    matrix = lambda m: np.array(m).reshape(N, N)

    def join(found):
        for (part, conv), group in groupby(found, key=lambda r: (r[0], r[1])):
            yield conv, part, _joined([matrix(r[3]) for r in group]).ravel().tolist()

    sums = _mapped(ones.repartition("part", "conv").sortWithinPartitions("part", "conv", "block").select("part", "conv", "block", "m"), join, f"conv {kind}, part int, m array<double>")

    def over(found):
        for conv, group in groupby(found, key=lambda r: r[0]):
            held = [(part, matrix(m)) for _, part, m in group]
            ends = _chained(np.zeros(N), [m for _, m in held], None)
            for (part, _), (before, end) in zip(held, ends, strict=True):
                yield conv, part, before, end

    parts = _mapped(sums.repartition("conv").sortWithinPartitions("conv", "part"), over, f"conv {kind}, part int, before int, end int")
    met = ones.join(parts, (ones["part"] == parts["part"]) & ones["conv"].eqNullSafe(parts["conv"])).select(ones["part"], ones["conv"], "block", "m", "before", "end")

    def within(found):
        for (part, _), group in groupby(found, key=lambda r: (r[0], r[1])):
            held = [(block, matrix(m), before, end) for _, _, block, m, before, end in group]
            v = np.full(N, -np.inf)
            v[held[0][2]] = 0
            for (block, *_), (before, end) in zip(held, _chained(v, [h[1] for h in held], held[0][3]), strict=True):
                yield part, block, before, end

    return _mapped(met.repartition("part", "conv").sortWithinPartitions("part", "conv", "block"), within, "part int, block int, before int, end int")


def escaped(text: Column) -> Column:
    """A text in which no control token stands: `<|` gets a backslash between, and one that
    has some already gets one more, so that `unescaped` finds back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def turns(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """The conversation column, turn (from 0), role, text, rendered, source_turn (the turn number
    of the row where it begins) for each recovered turn.

    Rows of a conversation follow each other by turn number, nulls last and rows of one
    number by a hash of role and text. Each row begins a turn. A row whose role the alias table
    knows is a turn of that role; a marker of its own role at its beginning is cut off, and what
    else its text holds never opens a turn. A row of another speaker (`tool`, `function` and the
    like) is one turn of that speaker: role and text come back as they are. Rows without a
    role, or one without a letter, are read line by line: a marker within them may begin a turn of its own,
    and is cut off where it does. `rendered` has the text with its control tokens escaped, and
    a speaker's name with `_` for white space and the signs of control tokens. A null or empty
    text is one empty line. Null conversation ids are one conversation. The model is learned from
    `learn_from` (rows like these), or from the rows themselves. Other columns are not read.
    """
    kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    columns = (conv_col, turn_col, role_col, text_col)
    seen = Stored(blocks(rows, *columns)).df
    model = learn(seen if learn_from is None else Stored(blocks(learn_from, *columns)).df)

    # a block's neighbours are known but for partitions' ends and stretches without a role
    last = seen.groupBy("part").agg(F.max("block").alias("_last"))
    edges = _edges(seen).select(F.col("part").alias("_part"), F.col("prev").alias("_prev"))
    marked = seen.join(F.broadcast(last), "part").join(F.broadcast(edges), (F.col("part") == F.col("_part")) & (F.col("block") == 0), "left")  # a row for each partition
    marked = marked.withColumn("prev", F.coalesce("_prev", "prev"))
    free = F.element_at("rows", -1)["given"].isNull()
    is_open = (F.col("prev") == UNKNOWN) | (free & (~F.col("ends") | (F.col("block") == F.col("_last"))))
    marked = marked.withColumn("open", is_open).drop("_last", "_part", "_prev")
    bounds = _bounds(model, marked.where("open"), kind)
    known = marked.where("not open").withColumns({"before": F.lit(None).cast("int"), "end": F.lit(None).cast("int")})
    met = marked.where("open").join(bounds, ["part", "block"]).select(*known.columns).unionByName(known)

    def decode(found):
        for conv, part, block, prev, before, end, own in found:
            if all(r["given"] is not None for r in own):
                states = [2 * r["given"] + (i > 0) for r in own for i in range(len(r["cues"]))]
            else:
                begin = _begin(model, prev)
                states = viterbi(model, emissions(model, own), model["step"][before] if begin is None else begin, end)
            at, made = 0, []
            for r in own:
                lines, cues, _ = features(r["text"])
                for line, cue, state in zip(lines, cues, states[at : at + len(lines)], strict=True):
                    if state % 2 == 0:
                        made.append((r["name"] if state // 2 == OTHER else ROLES[state // 2], r["turn"], []))
                        line = line[MARKER.match(line).end() :] if cue == state // 2 else line
                    made[-1][2].append(line)
                at += len(lines)
            for n, (role, turn, text) in enumerate(made):
                yield conv, part, block, n, len(made), role, turn, "\n".join(text)

    columns = "conv, part, block, n, begins, role, source_turn, text"
    types = (kind, "int", "int", "int", "int", "string", turn_kind, "string")
    decoded = met.select("conv", "part", "block", "prev", "before", "end", "rows")
    pieces = Stored(_mapped(decoded, decode, ", ".join(f"{c} {t}" for c, t in zip(columns.split(", "), types, strict=True)), 64)).df

    # turns begun before a block: over its partition's blocks, and over the conversation's partitions
    begun = pieces.groupBy("part", "block").agg(F.first("conv").alias("conv"), F.first("begins").alias("begins"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    local = begun.withColumn("here", F.coalesce(F.sum("begins").over(before("part", "conv", "block")), F.lit(0)))
    parts = begun.groupBy("part", "conv").agg(F.sum("begins").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before("conv", "part")), F.lit(0)))
    offsets = local.join(parts, (local["part"] == parts["part"]) & local["conv"].eqNullSafe(parts["conv"])).select(local["part"], "block", (F.col("here") + F.col("ahead")).alias("offset"))
    out = pieces.join(offsets, ["part", "block"]).withColumn("turn", F.col("n") + F.col("offset"))
    role, text = F.col("role"), F.trim("text")
    rendered = F.concat(F.lit("<|"), F.regexp_replace(role, r"[\s|<>\\]+", "_"), F.lit("|>\n"), escaped(text), F.lit("\n<|end|>\n"))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").cast("long").alias("turn"), role, text.alias("text"), rendered.alias("rendered"), "source_turn")
