"""Quality classifier by co-training.

Two views of a document are judged apart: its text (telling words and word starts, and
the text's shape) and its page metadata (source and language). Over rounds each classifier
judges all documents without a label and hands pseudo-labels that it is confident of to the
other. Both are calibrated on labelled documents that neither learns from, and a stacked
model of the calibrated views scores every document, for low quality and for toxicity.

Features of all documents are computed once into a narrow table: counts of metadata values,
the shapes' means and each round's search for confident documents cover all of them.
Classifiers are fitted on the driver, on about LABELLED labelled documents at most and, for
each round, class and view, about TAKEN of the documents that the other view is confident
of, dealt by a hash; every document is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice
from operator import eq, itemgetter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SLICE_ROWS, Stored, map_slices, quoted, unused

#: Bounds: labelled documents that are fitted on, pseudo-labels that a view gets in a round for
#: a class, words and word starts that a classifier looks at.
LABELLED, TAKEN, TOKENS = 12_000, 1_000, 256
ROUNDS, CONFIDENT = 3, 0.95
#: Share of documents that must stay whose chance may lie above the cut; the least cut.
SPARED, LEAST_CUT = 0.001, 0.1
#: Values of a metadata column that are told apart, the most frequent ones of all documents;
#: others are told apart by a hash into so many buckets.
VALUES, BUCKETS = 64, 64
HEADS = ("bad", "toxic")
#: Numbers of a text's shape; beyond so many deviations from the sample's mean they all count alike.
SHAPES, CLIP = 11, 3.0

WORD, SIGNS, TWICE = re.compile(r"\w+"), re.compile(r"[^\w\s]{2,}"), re.compile(r"([^\w\s])\1")
FIRST = itemgetter(0)


def tokens(text: str) -> set[str]:
    """Words, lower-cased, and the first four and five characters of longer ones."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:4]}~" for w in words if len(w) > 4} | {f"{w[:5]}~" for w in words if len(w) > 5}


class Finder:
    """Finds the places of a vocabulary's tokens in texts, as `tokens` would have them, but
    without making those that no vocabulary holds."""

    def __init__(self, vocabularies: list[dict[str, int]]):
        self.vocabularies = vocabularies
        starts = {t[:-1] for v in vocabularies for t in v if t.endswith("~")}
        self.words = {t for v in vocabularies for t in v if not t.endswith("~")}
        self.four, self.five = ({t for t in starts if len(t) == n} for n in (4, 5))

    def __call__(self, texts: list[str]) -> list[list[list[int]]]:
        out: list[list[list[int]]] = [[] for _ in self.vocabularies]
        for text in texts:
            words = set(WORD.findall(text.lower()))
            own = words & self.words
            own |= {f"{t}~" for t in self.four.intersection([w[:4] for w in words if len(w) > 4])}
            own |= {f"{t}~" for t in self.five.intersection([w[:5] for w in words if len(w) > 5])}
            for v, held in zip(self.vocabularies, out, strict=True):
                held.append(sorted(v[t] for t in own if t in v))
        return out


def shape(text: str) -> list[float]:
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    same = sum(map(eq, islice(words, 1, None), words))
    return [
        np.log1p(len(words)),
        len(text) / n,
        sum(len(TWICE.findall(run)) for run in SIGNS.findall(text)) / n,
        sum(map(str.isupper, words)) / n,
        (len(words) - sum(map(str.isalnum, map(FIRST, words)))) / n,
        same / n,
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
        sum(map(str.isdigit, words)) / n,
        float(not words),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression, by accelerated gradient steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    v = np.ones(x.shape[1])
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.25 * np.linalg.norm(x.T @ (x @ v)) / len(x) + ridge)
    w = z = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 0
    for t in range(steps):
        then = z - step * (x.T @ (_sigmoid(x @ z) - y) / len(x) + pull * z)
        z = then + t / (t + 3) * (then - w)
        w = then
    return w


@dataclass
class Head:
    """One target's classifier: no weights stand for a target with one class only."""

    vocabulary: dict[str, int]
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    mix: np.ndarray | None = None
    lines: dict[str, np.ndarray] | None = None
    prior: float = 0.0
    cut: float = 0.5

    def chance(self, raw: dict[str, np.ndarray]) -> np.ndarray:
        """The calibrated chance of rows with these scores of both views."""
        if self.mix is None:
            return np.full(len(raw["text"]), self.prior)
        return _sigmoid(np.column_stack([raw["text"], raw["meta"]]) @ self.mix[:-1] + self.mix[-1])

    def sure(self, view: str, raw: np.ndarray) -> np.ndarray:
        """The class that a view is confident of for each row, or -1."""
        line = self.lines[view]
        p = _sigmoid(raw * line[0] + line[1])
        return np.where(p >= CONFIDENT, 1, np.where(p <= 1 - CONFIDENT, 0, -1))


@dataclass
class Scale:
    """Means and deviations of the shapes of all documents."""

    mean: np.ndarray
    deviation: np.ndarray

    def text_view(self, size: int, found: Ragged, shapes: np.ndarray) -> np.ndarray:
        """The text view of rows: which of `size` tokens they hold, and their shapes."""
        x = np.zeros((found.n, size + SHAPES), np.float32)
        x[found.rows, found.flat] = 1
        x[:, size:] = np.clip((shapes - self.mean) / self.deviation, -CLIP, CLIP)
        return x


def _raw(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -15, 15)


class Training:
    """One head's labelled rows (views `x`, classes `y`, and which are held) and the
    pseudo-labelled rows that each view has got so far."""

    def __init__(self, head: Head, x: dict[str, np.ndarray], y: np.ndarray, held: np.ndarray):
        self.head, self.x, self.y, self.held = head, x, y, held
        self.given: dict[str, list] = {name: [] for name in x}
        head.prior = float(y.mean()) if len(y) else 0.0
        self.able = len(set(y[~held])) == 2 and len(set(y[held])) == 2

    def fit(self) -> None:
        """Fits both views, and the line that calibrates each on the held rows."""
        own, lines = ~self.held, {}
        for name, x in self.x.items():
            rows = np.concatenate([x[own], *(g[0] for g in self.given[name])])
            weights = fit_logistic(rows, np.concatenate([self.y[own], *(g[1] for g in self.given[name])]))
            setattr(self.head, name, weights)
            lines[name] = fit_logistic(_raw(weights, x[self.held])[:, None], self.y[self.held])
        self.head.lines = lines

    def give(self, view: str, rows: np.ndarray, classes: np.ndarray) -> None:
        if len(rows):
            self.given[view].append((rows, classes))

    def finish(self) -> None:
        """Stacks the views on the held rows and finds the cut."""
        raw = {name: _raw(getattr(self.head, name), x[self.held]) for name, x in self.x.items()}
        self.head.mix = fit_logistic(np.column_stack([raw["text"], raw["meta"]]), self.y[self.held])
        self.head.cut = _cut(self.head.chance(raw), self.y[self.held])


def co_train(heads: list[Training], confident) -> None:
    """Fits the heads' views in turns; in each, what one view is confident of among documents
    without a label is handed to the other. `confident(turn, heads)` yields head, view and the
    rows (views and `y`) that it is confident of."""
    able = [h for h in heads if h.able]
    for turn in range(ROUNDS + 1):
        for h in able:
            h.fit()
        if turn < ROUNDS and able:
            for h, view, found in list(confident(turn, able)):
                h.give("meta" if view == "text" else "text", found["meta" if view == "text" else "text"], found["y"])
    for h in able:
        h.finish()


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The chance from which a document is rejected: two thirds of the way, in log odds, from
    the highest chance of a held document that must stay (but a thousandth of them) to the
    next of one that must go; between LEAST_CUT and one half."""
    stay, go = np.sort(p[y == 0])[::-1], np.sort(p[y == 1])
    top = stay[int(len(stay) * SPARED)]
    above = go[go > top]
    if not len(above):
        return 0.5
    odds = lambda x: np.log(np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9)))
    return float(np.clip(_sigmoid((odds(top) + 2 * odds(above[0])) / 3), LEAST_CUT, 0.5))


class Metadata:
    """The places that a row's metadata values have among all, and its numbers by size."""

    def __init__(self, known: dict[str, list[str]], numeric: list[str]):
        self.known = {c: {v: j for j, v in enumerate(values)} for c, values in known.items()}
        self.numeric, self.one = numeric, VALUES + BUCKETS
        self.width = self.one * len(known) + 2 * len(numeric)

    def places(self, columns: dict[str, list], n: int) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(n)]
        for k, (c, known) in enumerate(self.known.items()):
            for own, v in zip(out, columns[c], strict=True):
                if v is not None:
                    at = known.get(v)
                    own.append(k * self.one + (VALUES + crc32(v.encode("utf-8", "surrogatepass")) % BUCKETS if at is None else at))
        return out

    def numbers(self, columns: dict[str, list], n: int) -> list[list[float]]:
        """Size, and whether there is none, of each number."""
        out: list[list[float]] = [[] for _ in range(n)]
        for c in self.numeric:
            for own, v in zip(out, columns[c], strict=True):
                own += [float(np.log1p(abs(v)) / 10), 0.0] if v is not None and v == v and abs(v) < float("inf") else [0.0, 1.0]
        return out

    def view(self, places: Ragged, numbers: np.ndarray) -> np.ndarray:
        x = np.zeros((places.n, self.width), np.float32)
        x[places.rows, places.flat] = 1
        x[:, self.width - 2 * len(self.numeric) :] = numbers
        return x


def _telling(sample: DataFrame) -> dict[str, dict[str, int]]:
    """For each head the tokens whose presence tells most about it (log-likelihood ratio),
    by counts over the sample's labelled documents."""

    def make():
        def work(texts, bad, toxic):
            n: dict[str, list[int]] = {}
            for text, b, t in zip(texts, bad, toxic, strict=True):
                for token in tokens(text or ""):
                    own = n.setdefault(token, [0, 0, 0])
                    own[0] += 1
                    own[1] += b or 0
                    own[2] += t or 0
            return [list(n), [x[0] for x in n.values()], [x[1] for x in n.values()], [x[2] for x in n.values()]]

        return work

    counts = map_slices(sample.select("text", "bad", "toxic"), make, "token string, n long, bad long, toxic long", rows=512)
    counts = Stored(counts.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic"))).where("n >= 3")).df
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    out = {}
    for head in HEADS:
        yes, no = float(total[head]), float(total["n"] - total[head])
        if not yes or not no:
            out[head] = {}
            continue
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        a, n = F.col(head).cast("double"), F.col("n").cast("double")
        g = F.round(part(a, n * yes / (yes + no)) + part(n - a, n * no / (yes + no)), 9)
        top = counts.where(g > 6).orderBy(F.desc(g), "token").limit(TOKENS).collect()
        out[head] = {r["token"]: i for i, r in enumerate(top)}
    return out


def _share(key: Column, salt: int) -> Column:
    """A number of a key, evenly spread from 0 to 1."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


FEATURES = "shape array<double>, t0 array<int>, t1 array<int>, places array<int>, numbers array<double>"


class Ragged:
    """Lists of numbers end to end."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.rows = flat, np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(sizes)

    @classmethod
    def of(cls, lists: list) -> Ragged:
        return cls(np.array([x for own in lists for x in own], np.int64), np.array([len(own) for own in lists], np.int64))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of the weights at each list's places."""
        return np.bincount(self.rows, weights[self.flat], self.n)


def _ragged(column) -> Ragged:
    """A column of lists of places."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return Ragged(own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), own.value_lengths().to_numpy(zero_copy_only=False))


def _matrix(column, width: int) -> np.ndarray:
    """A column of lists of `width` numbers."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), width)


class Model:
    """What has been fitted: the heads, the metadata's places, the shapes' scale."""

    def __init__(self, heads: dict[str, Head], meta: Metadata, scale: Scale):
        self.heads, self.meta, self.scale = heads, meta, scale

    def columns(self, rows: pa.Table | pa.RecordBatch) -> tuple:
        """shapes, places, numbers of a table of features."""
        return _matrix(rows["shape"], SHAPES), _ragged(rows["places"]), _matrix(rows["numbers"], 2 * len(self.meta.numeric))

    def views(self, name: str, rows: pa.Table) -> dict[str, np.ndarray]:
        """Both views of a table of features."""
        shapes, places, numbers = self.columns(rows)
        return {"text": self.scale.text_view(len(self.heads[name].vocabulary), _ragged(rows[f"t{HEADS.index(name)}"]), shapes), "meta": self.meta.view(places, numbers)}

    def raw(self, name: str, found: Ragged, shapes: np.ndarray, places: Ragged, numbers: np.ndarray) -> dict[str, np.ndarray]:
        """The scores of both views of a head, as their products with `views` would be."""
        head = self.heads[name]
        if head.text is None:
            return {"text": np.zeros(found.n), "meta": np.zeros(found.n)}
        size, k = len(head.vocabulary), numbers.shape[1]
        clipped = np.clip((shapes - self.scale.mean) / self.scale.deviation, -CLIP, CLIP)
        text = found.sums(head.text[:size]) + clipped @ head.text[size:-1] + head.text[-1]
        meta = places.sums(head.meta[: len(head.meta) - 1 - k]) + head.meta[-1]
        if k:
            meta = meta + numbers @ head.meta[-1 - k : -1]
        return {"text": np.clip(text, -15, 15), "meta": np.clip(meta, -15, 15)}

    def chances(self, texts: list[str], columns: dict[str, list], finder: Finder) -> dict[str, np.ndarray]:
        n = len(texts)
        shapes = np.array([shape(t) for t in texts], float).reshape(n, SHAPES)
        places, numbers = Ragged.of(self.meta.places(columns, n)), np.array(self.meta.numbers(columns, n), float).reshape(n, -1)
        return {name: self.heads[name].chance(self.raw(name, Ragged.of(own), shapes, places, numbers)) for name, own in zip(self.heads, finder(texts), strict=True)}


VIEWS = ("text", "meta")


def _confident(model: Model, free: DataFrame):
    """Documents without a label that a view is confident of: all are judged and counted, in one
    pass for all heads and views, and in another about TAKEN of each class taken, by a hash."""
    def judged(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        """The classes (or -1) of each row by each head and view."""
        rest, out = model.columns(batch), []
        for name in names:
            raw = model.raw(name, _ragged(batch[f"t{HEADS.index(name)}"]), *rest)
            out += [model.heads[name].sure(view, raw[view]) for view in VIEWS]
        return np.stack(out, 1)

    def confident(turn: int, heads: list[Training]):
        names = [name for name in HEADS if any(h.head is model.heads[name] for h in heads)]
        by = {name: next(h for h in heads if h.head is model.heads[name]) for name in names}
        pairs = [(name, view) for name in names for view in VIEWS]

        def count(batches):
            n = np.zeros((len(pairs), 2), np.int64)
            for batch in batches:
                if batch.num_rows:
                    found = judged(batch, names)
                    n += np.stack([(found == y).sum(0) for y in (0, 1)], 1)
            yield pa.RecordBatch.from_arrays([pa.array([p for p in range(len(pairs)) for _ in (0, 1)], pa.int32()), pa.array([0, 1] * len(pairs), pa.int32()), pa.array(n.ravel())], ["pair", "y", "n"])

        total = {(r["pair"], r["y"]): r["n"] for r in free.mapInArrow(count, "pair int, y int, n long").groupBy("pair", "y").agg(F.sum("n").alias("n")).collect()}
        rates = np.array([[min(1.0, TAKEN / max(1, total.get((p, y), 0))) for y in (0, 1)] for p in range(len(pairs))])
        salts = [4 * turn + 2 * HEADS.index(name) + VIEWS.index(view) + 7 for name, view in pairs]
        shares = free.select("*", *(_share(F.col("tie"), salt).alias(f"u{p}") for p, salt in enumerate(salts)))
        columns = ["tie", "shape", "t0", "t1", "places", "numbers"]

        def pick(batches):
            for batch in batches:
                if batch.num_rows:
                    found = judged(batch, names)
                    for p in range(len(pairs)):
                        y = found[:, p]
                        at = np.flatnonzero((y >= 0) & (batch[f"u{p}"].to_numpy(zero_copy_only=False) < rates[p][np.maximum(y, 0)]))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(y[at].astype(np.int32)), *(batch[c].take(pa.array(at)) for c in columns)], ["pair", "y", *columns])

        rows = shares.select(*columns, *(f"u{p}" for p in range(len(pairs)))).mapInArrow(pick, f"pair int, y int, tie long, {FEATURES}").toArrow()  # about 2 TAKEN for each pair
        rows = rows.sort_by([("pair", "ascending"), ("tie", "ascending")])
        for p, (name, view) in enumerate(pairs):
            own = rows.filter(pa.compute.equal(rows["pair"], p))
            yield by[name], view, model.views(name, own) | {"y": own["y"].to_numpy().astype(float)}

    return confident


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, meta_cols: list[str], number_cols: list[str]) -> Model:
    """The model from all of `docs` and about LABELLED of `labels` (the id column, quality,
    toxic), dealt by a hash of their id; of several labels of an id the worst counts, and of
    several rows of an id that with the least hash."""
    wide = [F.col(quoted(c)).cast("string").alias(f"m{i}") for i, c in enumerate(meta_cols)] + [F.col(quoted(c)).cast("double").alias(f"n{i}") for i, c in enumerate(number_cols)]
    base = docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("text"), *wide)
    ms, ns = [f"m{i}" for i in range(len(meta_cols))], [f"n{i}" for i in range(len(number_cols))]
    known = labels.where(F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("_id")).agg((1 - F.min("quality")).alias("bad"), F.max("toxic").alias("toxic"))
    known = Stored(known.where("bad is not null or toxic is not null")).df
    n_known = known.count()
    ids = known.where(_share(F.col("_id"), 1) < LABELLED / n_known) if n_known > LABELLED else known
    sample = base.join(F.broadcast(ids), "_id")  # about LABELLED ids are broadcast
    one = F.min(F.struct(F.xxhash64("text", *ms, *ns).alias("h"), "text", *ms, *ns, "bad", "toxic"))
    sample = Stored(sample.groupBy("_id").agg(one.alias("s")).select("_id", "s.*")).df
    vocabulary = _telling(sample)
    values = {}
    for c in ms:
        top = base.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(VALUES).collect()
        values[c] = sorted(r[c] for r in top)
    meta = Metadata(values, ns)

    def features(rows: DataFrame, keep: list[str]) -> DataFrame:
        def make():
            finder = Finder(list(vocabulary.values()))

            def work(*cols):
                texts, own = [t or "" for t in cols[len(keep)]], dict(zip(ms + ns, cols[len(keep) + 1 :], strict=True))
                return [*cols[: len(keep)], [shape(t) for t in texts], *finder(texts), meta.places(own, len(texts)), meta.numbers(own, len(texts))]

            return work

        kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        return map_slices(rows.select(*keep, "text", *ms, *ns), make, f"{kept}, {FEATURES}")

    every = Stored(features(base.withColumn("tie", F.xxhash64("_id", "text", *ms, *ns)), ["_id", "tie"])).df
    stats = every.select(*(F.element_at("shape", i + 1).alias(f"s{i}") for i in range(SHAPES))).agg(*(f(f"s{i}").alias(f"{n}{i}") for i in range(SHAPES) for n, f in (("a", F.avg), ("d", F.stddev_pop)))).first()
    number = lambda key, rest: np.array([rest if stats[f"{key}{i}"] is None else stats[f"{key}{i}"] for i in range(SHAPES)], float)
    scale = Scale(number("a", 0.0), number("d", 1.0) + 1e-6)
    free = Stored(every.join(known.select("_id"), "_id", "left_anti")).df
    rows = features(sample.withColumn("held", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(4)) == 0), ["_id", "bad", "toxic", "held"]).toArrow()  # about LABELLED
    names = [str(i) for i in rows["_id"].to_pylist()]
    rows = rows.take(pa.array(sorted(range(len(names)), key=names.__getitem__), pa.int64()))
    model = Model({name: Head(vocabulary[name]) for name in HEADS}, meta, scale)
    heads = []
    for name in HEADS:
        there = rows.filter(rows[name].is_valid())
        heads.append(Training(model.heads[name], model.views(name, there), there[name].to_numpy().astype(float), np.array(there["held"].to_pylist(), bool)))
    del rows
    co_train(heads, _confident(model, free))
    return model


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", meta_cols=("source", "lang"), number_cols=(), most_bad: float | None = None, most_toxic: float | None = None) -> DataFrame:
    """All columns of `docs` and p_good, p_toxic, accepted for each row. A row is accepted if
    its chances of being bad or toxic are under `most_bad` and `most_toxic`, or where these
    aren't given under cuts calibrated on held labelled documents.

    A null text is judged as an empty one; metadata columns that are missing are left
    out, and null metadata count as none. Where the labels have one class only, or none,
    each row gets the labels' mean (good and not toxic without labels). Repeated rows are
    judged each; of several texts of a labelled id the one with the least hash is learned
    from, so results don't depend on the order of rows. Columns of `docs` that bear one of
    the three new names are replaced; others may bear any name.
    """
    meta_cols, number_cols = [c for c in meta_cols if c in docs.columns], [c for c in number_cols if c in docs.columns]
    kept = [c for c in docs.columns if c not in ("p_good", "p_toxic", "accepted")]
    model = fit(docs, labels, id_col=id_col, text_col=text_col, meta_cols=meta_cols, number_cols=number_cols)
    cuts = {name: model.heads[name].cut if given is None else given for name, given in zip(HEADS, (most_bad, most_toxic), strict=True)}
    ms, ns = list(model.meta.known), model.meta.numeric

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        out, finder = [], Finder([h.vocabulary for h in model.heads.values()])
        for at in range(0, len(rows), SLICE_ROWS):
            texts, *rest = ([None if v is None or v != v else v for v in rows[c].iloc[at : at + SLICE_ROWS]] for c in rows)
            out.append(pd.DataFrame(model.chances([t or "" for t in texts], dict(zip(ms + ns, rest, strict=True)), finder)))
        p = pd.concat(out) if out else pd.DataFrame({"bad": [], "toxic": []}, dtype=float)
        return pd.DataFrame({"p_good": 1 - p["bad"].to_numpy(), "p_toxic": p["toxic"].to_numpy(), "accepted": ((p["bad"] < cuts["bad"]) & (p["toxic"] < cuts["toxic"])).to_numpy()})

    # only what is judged goes through Python, and only the scores come back; as it is marked not
    # deterministic, no filter on them runs it twice
    run = F.pandas_udf(judge, "p_good double, p_toxic double, accepted boolean").asNondeterministic()
    views = [F.col(quoted(c)).cast("string").alias(n) for n, c in zip(ms, meta_cols, strict=True)] + [F.col(quoted(c)).cast("double").alias(n) for n, c in zip(ns, number_cols, strict=True)]
    judged = unused("judged", docs.columns)
    out = docs.select(*map(quoted, kept), run(F.struct(F.col(quoted(text_col)).cast("string").alias("text"), *views)).alias(judged))
    return out.select(*map(quoted, kept), *(F.col(judged)[c].alias(c) for c in ("p_good", "p_toxic", "accepted")))
