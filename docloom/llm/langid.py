"""Language identification by rank-order profiles: a document's most frequent character
n-grams (one to three letters, words padded) are compared to each language's by the
out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import map_slices, quoted, stored

#: N-grams of a profile, of a language as of a document.
TOP = 400
#: Languages whose profiles are shipped to the executors at once (TOP codes and ranks each).
BLOCK = 256
#: Distinct n-grams a training task holds before it hands their counts on.
HELD = 1_000_000
BITS = 21
GAP = 1  # stands between words; no letter has this code point


class Grams:
    """N-gram codes of a text: 21 bits a character, the whole text."""

    def __init__(self):
        self.kind = np.full(0x110000, 2, np.uint8)  # 0 no letter, 1 letter, 2 not asked yet

    def __call__(self, text: str) -> np.ndarray:
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        kind = self.kind[x]
        if (kind == 2).any():
            for c in np.unique(x[kind == 2]):
                self.kind[c] = chr(c).isalpha()
            kind = self.kind[x]
        x = np.concatenate([[GAP], np.where(kind == 1, x, GAP), [GAP]])
        gap = x == GAP
        x = x[~gap | np.concatenate([[True], ~gap[:-1]])]
        if len(x) < 2:
            return x[:0]
        two = (x[:-1] << BITS) | x[1:]
        return np.concatenate([x[x != GAP], two, (two[:-1] << BITS) | x[2:]])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """lang, code, rank: each language's most frequent n-grams, over all rows that have
    text and language. Ties go to the lower code. Counts are summed in each task before
    they are shuffled, and the ranking keeps `top` rows a language and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(), {}

        def out():
            for lang, parts in held.items():
                codes, n = _merge(parts)
                for i in range(0, len(codes), 50_000):
                    k = len(codes[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(codes[i : i + k]), pa.array(n[i : i + k])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                langs, texts = (c.to_pylist() for c in batch.slice(start, 128).columns)
                by: dict[str, list] = {}
                for lang, text in zip(langs, texts, strict=True):
                    by.setdefault(lang, []).append(grams(text))
                for lang, found in by.items():
                    held.setdefault(lang, []).append(np.unique(np.concatenate(found), return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [_merge(held[lang])]
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                    yield from out()
        yield from out()

    rows = docs.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("rank", rank - 1).where(F.col("rank") < top).select("lang", "code", "rank")


def identify(docs: DataFrame, learned: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The id column, lang_pred, score for each row of `docs`; the whole text counts.

    score is 1 minus the distance over its possible maximum. `und` with score 0 where
    the text is null or has no letters, or nothing was learned; ties go to the first
    language by name. Profiles beyond `block` languages are compared in several passes.
    """
    learned = stored(learned)
    langs = [r[0] for r in learned.select("lang").distinct().orderBy("lang").toLocalIterator()]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    for at in range(0, len(langs), block):
        own = langs[at : at + block]
        rows = _compare(rows, own, learned.where(F.col("lang").isin(own)).toPandas(), kind, top)
    return rows.select(F.col("id").alias(id_col), "lang_pred", "score")


def _compare(rows: DataFrame, langs: list[str], learned, kind: str, top: int) -> DataFrame:
    codes = np.unique(learned["code"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(langs)), -1, np.int32)
    at = {lang: i for i, lang in enumerate(langs)}
    ranks[np.searchsorted(codes, learned["code"].to_numpy(np.int64)), learned["lang"].map(at).to_numpy()] = learned["rank"].to_numpy()

    def make():
        grams = Grams()

        def work(ids, texts, best, score):
            for i, text in enumerate(texts):
                found = grams(text or "")
                if not len(found):
                    continue
                own, n = np.unique(found, return_counts=True)
                own = own[np.argsort(-n, kind="stable")[:top]]
                to = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                known = codes[to] == own
                r = ranks[to[known]]
                away = np.where(r < 0, top, np.abs(r - np.flatnonzero(known)[:, None])).sum(0) + (len(own) - known.sum()) * top
                k = int(away.argmin())
                s = 1 - float(away[k]) / (top * len(own))
                if best[i] == "und" or s > score[i]:
                    best[i], score[i] = langs[k], s
            return [ids, texts, best, score]

        return work

    return map_slices(rows, make, f"id {kind}, text string, lang_pred string, score double")
