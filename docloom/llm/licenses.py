"""License scans: headers and licence files are compared to license templates by the
cosine of sparse TF-IDF vectors; files without a license of their own take that of the
nearest ancestor directory that holds a licence file.

Templates are of two kinds: notices, which any line, head or window of a file may hold, and
the licenses' full texts, which whole files are compared to whatever their names are."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Stored, map_slices, quoted, split_join

#: Least cosine of a notice in a file, of a whole text with a notice that it consists of, and
#: with a license's full text.
NOTICE, WHOLE, FULL = 0.6, 0.6, 0.85
#: Words of a text whose windows are looked at at once; bounds memory, not results.
WINDOWED = 16_384
#: Directories with their license, and words with their weight, are broadcast up to so many rows (two short values each).
BROADCAST_ROWS = 100_000
#: Names of licence files; their text need only reach NOTICE in part.
NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Notices and opening words by which licenses are known (fixed values).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC0-1.0": ("CC0 1.0 Universal", "Dedicated to the public domain under CC0 1.0."),
}
TERM = re.compile(r"[^\W_]+")


@cache
def full_texts() -> dict[str, tuple[str, ...]]:
    """The full texts of licenses that come with the library, by license."""
    folder = resources.files("docloom.llm").joinpath("license_texts")
    return {f.name.removesuffix(".txt"): (f.read_text("utf-8"),) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}



def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Matcher:
    """Finds the blocks of a text (a line, the head, which is the lines before the first blank
    one, the whole, or as many words as a template has, within lines or across them) that may
    come closest to a template.

    Only the weights of the templates' terms are known here; those of other words lie
    between `least_other` and `most`.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]], idf: dict[str, float], least_other: float, most: float, long: Matcher | None = None):
        self.long = long
        self.names = [name for name, texts in templates.items() for _ in texts]
        self.idf, self.least_other, self.most = idf, least_other, most
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for at, own in enumerate(text for texts in templates.values() for text in texts):
            w = {t: k * idf[t] for t, k in Counter(terms(own)).items()}
            norm = sum(x * x for x in w.values()) ** 0.5
            for t, x in w.items():
                self.postings.setdefault(t, []).append((at, x / norm))
        # for windows: each term's number, its products with the templates and its square; last, any other word
        self.code = {t: i for i, t in enumerate(self.postings)}
        self.products = np.zeros((len(self.code) + 1, len(self.names)))
        for t, own in self.postings.items():
            for at, y in own:
                self.products[self.code[t], at] = idf[t] * y
        self.squares = np.array([idf[t] ** 2 for t in self.code] + [least_other**2])
        self.columns: dict[int, list[int]] = {}  # the templates of each length
        for at, own in enumerate(text for texts in templates.values() for text in texts):
            self.columns.setdefault(len(terms(own)), []).append(at)

    def windows(self, words: list[str], least: float) -> list[tuple[str, ...]]:
        """As many words as a template has, wherever they may reach a cosine of `least` with
        it: sums over the words bound it, as a repeated word adds more to the length."""
        out, n = [], max(self.columns)
        for start in range(0, len(words), WINDOWED):
            part = words[start : start + WINDOWED + n - 1]
            codes = np.array([self.code.get(w, len(self.code)) for w in part])
            dots = np.concatenate([np.zeros((1, len(self.names))), self.products[codes].cumsum(0)])
            squares = np.concatenate([[0.0], self.squares[codes].cumsum()])
            for size, own in self.columns.items():
                if size < len(words) and size <= len(part):
                    met = (dots[size:, own] - dots[:-size, own]).max(1)
                    at = np.flatnonzero(met + 1e-6 >= least * np.sqrt(squares[size:] - squares[:-size]))
                    out += [tuple(part[i : i + size]) for i in at]
        return out

    def block(self, words: list[str], least: float, n: Counter | None = None) -> tuple | None:
        """None where the words can't reach a cosine of `least`; else the bounds of their
        cosine, the product with the closest template (the first license by name among
        equals), their own square over its terms, the license, and the other words."""
        if self.postings.keys().isdisjoint(words):
            return None
        n = Counter(words) if n is None else n
        known = {w: k * self.idf[w] for w, k in n.items() if w in self.postings}
        own = sum(x * x for x in known.values())
        squares = sum(k * k for w, k in n.items() if w not in known)
        longest = own + squares * self.least_other**2
        if own < least * least * longest * (1 - 1e-9):  # no template meets more than all of `own`
            return None
        dots = [0.0] * len(self.names)
        for t, x in known.items():
            for at, y in self.postings[t]:
                dots[at] += x * y
        dot, name = max(((round(d, 9), self.names[i]) for i, d in enumerate(dots)), key=lambda p: (p[0], [-ord(c) for c in p[1]]))
        high = round(dot / longest**0.5, 8)
        if high < least:
            return None
        return high, round(dot / (own + squares * self.most**2) ** 0.5, 8), dot, own, name, {w: k for w, k in n.items() if w not in known}

    def scan(self, text: str, least: float, full: float = 1.0) -> list[tuple]:
        """The whole text (-1) if it may reach `full` with one of the `long` templates, and (0) if
        it may reach `least`, and of the lines (from 1), the head and the windows those that may
        come closest: at, dot, own, license, other words and their counts."""
        split = [terms(line) for line in text.split("\n")]
        every = [w for own in split for w in own]
        count = Counter(every)
        long = self.long.block(every, full, count) if self.long else None
        wide = [(-1, *long[2:5], list(long[5]), list(long[5].values()))] if long else []
        if self.postings.keys().isdisjoint(count):
            return wide
        head = next((i for i, own in enumerate(split) if not own), len(split))
        blocks = [every, *split] + [[w for own in split[:head] for w in own]] * (1 < head < len(split))
        first: dict[tuple, int] = {}
        for at, words in enumerate(blocks):
            if at == 0 or not self.postings.keys().isdisjoint(words):
                first.setdefault(tuple(words), at)
        for words in self.windows(blocks[0], least):
            first.setdefault(words, len(first) + len(blocks))
        found = [(at, b) for words, at in first.items() if (b := self.block(list(words), least))]
        low = max((b[1] for _, b in found), default=0.0)
        return wide + [(at, dot, own, name, list(rest), list(rest.values())) for at, (high, _, dot, own, name, rest) in found if at == 0 or high >= low]


def _weights(texts: DataFrame, *vocabularies: set[str]) -> tuple[DataFrame, dict[str, float], list[float], float]:
    """term, idf of the words of all texts; the weights of the words of the vocabularies; for
    each vocabulary the least weight of a word out of it; the most of any.

    A weight is the logarithm of the share of texts that hold the word, and one, so it stays
    when the texts are repeated. A term of no text weighs as much as the rarest word.
    """

    def count():
        def work(texts):
            n: Counter = Counter()
            for text in texts:
                n.update(set(terms(text or "")))
            return [["", *n], [len(texts), *n.values()]]  # "" counts the texts

        return work

    counts = Stored(map_slices(texts, count, "term string, n long", rows=1024).groupBy("term").agg(F.sum("n").alias("n"))).df
    every = sorted(set().union(*vocabularies))
    wanted = counts.sparkSession.createDataFrame([(t,) for t in ["", *every]], "term string")
    df = {r["term"]: r["n"] for r in counts.join(F.broadcast(wanted), "term").collect()}  # a row for each template term
    total = df.pop("", 0)
    commonest = []
    for own in vocabularies:  # of the words beside the templates' the commonest one is told first
        held = counts.sparkSession.createDataFrame([(t,) for t in ["", *sorted(own)]], "term string")
        commonest.append(counts.join(F.broadcast(held), "term", "left_anti").agg(F.max("n")).first()[0])
    rarest = counts.where("term <> ''").agg(F.min("n")).first()[0]
    weigh = lambda n: float(np.log(total / n) + 1) if n else 1.0
    idf = counts.where("term <> ''").select("term", (F.log(F.lit(float(total)) / F.col("n")) + 1).alias("idf"))
    return idf, {t: weigh(df.get(t, rarest)) for t in every}, [weigh(n) for n in commonest], weigh(rarest)


def _best(seen: DataFrame, idf: DataFrame, full: float) -> DataFrame:
    """row, part and whole (score and license of the closest block, and of the whole text) by
    the weights of all words. A full text counts from `full` on."""
    blocks = seen.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    held = Stored(idf.join(blocks.select(F.explode("words").alias("term")).distinct(), "term")).df
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    each = blocks.select("row", "at", "dot", "own", "license", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("*", F.col("w.words").alias("term"), F.col("w.counts").alias("k"))
    more = each.join(held, "term").groupBy("row", "at", "dot", "own", "license").agg(F.sum(F.pow(F.col("k") * F.col("idf"), 2)).alias("more"))
    score = F.round(F.col("dot") / F.sqrt(F.col("own") + F.col("more")), 9)
    scored = blocks.where(F.size("words") == 0).select("row", "at", "dot", "own", "license", F.lit(0.0).alias("more")).unionByName(more).select("row", "at", "license", score.alias("score")).where((F.col("at") >= 0) | (F.col("score") >= full))
    whole = F.max(F.when(F.col("at") <= 0, F.struct("score", "license")))
    return scored.groupBy("row").agg(F.max(F.struct("score", -F.col("at"), "license")).alias("part"), whole.alias("whole"))


def scan(files: DataFrame, *, id_col: str, path_col: str, text_col: str, templates=TEMPLATES, texts=None, notice: float = NOTICE, whole: float = WHOLE, full: float = FULL) -> DataFrame:
    """The id column, path, license, score, origin, from_dir for each row of `files`.

    origin is `notice` (a line, the head, the whole text or a window of as many words as a
    template has reaches `notice`), `inherited`
    (from_dir is the nearest ancestor directory with a licence file) or null without a
    license; score is 0 where no bound can be reached. A licence file bears the name of one, or
    its whole text reaches `whole` with a notice or `full` with a full text (`texts`, by
    default those that come with the library); of several in a directory the highest score
    counts, then the least path. The weights of words are counted over all texts. A null text
    has no notice; a null path is the root's. Repeated rows are judged each. Other columns are
    not read.
    """
    complete = full_texts() if texts is None else texts
    words = lambda held: {t for own in held.values() for text in own for t in terms(text)}
    kind = files.schema[id_col].dataType.simpleString()
    base = files.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(path_col)), F.lit("")).alias("path"), F.col(quoted(text_col)).alias("text"))
    idf, weights, least_others, most = _weights(base.select("text"), words(templates), words(complete))

    def make():
        matcher = Matcher(templates, weights, least_others[0], most, Matcher(complete, weights, least_others[1], most) if complete else None)

        def work(rows, ids, paths, texts):
            return [rows, ids, paths, [matcher.scan(t or "", min(notice, whole), full) for t in texts]]

        return work

    seen = Stored(map_slices(base, make, f"row long, id {kind}, path string, blocks array<struct<at: int, dot: double, own: double, license: string, words: array<string>, counts: array<int>>>")).df
    part = lambda c, name: F.col(f"{c}.{name}")
    score = F.coalesce(part("part", "score"), F.lit(0.0)).alias("score")
    judged = seen.join(_best(seen, idf, full), "row", "left").select("id", "path", score, part("part", "license").alias("license"), part("whole", "score").alias("whole_score"), part("whole", "license").alias("whole_license"))
    own = Stored(judged).df.withColumn("dir", F.expr("CASE WHEN instr(path, '/') > 0 THEN substring_index(path, '/', -1 + size(split(path, '/'))) ELSE '' END")).withColumn("name", F.substring_index("path", "/", -1))
    named = F.col("name").rlike(NAMES)
    file_score = F.when(F.col("whole_score") >= whole, F.col("whole_score")).when(named & (F.col("score") >= notice), F.col("score"))
    file_license = F.when(F.col("whole_score") >= whole, F.col("whole_license")).otherwise(F.col("license"))
    held = own.where(file_score.isNotNull()).groupBy("dir").agg(F.min(F.struct((-file_score).alias("s"), "path", file_license.alias("license"))).alias("best")).select("dir", F.col("best.license").alias("dir_license"))

    # each directory, once, meets its ancestors
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.expr("transform(sequence(0, size(split(dir, '/'))), k -> array_join(slice(split(dir, '/'), 1, k), '/'))"))
    dirs = own.select("dir").distinct().select("dir", F.explode(ancestors).alias("up"))
    near = split_join(dirs, held.withColumnRenamed("dir", "up"), "up")  # the root and the topmost folders are above all
    near = near.groupBy("dir").agg(F.max_by(F.struct("up", "dir_license"), F.length("up")).alias("n"))
    near = Stored(near.select("dir", F.col("n.up").alias("from_dir"), "n.dir_license")).df
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    out = own.join(near, "dir", "left")
    has = F.col("score") >= notice
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.when(has, F.col("license")).otherwise(F.col("dir_license")).alias("license"),
        "score",
        F.when(has, "notice").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )
