"""Byte-level BPE encoding and decoding with a rank file, exact and linear in a text's length.

A pattern cuts a text into chunks; each distinct chunk that a task meets is segmented once.
A chunk's bytes are read as Latin-1, so that an Aho-Corasick automaton over all tokens finds,
in one pass, the longest token that starts at each place. Segmentation walks over those longest
matches. A sequence of tokens is what the merges make of a chunk if and only if the merges of
every two neighbours' bytes end in just these two; so a token is taken where it fits the one
before it, else the next shorter one is tried, and a place from which nothing leads on is left
for good. Whether two tokens fit is found by their merges once and remembered.

Chunks and pairs are remembered up to a bound in two generations: when a table is full, what was
met since it was last full stays. That changes no result.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache
from pathlib import Path
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_slices, quoted


def rank_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens: base64 text and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Recent:
    """A table of two generations, each of `most` entries and what one text or chunk adds."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def turn(self) -> dict:
        """The table to look in, and in `before`, and to add to."""
        if len(self.now) > self.most:
            self.before, self.now = self.now, {}
        return self.now


class Merges:
    """The merges of a rank table. Tokens are Latin-1 texts here."""

    NONE = 1 << 60

    def __init__(self, ranks: dict[bytes, int], most: int = 500_000):
        import ahocorasick

        self.bytes = [b""] * (max(ranks.values()) + 1)
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.tokens = [""] * len(self.bytes)
        for token, rank in self.ranks.items():
            self.tokens[rank], self.bytes[rank] = token, token.encode("latin-1")
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.lens = [len(t) for t in self.tokens]
        get = self.ranks.get
        #: The longest token that a token begins with, itself aside, or -1.
        self.shorter = [next((r for k in range(len(t) - 1, 0, -1) if (r := get(t[:k])) is not None), -1) for t in self.tokens]
        self.edges: dict[int, tuple | None] = {}
        self.pairs = Recent(most)

    def merged(self, text: str, halves: list | None = None) -> list[str]:
        """What is left when the neighbours of the least rank, the first of several, are merged
        as long as any can be. `halves` gets the parts of each merge in order."""
        parts, get, none = list(text), self.ranks.get, self.NONE
        near = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while near and (low := min(near)) < none:
            i = near.index(low)
            if halves is not None:
                halves.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = get(parts[i] + parts[i + 1], none)
            if i:
                near[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _edges(self, rank: int) -> tuple | None:
        """The parts that stand at a token's left and right edge on the way to it: each with the rank
        it was made at (-1: a byte) and the rank it is merged away at. None where the token's own
        merges don't end in it, or a part is made at a lower rank than one of its parts."""
        if rank not in self.edges:
            text, halves = self.tokens[rank], []
            made = None
            if self.merged(text, halves) == [text]:
                of = {a + b: (a, b) for a, b in halves}
                born = lambda t: self.ranks[t] if len(t) > 1 else -1
                if all(born(a + b) > max(born(a), born(b)) for a, b in halves):
                    made = ([], [])
                    for side, out in enumerate(made):
                        t, end = text, self.NONE
                        while t:
                            out.append((t, born(t), end))
                            end, t = born(t), of[t][side] if len(t) > 1 else ""
            self.edges[rank] = made
        return self.edges[rank]

    def _fit(self, pair: int) -> bool:
        """Whether the merges of both tokens' bytes end in these two, or those of a first token
        (before it -1) in itself: no part at the right edge of the first is ever merged with one at
        the left edge of the second. Both are there when their rank's turn comes if each was made
        before and is merged away after; of one rank the left comes first. Where ranks do not
        tell, all merges are gone through."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if a < 0:
            return self.merged(self.tokens[b]) == [self.tokens[b]]
        left, right = self._edges(a), self._edges(b)
        if left and right:
            get, odd = self.ranks.get, False
            for x, x_made, x_ends in left[1]:
                for y, y_made, y_ends in right[0]:
                    at = get(x + y)
                    if at is not None and at < x_ends and at <= y_ends:
                        if at > x_made and at > y_made:
                            return False
                        odd = True
            if not odd:
                return True
        return self.merged(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]

    def segment(self, chunk: str) -> list[int]:
        """The ranks of the tokens of a chunk (Latin-1); a chunk that is a token stays whole."""
        whole = self.ranks.get(chunk)
        if whole is not None:
            return [whole]
        lens, shorter, n = self.lens, self.shorter, len(chunk)
        pairs, before = self.pairs.turn(), self.pairs.before
        longest, lost = [0] * n, bytearray(n + 1)
        for end, rank in self.automaton.iter(chunk):  # later ends come later
            longest[end + 1 - lens[rank]] = rank
        out: list[int] = []
        at, rank, last = 0, longest[0] if n else -1, -1
        while at < n:
            end = at + lens[rank]
            if not lost[end]:
                pair = last << 32 | rank  # below zero for the first token
                fits = pairs.get(pair)
                if fits is None:
                    fits = before.get(pair)
                    pairs[pair] = fits = self._fit(pair) if fits is None else fits
                if fits:
                    out.append(rank)
                    at, last = end, rank
                    if at < n:
                        rank = longest[at]
                    continue
            rank = shorter[rank]
            while rank < 0:
                lost[at] = 1
                rank = out.pop()
                at -= lens[rank]
                rank, last = shorter[rank], out[-1] if out else -1
        return out


#: White space by Unicode's property of that name, as a class's inside.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Chunks:
    """Cuts texts by a pattern as the encoding's own library does.

    A pattern of letters, numbers and white space is written anew for Python's own module, which
    is faster and right for texts without letter-like numbers. Other texts are cut by a module
    whose tables of letters and numbers can be newer than the library's: characters that this
    Python does not know are tried in the library once, and in a copy of the text a character of
    the class found stands for each while it is cut.
    """

    STANDS = {"a": "é", "1": "0", "!": "!"}

    def __init__(self, pattern: str):
        import regex

        self.text, self.pattern = pattern, regex.compile(pattern)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\w{SPACE}]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.plain = None if r"\p" in plain or "[[" in plain else re.compile(plain)
        self.met: set[str] = set()
        self.odd: set[str] = set()
        self.stands: dict[int, str] = {}

    def stand(self, c: str) -> str:
        import tiktoken

        for k, v in self.STANDS.items():
            ranks = {bytes([i]): i for i in range(256)} | {(k + c).encode(): 256}
            if len(tiktoken.Encoding("probe", pat_str=self.text, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(k + c)) == 1:
                return v
        return " "

    def __call__(self, text: str) -> list[str]:
        own = set() if text.isascii() else set(text)
        for c in own - self.met:
            kind = unicodedata.category(c)
            if kind in ("Cn", "Nl", "No"):
                self.odd.add(c)
            if kind == "Cn":
                self.stands[ord(c)] = self.stand(c)
        self.met |= own
        if self.plain and own.isdisjoint(self.odd):
            return self.plain.findall(text)
        if self.stands and not own.isdisjoint(map(chr, self.stands)):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stands))]
        return self.pattern.findall(text)


class Codec:
    """Encodes texts and decodes ids as the library of the rank file does, without special tokens."""

    def __init__(self, data: bytes, pattern: str, most: int = 300_000):
        self.merges, self.chunks, self.table = Merges(read_ranks(data)), Chunks(pattern), Recent(most)

    def encode(self, text: str) -> bytes:
        """The ids, unsigned 32-bit integers, little-endian."""
        chunks = self.chunks(text)
        own, before = self.table.turn(), self.table.before
        for c in set(chunks).difference(own):
            own[c] = before.get(c) or self._chunk(c)
        return b"".join(map(own.__getitem__, chunks))

    def _chunk(self, chunk: str) -> bytes:
        own = self.merges.segment(chunk if chunk.isascii() else chunk.encode().decode("latin-1"))
        return pack(f"<{len(own)}I", *own)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(data: bytes, pattern: str) -> Codec:
    """One codec for all tasks that a worker runs, so what it remembers serves them all."""
    return Codec(data, pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """One row per row of `docs`: the id column, n_tokens, ids (binary: little-endian 32-bit
    integers) and decoded (binary: what the ids stand for), null unless asked for.

    A null text counts as empty and has no ids; a null id stays null; repeated rows are encoded
    each; a text of any length is encoded whole; other columns are not read."""
    data = rank_bytes(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        own = codec(data, pattern)

        def work(keys, texts):
            ids = [own.encode(t or "") for t in texts]
            return [keys, [len(i) // 4 for i in ids], ids, [own.decode(i) if decoded else None for i in ids]]

        return work

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    out = map_slices(rows, make, f"id {kind}, n_tokens long, ids binary, decoded binary", rows=64)
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of each row's ids (binary as `tokenize` gives them); null ids give none."""
    data = rank_bytes(path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        tokens = Merges(read_ranks(data)).bytes
        return lambda keys, ids: [keys, [b"".join(map(tokens.__getitem__, np.frombuffer(i or b"", "<u4").tolist())) for i in ids]]

    rows = encoded.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(ids_col)).alias("ids"))
    return map_slices(rows, make, f"id {kind}, decoded binary", rows=64).select(F.col("id").alias(id_col), "decoded")
