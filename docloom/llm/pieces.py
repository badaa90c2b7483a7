"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of a BPE model crosses a whitespace marker, a text's segmentation is
the concatenation of its marked words' segmentations. Each task keeps a table of the
distinct marked words it has met, segments each once, and joins ids and surfaces back
by position. The table is bounded: when `most` words are in it, those met since it was
last full stay and others go, which changes no result. Models that normalise text or whose pieces cross markers are encoded
whole.

Why the table is kept in the task: exploded words of 1 GB of documents are some
270 million rows, whose shuffle alone would take over four times the input on disk.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_slices, quoted

MARK = "▁"


def model_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def separable(model: bytes) -> bool:
    """Whether marked words can be segmented alone: BPE, text taken as it is, a marker
    put in front, and no piece with a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model)
    n, kinds = m.normalizer_spec, m.SentencePiece
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    pieces = [p.piece for p in m.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
    defined = any(p.type == kinds.USER_DEFINED for p in m.pieces)
    return plain and not defined and not m.trainer_spec.treat_whitespace_as_suffix and m.trainer_spec.model_type == m.trainer_spec.BPE and not any(MARK in p.lstrip(MARK) for p in pieces)


class Codec:
    """Encodes texts and decodes their ids as the model's library does."""

    def __init__(self, model: bytes, end: bool = True, most: int = 150_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_word, self.end, self.most = separable(model), [self.sp.eos_id()] if end else [], most
        self.ids: dict[str, str] = {}  # the table of distinct marked words
        self.before: dict[str, str] = {}  # the table when it was last full
        self.surfaces: dict[str, str] = {}  # of words that aren't decoded to themselves for sure
        self.special = {i for i in range(self.sp.get_piece_size()) if self.sp.is_unknown(i) or self.sp.is_control(i) or self.sp.is_unused(i)}
        self.runs = re.compile(" +[^ ]*")

    def chunks(self, text: str) -> list[str]:
        """The marked words of a text, each without the first of its markers."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in self.runs.findall(" " + text)]
        return text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Segments words. Ordinary pieces and bytes are decoded to what they were cut from; the library
        decodes the rest."""
        odd = []
        for word, own in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            if not word:
                own = [self.sp.piece_to_id(MARK)]
            self.ids[word] = " ".join(map(str, own))
            if not self.special.isdisjoint(own):
                odd.append((word, own))
        for (word, _), surface in zip(odd, self.sp.decode([own for _, own in odd], num_threads=1) if odd else [], strict=True):
            self.surfaces[word] = surface

    def look_up(self, words: set[str]) -> None:
        """Sees to it that the table has all these words."""
        if len(self.ids) > self.most:
            self.before, self.ids = self.ids, {}
            self.surfaces = {w: s for w, s in self.surfaces.items() if w in self.before}
        new = words.difference(self.ids)
        if new and self.before:
            again = {w: self.before[w] for w in new if w in self.before}
            self.ids |= again
            new.difference_update(again)
        if new:
            self.learn(list(new))

    def __call__(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text: its ids as decimal text, their number, the decoded text."""
        if not self.by_word:
            ids = [x + self.end for x in self.sp.encode(texts, num_threads=1)]
            return [(" ".join(map(str, x)), len(x), d) for x, d in zip(ids, self.sp.decode(ids, num_threads=1), strict=True)]
        end, out = [" ".join(map(str, self.end))] if self.end else [], []
        for text in texts:
            words = self.chunks(text)
            distinct = set(words)
            self.look_up(distinct)
            ids = " ".join([*map(self.ids.__getitem__, words), *end])
            if any(map(self.surfaces.__contains__, distinct)):
                words = [self.surfaces.get(w, w) for w in words]
            out.append((ids, ids.count(" ") + 1 if ids else 0, " ".join(words)))
        return out


def tokenize(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per row of `docs`: the id column, n_tokens, ids (decimal, one space
    between), decoded. A null text counts as empty and gets the end id alone; a null id
    stays null; repeated rows are encoded each; other columns are not read."""
    model = model_bytes(model_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        codec = Codec(model, end)

        def work(ids, texts):
            done = codec([t or "" for t in texts])
            return [ids, [d[1] for d in done], [d[0] for d in done], [d[2] for d in done]]

        return work

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    out = map_slices(rows, make, f"id {kind}, n_tokens long, ids string, decoded string", rows=64)
    return out.select(F.col("id").alias(id_col), "n_tokens", "ids", "decoded")


def encode(docs: DataFrame, model_path: str, **kw) -> DataFrame:
    """The ids of each text as array<int>."""
    out = tokenize(docs, model_path, **kw)
    return out.selectExpr(quoted(out.columns[0]), "n_tokens", "cast(split(ids, ' ') as array<int>) as ids")


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids; null ids give an empty text."""
    model = model_bytes(model_path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda keys, ids: [keys, sp.decode([x or [] for x in ids], num_threads=1)]

    rows = encoded.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(ids_col)).alias("ids"))
    return map_slices(rows, make, f"id {kind}, text string", rows=64).select(F.col("id").alias(id_col), "text")
