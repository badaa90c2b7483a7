import hashlib
import random
from struct import unpack

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bytepairs, catalogue

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DATA = bytepairs.rank_bytes(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytepairs.read_ranks(DATA), special_tokens={})
CODEC = bytepairs.Codec(DATA, PATTERN)


def encoded(codec, text):
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode()
    return list(unpack(f"<{len(ids) // 4}I", ids))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ab\n\t\r'stre1½²Ⅷ_é漢😀.\x1c\x85\xa0\u2028\u200b\u0301\u088f")), max_size=60) | st.text(max_size=60))
def test_codec_is_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoded(CODEC, text) == LIBRARY.encode_ordinary(text)


def test_characters_that_tables_differ_in():
    import unicodedata

    late = [chr(i) for i in range(128, 0x20000) if unicodedata.category(chr(i)) == "Cn"][::37]
    for c in late:
        for text in (f"a{c}b", f"1{c}2", f"!{c} {c}"):
            assert encoded(CODEC, text) == LIBRARY.encode_ordinary(text)


def test_long_chunks_and_small_tables():
    small = bytepairs.Codec(DATA, PATTERN, most=3)
    small.merges.pairs.most = 3
    r = random.Random(2)
    for _ in range(150):
        text = "".join(r.choice(["a", "b", "the", "ing", "-", "=", " ", "  ", "\n", "é"]) * r.randint(1, 9) for _ in range(r.randint(0, 60)))
        assert encoded(small, text) == LIBRARY.encode_ordinary(text)
    for text in ("a" * 30_000, "abc" * 10_000, " " * 20_000, "=-" * 9_000):
        assert encoded(CODEC, text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(6))
def test_made_up_ranks(seed):
    """Ranks in any order, so that tokens can be merged from parts of higher ranks, or never."""
    r = random.Random(seed)
    words = {"".join(r.choice("abc") for _ in range(r.randint(2, 6))) for _ in range(40)}
    ranks = {bytes([i]): i for i in range(256)} | {w.encode(): 256 + i for i, w in enumerate(r.sample(sorted(words), len(words)))}
    library = tiktoken.Encoding("made", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bytepairs.Merges(ranks)
    for _ in range(1500):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 16)))
        assert own.segment(text) == library.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, "Hello  world's ", "x"), (2, None, "x"), (3, "", None), (None, "a", None), (1, "Hello  world's ", "x"), (4, "wordé " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "n_tokens")
    out = bytepairs.tokenize(docs, PATH, PATTERN)
    want = [(i or 0, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    got = [(r.doc_id or 0, list(unpack(f"<{r.n_tokens}I", r.ids)), bytes(r.decoded)) for r in out.collect()]
    assert sorted(got) == sorted(want)
    back = bytepairs.decode(out, PATH)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back.collect()) == sorted((i, d) for i, _, d in want)
    assert bytepairs.tokenize(docs.limit(0), PATH, PATTERN).count() == 0
    assert {r.decoded for r in bytepairs.tokenize(docs, PATH, PATTERN, decoded=False).collect()} == {None}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)), digest((r.text or "").encode())))
    assert sorted(map(tuple, catalogue.op11_byte_bpe(spark, folder).collect())) == sorted(want)
