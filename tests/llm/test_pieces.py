import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.Codec(pieces.model_bytes(PATH))


def expected(text):
    ids = LIBRARY.encode(text, add_eos=True)
    return " ".join(map(str, ids)), len(ids), LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁ab\n\té漢😀.;}\r<>s/0x\x00")), max_size=60) | st.text(max_size=60))
def test_codec_is_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC([text])[0] == expected(text)


def test_a_small_table_changes_nothing():
    codec = pieces.Codec(pieces.model_bytes(PATH), most=5)
    r = random.Random(3)
    for _ in range(200):
        text = " ".join("".join(r.choice("abcé\n") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 12)))
        assert codec([text])[0] == expected(text)


def test_rows_nulls_long_texts_and_clashing_columns(spark):
    long = "wordé " * 40_000
    rows = [(1, "Hello  world ", "x"), (2, None, "x"), (3, "", None), (None, "a", None), (1, "Hello  world ", "x"), (4, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "n_tokens")
    got = sorted(((r.doc_id or 0, r.ids, r.n_tokens, r.decoded) for r in pieces.tokenize(docs, PATH).collect()), key=str)
    assert got == sorted((((i or 0), *expected(t or "")) for i, t, _ in rows), key=str)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "Ein Satz,\nzwei Zeilen."), (2, "")], "doc_id long, text string")
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == [(1, "Ein Satz,\nzwei Zeilen."), (2, "")]


def test_empty_table(spark):
    assert pieces.tokenize(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
