"""Every operator on nulls, empty and very long texts, repeats, clashing and dotted names, and
no rows: the same rows as on a plain table."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm import bytepairs, caps, catalogue, chat, decontaminate, langid, licenses, minhash, pieces, quality, substrings, urls

LONG = " ".join(f"w{i % 997}" for i in range(40_000))
TEXTS = ["The small house by the road and the water of it " * 4, None, "", " \n ", "Une petite maison au bord de la route et de " * 4, LONG, "x" * 300_000, "The small house by the road and the water of it " * 4, "one"]
DOCS = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "en", None), (3, TEXTS[0], "en", "s1"), (0, TEXTS[0], "en", "s0"), (0, TEXTS[0], "en", "s0")]
VECTORS = [(0, [1.0, 0.0, 0.2], 1), (1, [1.0, 0.0, 0.2], 1), (2, [1.0, 0.01, 0.2], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [1.0, 0.0, 0.2], None), (None, [1.0, 0.0, 0.2], 1), (0, [1.0, 0.0, 0.2], 1), (9, [1.0, 0.0], 1)]
TURNS = [(i, t, ("user", "assistant", None, "odd")[t % 4], TEXTS[(i + t) % len(TEXTS)]) for i in range(4) for t in range(5)] + [(None, None, None, None), (1, 1, "assistant", "again"), (1, 1, "assistant", "again")]
PAGES = [(0, "http://a.net/x"), (1, None), (2, ""), (3, "http://www.org/fr/" + "y" * 20_000), (4, "x://"), (0, "http://a.net/x"), (None, "http://b.de/")]
ODD = ("_key", "_m0", "_c0", "a.b", "c`d", "id", "hash", "uid", "h", "c", "key", "rep", "bucket", "band", "n", "sig", "row", "path", "conv", "given", "tie", "w", "label_", "ws", "at", "win", "valid", "v", "cid", "part", "block", "judged", "e", "kept_")


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 0), (4, 1, 1), (5, 0, None), (None, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, TEXTS[0]), (2, None), (3, ""), (4, "one"), (None, "une petite maison")], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contaminated(d, items(s)),
    "langid": lambda s, d: langid.identify(d, langid.profiles(d)),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "substrings": lambda s, d: substrings.remove_repeats(d),
    "pieces": lambda s, d: pieces.tokenize(d, catalogue.tokenizer_path()),
    "bytepairs": lambda s, d: bytepairs.tokenize(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "quality": lambda s, d: quality.classify(d, labels(s)).select("doc_id", "p_good", "p_toxic", "accepted"),
    "licenses": lambda s, d: licenses.scan(d.withColumn("where", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))), id_col="doc_id", path_col="where", text_col="text"),
}


def same(spark, run, plain):
    odd = plain.select("*", *(F.lit(f"{c}!").alias(c) for c in ODD if c not in plain.columns))
    rows = lambda df: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
    want = rows(run(spark, plain))
    assert rows(run(spark, odd)) == want
    assert run(spark, plain.limit(0)).count() == 0
    return want


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    assert len(same(spark, OPERATORS[name], docs)) == len(DOCS)


def test_vectors(spark):
    got = same(spark, lambda s, d: caps.near_duplicates(d), spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int"))
    assert len(got) == len(VECTORS)


def test_conversations(spark):
    same(spark, lambda s, d: chat.turns(d), spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))


def test_pages(spark):
    assert len(same(spark, lambda s, d: urls.judge(d), spark.createDataFrame(PAGES, "page_id long, url string"))) == len(PAGES)


def test_names_of_the_read_columns(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumnsRenamed({"doc_id": "doc.id", "text": "a.text"})
    own = {"id_col": "doc.id", "text_col": "a.text"}
    n = len(DOCS)
    assert minhash.near_duplicates(docs, **own).columns[0] == "doc.id" and minhash.near_duplicates(docs, **own).count() == n
    assert substrings.remove_repeats(docs, carry=("lang",), **own).count() == n and pieces.tokenize(docs, catalogue.tokenizer_path(), **own).count() == n
    assert decontaminate.contaminated(docs, items(spark), **own).count() == n and langid.identify(docs, langid.profiles(docs, text_col="a.text"), **own).count() == n


def test_joins_with_hot_keys(spark, monkeypatch):
    from docloom.llm import common

    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 60 + [2] * 30 + list(range(3, 40)))], "k int, x int")
    table = spark.createDataFrame([(k, k * 10) for k in range(0, 40, 2)] + [(1, 5), (1, 6)], "k int, y int")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for hot, most in ((4096, 100), (4, 100), (4, 0), (1, 100)):
        monkeypatch.setattr(common, "HOT", hot)
        monkeypatch.setattr(common, "HOT_ROWS", most)
        assert sorted(map(tuple, common.split_join(rows, table, "k").collect())) == want
        assert sorted(map(tuple, common.split_join(rows, table, ["k"]).collect())) == want
    assert common.split_join(rows.limit(0), table, "k").count() == 0
