import random
import zlib

from pyspark.sql import functions as F

from docloom.llm import langid

WORDS = {"en": "the and that with from this have which there their".split(), "fr": "les des une que pour dans avec est sont mais".split(), "de": "der die und nicht ist das mit auch eine sich".split()}


def corpus(n=240):
    r = random.Random(5)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(8, 60))) + ".", lang) for i in range(n) for lang in [r.choice(list(WORDS))]]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus() + [(900, None, "en"), (901, "", "en"), (902, "12 34 ?!", "fr"), (903, "the und" * 20_000, None), (0, corpus()[0][1], corpus()[0][2]), (None, "the and that", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, code string")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    learned = langid.profiles(docs.where(~held))
    got = langid.identify(docs, learned).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[2] for r in rows}
    tested = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 30 and sum(r.lang_pred == true[r.doc_id] for r in tested) / len(tested) > 0.97
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_against_plain_python(spark):
    docs = spark.createDataFrame([(1, "ab Ab", "x"), (2, "cab!", "y"), (3, "bab", None)], "doc_id long, text string, lang string")

    def grams(text):
        text = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} "
        text = " ".join(text.split())
        text, out = f" {text} ", {}
        for k in (1, 2, 3):
            for i in range(len(text) - k + 1):
                if text[i : i + k].strip():
                    out[text[i : i + k]] = out.get(text[i : i + k], 0) + 1
        code = lambda s: sum((ord(c) if c != " " else 1) << (21 * (len(s) - 1 - j)) for j, c in enumerate(s))
        return sorted(out, key=lambda s: (-out[s], code(s)))

    ranked = {lang: {s: i for i, s in enumerate(grams(t))} for lang, t in (("x", "ab Ab"), ("y", "cab!"))}
    for row in langid.identify(docs, langid.profiles(docs)).collect():
        own = grams({1: "ab Ab", 2: "cab!", 3: "bab"}[row.doc_id])
        away = {lang: sum(abs(i - r[s]) if s in r else langid.TOP for i, s in enumerate(own)) for lang, r in ranked.items()}
        best = min(away, key=lambda k: (away[k], k))
        assert row.lang_pred == best and abs(row.score - (1 - away[best] / (langid.TOP * len(own)))) < 1e-9


def test_many_languages_in_blocks(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string, lang string")
    learned = langid.profiles(docs)
    one = sorted(map(tuple, langid.identify(docs, learned).collect()))
    assert one == sorted(map(tuple, langid.identify(docs, learned, block=1).collect()))


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(docs, langid.profiles(docs)).collect()] == [(1, "und", 0.0)]
    assert langid.identify(docs.limit(0), langid.profiles(docs)).count() == 0
