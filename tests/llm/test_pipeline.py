import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import catalogue
from tests.llm import test_decontaminate, test_minhash, test_quality
from tests.llm.test_minhash import shingles
from tests.llm.test_substrings import brute as without_passages

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with a planted case for each stage, labels, and a benchmark of one item."""
    r = random.Random(6)
    place = tmp_path_factory.mktemp("sf")
    new = lambda n: [f"plain{r.randint(0, 10**6)}" for _ in range(n)]
    docs, labels = [], []
    for i in range(240):
        words = new(40)
        bad, toxic = i % 8 == 1, i % 8 == 2
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            words[5:8] = ["vorka", "vorkb", "vorkc"]
        docs.append((i, " ".join(words), "en", "s", 0))
        if i < 200:
            labels.append((i, int(not bad), int(toxic)))
    copy = docs[3][1].split(" ")
    copy[39] = "edited"
    passage, item = new(60), new(12)
    docs += [(500, docs[3][1], "en", "s", 0), (501, " ".join(copy), "en", "s", 0)]
    docs += [(510, " ".join(new(80) + passage), "en", "s", 0), (511, " ".join(passage + new(80)), "en", "s", 0)]
    docs += [(520, " ".join(new(30) + item + new(9)), "en", "s", 0), (530, None, None, None, None), (None, " ".join(new(50)), "en", "s", 1), (531, "", "en", "s", 0)]
    docs += [docs[5], docs[5], (7, docs[7][1], "en", "s", 77)]  # repeated rows, and one that differs elsewhere
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_stages_catch_what_is_planted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    good, single, rest, clean = seen
    assert not {i for i in good if i is not None and i < 240 and i % 8 in (1, 2)}
    assert {i for i in range(240) if i % 8 not in (1, 2)} <= set(good) and {None, 530, 531} <= set(good)
    assert 500 not in single and 501 not in single and 3 in single
    assert set(good) - set(single) == {500, 501}
    want = {i: t for i, _, n, t in without_passages(list(single.items())) if n}
    assert set(want) == {510, 511} and all(rest[i] == want.get(i, t) for i, t in single.items())
    assert set(rest) - set(clean) == {520}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in tokens.collect()} == set(clean)


def test_run_is_the_stages(spark, sf_dir):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 520 not in got and 3 in got and got[530] == 1


def brute(spark, sf_dir):
    """(doc_id, n_tokens, ids) by the brute-force forms of all five stages in a row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("*", F.xxhash64("text", "source", "lang").alias("hash"), F.xxhash64("doc_id", "text", "source", "lang").alias("tie"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("held")).collect()
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    judged = test_quality.brute([{"id": r.doc_id, "text": r.text, "source": r.source, "lang": r.lang, "hash": r.hash, "tie": r.tie, "held": r.held} for r in rows], labels, ["source", "lang"])
    left = [(r.doc_id, r.text) for r, (_, _, ok) in zip(rows, judged, strict=True) if ok]
    once = [x for i, x in enumerate(left) if x[0] is None or x not in left[:i]]
    component = {i: c for i, _, c in test_minhash.brute(once, 80)}
    left = [(i, t) for i, t in once if i is None or component[i] == i]
    left = [(i, text if n else next(t for j, t in left if j == i)) for i, _, n, text in without_passages(left)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in test_decontaminate.brute(left, items) if n}
    sp = sentencepiece.SentencePieceProcessor(model_file=catalogue.tokenizer_path())
    return sorted(((i, len(ids), ids) for i, t in left if i not in hit for ids in [sp.encode(t or "") + [sp.eos_id()]]), key=str)


def test_the_query_against_brute_force(spark, sf_dir):
    got = sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()), key=str)
    assert got == brute(spark, sf_dir)


ODD = {"_key": "k", "_gone": "g", "_m0": "m", "judged": "j", "a.b": "dot", "c`d": "tick", "uid": "u", "h": "h", "hash": "x", "key": "y", "id": "z", "spans": "s", "ws": "w", "_c0": "c"}


@pytest.mark.parametrize("at", range(5))
def test_stages_keep_columns_of_any_name(spark, sf_dir, at):
    """Clashing and dotted names, nulls, empty and very long texts, repeated rows, no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = spark.createDataFrame([(9000, " ".join(f"long{i}" for i in range(60_000)), "en", "s", 1), (9001, "x" * 500_000, None, None, None)], docs.schema)
    docs = docs.unionByName(long)
    stage = corpus_pipeline.STAGES[at][1]
    odd = docs.select("*", *(F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(k) for k, v in ODD.items()), F.array(F.lit(1)).alias("list"), F.create_map(F.lit("a"), F.lit(1)).alias("map"))
    plain = sorted(map(str, (tuple(r) for r in stage(spark, docs, sf_dir).collect())))
    out = stage(spark, odd, sf_dir)
    got = out.collect()
    if at < 4:
        assert out.columns == odd.columns
        assert all(r[k] == v + (str(r.doc_id) if r.doc_id is not None else "-") for r in got for k, v in ODD.items())
        assert sorted(str(tuple(r)[: len(docs.columns)]) for r in got) == plain
    else:
        assert sorted(map(str, (tuple(r) for r in got))) == plain
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_a_small_sieve_gives_the_same_rows(spark, sf_dir, monkeypatch):
    from docloom.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda: [sorted(map(str, (tuple(r) for r in corpus_pipeline.STAGES[at][1](spark, docs, sf_dir).collect()))) for at in (2, 3)]
    want = rows()
    monkeypatch.setattr(common, "LEAST_WORDS", 1)
    for most, bits in ((1, 0), (0, 4)):  # a full bitmap, then the keys themselves
        monkeypatch.setattr(common, "SIEVE_WORDS", most)
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        assert rows() == want


def test_near_duplicates_take_four_fifths(spark):
    a, b = (" ".join(f"w{i}" for i in range(50)), " ".join([*(f"w{i}" for i in range(48)), "x", "y"]))
    assert 0.85 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    other = " ".join(f"z{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (2, b), (2, other), (None, a)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()))) == sorted(map(str, [(1, a), (2, other), (None, a)]))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_queries_run(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0


def test_stages_on_many_copies_of_a_row(spark, tmp_path):
    """Every stage takes thousands of rows that repeat all their columns, without an id."""
    import random

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    r = random.Random(1)
    text = " ".join(f"v{r.randint(0, 10**7)}" for _ in range(500))
    copies = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", f"'{text}' as text", "'en' as lang", "'web' as source", f"cast({len(text)} as bigint) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.unionByName(copies), folder)
        n = out.where("doc_id is null").count()
        assert n == 3000 or name == "quality" and n == 0, name  # a judgement holds for all copies
