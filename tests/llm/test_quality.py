import random

import numpy as np

from docloom.llm import quality

GOOD, JUNK, RUDE = "the of and with from that place water small house light road".split(), ["***", "!!!", "%%%", "###"], ["vorkash", "vorkel", "vorkimo", "vorkun"]


def corpus(n, seed=1):
    """id, text, source, n_chars, quality, toxic: junk has signs, rude texts a word with a
    telling start; one source is mostly junk."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad, toxic = r.random() < 0.2, r.random() < 0.2
        words = [r.choice(GOOD) for _ in range(r.randint(20, 80))]
        if bad:
            words = [w + r.choice(JUNK) for w in words]
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(RUDE) + r.choice("abcd")
        text = " ".join(words)
        out.append((i, text, "farm" if bad and r.random() < 0.8 else r.choice(("a", "b")), len(text), int(not bad), int(toxic)))
    return out


def judged(spark, rows, labels, extra=()):
    docs = spark.createDataFrame([(*r[:4], "en") for r in rows] + list(extra), "doc_id long, text string, source string, n_chars long, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return quality.classify(docs, known).collect()


def test_held_out_accuracy(spark):
    rows = corpus(900)
    got = {r.doc_id: r for r in judged(spark, rows, [(r[0], r[4], r[5]) for r in rows if r[0] % 3])}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([(got[r[0]].p_good > 0.5) == bool(r[4]) for r in held]) > 0.97
    assert np.mean([(got[r[0]].p_toxic > 0.5) == bool(r[5]) for r in held]) > 0.97
    assert np.mean([got[r[0]].accepted == bool(r[4] and not r[5]) for r in held]) > 0.97


def test_edges(spark):
    rows = corpus(300)
    labels = [(r[0], r[4], r[5]) for r in rows] + [(0, 0, 1), (None, 1, 0), (5, None, None), (99_999, 1, 0)]
    extra = [(None, "the house", "a", 9, "en"), (901, None, None, None, None), (902, "", "new", -1, ""), (903, "the water road " * 20_000, "a", 1, "en"), (0, rows[0][1], "a", 1, "en")]
    got = judged(spark, rows, labels, extra)
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.p_good <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 903).p_toxic < 0.5


def test_one_class_or_no_labels(spark):
    rows = corpus(40)
    assert all(r.accepted and r.p_good == 1 and r.p_toxic == 0 for r in judged(spark, rows, []))
    assert all(r.p_good == 1 for r in judged(spark, rows, [(r[0], 1, r[5]) for r in rows]))
    assert judged(spark, [], []) == []


def test_missing_metadata_and_clashing_names(spark):
    docs = spark.createDataFrame([(r[0], r[1], 7, True) for r in corpus(60)], "doc_id long, text string, p_good int, accepted boolean")
    known = spark.createDataFrame([(r[0], r[4], r[5]) for r in corpus(60)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, known)
    assert out.columns == ["doc_id", "text", "p_good", "p_toxic", "accepted"] and out.count() == 60


def test_logistic_regression_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -1, 0.2] + 0.3)))).astype(float)
    w = quality.fit_logistic(x, y, steps=3000)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(np.column_stack([x, np.ones(400)]).T @ (p - y) / 400 + 1e-3 * np.append(w[:-1], 0)).max() < 1e-4


def test_the_cut_lies_between_the_classes():
    y = np.array([0] * 6 + [1] * 3)
    assert 0.1 <= quality._cut(np.array([0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.3, 0.8, 0.9]), y) < 0.2
    assert quality._cut(np.array([0.7] * 6 + [0.1] * 3), y) == 0.5
    assert quality._cut(np.array([0.001] * 6 + [0.002] * 3), y) == quality.LEAST_CUT


def test_views_exchange_pseudo_labels():
    """A view that learns from too few labels gains from what the other one is sure of."""
    rng = np.random.default_rng(1)
    y = (np.arange(60) % 2).astype(float)
    x = {"text": y[:, None] * 2 + rng.standard_normal((60, 1)) * 0.1, "meta": y[:, None] * np.ones((60, 2)) + rng.standard_normal((60, 2)) * 0.2}
    free = (rng.random(300) < 0.5).astype(float)
    pool = {"text": free[:, None] * 2 + rng.standard_normal((300, 1)) * 0.1, "meta": free[:, None] * np.ones((300, 2)) + rng.standard_normal((300, 2)) * 0.2}
    own, handed = quality.Training(quality.Head({}), x, y, np.arange(60) % 3 == 0), []

    def confident(turn, heads):
        for view in quality.VIEWS:
            classes = own.head.sure(view, quality._raw(getattr(own.head, view), pool[view]))
            at = np.flatnonzero(classes >= 0)
            handed.append((view, len(at)))
            yield own, view, {name: z[at] for name, z in pool.items()} | {"y": classes[at].astype(float)}

    quality.co_train([own], confident)
    chance = own.head.chance({v: quality._raw(getattr(own.head, v), x[v]) for v in quality.VIEWS})
    assert np.mean((chance > 0.5) == y) == 1
    assert len(handed) == 2 * quality.ROUNDS and any(n for _, n in handed)


def test_tokens_are_found_as_they_are_made():
    texts = [r[1] for r in corpus(40)] + ["", "Über straße ab abcd abcde abcdef ABCDEFG~ x~ --- a~~~", "_a b_ 12 1234567"]
    every = sorted(set().union(*map(quality.tokens, texts)))
    vocabularies = [{t: i for i, t in enumerate(every[::2])}, {t: i for i, t in enumerate(every[1::3])}]
    want = [[sorted(v[t] for t in quality.tokens(x) if t in v) for x in texts] for v in vocabularies]
    assert quality.Finder(vocabularies)(texts) == want


def brute(docs, labels, meta_cols):
    """p_good, p_toxic, accepted of each row of `docs` (dicts), by plain loops over all of it but
    for the logistic fits; labels must be fewer than LABELLED."""
    from zlib import crc32

    known = {}
    for i, q, t in labels:
        if i is not None:
            old = known.get(i, (None, None))
            least, most = [v for v in (old[0], q) if v is not None], [v for v in (old[1], t) if v is not None]
            known[i] = (min(least, default=None), max(most, default=None))
    known = {i: (None if q is None else 1 - q, t) for i, (q, t) in known.items() if q is not None or t is not None}
    sample = {}
    for d in docs:
        if d["id"] in known and (d["id"] not in sample or d["hash"] < sample[d["id"]]["hash"]):
            sample[d["id"]] = d
    order = sorted(sample, key=str)
    values = {c: sorted(sorted({d[c] for d in docs if d[c] is not None}, key=lambda v: (-sum(d[c] == v for d in docs), v))[: quality.VALUES]) for c in meta_cols}
    one = quality.VALUES + quality.BUCKETS

    def places(d):
        out = []
        for k, c in enumerate(meta_cols):
            if d[c] is not None:
                out.append(k * one + (values[c].index(d[c]) if d[c] in values[c] else quality.VALUES + crc32(d[c].encode()) % quality.BUCKETS))
        return out

    shapes = np.array([quality.shape(d["text"] or "") for d in docs])
    mean, deviation = shapes.mean(0), shapes.std(0) + 1e-6
    words = lambda d: quality.tokens(d["text"] or "")
    heads = []
    for j in range(2):
        ids = [i for i in order if known[i][j] is not None]
        own = {i: words(sample[i]) for i in order}
        yes, n = sum(known[i][j] or 0 for i in order), len(order)
        scored = []
        for token in set().union(*own.values()) if own and 0 < yes < n else ():
            seen = sum(token in w for w in own.values())
            a = sum(known[i][j] or 0 for i in order if token in own[i])
            part = lambda x, e: x * np.log(x / e) if x else 0.0
            g = round(part(a, seen * yes / n) + part(seen - a, seen * (n - yes) / n), 9)
            if seen >= 3 and g > 6:
                scored.append((-g, token))
        vocabulary = [t for _, t in sorted(scored)[: quality.TOKENS]]

        def text(rows):
            x = np.array([[float(t in words(d)) for t in vocabulary] + list(np.clip((np.array(quality.shape(d["text"] or "")) - mean) / deviation, -quality.CLIP, quality.CLIP)) for d in rows])
            return x.reshape(len(rows), len(vocabulary) + quality.SHAPES)

        def meta(rows):
            x = np.zeros((len(rows), one * len(meta_cols)))
            for i, d in enumerate(rows):
                x[i, places(d)] = 1
            return x

        head = quality.Head(dict.fromkeys(vocabulary))
        free = sorted((d for d in docs if d["id"] not in known), key=lambda d: d["tie"])
        views = {"text": text, "meta": meta}
        raw = lambda view, rows: quality._raw(getattr(head, view), views[view](rows)) if head.text is not None else np.zeros(len(rows))

        def confident(turn, heads):
            for view in quality.VIEWS:
                classes = head.sure(view, raw(view, free))
                taken = [(d, y) for d, y in zip(free, classes, strict=True) if y >= 0]
                assert all(sum(y == k for _, y in taken) <= quality.TAKEN for k in (0, 1))
                rows = [d for d, _ in taken]
                yield heads[0], view, {"text": text(rows), "meta": meta(rows), "y": np.array([y for _, y in taken], float)}

        rows = [sample[i] for i in ids]
        own_rows = quality.Training(head, {"text": text(rows), "meta": meta(rows)}, np.array([known[i][j] for i in ids], float), np.array([d["held"] for d in rows], bool))
        quality.co_train([own_rows], confident)
        heads.append((head, head.chance({view: raw(view, docs) for view in quality.VIEWS})))
    (bad, p), (toxic, q) = heads
    return [(1 - a, b, bool(a < bad.cut and b < toxic.cut)) for a, b in zip(p, q, strict=True)]


def test_the_query_against_brute_force(spark, tmp_path):
    """Rows with hidden labels, several texts of an id, nulls, over 64 sources."""
    from pyspark.sql import functions as F

    from docloom.llm import catalogue

    rows = [(i, t, "en" if i % 3 else None, s if i % 2 else f"site{i}", n) for i, t, s, n, _, _ in corpus(260)]
    rows += [(7, "another text of seven", "de", "a", 1), (None, "the house *** of", "en", "farm", 2), (901, None, None, None, None), (902, "", "fr", "b", 0)]
    labels = [(r[0], r[4], r[5]) for r in corpus(260) if r[0] % 3] + [(1, 0, None), (None, 1, 0), (4, None, None), (9999, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    hashed = df.select("*", F.xxhash64("text", "source", "lang").alias("hash"), F.xxhash64("doc_id", "text", "source", "lang").alias("tie"), (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)) == 0).alias("held")).collect()
    docs = [{"id": r.doc_id, "text": r.text, "source": r.source, "lang": r.lang, "hash": r.hash, "tie": r.tie, "held": r.held} for r in hashed]
    want = {d["tie"]: w for d, w in zip(docs, brute(docs, labels, ["source", "lang"]), strict=True)}
    got = quality.classify(df, spark.read.parquet(f"{tmp_path}/labels.parquet")).withColumn("tie", F.xxhash64("doc_id", "text", "source", "lang")).collect()
    assert len(got) == len(docs)
    for r in got:
        a, b, ok = want[r.tie]
        assert abs(r.p_good - a) < 1e-5 and abs(r.p_toxic - b) < 1e-5 and r.accepted == ok, (r, want[r.tie])
    query = {(r.doc_id, round(r.p_good, 6), r.kept) for r in catalogue.op4_quality(spark, str(tmp_path)).collect()}
    assert query == {(r.doc_id, round(r.p_good, 6), r.accepted) for r in got}


def test_names_and_order_make_no_difference(spark):
    rows = corpus(200)
    known = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    odd = spark.createDataFrame([(*r[:3], 1, "x", "y", "z") for r in reversed(rows)], "doc_id long, text string, source string, _m0 int, `a.b` string, judged string, `c``d` string")
    out = quality.classify(odd, known)
    assert out.columns == [*odd.columns, "p_good", "p_toxic", "accepted"]
    of = lambda df: {r.doc_id: (round(r.p_good, 9), round(r.p_toxic, 9)) for r in df.select("doc_id", "p_good", "p_toxic").collect()}
    assert of(out) == of(quality.classify(plain, known))
