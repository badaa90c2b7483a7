"""The queries of this subpackage, as __spark_entry__.py registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bytepairs, caps, chat, collocations, compaction, decontaminate, langid, licenses, minhash, pieces, quality, substrings, urls
from docloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, ws[i:i + 9] AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(win) AS k FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
m AS (
  SELECT p.doc_id, p.i, len(w.win) AS k, w.item_id
  FROM p JOIN lens ON p.i + lens.k - 1 <= len(p.ws) JOIN w ON w.win = p.ws[p.i:p.i + lens.k - 1]),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three quarters of the documents, by a hash of their id; judges all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    learned = langid.profiles(docs.where(~held))
    return langid.identify(docs, learned).select("doc_id", held.alias("held_out"), "lang_pred", "score")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, b: list_reduce(range(8), lambda t, i: xor(t >> 1, (t & 1) * 3988292384), xor(s, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 4 = 2 AS held_out,
    trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', chr(1), 'g'), chr(1)) AS bare, text IS NOT NULL AS there FROM documents),
c AS (SELECT doc_id, lang, held_out, list_transform(string_split(chr(1) || bare || chr(1), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS cs FROM d WHERE bare <> '' AND there),
p AS (SELECT doc_id, lang, held_out, cs, CAST(unnest(range(1, len(cs) + 1)) AS INT) AS i FROM c),
g AS (
  SELECT doc_id, lang, held_out, cs[i] AS code FROM p WHERE cs[i] <> 1
  UNION ALL SELECT doc_id, lang, held_out, cs[i] * 2097152 + cs[i + 1] FROM p WHERE i < len(cs)
  UNION ALL SELECT doc_id, lang, held_out, (cs[i] * 2097152 + cs[i + 1]) * 2097152 + cs[i + 2] FROM p WHERE i < len(cs) - 1),
n AS (SELECT doc_id, code, any_value(lang) AS lang, any_value(held_out) AS held_out, count(*) AS n FROM g GROUP BY doc_id, code),
l AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS r FROM (SELECT lang, code, sum(n) AS n FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code) QUALIFY r < {langid.TOP}),
k AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS r FROM n QUALIFY r < {langid.TOP}),
m AS (SELECT doc_id, count(*) AS own FROM k GROUP BY doc_id),
s AS (SELECT k.doc_id, l.lang, sum(abs(k.r - l.r) - {langid.TOP}) AS less FROM k JOIN l USING (code) GROUP BY k.doc_id, l.lang),
a AS (SELECT m.doc_id, x.lang, m.own * {langid.TOP} + coalesce(s.less, 0) AS away, m.own FROM m CROSS JOIN (SELECT DISTINCT lang FROM l) x LEFT JOIN s ON s.doc_id = m.doc_id AND s.lang = x.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) AS k FROM a)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - CAST(b.away AS DOUBLE) / (b.own * {langid.TOP}), 0.0) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1
"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = caps.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


OP3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
r(node, to_node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.y FROM r JOIN l ON r.to_node = l.x),
c AS (SELECT node, min(to_node) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_good", "p_toxic", F.col("accepted").alias("kept"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def _op6_sql() -> str:
    """The rules, then each order's smoothed probabilities from those of the order below."""
    low = f"(1 / {urls.ALPHABET})"
    fits = lambda h, path: f"((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{path}'))"
    ranked = sorted(urls.RULES, key=lambda r: -len(r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(*r[1].split('/', 1)[:1], '/' + r[1].split('/', 1)[1])} THEN '{pick(r)}'" for r in ranked) + " END"
    orders = ""
    for k in range(urls.ORDER + 1):
        below = f"{low} AS gl, {low} AS bl" if k == 0 else "p.gp AS gl, p.bp AS bl"
        join = "" if k == 0 else f" JOIN p{k - 1} p ON p.g = substr(o{k}.g, 2)"
        orders += f"""
o{k} AS (SELECT right(w, {k + 1}) AS g, sum(good) AS good, sum(bad) AS bad FROM w GROUP BY 1),
s{k} AS (SELECT o{k}.g, good, bad, {below}, sum(good) OVER c AS ga, sum(bad) OVER c AS ba, count(CASE WHEN good > 0 THEN 1 END) OVER c AS gk, count(CASE WHEN bad > 0 THEN 1 END) OVER c AS bk FROM o{k}{join} WINDOW c AS (PARTITION BY left(o{k}.g, {k}))),
p{k} AS (SELECT g, CASE WHEN ga > 0 THEN (good + gk * gl) / (ga + gk) ELSE gl END AS gp, CASE WHEN ba > 0 THEN (bad + bk * bl) / (ba + bk) ELSE bl END AS bp FROM s{k}),"""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, {case(lambda r: r[1])} AS rule, {case(lambda r: r[0])} AS action FROM b),
u AS (SELECT url, action, count(*) AS n, CAST('0x' || substr(md5(url), 1, 4) AS INT) % 5 <> 0 AS learns FROM r GROUP BY ALL),
f AS (SELECT url, CASE WHEN learns AND action = 'allow' THEN n ELSE 0 END AS good, CASE WHEN learns AND action = 'block' THEN n ELSE 0 END AS bad FROM u),
e AS (SELECT url, good, bad, substr(repeat(chr(2), {urls.ORDER}) || url || chr(3), CAST(unnest(range(1, length(url) + 2)) AS INT), {urls.ORDER + 1}) AS w FROM f),
w AS (SELECT w, sum(good) AS good, sum(bad) AS bad FROM e GROUP BY w),{orders}
sc AS (SELECT e.url, avg(ln(gp) - ln(bp)) AS score FROM e JOIN p{urls.ORDER} p ON p.g = e.w GROUP BY e.url),
h AS (SELECT CAST(floor(greatest(-{urls.LIMIT}, least({urls.LIMIT}, score)) / CAST({urls.BIN} AS DOUBLE)) AS BIGINT) AS k, sum(CASE WHEN action = 'allow' THEN n ELSE 0 END) AS good, sum(CASE WHEN action = 'block' THEN n ELSE 0 END) AS bad FROM sc JOIN u USING (url) WHERE NOT learns AND action IS NOT NULL GROUP BY 1),
t AS (SELECT k, sum(good) OVER () AS g, sum(bad) OVER () AS b, coalesce(sum(good) OVER z, 0) AS gb, coalesce(sum(bad) OVER z, 0) AS bb FROM h WINDOW z AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT k * CAST({urls.BIN} AS DOUBLE) AS c FROM t WHERE g > 0 AND b > 0 ORDER BY CAST(g - gb AS DOUBLE) / CAST(g AS DOUBLE) + CAST(bb AS DOUBLE) / CAST(b AS DOUBLE) DESC, abs(k * CAST({urls.BIN} AS DOUBLE)), k DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN score >= coalesce((SELECT c FROM cut), 0) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM r JOIN sc USING (url)
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source and a language make up the directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.withColumn("_path", path), id_col="doc_id", path_col="_path", text_col="text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations. The roles of a quarter of them, by a hash of their id, are hidden from
    the model and recovered (held_out), the others are given."""
    rows = table(spark, sf_dir, "conversations")
    held = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 4 == 2
    out = chat.turns(rows.withColumn("role", F.when(~held, F.col("role"))))
    return out.select("conv_id", held.alias("held_out"), "turn", "role", "text", "rendered", "source_turn")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, to_node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.y FROM r JOIN e ON r.to_node = e.x),
c AS (SELECT node, min(to_node) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p WHERE win IN (SELECT win FROM r)),
g AS (SELECT doc_id, list(j) AS js FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(js, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bytepairs.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM d),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (
  SELECT lang, 1 AS k, ws[i] AS w1, '' AS w2, '' AS w3 FROM i
  UNION ALL SELECT lang, 2, ws[i], ws[i + 1], '' FROM i WHERE i < len(ws)
  UNION ALL SELECT lang, 3, ws[i], ws[i + 1], ws[i + 2] FROM i WHERE i < len(ws) - 1),
f AS (SELECT lang, k, w1, w2, w3, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
s AS (
  SELECT x.lang, x.w1, x.w2, x.w3, x.f AS a, l.f AS l, r.f AS r, 1 AS cut FROM f x
  JOIN f l ON l.lang = x.lang AND l.k = 1 AND l.w1 = x.w1
  JOIN f r ON r.lang = x.lang AND r.k = x.k - 1 AND r.w1 = x.w2 AND r.w2 = x.w3
  WHERE x.k > 1
  UNION ALL
  SELECT x.lang, x.w1, x.w2, x.w3, x.f, l.f, r.f, 2 FROM f x
  JOIN f l ON l.lang = x.lang AND l.k = 2 AND l.w1 = x.w1 AND l.w2 = x.w2
  JOIN f r ON r.lang = x.lang AND r.k = 1 AND r.w1 = x.w3
  WHERE x.k = 3),
c AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM s),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, cut) = 1),
t AS (SELECT lang, w1 AS u, w2 AS v, f FROM f WHERE k = 3 UNION ALL SELECT lang, w2, w3, f FROM f WHERE k = 3),
o AS (SELECT lang, u, v, max(f) AS f FROM t GROUP BY ALL),
kept AS (
  SELECT b.lang, CASE WHEN w3 = '' THEN w1 || ' ' || w2 ELSE w1 || ' ' || w2 || ' ' || w3 END AS phrase, a, l, r, score
  FROM b LEFT JOIN o ON b.w3 = '' AND o.lang = b.lang AND o.u = b.w1 AND o.v = b.w2 WHERE o.f IS NULL OR 100 * o.f < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compaction.compacted(table(spark, sf_dir, "clicks"))
    return out.withColumnsRenamed({"min_id": "min_click_id", "max_id": "max_click_id"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_language_id": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op6_url_filter": _op6_sql(), "op9_minhash": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op12_collocations": OP12_SQL}
