"""URL filters: allow and block rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell, contexts of up to four
characters) are counted from the URLs that rules accept and reject; a URL's score is
its log-likelihood difference over its length, and the threshold is calibrated on a
fifth of those URLs that the models have not seen. DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Stored, ascii_lower, quoted

#: (action, rule); a rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Characters of context in the longest order.
ORDER = 4
#: Probability floor: one over the characters there may be.
ALPHABET = 1024.0
#: Score tables of at most so many rows (under 100 bytes each) are broadcast whole;
#: beyond, those windows that make up 1/HOT of all text each are, and the rest is joined.
BROADCAST_ROWS = 400_000
HOT = 4096
#: Calibration: scores fall into bins of this width between -LIMIT and LIMIT.
BIN, LIMIT = 0.01, 20.0
START, END = "\x02", "\x03"


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def fitting(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent domain) and path, and its action; else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(slash + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _windows(urls: DataFrame) -> DataFrame:
    """The columns of `urls` but url, and w, each character of each URL behind its four
    predecessors. A URL is cut into its characters once, so the work grows with its length."""
    chars = F.split(F.concat(F.lit(START * ORDER), "url", F.lit(END)), "")
    each = F.transform(F.sequence(F.lit(1), F.size("_chars") - ORDER), lambda i: F.array_join(F.slice("_chars", i, ORDER + 1), ""))
    return urls.withColumn("_chars", chars).withColumn("w", F.explode(each)).drop("_chars", "url")


def key_of(url: Column) -> Column:
    """What stands for a URL in joins and sums, however long it is."""
    return F.md5(url.cast("binary"))


def ratio_table(urls: DataFrame) -> DataFrame:
    """w, n, llr for each distinct window of `urls` (url, n, good, bad): the log of its last
    character's probability after its context under the accepted model over that under
    the rejected one. good and bad say how often a URL counts for either model.

    Orders build on each other: an n-gram meets its context and its shorter suffix,
    so that no join has a key with more rows than there are characters.
    """
    seen = _windows(urls.select("url", "n", "good", "bad")).groupBy("w").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    base = Stored(seen).df
    below = None
    for order in range(ORDER + 1):
        grams = base.groupBy(F.expr(f"right(w, {order + 1})").alias("g")).agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        by = Window.partitionBy(F.expr(f"left(g, {order})"))
        for c in ("good", "bad"):
            grams = grams.withColumn(f"{c}_all", F.sum(c).over(by)).withColumn(f"{c}_kinds", F.count(F.when(F.col(c) > 0, 1)).over(by))
        if below is None:
            grams = grams.withColumn("good_low", F.lit(1 / ALPHABET)).withColumn("bad_low", F.lit(1 / ALPHABET))
        else:
            grams = grams.withColumn("_s", F.expr("substring(g, 2)")).join(below, "_s").drop("_s")
        for c in ("good", "bad"):
            smoothed = (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_low")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))
            grams = grams.withColumn(f"{c}_p", F.when(F.col(f"{c}_all") > 0, smoothed).otherwise(F.col(f"{c}_low")))
        below = grams.select(F.col("g").alias("_s"), F.col("good_p").alias("good_low"), F.col("bad_p").alias("bad_low"))
    return grams.select(F.col("g").alias("w"), "n", (F.log("good_p") - F.log("bad_p")).alias("llr"))


def score(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """key, score of distinct `urls` (key, url): the mean of its windows' log ratios."""
    rows = _windows(urls.select("key", "url"))
    if ratios.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(ratios), "w").select("key", "llr")
    else:
        total = ratios.agg(F.sum("n")).first()[0]
        hot = ratios.where(F.col("n") * HOT >= total).select("w", F.col("llr").alias("hot_llr"))
        marked = rows.join(F.broadcast(hot), "w", "left")
        rest = marked.where("hot_llr is null").join(ratios.where(F.col("n") * HOT < total), "w").select("key", "llr")
        met = rest.unionByName(marked.where("hot_llr is not null").select("key", F.col("hot_llr").alias("llr")))
    return met.groupBy("key").agg(F.avg("llr").alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score from which a URL is accepted: the cut between bins that makes the mean of
    both classes' hit rates largest on `scored` (score, good, bad), the one nearest to 0
    among equals; 0 where a class is missing."""
    bins = scored.groupBy(F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "score")) / BIN).alias("k")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("k").collect()
    good, bad = sum(r["good"] for r in bins), sum(r["bad"] for r in bins)
    if not good or not bad:
        return 0.0
    best, below_good, below_bad = (1.0, 0.0, 0.0), 0, 0
    choices = []
    for r in bins:
        choices.append(((good - below_good) / good + below_bad / bad, -abs(r["k"] * BIN), r["k"] * BIN))
        below_good, below_bad = below_good + r["good"], below_bad + r["bad"]
    best = max(choices)
    return best[2]


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """The id column, host, path, rule, verdict, score for each row of `pages`.

    A null url is judged as an empty one: no rule fits and the models decide. Repeated
    rows are judged each; a URL counts in the models as often as it occurs. Without
    accepted or without rejected URLs to learn from, the threshold is 0. Other columns
    are not read.
    """
    url = F.coalesce(F.col(quoted(url_col)), F.lit(""))
    rule, action = fitting(host(url), path(url), rules)
    rows = pages.select(F.col(quoted(id_col)).alias("id"), url.alias("url"), key_of(url).alias("key"), host(url).alias("host"), path(url).alias("path"), rule.alias("rule"), action.alias("action"))
    kinds = rows.groupBy("key").agg(F.first("url").alias("url"), F.first("action").alias("action"), F.count("*").alias("n"))
    learns = F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % 5 != 0
    count = lambda act, where: F.when((F.col("action") == act) & where, F.col("n")).otherwise(0)
    known = kinds.select("key", "url", "n", count("allow", learns).alias("good"), count("block", learns).alias("bad"), count("allow", ~learns).alias("held_good"), count("block", ~learns).alias("held_bad"))
    ratios = Stored(ratio_table(known)).df
    scored = Stored(score(known, ratios)).df
    held = scored.join(known.where("held_good + held_bad > 0").select("key", F.col("held_good").alias("good"), F.col("held_bad").alias("bad")), "key")
    cut = threshold(held)
    out = rows.join(scored, "key", "left")
    verdict = F.coalesce("action", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
