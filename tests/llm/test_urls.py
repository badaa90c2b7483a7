from math import log

from docloom.llm import urls

SITES = ["http://good{0}.org/fr/{0}", "https://a.bad{0}.net/x{0}", "http://x.example.net/en/{0}", "https://Example.com/de/{0}?q", "http://plain{0}.com/en/{0}", "good{0}.org"]
ROWS = [(i, SITES[i % len(SITES)].format(i % 50)) for i in range(240)] + [(900, None), (901, ""), (902, "x://net/"), (903, "x://net"), (904, "a://b://org/fr/"), (905, "http://" + "z" * 5000 + ".net/"), (0, ROWS0 := SITES[0].format(0)), (None, ROWS0)]


def parsed(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def ruled(host, path):
    best = None
    for act, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = act, rule
    return best


def test_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "n") for i, u in ROWS], "page_id long, url string, host string")
    got = urls.judge(pages).collect()
    assert len(got) == len(ROWS)
    for r in got:
        url = next(u for i, u in ROWS if i == r.page_id)
        host, path = parsed(url)
        want = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want[1] if want else None)
        if want:
            assert r.verdict == want[0]
        assert r.verdict in ("allow", "block")


def test_ratio_is_the_smoothed_model(spark):
    known = [("ab", 2, 2, 0), ("abc", 1, 0, 1), ("xb", 3, 0, 0)]
    table = {r.w: r.llr for r in urls.ratio_table(spark.createDataFrame(known, "url string, n long, good long, bad long")).collect()}
    grams = {}
    for url, _, good, bad in known:
        s = urls.START * urls.ORDER + url + urls.END
        for i in range(len(url) + 1):
            w = s[i : i + urls.ORDER + 1]
            for k in range(urls.ORDER + 1):
                own = grams.setdefault(w[-k - 1 :], [0, 0])
                own[0] += good
                own[1] += bad

    def p(gram, c):
        low = p(gram[1:], c) if len(gram) > 1 else 1 / urls.ALPHABET
        same = [v[c] for g, v in grams.items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        total, kinds = sum(same), sum(x > 0 for x in same)
        return (grams[gram][c] + kinds * low) / (total + kinds) if total else low

    assert set(table) == {g for g in grams if len(g) == urls.ORDER + 1}
    for w, llr in table.items():
        assert abs(llr - (log(p(w, 0)) - log(p(w, 1)))) < 1e-9


def test_hot_windows_join_gives_the_same(spark, monkeypatch):
    known = spark.createDataFrame([(u, u, 1, i % 2, 1 - i % 2) for i, u in enumerate({u for _, u in ROWS if u})], "key string, url string, n long, good int, bad int")
    ratios = urls.ratio_table(known)
    one = {r.key: round(r.score, 9) for r in urls.score(known, ratios).collect()}
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(urls, "HOT", 16)
    assert one == {r.key: round(r.score, 9) for r in urls.score(known, ratios).collect()}


def test_empty_table_and_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.judge(pages.limit(0)).count() == 0
    plan = urls.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_work_grows_with_a_url_s_length(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        pages = spark.createDataFrame([(1, "http://a.net/" + "ab" * (n // 2)), (2, "http://www.org/fr/" + "é/x" * (n // 3)), (3, "http://other.de/" + "ab" * 30), (4, None)], "page_id long, url string")
        start = time.perf_counter()
        got = {r.page_id: r for r in urls.judge(pages).collect()}
        took.append(time.perf_counter() - start)
        assert (got[1].verdict, got[2].verdict, got[2].rule) == ("block", "allow", "org/fr/") and len(got) == 4
    assert took[1] < 20
