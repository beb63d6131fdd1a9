import re

from conftest import SMALL
from doclake.llm import url_filters as U
from doclake.llm.queries import QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(url):
    host, path = parts(url)
    fits = [r for r in U.PLACE_RULES for h, p in [r.pattern.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        best = max(fits, key=lambda r: len(r.pattern))
        return host, path, best.pattern, best.action
    if not host and not path and (url is None or "://" not in url):
        return host, path, None, "allow"
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url)
    fits = [r for r in U.PATTERN_RULES if re.search(U.regex(r), low)]
    best = max(fits, key=lambda r: (len(r.pattern), r.action == "allow"), default=None)
    return host, path, None, best.action if best else "allow"


def test_query_matches_brute_force(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op7_url_filters"](spark, SMALL).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {
        k: brute(u) for k, u in urls.items()} and len(rows) == len(urls)


URLS = [None, "", "no scheme/net/", "http://net/", "http://NET", "https://a.b.Example.NET/en/x?y#z", "https://xexample.net/en/",
        "https://example.com/de/1", "https://example.com/DE/1", "ftp://org/fr/", "https://a.org/fr", "https://a.org?/fr/",
        "https://m.ads-track.example.com/en/1", "https://ads-track.example.org/fr/1", "https://x.org/ads/b", "https://x.org/adsx/b",
        "https://x.org/a?b=1&utm_campaign=3", "https://x.org/login", "https://x.org/login?next=/", "https://x.org/loginpage",
        "https://casino777.example.org/", "https://x.org/track/a/b/pixel.gif", "https://x.org/track/pixel?x", "https://docs.x.org/ads/",
        "https://x.org/a://net/", "https://user@net:80/x", "://net/", "http:///en/", "https://é.net/ü", "https://x.org/" + "a/" * 40_000 + "ads/",
        "https://x.org/robots.txt", "HTTPS://X.ORG/ADS/B", "https://x.org/a\nb/ads/"]


def test_cases_match_brute_force(spark):
    rows = [(i, u, "text", "mine") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None), (5, URLS[5], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judged(pages).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, *_ in rows), key=str)
    assert U.judged(pages.limit(0)).count() == 0


def test_rules_are_fetched_by_tokens_that_every_match_has():
    for rule in U.PLACE_RULES + U.PATTERN_RULES:
        for url in filter(None, URLS):
            low = url.lower()
            text = "".join(parts(url)) if rule.on == "place" else low
            if re.search(U.regex(rule), text):
                tokens = set(re.split("[^0-9a-z]+", low))
                assert set(U.literal_tokens(rule)) <= tokens


def test_many_rules_are_a_table(spark):
    urls = [f"https://site{i % 700}.example.org/path{i % 90}/x{i}?q=word{i % 13}" for i in range(300)] + URLS
    rules = [U.Rule(f"||site{i}.", "block") for i in range(0, 25_000, 2)] + [U.Rule(f"/path{i}/", "allow") for i in range(12_500)]
    rules += [U.Rule(f"=word{i}^", "block") for i in range(25_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = U.judged(pages, rules)
    plan = df._jdf.queryExecution().toString()
    assert len(plan) < 200_000 and "site24000" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

    def best(url):
        m = re.match(r"https://site(\d+)\.example\.org/path(\d+)/x\d+\?q=word(\d+)$", url or "")
        if not m:
            return None
        site, path_, word = map(int, m.groups())
        fits = [f"/path{path_}/", f"=word{word}^"] + [f"||site{site}."] * (site % 2 == 0)
        return max(fits, key=lambda p: (len(p), p.startswith("/path"), p))
    got = {r["page_id"]: r["pattern"] for r in df.collect()}
    assert got == {i: best(u) for i, u in enumerate(urls)}


def test_rules_without_tokens_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "https://x.org/abcdef"), (2, "https://y.org/")], "page_id long, url string")
    rules = [U.Rule("bcd", "block"), U.Rule("*cde*", "allow")]
    assert [U.literal_tokens(r) for r in rules] == [[], []]
    assert {r["page_id"]: (r["verdict"], r["pattern"]) for r in U.judged(pages, rules).collect()} == {
        1: ("allow", "*cde*"), 2: ("allow", None)}


def test_main_path_is_native(spark):
    plan = QUERIES["op7_url_filters"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
