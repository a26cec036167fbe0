import random

from tallyframe.llm import url_filter
from tests.llm.helpers import rows, with_clashes


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, tail = lower(rest[:at]), rest[at:]
        path = tail[:min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    fits = []
    for verdict, rule in rules:
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), len(h), verdict == "block", rule, verdict))
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else "allow"


def urls():
    rnd = random.Random(5)
    out = [None, "", "no scheme", "http://", "://org/", "http:///x", "HTTP://EXAMPLE.ORG/es/", "http://example.org",
           "http://x.example.org/ES/", "http://notexample.org/es/1", "http://a.com/de", "http://com/de/#x",
           "http://com?/fr/", "http://b.com/fr/é" + "y" * 5000, "a://b://c/d", "http://x.org./", "http://..org/x"]
    for _ in range(300):
        host = rnd.choice(["example.org", "EXAMPLE.org", "a.example.org", "b.com", "com", "x.net", "y.org"])
        out.append(f"http://{host}" + rnd.choice(["", "/", "/es/", "/en/1", "/en/12", "/fr/", "/de/", "?q=/es/"]) +
                   rnd.choice(["", "x", "?a", "#b"]))
    return out


def check(spark, rules, **options):
    table = list(enumerate(urls())) + [(None, "http://example.org/es/"), (3, "http://com/de/"), (3, "http://com/de/")]
    pages = with_clashes(spark.createDataFrame(table, "page_id long, url string"), "html", "key", "block", "w0", "rule")
    got = rows(url_filter.judge(pages, url_filter.rule_table(spark, rules), **options),
               "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *brute(u, rules)) for i, u in table), key=repr)


def test_given_rules(spark):
    check(spark, url_filter.RULES)


def test_many_rules_and_the_shuffled_path(spark):
    rules = url_filter.RULES + [("block", f"h{i}.net/{'p' * (i % 7)}") for i in range(500)]
    rules += [("allow", "example.org/en/1"), ("block", "b.com/"), ("allow", "a.example.org/es/x")]
    check(spark, [r for r in rules if r != ("allow", "example.org/en/1")])
    check(spark, [r for r in rules if r != ("allow", "example.org/en/1")], broadcast_rules=10)


def test_no_rules_and_no_pages(spark):
    check(spark, [("block", "nowhere.example/")])
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.rule_table(spark)).count() == 0
    empty = spark.createDataFrame([], "verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, empty).collect()] == ["allow"]


def test_bloom_passes_all_listed(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) as key")
    bloom = url_filter.bloom_filter(keys, 250)
    assert url_filter.possible_hits(keys, bloom, 250).count() == 2000
    others = spark.range(20_000).selectExpr("concat('o', id) as key")
    assert url_filter.possible_hits(others, bloom, 250).count() < 1000


def test_very_long_urls(spark):
    """Keys do not grow with the labels of a host or the length of a path."""
    long_host = "a." * 10_000 + "example.org"
    urls = [f"http://{long_host}/en/1", "http://example.org/" + "x" * 1_000_000, "http://" + "y" * 1_000_000 + ".com/de/",
            "http://" + "." * 20_000 + "com/fr/x", "http://" + "b." * 300_000 + "org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in
           url_filter.judge(pages, url_filter.rule_table(spark)).select("page_id", "rule", "verdict").collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("org/", "allow"), 2: ("com/de/", "block"), 3: ("com/fr/", "allow"),
                   4: ("org/", "allow")}
