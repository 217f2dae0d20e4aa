import random

from gavelflow.llm import url_rules

PAGES = "page_id long, url string, x_key string, host string, html string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "k", "h", None) for i, u in urls], PAGES)


def plain(url, rules, default="allow"):
    """host, path, rule, verdict by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, default))
    return host, path, rule, verdict


def judged(spark, urls, rules, **more):
    return sorted(map(tuple, url_rules.judge(pages(spark, urls), url_rules.rule_table(spark, rules), **more).collect()), key=str)


def test_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http:///en/x", "http://a.net", "http://NET/x", "http://examplenet/", "http://a.example.net/en/", "http://a.example.net/en", "https://example.net/EN/1",
        "http://example.org/fr/x?y#z", "http://x.example.com/de/1", "http://x.example.com#/de/1", "http://a..net/", "http://a.net./", "http://a.net:80/", "ftp://b.net/://c.org/fr/", "x\ny://q.net/a\nb",
        "http://a\x01net/", "http://a\x00.net/", "http://É.net/é", "http://" + "a." * 300 + "net/" + "p" * 20_000,
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, "http://a.net/"), (9, urls[9])]
    want = sorted(((i, *plain(u, url_rules.RULES)) for i, u in rows), key=str)
    assert judged(spark, rows, url_rules.RULES) == want


def test_nested_rules_of_hosts_and_paths_against_every_rule(spark):
    r = random.Random(5)
    host = lambda: ".".join(r.choice(["a", "b", "ab", "c"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 5)))
    rules = list({(h, p): (h, p, r.choice(["block", "allow"])) for h, p in ((host(), path()) for _ in range(120))}.values())
    urls = [(i, f"http://{host()}{path()}?q") for i in range(600)] + [(i, "http://a.b.ab/xy/x") for i in range(1000, 1400)]
    want = sorted(((i, *plain(u, rules)) for i, u in urls), key=str)
    assert judged(spark, urls, rules) == want


def test_ties_doubles_and_no_rules(spark):
    rules = [("b", "/a", "allow"), ("b", "/a", "block"), ("a.b", "/", "allow"), ("b", "/x/", "allow")]
    assert judged(spark, [(1, "http://a.b/a"), (2, "http://b/a"), (3, "http://a.b/x/")], rules) == [(1, "a.b", "/a", "a.b/", "allow"), (2, "b", "/a", "b/a", "block"), (3, "a.b", "/x/", "a.b/", "allow")]
    none = url_rules.rule_table(spark).filter("false")
    assert [tuple(x) for x in url_rules.judge(pages(spark, [(1, "http://a.net/")]), none, default="block").collect()] == [(1, "a.net", "/", None, "block")]
    assert url_rules.judge(pages(spark, []), url_rules.rule_table(spark)).collect() == []


def test_no_python_on_the_way(spark):
    plan = url_rules.judge(pages(spark, [(1, "http://a.net/")]), url_rules.rule_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
