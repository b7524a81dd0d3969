import re

from cases import PAGES, none, page

from shiftledger.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://x.net", "http://x.net/", "HTTPS://WWW.Example.NET/en/1?x#y", "http://example.net/en",
    "http://example.com/de/1", "http://a.b.example.com/de/", "http://notexample.com/de/x", "http://x.org/fr/?q=://y", "http://org/fr/z",
    "http://x.org/fr", "ftp://net/a", "http://.net/", "http://a..net/b", "http://example.net?/en/", "http://É.NET/en/", "x://" + "a." * 300 + "net/" + "p/" * 900,
    "http://sub.example.net/en/q", "http://sub.example.net/en/q",
]


def judged(url, rules=urls.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_verdicts_equal_the_plain_ones(spark):
    rows = [page(k, u, "") for k, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, PAGES)
    found = urls.judge(pages, urls.rule_table(spark)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == [judged(u) for u in URLS]


def test_other_rules(spark):
    rules = (("net", "", "block"), ("x.net", "/a", "allow"), ("x.net", "/a", "block"), ("y.net", "/abc", "allow"), ("", "/", "block"))
    pages = spark.createDataFrame([page(k, u, "") for k, u in enumerate(["h://x.net/abc", "h://z.y.net/abcd", "h://y.net/ab", "h:///q", None])], PAGES)
    found = urls.judge(pages, urls.rule_table(spark, rules)).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in found] == [
        ("x.net/a", "block"), ("y.net/abc", "allow"), ("net", "block"), ("/", "block"), (None, "allow"),
    ]


def test_empty_tables(spark):
    assert urls.judge(none(spark, PAGES), urls.rule_table(spark)).count() == 0
    no_rules = urls.rule_table(spark).filter("false")
    found = urls.judge(spark.createDataFrame([page(1, "http://x.net/", "")], PAGES), no_rules).collect()
    assert [(r["rule"], r["verdict"]) for r in found] == [(None, "allow")]


def test_the_join_is_on_the_prefix_and_the_digest_confirms(spark, monkeypatch):
    """With one digit most prefixes are shared by several rules and expressions; the results stay the same."""
    rules = spark.createDataFrame([(f"h{k}.org", f"/{k % 3}/", "block") for k in range(60)] * 2, "host string, path string, action string")
    urls_ = [(k, f"http://a.h{k}.org/{k % 4}/x") for k in range(80)]
    pages = spark.createDataFrame(urls_, "page_id long, url string")
    expected = [(k, f"h{k}.org/{k % 3}/" if k < 60 and k % 4 == k % 3 else None) for k, _ in urls_]
    for prefix in (8, 1):
        monkeypatch.setattr(urls, "PREFIX", prefix)
        found = urls.judge(pages, rules)
        assert sorted((r["page_id"], r["rule"]) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line and "LeftOuter" in line]
    assert joins and all("rule_digest" not in line for line in joins)
