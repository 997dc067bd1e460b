"""URL filters against every rule held against every URL."""

import random
import re

import pytest

from vigil.llm import urlfilter

RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("com", "/de/", "allow"), ("b.a.com", "/", "block"), ("a.com", "/x/y", "allow"), ("com", "/ü", "block"),
         ("", "", "block"), (None, "/none", "allow"), ("net", None, "block"), ("skip.net", "/", None), ("a.b.c.d.e.net", "/q", "allow")]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = lower(host)
    best = None
    for h, p, v in rules:
        h, p = lower(h or ""), p or ""
        if v is not None and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), v == "block", h + p, v))
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [None, "", "no scheme.org/", "http://", "http://org", "http://ORG/", "https://x.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://example.org/en/2",
        "http://notexample.org/es/", "http://a.com/fr/?x=://org/", "http://b.a.com/de/", "http://c.b.a.com/x/y", "http://a.com/x/yz#/", "ftp://com/ü/ß", "http://x.com?/fr/",
        "http://u:p@a.com:80/fr/", "http://a.com./fr/", "http://.com/fr/", "http://a.b.c.d.e.net/q", "http://z.a.b.c.d.e.net/", "http://net", "http://a.b.org/\n/x",
        "http://" + "a." * 3000 + "com/fr/" + "x" * 100000, "://org/", "x://y://com/fr/"]


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", -1)
    rng = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "a.com", "b.a.com", "x.net", "com"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['/', '/es/', '/en/1', '/fr/', '/de/', '/x/y', ''])}{rng.choice(['', '7', '?q'])}" for _ in range(300)]
    urls += ["http://hot.example.org/es/9"] * 400
    rows = [(i % 50 if i % 7 else None, u, "own", i) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, key long")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = urlfilter.judge(pages, rules)
    assert out.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == [(p, u, k, *brute(u, RULES)) for p, u, _, k in rows]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted((r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, none, "block").collect()) == [
        ("", "", None, "block"), ("a.org", "/", None, "block"), ("a.org", "/", None, "block")]
    assert urlfilter.judge(pages.limit(0), spark.createDataFrame(RULES, none.schema)).count() == 0


def test_no_python_and_no_cross_join(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string").where("page_id > 0")
    rules = spark.sql("SELECT * FROM VALUES ('org', '/', 'allow') AS r(host, path, verdict)")
    plan = urlfilter.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
