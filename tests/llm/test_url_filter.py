import re

from papyra.llm import queries, url_filter


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", rest).group()) if rest is not None else ""
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group() if rest is not None else ""
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


RULES = [*queries.URL_RULES, ("a.b.org", "", "block"), ("org", "/x/y/z", "block"), ("org", "/x/", "block"), ("net", "", "block"), ("com", "/fr/a", "block")]
URLS = [
    "http://ORG/", "https://a.b.org", "https://x.a.b.org/x/y/z/1?q#f", "http://org/x/yes", "http://example.org/es/1", "http://www.Example.org/en/12#t",
    "http://example.com/fr/abc", "http://example.com/fr", "http://xcom/fr/", "ftp://u@h.net:80/p", None, "", "no scheme", "://", "http://", "http://a..org/x/",
    "http://.com/de/", "http://example.org?x=/es/", "http://h/\nline", "x://y://net/", "http://net", "http://é.net/É",
]


def test_against_plain(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (0, URLS[0]), (None, URLS[3])]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in url_filter.judge(pages, rules).collect()]
    want = [(i, *plain(u, RULES)) for i, u in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_salted_hosts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SWEEP_ROWS", 3)
    rows = [(i, f"http://h{i % 3}.example.org/{'es' if i % 2 else 'en'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: plain(u, RULES) for i, u in rows}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge(pages, none).collect()] == [(1, "a.com", "/x", None, "allow")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = queries.op4_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_that_repeat_without_end(spark, monkeypatch):
    """A third of all rows are one row: dealt over many windows, given back in many runs."""
    monkeypatch.setattr(url_filter, "SWEEP_ROWS", 50)
    monkeypatch.setattr(url_filter, "AGAIN_ROWS", 64)
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block")], "host string, path string, verdict string")
    hot = [(None, "http://a.org/x/y")] * 500 + [(7, "http://b.org/")] * 64 + [(8, "http://b.org/")] * 65 + [(i, f"http://a.org/{i}") for i in range(100, 400)]
    got = {}
    for r in url_filter.judge(spark.createDataFrame(hot, "page_id long, url string"), rules).collect():
        k = (r["page_id"], r["rule"], r["verdict"])
        got[k] = got.get(k, 0) + 1
    assert got == {(None, "a.org/x", "block"): 500, (7, "org/", "allow"): 64, (8, "org/", "allow"): 65, **{(i, "org/", "allow"): 1 for i in range(100, 400)}}
