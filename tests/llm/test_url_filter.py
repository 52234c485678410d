import pytest

from fieldloom.llm import url_filter as uf

SCHEMA = "page_id long, url string, host string, template int"


def judged(spark, urls):
    rows = uf.judge(spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], SCHEMA)).collect()
    assert len(rows) == len(urls)
    return {r["page_id"]: r for r in rows}


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.COM/EN/1?q#f", "a.example.com", "/EN/1", "com/", "allow"), ("x://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"), ("http://www.example.com/en/z", "www.example.com", "/en/z", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/z", "a.www.example.com", "/en/z", "www.example.com/en/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("https://b.net/fr/x", "b.net", "/fr/x", "net/fr/", "block"), ("https://net/es/", "net", "/es/", "net/es/", "block"), ("https://b.net/fr", "b.net", "/fr", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"), ("http://a.com?x/", "a.com", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a\nb://c.net/es/\nd", "c.net", "/es/\nd", "net/es/", "block"), ("http://a.com:80/en/", "a.com:80", "/en/", None, "allow"), ("u://h.com/a://b", "h.com", "/a://b", "com/", "allow"),
    ("http://É.COM/x", "É.com", "/x", "com/", "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, [url])[0]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_templates(spark):
    urls = [f"http://s.net/{lang}/{i}" for i in range(60) for lang in ("en", "de", "es", "fr")] + [f"http://s.net/only{i}/x" for i in range(20)]
    urls += [f"http://k.net/es/{i}" for i in range(50)] + ["http://k.net/es"] * 2 + ["http://deep.org/" + "/".join("abcdefgh")] * 9 + ["http://long.org/" + "x" * 50_000]
    found = judged(spark, urls)
    by_url = {u: found[i] for i, u in enumerate(urls)}
    assert by_url["http://s.net/es/3"]["template"] == "/es|fr/*" and by_url["http://s.net/en/3"]["template"] == "/de|en/*"
    assert by_url["http://s.net/en/3"]["verdict"] == "allow" and by_url["http://s.net/fr/9"]["verdict"] == "block"
    assert by_url["http://s.net/only3/x"]["template"].startswith("/*/")
    assert by_url["http://deep.org/" + "/".join("abcdefgh")]["template"] == "/a/b/c/d/e/f/g/h"


def test_impure_neighbours_are_rejected(spark):
    """Urls that no rule decides share the fate of a template that is nearly all blocked."""
    rules = (("bad.org", "/ads/", "block"),)
    urls = [f"http://bad.org/ads/{i}" for i in range(90)] + [f"http://bad.org/adz/{i}" for i in range(3)] + [f"http://fine.org/a/{i}" for i in range(90)]
    frame = spark.createDataFrame([(i, u, "", 1) for i, u in enumerate(urls)], SCHEMA)
    out = {r["page_id"]: r["verdict"] for r in uf.judge(frame, rules=rules).collect()}
    assert out[0] == "block" and out[100] == "allow"


def test_empty_table_and_plan(spark):
    assert uf.judge(spark.createDataFrame([], SCHEMA)).count() == 0
