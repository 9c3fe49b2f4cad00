"""URL rules against a plain search of all rules, on both ways of joining."""
import pytest

from wirelake.llm import url_filter as uf

URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/x", "https://www.example.com/en/", "https://a.b.www.example.com/en/q?u=://z.net/es/", "http://x.net/es", "http://x.net/es/1#t", "x://net/fr/",
        "http://com/", "http://com", "http://notcom/", "http://a.com:80/", "http://a.org?x=http://b.com/", "http://a.com?/en/", "http://é.net/fr/ü", "http://a..com/", "http://.com/", "http://example.com/en/" + "y" * 5000,
        "http://h" + ".a" * 100 + ".com/", "javascript:://net/es/x", "http://a.com/\nb", "http://SUB.Example.com/private/a", "http://example.com/priv"]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("Example.com", "/priv", "block"),
         ("com", "/", "allow"), ("b.com", "/", "allow"), ("b.com", "/", "block"), (None, "/", "block")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h.lower() + p, max(a for x, y, a in RULES if x and x.lower() == h.lower() and y == p)) for h, p, _ in RULES
            if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[2], best[3] if best else "allow")


@pytest.mark.parametrize("most", [100, 0])
def test_rules(spark, monkeypatch, most):
    monkeypatch.setattr(uf, "BROADCAST_RULES", most)
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(5, URLS[5], "h"), (None, URLS[4], "h")]
    d = uf.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string"), uf.rules_table(spark, RULES), "page_id")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in d.collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, _ in rows), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert uf.judge(d.limit(0), uf.rules_table(spark, RULES), "page_id").count() == 0
    assert [r["verdict"] for r in uf.judge(d, none, "page_id", default="block").collect()] == ["block"]


def test_hosts_of_very_many_labels(spark):
    rules = uf.rules_table(spark, [("com", "/", "allow"), ("b.example.com", "/x", "block"), ("a.a.a", "/", "block")])
    hosts = [".".join(["w"] * 50_000 + ["b", "example", "com"]), ".".join(["a"] * 50_000), "a.a", ".".join(["q"] * 50_000 + ["example", "com"]), "com"]
    d = spark.createDataFrame([(i, f"https://{h}/xy") for i, h in enumerate(hosts)], "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.judge(d, rules, "page_id", default="review").collect()}
    assert got == {0: ("b.example.com/x", "block"), 1: ("a.a.a/", "block"), 2: (None, "review"), 3: ("com/", "allow"), 4: ("com/", "allow")}
