from passageway.llm.urlfilter import judge_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("b.org", "/x+(y", "block"), ("b.org", "", "allow")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/1?x=/es/", "http://www.example.com/en/", "http://www.example.com/en", "http://a.b.net/es/1", "http://net/es", "http://anet/es/",
    "x://b.org/x+(y/1", "x://b.org/xxy", "x://b.org", "x://bxorg/x", "x://a.org/b.org/x", "x://a.org?u=http://example.com/en/", "x://e.org/y://com/", "http://user@example.com/en/", "http://sub.example.com/en/a\nb", "http://example.com/english/",
]


def test_against_every_rule(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, host int")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = judge_urls(pages, rules)
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == [(i, *judged(u)) for i, u, _, _ in rows]
    assert judge_urls(pages.filter("false"), rules).count() == 0
