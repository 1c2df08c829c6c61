import random

from assay.llm import urlfilter
from assay.llm.queries import URL_RULES


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "example.org/es/1", "http://example.org/es/1", "HTTP://WWW.Example.ORG/es/", "http://example.org", "http://example.org?/es/",
    "http://example.org/en/12#x", "http://xexample.org/es/", "http://a.b.com/fr/", "http://com/de/x?y", "http://org/", "a://b://org/", "http://É.org/es/",
    "http://example.org/es/" + "x" * 50_000, "http://" + "a." * 300 + "org/",
]


def test_urls_match_brute_force(spark):
    random.seed(1)
    parts = (["http://", "https://", ""], ["", "www.", "a.b."], ["example.org", "org", "com", "net", "Example.com"], ["", "/es/", "/en/1", "/en/", "/fr/x", "/de/"], ["", "?q=/de/", "#f"])
    urls = URLS + ["".join(random.choice(p) for p in parts) for _ in range(300)]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, "http://org/", "h")] * 3 + [(None, "http://com/de/", "h")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    want = sorted(((i, *brute(u)) for i, u, _ in rows), key=str)
    assert sorted(map(tuple, urlfilter.judge(pages, rules).collect()), key=str) == want
    limit, urlfilter.BROADCAST_RULES = urlfilter.BROADCAST_RULES, 0
    try:
        assert sorted(map(tuple, urlfilter.judge(pages, rules).collect()), key=str) == want
    finally:
        urlfilter.BROADCAST_RULES = limit


def test_empty_tables_and_equal_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    kind = "host string, path string, verdict string"
    assert tuple(urlfilter.judge(pages, spark.createDataFrame([], kind)).first()) == (1, "a", "/b", None, "allow")
    both = spark.createDataFrame([("A", "/", "allow"), ("a", "/", "block"), (None, "/b", "allow")], kind)
    assert urlfilter.judge(pages, both).first().verdict == "block"
    assert urlfilter.judge(pages.limit(0), both).collect() == []
