"""URL verdicts against SQL and a plain rule reading."""

from collections import Counter

import checker
from pyspark.sql import functions as F

from wireloom.llm import ORACLES, QUERIES, load
from wireloom.llm.url_filter import RULES, bloom_filter, canonical, url_filter

load()


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit) if fit else None


def test_query_equals_oracle(spark):
    ok, msg = checker.compare(spark, "op1", QUERIES["op1_url_filter"], ORACLES["op1_url_filter"], checker.connect())
    assert ok, msg


def test_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM:80/en/x?b=2&a=1&utm_source=q#f", "https://example.com/en/x/?a=1&b=2", "http://a.net/es/1", "http://a.net?x=/es/",
            "http://net/fr/", "http://net/fr", "ftp://h/p://q", "http://É.org/p/", "http://www.example.com/en/", "http://xexample.com/en/", "http://b.org/1?" + "k=v&" * 100_000, "http://b.org/2"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2 + [(None, "http://b.org/2")], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("block", F.lit(2))
    listed = spark.createDataFrame([("https://www.b.org/2/#x",), (None,), ("http://a.net/es/1",), ("http://b.org/2",)], "url string")
    got = url_filter(pages, listed).collect()
    want = []
    for r in pages.collect():
        h, p, rule = plain(r.url)
        want.append((r.page_id, h, p, rule[1] if rule else None, rule[2] if rule else "block" if r.url == "http://b.org/2" else "allow"))
    assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(want)
    assert url_filter(pages.limit(0), listed).collect() == []
    assert {r.verdict for r in url_filter(pages, listed.limit(0)).filter("rule is null").collect()} == {"allow"}


def test_canonical_and_filter(spark):
    df = spark.createDataFrame([("HTTP://www.A.org:443/x/?c=3&b=2&gclid=1#q",), ("http://a.org/x?b=2&c=3",), ("http://a.org/x?c=3&b=2",)], "url string")
    assert {r[0] for r in df.select(canonical(F.col("url"))).collect()} == {"a.org/x?b=2&c=3"}
    urls = spark.range(5000).selectExpr("concat('h/', id) as c")
    assert 0 < bloom_filter(urls, "c", 5000).count() <= 5000 * 16 // 248
