import numpy as np

from swipewatch.llm.urls import RULES, _bits, bloom_filter, judge_urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.com/en/x", "http://www.example.com/en", "http://a.www.example.com/en/1?q=/", "http://example.com/en/?x", "http://xexample.com/en/",
    "http://example.com?x=/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/de/", "x://y://example.com/en/", "http://com./", "http://É.com/ß", "http://" + "a." * 3000 + "com/" + "p" * 9000, "http://com", "http://.com/",
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:n].translate({c: c + 32 for c in range(65, 91)})
    path = rest[n:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_equals_plain_rule(frame):
    rules = [*RULES, ("com", "/", "allow"), (None, "/", "block"), ("y:", "", "block"), ("", "", "allow")]
    for listed in (rules, RULES, []):
        out = judge_urls(frame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string"), frame(listed, "host string, path string, verdict string"))
        rows = out.collect()
        assert len(rows) == 2 * len(URLS)
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, [x for x in listed if None not in x])


def test_names_and_empty(frame):
    rules = frame(RULES, "host string, path string, verdict string")
    out = judge_urls(frame([("http://a.net/es/", 1)], "url string, Rule int"), rules)
    assert out.columns == ["url", "Rule", "host", "path", "_rule", "verdict"] and out.first()._rule == "net/es/"
    assert judge_urls(frame([], "url string"), rules).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    words = bloom_filter(spark.range(5000).selectExpr("xxhash64(id) as h"), "h", 240)
    check = lambda df: np.mean([bool(((words[b] & m) == m).all()) for b, m in zip(*_bits(np.array([r.h for r in df.collect()]), 240), strict=True)])
    assert check(spark.range(5000).selectExpr("xxhash64(id) as h")) == 1
    assert check(spark.range(10000, 15000).selectExpr("xxhash64(id) as h")) < 0.05
