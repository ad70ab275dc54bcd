import re

from quayside.llm import registry, url_filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/", "block"), (None, "/x", "block")]
URLS = [
    "https://a.example.com/en/75?x=1", "http://EXAMPLE.com/en/7", "http://badexample.com/en/7", "https://x.net/de/8", "https://example.net/de/81#top", "https://example.net/fr/",
    "https://sub.b.org", "https://sub.b.org/", "no scheme.com/en/", "", None, "ftp://", "http:///en/x", "x://com/en/://net/de/", "https://a.com/EN/1", "https://a.com/en/\nline?q", "https://..com/en/1",
]


def brute(url):
    rest = (url or "").partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, *best


def test_rules(spark, monkeypatch):
    rules = spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)
    urls = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string")
    want = [(i, *brute(u)) for i, u in enumerate(URLS + URLS[:2])]
    for limit in (20_000, 0):  # broadcast, and joined by shuffle
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
        out = url_filter.match_rules(urls, rules)
        assert sorted((r.page_id, *r.judged) for r in out.collect()) == want
    assert url_filter.match_rules(urls.limit(0), rules).count() == 0
    assert {r.judged.verdict for r in url_filter.match_rules(urls, rules.limit(0)).collect()} == {"allow"}


def test_equal_rules_and_a_frequent_url(spark):
    rules = spark.createDataFrame([("a.com", "/xy", "block"), ("com", "/xyzz", "allow"), ("b.org", "/", "allow"), ("b.org", "/", "block")], url_filter.RULE_SCHEMA)
    urls = spark.createDataFrame([(1, "http://a.com/xyzz", "v"), (2, "http://b.org/q", "v")] + [(3, "http://a.com/xy", "v")] * 3000 + [(None, None, None)] * 40, "page_id long, url string, verdict string")
    got = {}
    for r in url_filter.match_rules(urls, rules).groupBy("page_id", "judged").count().collect():
        got[r.page_id] = (r.judged.rule, r.judged.verdict, r["count"])
    # Of rules of one length the last in order of host and path counts; equal rules resolve to block.
    assert got == {1: ("com/xyzz", "allow", 1), 2: ("b.org/", "block", 1), 3: ("a.com/xy", "block", 3000), None: (None, "allow", 40)}


#: The rules of the query's contract, written down apart from the code.
CONTRACT = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_rules_of_the_query(spark, tmp_path):
    import duckdb

    urls = {  # the rule that wins by the contract
        "https://a.com/en/1": 0, "https://sub.example.com/en/1": 0, "https://example.com/en/75": 1, "http://badexample.com/en/7": 0,
        "https://a.net/de/1": 2, "https://B.A.net/de/8": 2, "https://example.net/de/7": 2, "https://sub.example.net/de/81?q": 3,
        "https://a.org/es/": 4, "https://a.org/en/": None, "https://a.net/en/": None, "no scheme": None, None: None,
    }
    rows = [(i, u, None) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = [(i, *((None, "allow") if k is None else CONTRACT[k])) for i, k in enumerate(urls.values())]
    got = registry.op10_url_filter(spark, str(tmp_path)).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == want
    db = duckdb.connect()
    db.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert db.sql(f"select page_id, rule, verdict from ({registry.oracle_sql()['op10_url_filter']}) order by page_id").fetchall() == want
