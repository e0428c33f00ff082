import random

from mileglass.llm import url_filter as U

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
         ("allow", "a.example.com/de/"), ("block", "org/fr/"), ("allow", None), ("odd", "com/")]
SCHEMA = "page_id long, url string, host string, Verdict string"


def plain(url):
    """host, path, rule and verdict from the definition."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    fitting = []
    for verdict, rule in RULES:
        if rule is None or verdict == "odd":
            continue
        rule_host, rule_path = rule[:rule.index("/")], rule[rule.index("/"):]
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            fitting.append((len(rule), rule_host.count("."), verdict == "block", rule, verdict))
    return (host, path, *(max(fitting)[3:] if fitting else (None, "allow")))


def test_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.net", "EXAMPLE.net", "x.example.com", "a.example.com", "b.a.example.com", "badexample.com", "net",
             "é.net", "org", "q.org", ".net", "net.", "", "example.com"]
    paths = ["", "/", "/en", "/en/", "/EN/a", "/de/x/y", "/fr/", "?q=/en/", "#/de/", "/de/?a#b", "//fr/", "/fr/://net/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "example.net/en/", "://", "x" * 50_000, "http://n.net/" + "a/" * 20_000, "http://net/"] * 2
    rows = [(i if i % 9 else None, u, "clash", "clash") for i, u in enumerate(urls)]
    got = U.filter_urls(spark.createDataFrame(rows, SCHEMA).repartition(3), U.rule_table(spark, RULES))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = [(i, u, *plain(u)) for i, u, _, _ in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "x", "y")], SCHEMA)
    no_rules = spark.createDataFrame([], "rule string, verdict string")
    assert [r.verdict for r in U.filter_urls(pages, no_rules, default="block").collect()] == ["block"]
    assert U.filter_urls(pages.limit(0), U.rule_table(spark, RULES)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "https://www.example.net/en/x", "f", "u"), (2, None, "f", "u")], "page_id long, url string, found string, __u string")
    rows = U.filter_urls(df, U.rule_table(spark, RULES[:4])).orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(1, "https://www.example.net/en/x", "f", "u", "www.example.net", "/en/x", "example.net/en/", "allow"),
                                        (2, None, "f", "u", "", "", None, "allow")]
