import itertools

from pyspark.sql import functions as F

from provspark.llm.url_query import RULES, op6
from provspark.llm.url_rules import judge


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))]
    fit = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules, default="allow"):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = df.withColumns({"host": F.lit(1), "verdict": F.lit("x"), "key": F.lit("k")})
    marks = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge(df, marks, default=default).collect()}
    assert got == {i: plain(u, rules, default) for i, u in enumerate(urls)}


def test_query_on_a_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: tuple(r)[1:] for r in op6(spark, sf).collect()}
    assert got == {r["page_id"]: plain(r["url"], RULES) for r in rows}


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://ORG", "HTTP://Example.ORG/es/x?q#f", "x://example.org?/es/", "a://b.example.org/es",
        "a://b.example.org/es/", "a://badexample.org/es/", "a://example.org./es/", "a://.org/", "a://a..org/", "a://org:80/", "a://u@org/",
        "a://example.org/en/1", "a://example.org/en/12", "a://example.org/en/2", "a://com/fr/", "a://x.com/de/#", "a://ÄÖ.org/ß",
        "a://example.org/es/://b.com/fr/", "a://" + "s." * 3000 + "org/", "a://com/" + "p" * 50000, "a://org\n/x", "a://o-g/", "a://org-x.com/de/",
    ]
    check(spark, urls + urls[:5], RULES)


def test_nested_rules_over_many_ranges_and_a_hot_host(spark):
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "a-b.example.org", "example.com", "com", "x.net"]
    urls = [f"http://{h}{p}{i}" for h, p, i in itertools.product(hosts, ["/", "/en/", "/en/x/", ""], range(6))]
    urls += ["https://hot.example.org/en/x/1"] * 400
    rules = [
        ("org", "/", "block"), ("example.org", "/en/", "allow"), ("a.example.org", "/", "block"), ("example.org", "/en/x/", "block"),
        ("com", "/en/", "block"), ("example.org", "", "allow"), ("b.a.example.org", "/en/", "allow"), ("example.org", "/", "allow"),
        ("example.org", "/", "block"),
    ]
    check(spark, urls, rules)
    check(spark, urls, rules[:1], default="block")


def test_no_rules_and_no_urls(spark):
    marks = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.b/c"), (None, "http://a.b/c")], "page_id long, url string")
    assert {tuple(r) for r in judge(df, marks).collect()} == {(1, "a.b", "/c", None, "allow"), (None, "a.b", "/c", None, "allow")}
    assert judge(df.limit(0), spark.createDataFrame(RULES, marks.schema)).collect() == []
