import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import urls

URLS = [
    "https://example.org/es/a?x", "http://A.Example.ORG/en/12#f", "ftp://x.com/fr/", "ftp://x.com/de/?q=/", "nothing", None, "", "http://", "http://com", "http://com/de/x", "x://y://org/z", "http://notorg/", "http://org", "http://org/",
    "http://example.org?/es/", "http://a.b.example.org/es", "http://x.com/DE/", "//x.com/de/", "http://user@x.com:80/fr/", "http://x.com:80/fr/",
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, u) for k, u in enumerate(URLS)]
    return spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))


def brute(url, rules=urls.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:n].lower(), rest[n:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fit = []
    for verdict, rule in rules:
        h, p = urls.split_rule(rule)
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((len(rule), len(h), rule, verdict))
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def listed(df):
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in df.orderBy("page_id").collect()]


def test_brute_force(pages):
    assert listed(urls.judge_urls(pages)) == [brute(u) for u in URLS]


def test_join_way(spark, pages):
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, rule string")
    assert listed(urls.judge_urls(pages, rules, most=0)) == listed(urls.judge_urls(pages, rules)) == [brute(u) for u in URLS]


def test_sql_twin(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    r = con.execute(urls.OP6_SQL)
    cols = [d[0] for d in r.description]
    want = sorted(map(str, ({c: x for c, x in zip(cols, row, strict=True)} for row in r.fetchall())))
    got = sorted(map(str, ({c: row[c] for c in cols} for row in urls.op6_url_digests(spark, path).collect())))
    assert got == want


def array_of(rules, folder):
    return urls.DigestArray(urls.DigestArray.write(sorted((urls.digest(*urls.split_rule(r)), r, v) for v, r in rules), str(folder)))


def test_equal_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(urls, "digest", lambda host, path: 7)
    array = array_of(urls.RULES, tmp_path)
    assert [array.rule(j) if j >= 0 else None for j in array.find(["example.org", "com", "net"], ["/es/", "/de/", "/"])] == ["example.org/es/", "com/de/", None]


def test_many_rules_from_a_file(spark, tmp_path):
    rules = [("block" if k % 3 else "allow", f"h{k % 97}.example.net/p{k}é/") for k in range(3000)]
    array = array_of(rules, tmp_path)
    assert (np.diff(array.keys) >= 0).all() and len(list(tmp_path.iterdir())) == 1
    rows = [(k, f"https://a.h{k % 97}.example.net/p{k}é/x") for k in range(0, 3000, 7)] + [(-1, "https://h5.example.net/p6é/")]
    pages_ = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, rule string")
    for given in (rules, table):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages_, given).collect()}
        assert got == {**{k: (rules[k][1], rules[k][0]) for k, _ in rows if k >= 0}, -1: (None, "allow")}
    joined = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages_, table, most=0).collect()}
    assert joined == got


def test_digests_are_sparks(spark):
    rules = urls._sorted_rules(spark, urls.RULES).collect()
    assert {r["key"] for r in rules} == {urls.digest(*urls.split_rule(r)) for _, r in urls.RULES}


def test_odd_rows(spark, pages):
    twice = pages.unionByName(pages).withColumn("page_id", F.when(F.col("page_id") % 2 == 0, F.col("page_id")))
    long = spark.createDataFrame([(1, "http://org/" + "x" * 100_000)], "page_id long, url string")
    assert urls.judge_urls(twice).count() == urls.judge_urls(twice, spark.createDataFrame(list(urls.RULES), "verdict string, rule string"), most=0).count() == 2 * len(URLS)
    assert urls.judge_urls(long).first()["rule"] == "org/"


def test_no_rules_and_no_rows(spark, pages):
    assert {r["verdict"] for r in urls.judge_urls(pages, []).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0)).count() == 0
