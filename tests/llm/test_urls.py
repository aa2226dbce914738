import duckdb
from pyspark.sql import functions as F

from veilframe.llm import queries, urls

URLS = {
    "https://shop.example.net/x": ("shop.example.net", "/x", "net/", "block"),
    "https://Shop.EXAMPLE.net/en/1?a#b": ("shop.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "http://a.org/fr/x://y": ("a.org", "/fr/x://y", "org/fr/", "allow"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://x.net": ("x.net", "", None, None),
    "http://x.net?q=/": ("x.net", "", None, None),
    "no scheme": ("", "", None, None),
    "://": ("", "", None, None),
    "http://ÄB.org/\nfr": ("Äb.org", "/\nfr", None, None),
    None: ("", "", None, None),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(URLS)] + [(0, next(iter(URLS)), "h", "t")], "page_id long, url string, host string, template string")
    got = urls.judge(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = list(URLS.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).collect() == []


def test_tree(spark):
    """Blocked labels under /a/ and /b/ merge and reject; /ok/ and what has no labels stay."""
    rules = (("block", "h.org", "/a/bad"), ("block", "h.org", "/b/bad"), ("allow", "h.org", "/ok/"))
    rows = [f"http://h.org/{s}/bad{i}" for s in "ab" for i in range(200)] + [f"http://h.org/ok/{i}" for i in range(300)]
    rows += [f"http://h.org/free/u{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert got[0]["template"] == "/a/bad#" and got[0]["verdict"] == "block"
    assert got[450]["template"] == "/ok/#" and got[450]["verdict"] == "allow"
    assert {got[700 + i]["template"] for i in range(60)} == {"/free/*"} and got[700]["verdict"] == "allow"
    counts = spark.createDataFrame([("h", "/a/#", 90, 100), ("h", "/b/#", 92, 100), ("h", "/c/#", 5, 100), ("g", "/a/#", 9, 10), ("g", "/b/#", 9, 10), ("g", "/n/#", 0, 0)], "host string, template string, blocked long, labelled long")
    assert {(r["host"], r["template"]) for r in urls.merged(counts).collect()} == {("g", "/a/#"), ("g", "/b/#")}


def test_native(spark):
    plan = queries.op7_urls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query(spark):
    got = queries.op7_urls(spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert got.where(F.col("verdict").isNull()).count() == 0


def test_labels_reach_urls_without_a_rule(spark):
    """Unlabelled urls take the labels of a merged branch, of their host, then of parent hosts."""
    rules = (("block", "bad.com", "/a/"), ("block", "h.org", "/x/p/"), ("block", "h.org", "/x/q/"), ("allow", "h.org", "/ok/"))
    rows = [f"http://bad.com/a/{i}" for i in range(300)] + ["http://bad.com/free/1", "http://sub.bad.com/free/1", "http://else.net/free/1"]
    rows += [f"http://h.org/x/{s}/{i}" for s in "pq" for i in range(250)] + [f"http://h.org/ok/{i}" for i in range(500)] + ["http://h.org/x/r/1", "http://h.org/y/r/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = {rows[r["page_id"]]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got["http://bad.com/free/1"] == got["http://sub.bad.com/free/1"] == (None, "block")
    assert got["http://h.org/x/r/1"] == (None, "block")
    assert got["http://h.org/y/r/1"] == got["http://else.net/free/1"] == (None, "allow")


def test_deep_siblings_merge(spark):
    counts = spark.createDataFrame([("g", "/s/a/#", 9, 10), ("g", "/s/b/#", 9, 10), ("g", "/s/n/#", 0, 0)], "host string, template string, blocked long, labelled long")
    assert {(r["template"], r["depth"], r["branch"]) for r in urls.merged(counts).collect()} == {(f"/s/{x}/#", 2, "/s/*/#") for x in "ab"}


def test_a_label_counts_once_on_the_way(spark):
    """Ten labels of one template, far down a long host name, weigh no more than ten anywhere."""
    counts = spark.createDataFrame([("a.b.c.d", "/x/#", 10, 10), ("a.b.c.d", "/y/#", 0, 0), ("e", "/z", 0, 30)], "host string, template string, blocked long, labelled long")
    got = {r["template"]: r["purity"] for r in urls.purities(counts).collect()}
    assert abs(got["/y/#"] - (10 + 10 * 0.25) / 20) < 1e-12 and abs(got["/x/#"] - got["/y/#"]) < 1e-12


def test_rejects_on_the_real_table(spark):
    got = queries.op7_urls(spark, "/root/testdata/sf0.1").where(F.col("rule").isNull())
    n = {r["verdict"]: r["count"] for r in got.groupBy("verdict").count().collect()}
    assert n.get("block", 0) > 0 and n.get("allow", 0) > 0


def test_rows_against_sql(spark, tmp_path):
    hosts = ["a.net", "b.net", "example.com", "x.example.com", "d.org", "shop.io", "img.shop.io"]
    rows = [(i, f"https://{hosts[i % 7]}/{'de' if i % 3 else 'fr'}/item-{i % 40}/{'pqrstuvwxyz'[i % 11]}{i}?q={i}") for i in range(1500)]
    rows += [(None, None), (2000, ""), (2001, "no scheme"), (2002, "x://HOST"), (2003, "x://h//a//"), (2004, f"x://h/{'a/' * 50}")] * 2
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages"))
    got = urls.judge(spark.read.parquet(str(tmp_path / "pages"))).select("page_id", "host", "path", "rule", "verdict", "template").collect()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(urls.oracle()).fetchall()))
    assert {(r["rule"] is None, r["verdict"]) for r in got} == {(a, b) for a in (True, False) for b in ("allow", "block")}
