"""URL rules against a plain reading of the definition, the model against numpy and on urls it has not seen."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from portlens.llm import urls

#: (url, host, path, rule)
CASES = [
    (None, "", "", None),
    ("", "", "", None),
    ("no scheme here", "", "", None),
    ("http://", "", "", None),
    ("HTTP://WWW.Example.COM/EN/1", "www.example.com", "/EN/1", None),
    ("http://example.com", "example.com", "", None),
    ("http://example.com/de/1?x=/en/", "example.com", "/de/1", "example.com/de/"),
    ("http://a.b.example.com/de/", "a.b.example.com", "/de/", "example.com/de/"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None),
    ("http://example.com/de", "example.com", "/de", None),
    ("http://example.com?/de/", "example.com", "", None),
    ("http://example.com#/de/", "example.com", "", None),
    ("https://example.net/en/7", "example.net", "/en/7", "example.net/en/"),
    ("https://example.net/fr/7", "example.net", "/fr/7", "net/"),
    ("https://example.net", "example.net", "", None),
    ("https://xexample.net/en/7", "xexample.net", "/en/7", "net/"),
    ("https://net/", "net", "/", "net/"),
    ("https://xnet/", "xnet", "/", None),
    ("https://example.net:80/en/", "example.net:80", "/en/", None),
    ("ftp://a.org/fr/http://b.net/", "a.org", "/fr/http://b.net/", "org/fr/"),
    ("x://y://z.net/", "y:", "//z.net/", None),
    ("http://É.Net/É?q", "É.net", "/É", "net/"),
    ("http://a.org/fr/\nnext line#x", "a.org", "/fr/\nnext line", "org/fr/"),
    ("http://\U0001f600.net/" + "a" * 100_000, "\U0001f600.net", "/" + "a" * 100_000, "net/"),
]
UNSEEN = {
    "block": "http://mega-casino.example/en/9 http://www.betting-tips.example/fr/8 http://xxx-videos.example/de/7 http://order-pills.example/es/6 http://spam-farms.example/5 http://ads-tracker.example/en/4 http://viagra-cheap.example/fr/3 http://adult-xxx.example/de/2 http://jackpot-casino.example/es/1 http://slots-casino.example/x",
    "allow": "http://town-hall.example/en/9 http://www.newspaper.example/fr/8 http://botany.example/de/7 http://rivers.example/es/6 http://m.thandle.example/5 http://blog.stones.example/en/4 http://literature.example/fr/3 http://observatory.example/de/2 http://orchard.example/es/1 http://www.thunder.example/x",
}


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(urls.labelled_urls(spark))


def _buckets(host, path):
    grams = []
    for mark, text in (("h", f"^{host}$" if host else ""), ("p", "".join("0" if c in "123456789" else c for c in path) + "$" if path else "")):
        grams += [mark + text[i : i + n] for n in urls.SIZES for i in range(len(text) - n + 1)]
    return list(dict.fromkeys(int(hashlib.md5(g.encode()).hexdigest()[:4], 16) for g in grams))


def test_rules_hosts_and_paths(spark, model):
    rows = [(i, c[0]) for i, c in enumerate(CASES)] + [(0, None), (None, "http://a.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("own") for c in ("host", "path", "decided", "score", "verdict", "html")})
    out = urls.judge(pages, model)
    got = out.collect()
    verdicts = {r: v for v, r in urls.RULES}
    for r in got:
        if r["page_id"] is not None:
            url, host, path, rule = CASES[r["page_id"]]
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == (verdicts[rule] if rule else "block" if r["score"] > 0.5 else "allow")
            want = model[0] + sum(model[1][b] for b in _buckets(host, path)) / max(1, len(_buckets(host, path))) ** 0.5
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-want)), rel=1e-9)
    assert len(got) == len(rows) and sum(r["page_id"] is None for r in got) == 1
    assert next(r["verdict"] for r in got if r["host"] == "") == "allow"
    assert urls.judge(pages.limit(0), model).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "Join"))


def test_longest_rule_wins_and_ties_go_to_the_longer_host(spark):
    rules = (("block", "b.c/x/"), ("allow", "a.b.c/"), ("allow", "c/x/y/z/"), ("block", "c/"))
    rows = spark.createDataFrame([("a.b.c", "/x/"), ("a.b.c", "/x/y/z/"), ("c", "/q")], "host string, path string")
    got = [r[0] and tuple(r[0]) for r in rows.select(urls.deciding_rule(F.col("host"), F.col("path"), rules)).collect()]
    assert got == [("a.b.c/", "allow"), ("c/x/y/z/", "allow"), ("c/", "block")]
    assert rows.select(urls.deciding_rule(F.col("host"), F.col("path"), ())).filter("true").count() == 3


def test_model_is_the_descent_that_it_says(spark, model):
    labelled = [(u, 1.0) for u in urls.BLOCKED] + [(u, 0.0) for u in urls.ALLOWED]
    cut = [(*_cut(u), y) for u, y in labelled]
    x = np.zeros((len(cut), urls.BUCKETS))
    for i, (host, path, _) in enumerate(cut):
        f = _buckets(host, path)
        x[i, f] = 1 / max(1, len(f)) ** 0.5
    y, w, b = np.array([c[2] for c in cut]), np.zeros(urls.BUCKETS), 0.0
    for _ in range(urls.ROUNDS):
        r = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w, b = w * (1 - urls.RATE * urls.PENALTY) - urls.RATE * (x.T @ r), b - urls.RATE * r.sum()
    assert model[0] == pytest.approx(b, rel=1e-9)
    assert np.abs(np.array(model[1]) - w).max() < 1e-9
    assert ((x @ w + b > 0) == (y == 1)).all()


def _cut(url):
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, slash, path = rest.partition("/")
    return host, slash + path


def test_unseen_urls(spark, model):
    rows = [(u, v) for v, text in UNSEEN.items() for u in text.split()]
    got = urls.judge(spark.createDataFrame(rows, "url string, page_id string"), model, rules=())
    assert sum(r["page_id"] == r["verdict"] for r in got.collect()) >= 18


def test_fit_without_rows_and_with_odd_ones(spark):
    schema = "url string, blocked boolean"
    assert urls.fit(spark.createDataFrame([], schema)) == (0.0, [0.0] * urls.BUCKETS)
    one = urls.fit(spark.createDataFrame([("", True), (None, True), ("http://a.b/", None)], schema), rounds=5)
    assert one[0] > 0 and not any(one[1])
    same = [("http://casino.test/", True), ("http://casino.test/", True), ("http://library.test/", False)]
    assert urls.fit(spark.createDataFrame(same, schema), rounds=5) == urls.fit(spark.createDataFrame(same[1:], schema), rounds=5)


def test_sql_says_the_same(spark, model):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = urls.judge(spark.read.parquet(f"{sf}/pages.parquet"), model).drop("score").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(urls.judge_sql()).fetchall()))
