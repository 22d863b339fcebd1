import duckdb
import pytest

from quillstream.llm import url_filter as u

from .common import FOLDER

URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://Example.COM/en/1?x=/es/"), (5, "https://www.example.com/en/2"), (6, "https://a.www.example.com/en/2"), (7, "http://shop.net/es/"), (8, "http://shop.net/fr/a#b"), (9, "http://net/es/x"),
    (10, "http://notnet/es/"), (11, "http://x.com"), (12, "http://x.com/"), (13, "http://example.com/EN/"), (14, "ftp://garden-news.example.org/de/5.html"), (15, "http://best-casino-poker.example.org/x"), (15, "http://best-casino-poker.example.org/x"),
    (16, "http://user@x.org:80/a?b://c"), (None, "http://x.com/a"), (17, "http://é.example.org/ü"), (18, "http://a.org/" + "x" * 5000), (19, "://"),
]


def slow(url):
    host, path = u.split_url(url)
    best = max(((h, p, v) for h, p, v in u.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)), key=lambda r: len(r[0] + r[1]), default=None)
    if best:
        return host, path, best[0] + best[1], best[2]
    w, bias = u.weights()
    return host, path, None, "block" if bias + sum(w[g] for g in u.grams(host, path)) >= u.BLOCK_AT else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, x, "html", "clash") for i, x in URLS], "page_id bigint, url string, html string, host string")


def test_like_brute_force(pages):
    got = sorted(((r["id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages).collect()), key=str)
    assert got == sorted(((i, *slow(x)) for i, x in URLS), key=str)


def test_verdicts(pages):
    got = {r["id"]: (r["rule"], r["verdict"]) for r in u.judge(pages).collect()}
    assert got[4] == ("example.com/en/", "block") and got[5] == ("www.example.com/en/", "allow") and got[6][1] == "allow"
    assert got[9] == ("net/es/", "block") and got[10][0] is None and got[11][0] is None and got[12] == ("com/", "allow")
    assert got[15] == (None, "block") and got[14] == (None, "allow") and got[1] == (None, "allow")


def test_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{FOLDER}/pages.parquet'")
    got = u.judge(spark.read.parquet(f"{FOLDER}/pages.parquet")).drop("probability")
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(con.sql(u.judge_sql()).fetchall(), key=str)


def test_held_out_names():
    w, bias = u.weights()
    logit = lambda url: bias + sum(w[g] for g in u.grams(*u.split_url(url)))
    assert all(logit(f"https://{n}.example.org/en/7") > u.BLOCK_AT for n in ("cheap-viagra-pills", "online-casino", "adult-cams", "spam-blogs", "torrents-free"))
    assert all(logit(f"https://{n}.example.org/en/7") < u.BLOCK_AT for n in ("botany", "bicycles", "newspaper", "schoolbook", "villages", "thingould"))


def test_native_and_empty(pages):
    plan = u.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert u.judge(pages.limit(0)).count() == 0
