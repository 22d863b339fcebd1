import hashlib

import duckdb
import pytest

from quillstream.llm import merkle

from .common import FOLDER, ODD, frame, prose


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def slow_root(text):
    nodes = [sha(p) for p in (text or "").split("\n")]
    return sha("".join(sha("".join(nodes[i : i + merkle.SECTION])) for i in range(0, len(nodes), merkle.SECTION)))


def slow_next(rows):
    """Pairs of texts in order of ids; rows of one id must be equal."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


@pytest.mark.parametrize("range_rows", [2, 2000])
def test_odd_rows(spark, range_rows):
    got = sorted((tuple(r) for r in merkle.edited(frame(spark, ODD), range_rows=range_rows).select("id", "text", "next_text", "n_chars", "edited_text").collect()), key=str)
    want = []
    for i, text, following in slow_next(ODD):
        cut = len(text) // 4
        want.append((i, text, following, len(text), text[: len(text) - cut] + following[:cut]))
    assert got == sorted(want, key=str)
    for r in merkle.compare(frame(spark, ODD), range_rows=range_rows).collect():
        texts = {i: t for i, t in ODD}
        assert r["fingerprint"] == slow_root(texts[r["id"]])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def test_one_row_and_none(spark):
    (r,) = merkle.compare(frame(spark, [(1, "abcdefgh")])).collect()
    assert r["edited_sha256"] == sha("abcdefab") and r["near_next"] == 1.0
    assert merkle.compare(frame(spark, [])).count() == 0


def test_like_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{FOLDER}/documents.parquet'")
    want = sorted(con.sql(merkle.compare_sql()).fetchall())
    got = merkle.compare(spark.read.parquet(f"{FOLDER}/documents.parquet"), range_rows=17)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[5] > w[6] for w in want) > 0.98 * len(want)


def test_differing_branches(spark):
    lines = [prose(i, 12) for i in range(40)]
    other = lines.copy()
    other[3], other[25] = "x", "y"
    a, b = merkle.trees(frame(spark, [(1, "\n".join(lines)), (2, "same")])), merkle.trees(frame(spark, [(1, "\n".join([*other, "more"])), (2, "same")]))
    assert sorted(tuple(r) for r in merkle.differing_branches(a, b).collect()) == [(1, 0, 3), (1, 3, 25), (1, 5, 40)]
    assert merkle.trees(frame(spark, [(1, "a\nb")])).first()["root"] == slow_root("a\nb")


def test_native(spark):
    plan = merkle.compare(frame(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
