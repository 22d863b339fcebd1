import math

import pytest

from quillstream.llm import lm_score, queries
from quillstream.llm.support import read_table
from quillstream.session import ship

from .automaton import SuffixAutomaton
from .common import FOLDER, ODD, frame, prose

SMALL = {"block_words": 1000, "part_words": 500}


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def slow_phrases(words, texts, context=None):
    """Greedy longest matches; with a context, a match goes on while its last so many words occur."""
    runs = {tuple(t[i : i + n]) for t in texts for n in range(1, (context or len(words)) + 1) for i in range(len(t) - n + 1)}
    count = at = 0
    while at < len(words):
        n = 1
        if tuple(words[at : at + 1]) in runs:
            while at + n < len(words) and tuple(words[max(at, at + n + 1 - context) if context else at : at + n + 1]) in runs:
                n += 1
        at += n
        count += 1
    return count


def test_the_automaton_of_these_tests():
    texts = [prose(s, 60, 12).split() for s in range(4)]
    automaton = SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    for s in range(30):
        words = prose(100 + s, 40, 14).split()
        assert automaton.phrases(words) == slow_phrases(words, texts)
    assert automaton.phrases([]) == 0 and automaton.phrases(texts[2]) == 1


def test_own_phrases():
    assert [lm_score.own_phrases(t.split()) for t in ("", "a", "a a a a a a", "a b a b a b")] == [0, 1, 3, 4]


def corpus():
    """Texts over few words, so matches are long; copies, a repeated row, passages that overlap, the second half is reference text."""
    rows = [(i, prose(i, 20 + 3 * i, 6 + i % 9)) for i in range(40)]
    shared = prose(900, 30, 4)
    rows += [(40 + i, f"{prose(50 + i, 10, 9)} {shared[: 40 + 9 * i]} {prose(70 + i, 10, 9)}") for i in range(8)]
    rows += [(60, rows[39][1]), (61, rows[3][1]), (61, rows[3][1]), (62, "z1 z2 z3"), (63, rows[20][1] + " " + rows[30][1])]
    return rows


@pytest.mark.parametrize("context", [2, 3, 8])
def test_whole_score_like_brute_force(spark, context):
    rows = corpus()
    reference = {i for i, _ in rows if i >= 20}
    got = {(r["id"], r["n_words"]): r for r in lm_score.score(frame(spark, rows), frame(spark, [r for r in rows if r[0] in reference]), context=context, **SMALL).collect()}
    texts = [(i, t.split()) for i, t in rows]
    for at, (i, words) in enumerate(texts):
        r = got[i, len(words)]
        other = [t for j, (k, t) in enumerate(texts) if j != at]
        among = [t for j, (k, t) in enumerate(texts) if j != at and k in reference]
        assert r["phrases"] == slow_phrases(words, among, context)
        assert r["corpus_phrases"] == slow_phrases(words, other, context)
        assert r["reference_words"] == sum(map(len, among))
        assert r["cross_entropy"] == pytest.approx(r["phrases"] * math.log2(r["reference_words"] + 1) / len(words))
        assert r["own_phrases"] == lm_score.own_phrases(words)
        assert r["score"] == pytest.approx(r["cross_entropy"] - r["own_entropy"])


def test_blocks_and_parts_change_nothing(spark):
    rows = corpus()
    one = sorted(map(tuple, lm_score.score(frame(spark, rows), frame(spark, rows[::2])).collect()))
    for block, part in ((64, 10), (300, 70)):
        assert sorted(map(tuple, lm_score.score(frame(spark, rows), frame(spark, rows[::2]), block_words=block, part_words=part).collect())) == one


def test_query_against_the_whole_reference(spark):
    """The registered query against a suffix automaton of the whole reference, document by document."""
    got = queries.op7_lm_score(spark, FOLDER).toPandas().set_index("doc_id")
    docs = {r["doc_id"]: (r["text"] or "").encode().split() for r in read_table(spark, FOLDER, "documents").collect()}
    good = {r["doc_id"] for r in read_table(spark, FOLDER, "labels").where("quality = 1 AND toxic = 0").collect()} & set(docs)
    assert set(got.index) == set(docs)
    whole = SuffixAutomaton()
    for i in good:
        whole.add(docs[i])
    exact = {i: whole.phrases(w) for i, w in docs.items() if i not in good}
    for i in sorted(good)[:12]:
        rest = SuffixAutomaton()
        for j in good - {i}:
            rest.add(docs[j])
        exact[i] = rest.phrases(docs[i])
    ours = {i: int(got.phrases[i]) for i in exact}
    assert all(ours[i] <= exact[i] for i in exact)
    assert sum(exact.values()) <= 1.001 * sum(ours.values())
    copies = [i for i, w in docs.items() if len(w) > 1 and any(docs[j] == w for j in good - {i})]
    assert all(got.phrases[i] == 1 for i in copies)


def test_copies_are_one_phrase(spark):
    folder = FOLDER.replace("0.001", "0.01")
    got = queries.op7_lm_score(spark, folder).toPandas().set_index("doc_id")
    docs = {r["doc_id"]: r["text"] or "" for r in read_table(spark, folder, "documents").collect()}
    by_text = {}
    for i, t in docs.items():
        by_text.setdefault(t, []).append(i)
    copies = [i for ids in by_text.values() if len(ids) > 1 for i in ids if docs[i].strip()]
    assert len(copies) > 20 and (got.corpus_phrases[copies] == 1).all()


def test_odd_rows(spark):
    got = lm_score.score(frame(spark, ODD), frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["phrases"] == 0 and r["own_entropy"] == 0 for r in got if r["n_words"] == 0)
    assert all(r["phrases"] == 1 for r in got if r["id"] in (4, 5))
    none = lm_score.score(frame(spark, ODD), frame(spark, [])).collect()
    assert len(none) == len(ODD) and all(r["score"] is None for r in none)
    assert lm_score.score(frame(spark, []), frame(spark, ODD)).count() == 0


def test_clashing_columns(spark):
    docs = frame(spark, ODD).selectExpr("doc_id", "text", "lang AS block", "source AS part", "n_chars AS answer", "lang AS id", "1 AS shared")
    assert lm_score.score(docs, frame(spark, ODD)).count() == len(ODD)
