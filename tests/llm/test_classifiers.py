import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import language_id, queries, quality_classifier, quality_rules
from quillstream.llm.support import bytes_of
from quillstream.session import ship

from .common import FOLDER, ODD, frame, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


# --- quality rules ---


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_base_counts_like_brute_force(spark):
    texts = [t for _, t in ODD] + ["a b c a b c", "a a a a", "x\nx\n \n \nx\ny", "a\x1cb \x85c\u2003d #*$%&|<>", "one two\n" * 40, prose(1, 200, 6)]
    docs = frame(spark, list(enumerate(texts)))
    model = quality_rules.Model(np.zeros(quality_rules.BUCKETS), 4.0)
    for r in quality_rules.assess(docs, model).collect():
        want = slow_counts(texts[r["id"]])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])


def test_table_counts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op9_quality_rules(spark, FOLDER).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_counts(texts[r["doc_id"]])


def test_scorer_sums_up_the_features():
    draw = np.random.default_rng(0)
    model = quality_rules.Model(draw.normal(size=quality_rules.BUCKETS), 0.3)
    scorer = quality_rules.Scorer(model)
    for text in ["one", "one two two ***", prose(5, 300)]:
        words = bytes_of(text).split()
        at, value = quality_rules.features(words)
        z = model.bias + value @ model.weights[at]
        assert scorer.probability(scorer.words.rows(words)) == pytest.approx(1 / (1 + np.exp(-z)))


def test_small_word_table_gives_the_same():
    model = quality_rules.Model(np.random.default_rng(1).normal(size=quality_rules.BUCKETS), 0.0)
    one, two = quality_rules.Scorer(model), quality_rules.Scorer(model)
    two.words.limit = 3
    for s in range(20):
        words = bytes_of(prose(s, 50)).split()
        assert one.probability(one.words.rows(words)) == two.probability(two.words.rows(words))


def test_verdict_follows_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality_rules(spark, SF).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == 0]) < 0.1


def test_keep_good_and_missing_labels(spark):
    docs = frame(spark, [*ODD, (20, prose(9, 80))]).withColumnRenamed("lang", "kept")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality_rules.fit(docs, none)
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [8, 20]
    assert quality_rules.assess(frame(spark, []), model).count() == 0


# --- quality classifier ---


def test_isotonic_like_brute_force():
    draw = np.random.default_rng(3)
    x = np.arange(12.0)
    y, n = draw.integers(0, 5, 12).astype(float), np.full(12, 4.0)
    knots, levels = quality_classifier.isotonic(x, y, n)
    assert (np.diff(levels) > 0).all()
    fit = lambda cuts: sum((y[a:b].sum() / n[a:b].sum() - y[i] / n[i]) ** 2 * n[i] for a, b in itertools.pairwise([0, *cuts, 12]) for i in range(a, b))
    means = lambda cuts: [y[a:b].sum() / n[a:b].sum() for a, b in itertools.pairwise([0, *cuts, 12])]
    best = min((fit(c) for k in range(6) for c in itertools.combinations(range(1, 12), k) if all(p <= q for p, q in itertools.pairwise(means(c)))))
    assert sum(((np.repeat(levels, [round(c) for c in _sizes(knots, x)])[i] - y[i] / n[i]) ** 2) * n[i] for i in range(12)) == pytest.approx(best)


def _sizes(knots, x):
    sizes, at = [], 0
    for k in knots:
        size = int(round(2 * (k - x[at]) + 1))
        sizes.append(size)
        at += size
    return sizes


def test_ridge_like_numpy(spark):
    draw = np.random.default_rng(0)
    stats = draw.normal(size=(400, quality_classifier.N_STATS))
    label = (stats[:, 0] + stats[:, 1] ** 2 > 0.7).astype(int)
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(stats)], "id bigint, stats array<double>").repartition(7)
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(label)], "doc_id bigint, quality int")
    model = quality_classifier.fit(df, marks)
    z = quality_classifier._fourier(stats, stats.mean(axis=0), stats.std(axis=0))
    want = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * 400 * np.eye(z.shape[1]) / quality_classifier.FEATURES, z.T @ label)
    assert np.allclose(z @ model.ridge, z @ want, atol=1e-6)
    got = {r["id"]: r["score"] for r in quality_classifier.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in enumerate(label)]) > 0.9


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in tested]) > 0.97


def test_held_out_labels_are_never_learnt(spark):
    stats = quality_classifier.statistics(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.fit(stats, x, learn=~quality_classifier.held_out()) for x in (labels, flipped))
    assert np.allclose(a.ridge, b.ridge, atol=1e-9)


def test_classifier_odd_rows(spark):
    docs = frame(spark, ODD).withColumnRenamed("lang", "score")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    stats = quality_classifier.statistics(docs)
    model = quality_classifier.fit(stats, none)
    assert [r["score"] for r in quality_classifier.score(stats, model).collect()] == [0.5] * len(ODD)
    assert quality_classifier.keep_good(docs, model).count() == 0 and quality_classifier.keep_good(docs, model, keep_at=0.5).columns == docs.columns
    assert quality_classifier.score(quality_classifier.statistics(frame(spark, [])), model).count() == 0


def slow_statistics(text):
    """The statistics of a text, one character at a time."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n = len(words)
    if not n:
        return [0.0] * quality_classifier.N_STATS
    chars = sum(map(len, words))
    letters, capitals, digits = (sum(sum(1 for c in w if f(c)) for w in words) for f in (str.isalpha, str.isupper, str.isdigit))
    shouted = sum(1 for w in words if sum(c.isalpha() for c in w) > 1 and all(c.isupper() for c in w if c.isalpha()))
    bare = sum(1 for w in words if not any(c.isalpha() for c in w))
    ended = sum(1 for w in words if not w[-1].isalnum())
    share = [words.count(w) / n for w in sorted(set(words))]
    _, _, symbols, again, repeats = slow_counts(text)
    lines = len(text.split("\n"))
    return [
        np.log(1 + n), chars / n, len(share) / n, -sum(p * np.log(p) for p in share) / np.log(n + 1), max(share), symbols / n, text.count("!") / n, letters / chars,
        capitals / max(letters, 1), digits / chars, shouted / n, bare / n, ended / n, again / lines, repeats / n, np.log(1 + n / lines),
    ]


def test_statistics_like_brute_force(spark):
    texts = [t for _, t in ODD] + ["AB ab! 12 É3, x\nAB ab!\nAB ab!", "!!! ??? 1.5 OK", "éé ÉÉ ß \x1c x\u2003y", prose(3, 400, 20)]
    texts += [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    got = {r["id"]: r["stats"] for r in quality_classifier.statistics(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert np.allclose(got[i], slow_statistics(text)), text[:50]


def test_clashing_names_of_the_quality_operators(spark):
    docs = frame(spark, [*ODD, (20, prose(9, 80))]).selectExpr("*", "lang AS kept", "lang AS score", "lang AS `__text`", "lang AS stats", "lang AS id")
    model = quality_rules.Model(np.zeros(quality_rules.BUCKETS), 4.0)
    assert quality_rules.assess(docs, model).count() == docs.count()
    assert quality_rules.keep_good(docs, model).columns == docs.columns
    labels = spark.createDataFrame([(8, 1), (20, 1), (9, 0)], "doc_id bigint, quality int")
    assert isinstance(quality_rules.fit(docs, labels), quality_rules.Model)
    assert quality_classifier.statistics(docs).count() == docs.count()
    assert quality_classifier.keep_good(docs, quality_classifier.fit(quality_classifier.statistics(docs), labels), keep_at=0.0).columns == docs.columns


# --- language ID ---


def toy(seed, lang, n):
    draw = random.Random(seed)
    parts = {"xx": ["ab", "ba", "ka", "la"], "yy": ["öm", "un", "ig", "est"], "zz": ["qo", "vi", "ze", "wu"]}[lang]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def toy_model():
    rows = [(toy(i, lang, 60), lang) for i in range(40) for lang in ("xx", "yy", "zz")]
    return language_id.fit_model([t for t, _ in rows], [x for _, x in rows])


def test_forward_backward_like_enumeration(toy_model):
    tagger = language_id.Tagger(toy_model)
    words = language_id.words_of(toy(1, "xx", 2) + " " + toy(2, "yy", 3))
    at = tagger.words.rows(words)
    e = tagger.words.table[at]
    mass = np.zeros((len(words), 3))
    for path in itertools.product(range(3), repeat=len(words)):
        w = np.exp(toy_model.start[path[0]] + sum(e[t, y] for t, y in enumerate(path)) + sum(toy_model.transitions[a, b] for a, b in itertools.pairwise(path)))
        for t, y in enumerate(path):
            mass[t, y] += w
    want = (mass / mass.sum(axis=1, keepdims=True)).sum(axis=0)
    rows = tagger.words.rows(words + words[:2])
    got = language_id.posteriors(rows[[0, 1, 2, 3, 4, 0, 1]], np.array([5, 2]), tagger.words.table, toy_model)
    assert np.allclose(got[0], want)


def test_code_switching(toy_model):
    text = toy(7, "xx", 20) + " " + toy(8, "zz", 20)
    assert language_id.Tagger(toy_model).spans(text) == [(0, 20, "xx"), (20, 40, "zz")]


def test_segments_and_small_tables(toy_model, monkeypatch):
    texts = [toy(i, lang, n) for i, (lang, n) in enumerate(itertools.product(("xx", "yy", "zz"), (1, 7, 90)))]
    want = language_id.Tagger(toy_model).classify(texts)
    assert [x for x, _ in want] == ["xx"] * 3 + ["yy"] * 3 + ["zz"] * 3
    monkeypatch.setattr(language_id, "BATCH_WORDS", 50)
    small = language_id.Tagger(toy_model)
    small.words.limit = 5
    again = small.classify(texts)
    assert [x for x, _ in again] == [x for x, _ in want] and np.allclose([s for _, s in again], [s for _, s in want], atol=1e-4)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = queries.op8_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.98


def test_language_odd_rows(spark, toy_model):
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language_id.classify(frame(spark, [*ODD, (30, "123 !!"), (31, "½"), (32, "² ③ Ⅷ"), (33, "½ qo")]).selectExpr("*", "lang AS lang_pred", "1 AS id"), toy_model).collect()}
    assert got[1] == got[2] == got[3] == got[30] == got[31] == got[32] == ("und", 0.0) and got[33] == (language_id.Tagger(toy_model).classify(["qo"])[0]) and 0 < got[4][1] <= 1
    empty = language_id.fit(frame(spark, []))
    assert {r["lang_pred"] for r in language_id.classify(frame(spark, ODD), empty).collect()} == {"und"}
    assert language_id.classify(frame(spark, []), toy_model).count() == 0
