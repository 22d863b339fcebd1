import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillstream.llm import simhash
from quillstream.session import ship

from .common import FOLDER, ODD, frame, prose


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def slow_result(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f, least.get(r)) for (i, _), f, r in zip(rows, fps, roots)), key=str)


def test_fingerprints_like_brute_force():
    for text in ["", None, "One", "One two", "ONE two\x0bthree\x1cfour", "é É a b c a b c", prose(3, 500)]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    draw = random.Random(0)
    for radius in (1, 2, 3):
        found = simhash.masks(radius)
        assert len(found) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            apart = sum(1 << b for b in draw.sample(range(64), radius))
            assert any(not apart & m for m in found)


def test_odd_rows(spark):
    got = [(r["id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(frame(spark, ODD)).collect()]
    assert sorted(got, key=str) == slow_result(ODD)


def test_table_like_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == slow_result(rows)


def test_dense_buckets_are_split_and_lose_no_link(spark):
    """A ball of fingerprints around one centre, with a bucket bound that they exceed many times."""
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(6))) for _ in range(600)} | {draw.getrandbits(64) for _ in range(200)}
    fps = sorted(ball)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, bucket_rows=16)).collect()}
    mine = [roots.get(int(np.uint64(f).astype(np.int64)), f) for f in fps]
    slow = slow_components(fps)
    assert len(set(zip(mine, slow))) == len(set(mine)) == len(set(slow))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 500) for i in range(1, 300)]
    roots = dict(simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(roots[i] == 0 for i in range(201)) and all(roots[1000 + i] == 500 for i in range(1, 300))


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_keep_one(spark):
    base = prose(1, 400).split()
    near = base.copy()
    near[100] = "changed"
    far = base[:200] + prose(2, 200).split()
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(far)), (7, prose(4, 300)), (7, prose(4, 300)), (None, prose(6, 100)), (11, None), (12, "")]
    kept = simhash.keep_one(frame(spark, rows).withColumnRenamed("lang", "fp"))
    assert kept.columns == ["doc_id", "text", "fp", "source", "n_chars"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 9, 7, None, 11], key=str)


def test_keep_one_like_exact_similarity(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = t.encode().translate(simhash.LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    groups = {}
    for i in rows:
        groups.setdefault(find(i), set()).add(i)
    assert all(len(g & kept) == 1 for g in groups.values())


def test_keep_one_in_a_family_of_a_shared_passage(spark):
    """2000 texts share about 72 % of their shingles; among them are pairs of over 0.8."""
    passage = prose(50, 300, 10**6).split()
    texts = {i: passage + prose(1000 + i, 55, 10**6).split() for i in range(2000)}
    for i in range(60):
        near = texts[i].copy()
        near[310 + i % 10] = near[330] = near[340] = "changed"
        texts[10_000 + i] = near
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(i, 10_000 + i) >= 0.8 for i in range(60)) and all(0.7 < alike(i, i + 1) < 0.8 for i in range(1999))
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()}
    assert kept == set(range(2000))


def test_keep_one_of_texts_with_equal_fingerprints(spark):
    """A third text is at 0.8 to one of two texts with one fingerprint, but below it to the one with the least hash."""
    signed_hash = lambda t: simhash.signed(xxhash.xxh64_intdigest(t, 42))
    for seed in range(500):
        one = prose(seed, 2000, 10**6).split()
        two = one.copy()
        two[1500] = "changed"
        a, b = " ".join(one), " ".join(two)
        if signed_hash(b) < signed_hash(a) and simhash.fingerprint(a, 5) == simhash.fingerprint(b, 5):
            break
    else:
        raise AssertionError("no such pair")
    third = one[:200] + prose(1001, 217, 10**6).split() + one[417:]
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, [(1, a), (2, b), (3, " ".join(third))])).collect()}
    assert kept == {1}


def test_keep_one_with_clashing_names(spark):
    docs = frame(spark, [(1, prose(1, 60)), (2, prose(1, 60)), (3, prose(2, 60)), *ODD]).selectExpr("*", "doc_id AS __text", "doc_id AS __row", "lang AS fp", "lang AS first", "lang AS `row`", "lang AS a")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and all(r["__text"] == r["doc_id"] and r["row"] == "en" for r in kept.collect())
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"]) == sorted(r["doc_id"] for r in simhash.keep_one(docs.select("doc_id", "text")).collect() if r["doc_id"])
    found = simhash.near_duplicates(docs.withColumnRenamed("lang", "id"))
    assert found.count() == docs.count()


def templated(pairs, base, own, edit, seed=0):
    """Pages with shared boilerplate: pairs above the threshold, families below it."""
    draw = random.Random(seed)
    word = lambda: f"v{draw.randrange(10**6)}"
    head, tail = [word() for _ in range(base // 2)], [word() for _ in range(base // 2)]
    rows = []
    for i in range(pairs):
        middle = [word() for _ in range(own)]
        other = [*middle[: own - edit], *[word() for _ in range(edit)]]
        rows += [(2 * i, " ".join([*head, *middle, *tail])), (2 * i + 1, " ".join([*head, *other, *tail]))]
    return rows


@pytest.mark.parametrize("pairs", [60, 600])
def test_keep_one_on_templated_pages(spark, pairs):
    """Similarity is about 0.62 across pairs and 0.85 within: one of each pair stays, at both sizes."""
    rows = templated(pairs, 160, 45, 12)
    sets = [set(simhash.shingle_set(t).tolist()) for _, t in rows[:6]]
    likeness = lambda a, b: len(a & b) / len(a | b)
    assert likeness(sets[0], sets[1]) >= 0.8 > 0.75 > likeness(sets[0], sets[2])
    kept = [r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).select("doc_id").collect()]
    assert sorted(kept) == list(range(0, 2 * pairs, 2))


def nothing(schema):
    """In place of a step over Arrow batches: no rows."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)

    return lambda *_: run


def test_keep_one_finds_near_copies_by_fingerprints(spark, monkeypatch):
    """Without the join of shingle sets, the texts within three bits that are alike are still linked, and only these."""
    monkeypatch.setattr(simhash, "_neighbours", nothing("kind int, a bigint, b bigint, n int, at int"))
    monkeypatch.setattr(simhash, "_apart", nothing("a bigint, b bigint"))
    base = prose(1, 3000, 10**6).split()
    near, spaced = base.copy(), " \n".join(base)
    near[1500] = "changed"
    other = prose(2, 300)
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(near))).bit_count() <= 3
    rows = [(4, " ".join(near)), (2, " ".join(base)), (3, spaced), (9, other), (8, other), (7, prose(3, 300))]
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()) == [2, 7, 8]


def test_fingerprint_pairs_like_brute_force(spark):
    rows = []
    for i in range(20):
        base = prose(i, 1500, 10**6).split()
        for at in range(4):
            rows.append((len(rows), " ".join([*base[: 300 * at], *["other"] * at, *base[300 * at + at :]])))
    marked = simhash.fingerprints(frame(spark, rows)).collect()
    fps = {r["text_hash"]: r["fp"] & (1 << 64) - 1 for r in marked}
    found = simhash.components(simhash.fingerprint_pairs(spark.createDataFrame(marked), 3)).collect()
    roots = {r["node"]: r["root"] for r in found}
    texts = sorted(fps)
    expected = slow_components([fps[t] for t in texts])
    groups = lambda root_of: {frozenset(t for t in texts if root_of[t] == x) for x in set(root_of.values())}
    assert groups({t: roots.get(t, t) for t in texts}) == groups(dict(zip(texts, expected)))
    assert len(roots) > 2


def test_few_words_in_the_slots_of_a_template(spark):
    """Pages that meet in many buckets but are unlike don't leave them as pairs; alike ones do, and none is lost."""
    draw = random.Random(3)
    words = prose(5, 270, 10**6).split()
    pages = {}
    for i in range(300):
        page = words.copy()
        for slot in range(0, 270, 30):
            page[slot] = f"s{draw.randrange(6)}"
        pages[i] = page
    for i in range(20):
        pages[1000 + i] = [*pages[i][:-1], "end"]
    sets = {i: simhash.shingle_set(" ".join(w)) for i, w in pages.items()}
    alike = {(a, b) for a in pages for b in pages if a > b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    size, parity = len(sets[0]), [simhash._parity(x) for x in sets.values()]
    columns = [np.zeros(len(pages)), list(pages), list(pages), [len(x) for x in sets.values()], np.zeros(len(pages))]
    batch = pa.RecordBatch.from_arrays([*[pa.array(np.array(c, dtype=np.int64)) for c in columns], pa.array(parity, pa.binary())], names=list("srtnap"))
    found = {(a, b) for out in simhash._apart(0.8)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert size > 250 and alike <= found and len(found) < len(pages) * (len(pages) - 1) / 2 / 4
    parent = {i: i for i in pages}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(alike):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, [(i, " ".join(w)) for i, w in pages.items()])).collect()}
    assert kept == {i for i in pages if find(i) == i}
