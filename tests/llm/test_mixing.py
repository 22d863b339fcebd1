import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from quillstream.llm import mixing, queries

from .common import FOLDER, ODD, frame


def test_schedule_meets_every_deadline():
    for shares in ({"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {str(i): i + 1 for i in range(20)}, {"a": 997, "b": 3}):
        period = sum(shares.values())
        slots = mixing.schedule(shares)
        assert sorted(s for x in slots.values() for s in x) == list(range(period))
        for name, own in slots.items():
            counts = np.cumsum(np.isin(np.arange(period), own))
            assert np.abs(counts - shares[name] / period * np.arange(1, period + 1)).max() < 1


def test_positions(spark):
    sizes = {"big": 700, "mid": 200, "low": 33, None: 40}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "t", "en", s))
            i += 1
    weights = {"big": 1.0, "mid": 2.0, "low": 1.0, None: 1.0}
    got = mixing.positions(frame(spark, rows), weights=weights, block_docs=4, period=50, range_rows=90).toPandas()
    assert sorted(got.position) == list(range(len(rows))) and set(got.id) == set(range(len(rows)))
    blocks = got.drop_duplicates(["source", "block"]).sort_values("slot")
    assert list(blocks.slot) == list(range(len(blocks)))
    assert ((blocks.slot >= blocks.release) & (blocks.slot < blocks.deadline)).all()
    for _, phase in blocks.groupby("phase"):
        for s, w in phase.groupby("source", dropna=False).weight.first().items():
            here = (phase.source.isna() if s is None or s != s else phase.source == s).cumsum().to_numpy()
            assert np.abs(here - w * np.arange(1, len(phase) + 1)).max() < 1
    again = mixing.positions(frame(spark, rows).repartition(3), weights=weights, block_docs=4, period=50, range_rows=5000).toPandas()
    assert dict(zip(got.id, got.position)) == dict(zip(again.id, again.position))


def test_odd_rows_and_errors(spark):
    got = mixing.positions(frame(spark, ODD)).toPandas()
    assert sorted(got.position) == list(range(len(ODD)))
    assert mixing.positions(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="without a weight"):
        mixing.positions(frame(spark, ODD), weights={"other": 1.0})
    with pytest.raises(ValueError, match="positive"):
        mixing.positions(frame(spark, ODD), weights={"s": 0.0})


def test_interleave_keeps_rows_and_order(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "a" if i % 3 else "b") for i in range(500)]
    docs = frame(spark, rows).withColumnRenamed("lang", "position")
    mixing.interleave(docs).write.parquet(str(tmp_path / "out"))
    ids = [r["doc_id"] for f in sorted((tmp_path / "out").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert ids == [r["id"] for r in mixing.positions(docs).orderBy("position").collect()]
    assert spark.read.parquet(str(tmp_path / "out")).columns == docs.columns


def test_targets_hold_over_many_periods(spark):
    rows = [(i, "t", "en", "abc"[i % 3]) for i in range(24_000)] + [(24_000 + i, "t", "en", "rare") for i in range(3)]
    weights = {"a": 1.0, "b": 1.0, "c": 1.0, "rare": 3e-5}
    got = mixing.positions(frame(spark, rows).drop("n_chars"), weights=weights, block_docs=1).toPandas().sort_values("slot")
    first = got[got.phase == 0]
    assert len(first) > 20_000 and sorted(got.position) == list(range(len(rows)))
    for s, w in weights.items():
        target = w / sum(weights.values())
        assert np.abs((first.source == s).cumsum().to_numpy() - target * np.arange(1, len(first) + 1)).max() < 1
        assert np.allclose(first[first.source == s].weight, target)


def earliest_deadline(weights, slots):
    """The source of each slot, slowly: among the blocks whose window is open, the one with the earliest deadline."""
    exact = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    served, out = dict.fromkeys(weights, 0), []
    for slot in range(slots):
        open_ = [(math.ceil((served[s] + 1) / w), s) for s, w in exact.items() if math.floor(served[s] / w) <= slot]
        due, s = min(open_)
        assert slot < due
        served[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.443, "b": 0.314, "c": 0.162, "d": 0.081}, {str(i): (i + 1) ** 0.5 for i in range(9)}])
def test_slots_like_brute_force(weights):
    shares = mixing.whole_weights(weights)
    names = sorted(shares, key=str)
    got = [names[i] for i, _, _ in itertools.islice(mixing.earliest([shares[s] for s in names]), 3000)]
    assert got == earliest_deadline(weights, 3000)


def test_unequal_weights_over_a_hundred_thousand_blocks():
    """Every source stays within one block of its target until one really runs out, whatever the sources' sizes."""
    weights = {"a": 0.443, "b": 0.314, "c": 0.162, "d": 0.081}
    tables = mixing.timetables({"a": 60_000, "b": 31_000, "c": 20_000, "d": 9_000}, mixing.whole_weights(weights))
    slots = {s: np.array(t.slot) for s, t in tables.items()}
    assert sorted(np.concatenate(list(slots.values()))) == list(range(120_000))
    first = min(int(slots[s][-1]) for s in weights)
    assert first > 95_000
    for s, w in weights.items():
        served = np.bincount(slots[s][slots[s] <= first], minlength=first + 1).cumsum()
        assert np.abs(served - w * np.arange(1, first + 2)).max() < 1


def test_explicit_weights_in_the_mix(spark):
    sizes, weights = {"a": 3000, "b": 1500, "c": 400, "d": 100}, {"a": 0.443, "b": 0.314, "c": 0.162, "d": 0.081}
    rows = [(i, "t", "en", s) for i, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in sizes.items()))]
    got = mixing.positions(frame(spark, rows), weights=weights, block_docs=1).toPandas().sort_values("slot")
    first = got[got.phase == 0]
    assert len(first) > 1200
    for s, w in weights.items():
        assert np.abs((first.source == s).cumsum().to_numpy() - w * np.arange(1, len(first) + 1)).max() < 1


def test_clashing_names(spark, tmp_path):
    names = ["__source", "__hash", "__rank", "__p", "__at", "__row", "__range", "row", "id", "slot", "position", "__s", "name", "start", "at", "__name"]
    docs = frame(spark, [(i, f"t{i}", "en", "ab"[i % 2]) for i in range(100)]).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    mixing.interleave(docs).write.parquet(str(tmp_path / "out"))
    mixed = spark.read.parquet(str(tmp_path / "out"))
    assert mixed.columns == docs.columns
    assert all(r[n] == f"{n}{r['doc_id']}" for r in mixed.collect() for n in names)
    placed = mixing.stored_order(mixed, "place")
    assert placed.columns == [*docs.columns, "place"]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in placed.collect() for n in names)
    assert [r["doc_id"] for r in placed.orderBy("place").collect()] == [r["id"] for r in mixing.positions(docs.select("doc_id", "source")).orderBy("position").collect()]


def test_query(spark):
    got = queries.op1_mix_sources(spark, FOLDER).toPandas()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and sorted(got.position) == list(range(len(docs)))
    counts = docs.source.value_counts()
    blocks = got.drop_duplicates(["source", "block"]).sort_values("slot")
    first = blocks[blocks.phase == 0]
    assert list(first.source) == earliest_deadline({s: float(n) ** 0.5 for s, n in counts.items()}, len(first))
