import re
import time

import numpy as np

from quillstream.functions import ml


def plain_lloyd(points, weights, k, rounds):
    """All distances to all centres, at every step."""
    draw = np.random.default_rng(0)
    centres = [points[draw.choice(len(points), p=weights / weights.sum())]]
    for _ in range(1, k):
        d = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0) * weights
        centres.append(points[draw.choice(len(points), p=d / d.sum())] if d.sum() > 0 else points[draw.integers(len(points))])
    c = np.array(centres)
    for _ in range(rounds):
        near = np.array([((p - c) ** 2).sum(axis=1).argmin() for p in points])
        new = np.array([np.average(points[near == i], axis=0, weights=weights[near == i]) if (near == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return c


def test_lloyd_gives_what_all_distances_give():
    points = np.random.default_rng(5).normal(size=(400, 8)).round(1)
    points[200:300] = points[:100]  # copies, so centres tie
    weights = np.random.default_rng(6).integers(1, 5, 400).astype(float)
    assert np.array_equal(ml._lloyd(points, weights, 60, 4), plain_lloyd(points, weights, 60, 4))
    few = np.repeat(points[:3], 5, axis=0)  # more centres than different points
    assert np.array_equal(ml._lloyd(few, np.ones(15), 6, 3), plain_lloyd(few, np.ones(15), 6, 3))


def test_coreset_takes_time_in_proportion_to_its_centres():
    points = np.random.default_rng(7).normal(size=(4200, 64))
    began = time.process_time()
    found, weights = ml.coreset(points, np.ones(len(points)))
    assert weights.sum() == len(points) and len(found) <= ml.CORESET
    assert time.process_time() - began < 40


def test_costly_redaction_of_one_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    from quillstream.plans.catalogue import QUERIES

    spark.range(5000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["fn_pii_made"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 8
    assert sorted(r["c_custkey"] for r in found.collect()) == list(range(5000))


def test_addresses_are_looked_for_only_where_they_can_be():
    from quillstream.functions.pii import TAGGERS, V4, Runs, redact

    assert [type(pattern) for name, pattern, _ in TAGGERS if name in ("IPV4", "IPV6")] == [Runs, Runs]
    v4 = Runs(r"[0-9.]{7,}", lambda s: s.count(".") >= 3, V4)
    for text in ("a 1.2.3.4.5.6.7.8 b", "1.2.3 4.5", "300.1.2.3", "x1.2.3.4y255.255.255.2555", "1..2.3.4", ""):
        assert [m.span() for m in v4.finditer(text)] == [m.span() for m in re.finditer(V4, text)]
    assert redact("at fe80::1, ::ffff:1.2.3.4 and 1:2:3:4:5:6:7:8 not 1:2:3") == "at <REDACTED_IPV6>, <REDACTED_IPV6> and <REDACTED_IPV6> not 1:2:3"
