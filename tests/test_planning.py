"""Queries without SQL held to plain versions over whole tables: the split, the ridge fit and the filter in two parts."""

import math
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from isoline.operators import sequence as Q
from isoline.plans import QUERIES
from isoline.sources.tables import points, read

SF = "/root/testdata/sf0.001"


def test_validation_split_by_the_hash_of_the_key(spark):
    ids = [r.doc_id for r in read(spark, SF, "documents").collect()]

    def side(k):
        first = xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 0), first)
        return "validation" if (h - (1 << 64) * (h >> 63)) % 1_000_000 / 1e6 < 0.2 else "train"

    got = [(r.doc_id, r.split) for r in QUERIES["validation_split"](spark, SF).collect()]
    assert sorted(got) == sorted((k, side(k)) for k in ids)
    assert 0.1 < sum(s == "validation" for _, s in got) / len(got) < 0.3


def test_ridge_fit_against_numpy(spark):
    rows = defaultdict(list)
    for r in points(spark, SF).collect():
        rows[r.label].append((1.0, r.x, r.y, r.z, r.qx))
    got = {r.label: r for r in QUERIES["ridge_fit"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    for label, of in rows.items():
        a = np.array(of)
        x, y = a[:, :4], a[:, 4]
        w = np.linalg.solve(x.T @ x + 1e-3 * np.diag([0, 1, 1, 1]), x.T @ y)
        assert [got[label][f"c{i}"] for i in range(4)] == pytest.approx(w, abs=2e-6)
        assert got[label].rmse == pytest.approx(math.sqrt(np.mean((y - x @ w) ** 2)), abs=2e-6)


def filtered(series, least, beta):
    """The one-euro filter of (t, x) written out."""
    weight = lambda cutoff, dt: 1 / (1 + 1 / (2 * math.pi * cutoff * dt))
    out = []
    for i, (t, x) in enumerate(series):
        if i == 0:
            value, slope = x, 0.0
        else:
            dt = t - series[i - 1][0]
            dt = dt if dt > 0 else 1e-3
            a = weight(1.0, dt)
            slope = a * (x - value) / dt + (1 - a) * slope
            b = weight(least + beta * abs(slope), dt)
            value = b * x + (1 - b) * value
        out.append(value)
    return out


def test_stabilized_one_euro_against_a_loop(spark):
    users = defaultdict(list)
    for r in read(spark, SF, "events").selectExpr("user_id", "event_id", "value", "unix_micros(cast(ts as timestamp)) / 1e6 t").collect():
        users[r.user_id].append((r.t, r.event_id, r.value))
    want = {}
    for rows in users.values():
        rows.sort()
        whole = [(t, (v + i % 13) / 2) for t, i, v in rows]
        rest = [(t, v - m) for (t, _, v), (_, m) in zip(rows, whole, strict=True)]
        for (_, i, _), a, b in zip(rows, filtered(whole, 1.25, 0.012), filtered(rest, 1.5, 0.05), strict=True):
            want[i] = a + b
    got = {r.event_id: r.smooth for r in QUERIES["stabilized_one_euro"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)


def test_anchored_one_euro_against_a_loop(spark):
    labels = defaultdict(list)
    for r in read(spark, SF, "embeddings").collect():
        labels[r.label].append((r.vec_id, r.embedding))
    want = {}
    for label, frames in labels.items():
        frames.sort()
        for n, axis in enumerate("xyz"):
            mean = [(i * 0.04, (float(e[6 + n]) + float(e[15 + n])) / 2) for i, e in frames]
            steady = filtered(mean, 1.25, 0.012)
            for p in range(7):
                own = filtered([(t, float(e[3 * p + n]) - m) for (_, e), (t, m) in zip(frames, mean, strict=True)], 1.5, 0.05)
                want |= {(label, i, p, axis): a + b for (i, _), a, b in zip(frames, steady, own, strict=True)}
    got = {(r.label, r.vec_id, r.point, r.axis): r.smooth for r in QUERIES["anchored_one_euro"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_anchored_one_euro_of_odd_rows(spark):
    rows = [(None, 0, 0.0, 1, 1.0), (None, 1, 0.1, 1, None), ("a", 0, 0.0, 9, 3.0), ("a", 1, 0.1, 9, 4.0)]
    df = spark.createDataFrame(rows, "g string, i long, t double, p long, x double")
    got = {(r.g, r.i): (r.raw, r.smooth) for r in Q.anchored_one_euro(df, "g", "p", [1], ["x"], "t", "i").collect()}
    want = filtered([(0.0, 3.0), (0.1, 4.0)], 1.5, 0.05)
    assert got == {(None, 0): (1.0, 1.0), ("a", 0): (3.0, pytest.approx(want[0])), ("a", 1): (4.0, pytest.approx(want[1]))}
    assert Q.anchored_one_euro(df.limit(0), "g", "p", [1], ["x"], "t", "i").isEmpty()
