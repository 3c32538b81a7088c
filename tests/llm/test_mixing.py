import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.llm import mixing as M


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, out = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in out]
        left = total - sum(out.values())
        share = {n: left * w[n] / sum(w[m] for m in free) for n in free}
        over = [n for n in free if share[n] > most * sizes[n] + 1e-9]
        if not over:
            return out | share
        out |= {n: most * sizes[n] for n in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 50}, {"x": 7}, {"a": 1, "b": 1, "c": 10_000}, {"a": 0, "b": 4}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = filled(sizes)
    for k, v in got.items():
        assert v == pytest.approx(want[k]), k


def test_tree_keeps_quotas_and_shard_sizes(spark):
    q = {"a": 1000, "b": 37, None: 5, "c": 600}
    rows = M.split(spark.createDataFrame(list(q.items()), "source string, q long"), 13).collect()
    by = lambda k: {x: sum(r.q for r in rows if r[k] == x) for x in {r[k] for r in rows}}
    assert by("source") == q
    shards = by("shard")
    assert set(shards) <= set(range(13))
    assert max(shards.values()) - min(shards.values()) <= 8
    # A shard's share of a source is about its share of all draws.
    a = [r.q for r in rows if r.source == "a"]
    assert abs(np.mean(a) - 1000 / 13) < 1 and np.std(a) < 15


def test_sources_meet_their_targets(spark, sf):
    rows = M.op1_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes, taken, target, left = {}, {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        words = docs[r.doc_id].text.encode().split()
        draws = len(r.shards.split(",")) if r.shards else 0
        assert r.size == len(words) and draws <= 3 and r.taken == draws * r.size and len(r.orders.split(",")) == max(draws, 1)
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        left.setdefault(s, []).append((draws, r.size))
    want = filled(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        # Ten documents a source: all are near its target's end, so none that would fit is left.
        last = max(d for d, _ in left[s])
        out = [n for d, n in left[s] if n and d < last]
        assert taken[s] - target[s] <= max(n for _, n in left[s]) / 2 + 1
        assert not out or target[s] - taken[s] < min(out) + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.op1_mixing(spark, sf).collect()))


def test_odd_rows_and_clashing_names(spark, docs_of):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 40) for _ in range(rng.randint(1, 50))), rng.choice("abc")) for i in range(60)]
    docs = docs_of([*rows, (7, None, "a"), (8, "", None), (9, "one two three", None), (9, "one two three", None), (None, "x y", "b"), (10, "z " * 30_000, "d")])
    docs = docs.withColumns({"mix_size": F.lit("own"), "draws": F.lit(1), "mix_shard": F.lit("mine")})
    mix = M.mixed(docs)
    assert mix.columns[: len(docs.columns)] == docs.columns
    got = mix.collect()
    assert all(r.mix_size == "own" and r.draws == 1 and r["mix_shard"] == "mine" for r in got)
    words = {}
    for r in got:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in docs.collect()}
    for s, t in filled(sizes).items():
        assert abs(words.get(s, 0) - t) <= (30_000 if s == "d" else 20)
    assert M.mixed(docs.limit(0)).count() == 0
    placed = M.shuffled(M.mixed(docs.drop("mix_shard"))).withColumn("p", F.spark_partition_id()).groupBy("mix_shard").agg(F.countDistinct("p").alias("n"))
    assert placed.filter("n > 1").count() == 0


def test_shards_draw_as_from_an_urn(spark):
    """Over many seeds, a shard's draws of a source have the mean and variance of the multivariate hypergeometric law."""
    q = np.array([300, 60, 40])
    df = spark.createDataFrame([("a", 300), ("b", 60), ("c", 40)], "source string, q long").coalesce(1)
    got = []
    for seed in range(25):
        rows = M.split(df, 8, seed).collect()
        shards = np.zeros((8, 3), dtype=int)
        for r in rows:
            shards[r.shard, "abc".index(r.source)] += r.q
        assert (shards.sum(axis=0) == q).all() and (shards.sum(axis=1) == 50).all()
        got.append(shards)
    got = np.concatenate(got)
    p = q / q.sum()
    assert np.allclose(got.mean(axis=0), 50 * p)
    assert np.allclose(got.var(axis=0), 50 * p * (1 - p) * (400 - 50) / 399, rtol=0.35)


def test_draws_beyond_what_numpy_has(monkeypatch):
    q = np.array([5 * 10**9, 10**9, 7])
    got = M.half(q, 3 * 10**9, np.random.default_rng(1))
    assert got.sum() == 3 * 10**9 and (got <= q).all() and abs(got[1] - 5 * 10**8) < 10**5
    monkeypatch.setattr(M, "NUMPY_MOST", 0)
    rng, q = np.random.default_rng(2), np.array([30, 12, 6])
    x = np.array([M.half(q, 16, rng) for _ in range(4000)])
    assert (x.sum(axis=1) == 16).all() and (x <= q).all()
    p = q / 48
    assert np.allclose(x.mean(axis=0), 16 * p, atol=0.1) and np.allclose(x.var(axis=0), 16 * p * (1 - p) * 32 / 47, rtol=0.1)


def test_shards_and_blocks_grow_with_the_words():
    assert M.shards_for(0) == M.shards_for(64 << 27) == 64
    assert M.shards_for((64 << 27) + 1) == 128
    assert M.shards_for(1 << 44) == 1 << 17


def test_a_source_fills_its_target_with_whole_rows():
    import pandas as pd

    def fit(left, units):
        rows = [("s", b, 1, place, h, left, n) for b, place, h, n in units]
        got = M.fitted(pd.DataFrame(rows, columns=["s", "block", "epoch", "place", "h", "left", "unit"]))
        out = []
        for r in got.itertuples():
            out += [n for b, _, h, n in units if b == r.block and ((r.cut_hash is not pd.NA and h <= r.cut_hash) or h in r.also)]
        return sorted(out)

    big = 2**62  # hashes beyond what doubles hold
    assert fit(100, [(1, 1, big + 1, 40), (1, 1, big + 2, 70), (1, 1, big + 3, 30), (2, 2, 5, 25), (2, 2, big + 7, 60)]) == [40, 60]
    assert fit(100, [(1, 1, big + 1, 40), (1, 1, big + 2, 70), (2, 2, 5, 25), (3, 3, 6, 31), (3, 3, 7, 3)]) == [3, 25, 31, 40]
    assert fit(10, [(1, 1, 1, 15)]) == [15] and fit(5, [(1, 1, 1, 15)]) == [] and fit(0, [(1, 1, 1, 15)]) == []
