import random
from itertools import combinations

import numpy as np
import xxhash

from isoline.llm import simhash as S


def plain(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(fps))]


def test_against_every_pair(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in S.op4_simhash(spark, sf).collect()}
    fps = [plain(r.text) for r in rows]
    for r, fp, c in zip(rows, fps, components(fps, [r.doc_id for r in rows]), strict=True):
        assert got[r.doc_id].fingerprint == f"{fp:016x}"
        assert got[r.doc_id].component_id == c


def test_links_of_close_fingerprints(spark):
    """Chains, dense groups and random ones, cut into chunks of a few, link as all pairs do."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    near = {base ^ (1 << i) ^ (1 << j) for i, j in combinations(range(20), 2)}
    chain, x = [], rng.getrandbits(64)
    for k in range(20):
        x ^= 7 << (3 * k)
        chain.append(x)
    fps = [*near, *chain, *(rng.getrandbits(64) for _ in range(100))]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), chunk=16).collect()
    parent = {f: f for f in signed}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in edges:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
        parent[root(a)] = root(b)
    ids = list(range(len(fps)))
    want = components(fps, ids)
    for i, j in combinations(ids, 2):
        assert (root(signed[i]) == root(signed[j])) == (want[i] == want[j])


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (5, "a b c d e f"), (6, " A b\tc d E f\n"), (7, "x" * 200_000)])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == [(-1, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5), (6, 5), (7, 7)]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark, docs_of):
    docs = docs_of([(4, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (9, "other words are here"), (None, None)])
    docs = docs.withColumnRenamed("source", "fp").withColumnRenamed("lang", "row_key")
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["2", "9", "None"]


def test_spanning_links_is_a_forest():
    fps = np.array([0, 1, 3, 7, 15, 31, 31 << 40], dtype=np.int64)
    assert len(S.spanning_links(fps)) == 5


def test_tally_drops_pairs_before_their_bits_are_compared():
    """Of a list's pairs those without a fifth common byte go by the tally; none that links is among them."""
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 32, 400, dtype=np.int64) << 32 | 12345  # the lower half is alike
    fps[1::4] = fps[0::4] ^ (1 << 40)
    seen = [0, 0]
    links = S.spanning_links(np.unique(fps), (0, 1, 2, 3), seen)
    assert len(links) == 100
    assert seen[0] > 40_000 and 100 <= seen[1] < seen[0] / 20  # 45,000 or so met, under 1 in 20 verified


def test_hot_fingerprints_are_named_alike(spark, docs_of, monkeypatch):
    docs = docs_of([*((i, "a b c d") for i in range(50)), (60, "other words are here"), (61, None)])
    want = sorted(map(tuple, S.near_duplicates(docs).collect()))
    monkeypatch.setattr(S, "HOT", 3)
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == want


def test_components_of_a_star_and_a_path(spark):
    from isoline.llm.components import components as stars

    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(100)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{5000 + i: 5000 for i in range(101)}}
