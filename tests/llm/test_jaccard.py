"""The n-gram join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.llm import jaccard as J


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain(rows):
    """(doc_id, n, component) from every pair of rows."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, j in {p for h in holders.values() for p in combinations(h, 2)}:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(rng):
    """Copies, near copies at every distance from the threshold, chains, nested texts, a passage that many share."""
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    out = []
    for size in (6, 12, 40, 90, 300):
        for _ in range(4):
            base = fresh(size)
            out += [base, base, base[:-1], base[: size * 5 // 6], base[: size * 4 // 5 + 1]]
            out += [edited(rng, base, k) for k in (1, 1, 2, 3, max(1, size // 50), max(1, size // 25), max(2, size // 12))]
    chain = fresh(120)
    for _ in range(15):
        chain = edited(rng, chain, 2)
        out.append(chain)
    passage = fresh(60)
    out += [passage + fresh(rng.choice([3, 8, 14, 20, 60])) for _ in range(80)]
    out += [fresh(50) for _ in range(100)]
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("block,chunk", [(3, 8), (256, 4096)])
def test_against_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J.skipped, "__defaults__", (None, block))
    monkeypatch.setattr(J.later_pairs, "__defaults__", (False, chunk))
    rows = list(enumerate(corpus(random.Random(block))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(J.linked(docs)) == plain(rows)


def test_odd_rows(spark, docs_of):
    """Nulls in any column, empty and very long texts, few words, repeated rows, clashing names, an empty table."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One\ttwo"), (5, "One\ttwo"), (6, "one two three four five"), (None, "ONE two three four five"), (None, "alone in this table by itself"), (8, long), (9, long + " more"), (10, "one two three")]
    docs = docs_of(rows).withColumnRenamed("lang", "sid").withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    assert got(J.linked(docs)) == plain(rows)
    assert J.linked(docs.limit(0)).count() == 0


def test_a_hot_set_and_a_hot_passage(spark, monkeypatch):
    """A third of all rows are one text, a third near copies of it, and many share a passage."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [" ".join(base)] * 300 + [" ".join(edited(rng, base, 1)) for _ in range(300)]
    rows += [" ".join(base[:50] + [f"x{rng.randrange(10**6)}" for _ in range(80)]) for _ in range(300)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(J, "HOT", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(J.linked(docs)) == plain(rows)


def test_prefixes_share_and_bounds_hold():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a = sorted(rng.sample(range(200), n))
        b = sorted(set(a[rng.randrange(0, max(1, n // 5)) :]) | set(rng.sample(range(200), rng.randrange(0, 3))))
        i, linked = len(set(a) & set(b)), 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))
        assert linked == (i >= J.least_overlap(len(a), len(b)))
        if linked:
            assert set(a[: J.prefix(len(a))]) & set(b[: J.prefix(len(b))])
        x, y = np.array(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array(b, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert i <= J.most_overlap(J.parity(x), J.parity(y), len(a), len(b))


def test_blocks_are_skipped_and_answered_pairs_left_out():
    """Pairs of one component, of sizes too far apart, or with the first set of a stretch aren't formed."""
    n = np.sort(np.random.default_rng(1).integers(50, 400, 1000))
    pos, sid = np.zeros(1000, np.int64), np.arange(1000)
    of = lambda comp, first: sum(len(i) for i, _ in J.skipped(n, pos, comp, sid, first, block=64))
    assert of(np.zeros(1000, np.int64), np.full(1000, -1)) == 0
    every = of(sid, np.full(1000, -1))
    assert every == sum(5 * a >= 4 * b for a, b in combinations(n.tolist(), 2))
    assert every - of(sid, np.zeros(1000, np.int64)) == sum(5 * n[0] >= 4 * b for b in n[1:])
    late = n // 2  # too few shingles are left
    assert sum(len(i) for i, _ in J.skipped(n, late, sid, sid, np.full(1000, -1), block=64)) == 0


def test_answers_settle_pairs_of_similar_sets(spark):
    """b is close to a; what is far from a needs no look at b."""
    answers = spark.createDataFrame([(1, 100, 2, 100, 98, True), (1, 100, 3, 100, 60, True), (1, 100, 4, 100, 87, True), (1, 100, 5, 100, 50, False)], "a long, an long, b long, bn long, overlap long, exact boolean")
    pairs = spark.createDataFrame([(2, 100, 3, 100), (2, 100, 4, 100), (2, 100, 5, 100), (2, 100, 6, 100)], "a long, an long, b long, bn long")
    assert sorted(r.b for r in J.derived(pairs, answers).collect()) == [4, 6]


def test_a_forest_joins_what_all_pairs_join():
    """Of the pairs of a group only as many are left as join its components."""
    g, comp = np.array([1, 1, 1, 1, 2, 2]), np.array([5, 6, 7, 5, 6, 8])
    i, j, joined = np.array([0, 0, 1, 2, 4]), np.array([1, 2, 2, 3, 5]), {}
    assert J._joining(g, comp, i, j, joined).tolist() == [True, True, False, False, True]
    assert not J._joining(g, comp, i, j, joined).any()


def test_lists_over_batches(spark):
    """Lists, copies and the first sets of stretches are found alike however rows come in batches."""
    import pandas as pd

    rng = random.Random(4)
    rows = sorted({(rng.randrange(30), n := rng.randrange(10, 40), rng.randrange(4), n * 10 + rng.randrange(3)) for _ in range(300)})
    df = pd.DataFrame([(t, s, n, p) for t, n, p, s in [*rows, *rows]], columns=["token", "sid", "n", "pos"]).sort_values(["token", "n", "pos", "sid"])
    whole = pd.concat(J._lists(iter([df]))).values.tolist()
    for size in (1, 2, 7):
        assert pd.concat(J._lists(iter([df.iloc[i : i + size] for i in range(0, len(df), size)]))).values.tolist() == whole
    assert all(5 * r[5] >= 4 * r[2] for r in whole)


def test_query_and_sql(spark, sf):
    import duckdb

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = got(J.op13_ngram_jaccard(spark, sf))
    assert out == plain(rows)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert out == sorted(c.execute(f"select doc_id, n_shingles, component_id from ({J.OP13_SQL})").fetchall(), key=str)
