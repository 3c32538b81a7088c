"""Ranked search against scores of every item and document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.llm import ranked as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n, size = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 100 - 75 + (75 * sum(b.values()) * n) // size if size else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(spark, items, docs):
    return spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("docs_a_tree,chars", [(4, 1 << 21), (64, 200)])
def test_random_texts(spark, monkeypatch, docs_a_tree, chars):
    """Small trees, several blocks of items, ties by the dozen."""
    monkeypatch.setattr(R, "DOCS", docs_a_tree)
    monkeypatch.setattr(R, "LEAF", 2)
    monkeypatch.setattr(R, "ITEM_CHARS", chars)
    rng = random.Random(docs_a_tree)
    vocabulary = ["Ab", "ÄB", "äb", "x1", "c", "d-e", "ñ", "f", "g", "日本", "z"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=range(1, 12), k=n))
    docs = [(i, text(rng.choice([1, 2, 5, 30]))) for i in range(150)]
    docs += [(200 + i, docs[i][1]) for i in range(40)]
    items = [(i, text(rng.choice([1, 3, 8]))) for i in range(25)]
    assert got(R.ranked(*tables(spark, items, docs))) == plain(items, docs)


def test_odd_rows(spark, stored):
    """Nulls in any column, empty and very long texts, repeated rows, texts without terms, further columns, empty tables."""
    docs = [(1, None), (2, ""), (3, "... --"), (4, "one Two"), (4, "one Two"), (None, "one two"), (6, "one " * 100_000 + "rare"), (7, "a\0b one")]
    items = [(1, None), (2, ""), (3, "ONE two two"), (3, "ONE two two"), (None, "rare"), (5, "unheard"), (6, "b")]
    a, b = tables(spark, items, docs)
    d = stored(benchmark=a.withColumn("row", F.lit(1)).withColumn("n", F.lit(2)), documents=b.withColumn("terms", F.lit("x")).withColumn("n", F.lit(2)))
    assert got(R.op12_ranked_search(spark, d)) == plain(items, docs)
    assert got(R.op12_ranked_search(spark, stored(benchmark=a.limit(0), documents=b))) == []
    assert got(R.op12_ranked_search(spark, stored(benchmark=a, documents=b.limit(0)))) == []


def test_batches_are_pruned_and_the_rest_is_exact():
    """Node pairs below the weakest kth score go; the ten best of each item stay what all scores give."""
    rng = np.random.default_rng(5)
    n_docs, size = 4096, 400
    items = R.items_of([(i, i, " ".join(f"t{x}" for x in (i % 8) * 50 + rng.integers(0, 50, 12))) for i in range(64)])
    names = {int(t[1:]): i for t, i in items.vocabulary.items()}
    idf = rng.integers(1, 9000, len(names))
    search = R.Search(items, idf, np.zeros(64, np.int64), 10)
    table = np.zeros((n_docs, len(names)), dtype=np.int64)
    for d in range(n_docs):
        for t in {x for x in (d % 8) * 50 + rng.integers(0, 50, 20)} & set(names):
            table[d, names[t]] = rng.integers(1, 1_000_000)
    for lo in range(0, n_docs, 512):
        owner, term = np.nonzero(table[lo : lo + 512])
        search.add(np.arange(lo, lo + 512), np.zeros(512, bool), owner, term, table[lo : lo + 512][owner, term])
    assert search.met[0] == 64 * n_docs and search.met[1] < search.met[0] / 3
    for at, (s, _, d) in zip(search.tree.order, search.best, strict=True):
        scores = (items.repeats[at] * idf[items.terms[at]]) @ table[:, items.terms[at]].T
        want = sorted((-x, i) for i, x in enumerate(scores.tolist()) if x > 0)[:10]
        assert [(-a, b) for a, b in zip(s.tolist(), d.tolist(), strict=True)] == want


def test_query_against_brute_force_and_sql(spark, sf):
    import duckdb

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = got(R.op12_ranked_search(spark, sf))
    assert out == plain(items, docs)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert out == sorted(c.execute(f"select item_id, rank, doc_id, score from ({R.OP12_SQL})").fetchall(), key=str)
