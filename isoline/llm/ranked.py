"""Ranked lexical search by two trees, one over items and one over documents.

A score is the inner product of an item's weights and a document's values, none of
which is negative. So the product of two nodes' coordinate maxima bounds every
score between the items under one and the documents under the other. A pair of
nodes goes as a whole when its bound is below the weakest of its items' kth scores
so far; what is left is scored in whole numbers. Equal bounds stay, as a tie may
be won by the smaller id: nothing is lost.

Documents are read once and kept as the counts of those terms that some item has,
with the corpus' own counts taken over all of them. Tasks build a tree for each
few hundred of their documents and keep their items' best; a first search over
every 32nd or so document gives each item a score that its kth can't be below, so
that all tasks prune from the start. Items come in blocks of bounded size, each
searched for in all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, table, text_or_empty, written

#: Characters of the items of a block, about: their vocabulary and weights are sent to all tasks.
ITEM_CHARS = 1 << 21
#: Documents of a tree at most, cells of its table of values at most, and documents of a leaf; items stand alone in theirs.
DOCS, CELLS, LEAF = 1024, 1 << 23, 8
#: One of so many documents is searched first.
FIRST = 32
#: Numbers that stand for a vector where a tree is cut.
SKETCH = 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of anything beyond ASCII, A to Z in lower case, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Items:
    """A block of items: ids, rows (their keys), and by item the numbers of its terms with their repeats."""

    ids: list[int | None]
    rows: list[int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]


def items_of(rows: list[tuple[int | None, int, str | None]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    counted = [Counter(terms_of(text)) for _, _, text in rows]
    terms = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in c], dtype=np.int64) for c in counted]
    return Items([r[0] for r in rows], [r[1] for r in rows], terms, [np.array(list(c.values()), dtype=np.int64) for c in counted], vocabulary)


def counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): each whole text's number of terms, and of the vocabulary's those that it has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                found = terms_of(text)
                held = [(vocabulary[t], k) for t, k in Counter(found).items() if t in vocabulary]
                out.append((None if pd.isna(doc) else int(doc), len(found), [t for t, _ in held], [k for _, k in held]))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "tf"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(count, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass
class Tree:
    """Nodes over rows in the order of ``order``: node v holds order[low[v]:high[v]]; its children follow it, or it has none (-1)."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray


def tree_of(sketches: np.ndarray, leaf: int) -> Tree:
    """Parts of parts of rows, each cut into those nearer to one of two means, until a node has at most leaf; rows that are all alike are cut in half."""
    order, spans, left, right = np.arange(len(sketches)), [], [], []
    stack = [(0, len(sketches), -1, False)]
    while stack:
        lo, hi, parent, is_left = stack.pop()
        v = len(spans)
        spans.append((lo, hi))
        left.append(-1)
        right.append(-1)
        if parent >= 0:
            (left if is_left else right)[parent] = v
        if hi - lo > leaf:
            x = sketches[order[lo:hi]]
            a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
            b = x[np.argmax(((x - a) ** 2).sum(1))]
            for _ in range(4):
                near = x @ (b - a) * 2 > b @ b - a @ a
                if near.all() or not near.any():
                    break
                a, b = x[~near].mean(0), x[near].mean(0)
            order[lo:hi] = order[lo:hi][np.argsort(near, kind="stable")]
            mid = hi - int(near.sum()) if near.any() and not near.all() else (lo + hi) // 2
            stack += [(mid, hi, v, False), (lo, mid, v, True)]
    low, high = np.array(spans, dtype=np.int64).reshape(-1, 2).T
    return Tree(order, low, high, np.array(left), np.array(right))


def sketched(owner: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Rows of unit length that stand for sparse vectors: terms fall into SKETCH cells with a sign."""
    h = (term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    cell, sign = (h >> np.uint64(40)).astype(np.int64) % SKETCH, np.where(h >> np.uint64(63), 1.0, -1.0)
    x = np.bincount(owner * SKETCH + cell, weights=sign * weight, minlength=rows * SKETCH).reshape(rows, SKETCH)
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)


class Search:
    """The best documents so far of a block's items, and the tree over the items."""

    def __init__(self, items: Items, idf: np.ndarray, least: np.ndarray, k: int):
        self.k, self.idf, self.size = k, idf, len(items.vocabulary)
        weights = [r * idf[t] for t, r in zip(items.terms, items.repeats, strict=True)]
        owner = np.repeat(np.arange(len(weights)), [len(w) for w in weights])
        self.tree = tree_of(sketched(owner, np.concatenate([*items.terms, np.empty(0, np.int64)]), np.concatenate([*weights, np.empty(0)]), len(weights)), 1)
        self.terms, self.weights = [items.terms[i] for i in self.tree.order], [weights[i] for i in self.tree.order]
        self.kth = least[self.tree.order].astype(np.int64)  # none of the k best scores less
        self.best = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)) for _ in weights]
        self.nodes = [self._maxima(lo, hi) for lo, hi in zip(self.tree.low, self.tree.high, strict=True)]
        self.met = [0, 0]  # pairs of an item and a document: all, and those scored

    def _maxima(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        terms, weights = np.concatenate(self.terms[lo:hi]), np.concatenate(self.weights[lo:hi])
        own, at = np.unique(terms, return_inverse=True)
        most = np.zeros(len(own), dtype=np.int64)
        np.maximum.at(most, at, weights)
        return own, most

    def add(self, ids: np.ndarray, missing: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Searches documents: ids, those that are null, and their values, at most a million, by number of document and term."""
        if not len(ids) or not self.terms:
            return
        tree = tree_of(sketched(owner, term, value * self.idf[term], len(ids)), LEAF)
        place = np.empty(len(ids), np.int64)
        place[tree.order] = np.arange(len(ids))
        self.ids, self.missing = ids[tree.order], missing[tree.order]
        self.values = np.zeros((self.size, len(ids)), dtype=np.int32)
        self.values[term, place[owner]] = value
        self.docs = tree
        self.most = np.stack([self.values[:, lo:hi].max(1) for lo, hi in zip(tree.low, tree.high, strict=True)], axis=1)
        self.met[0] += len(ids) * len(self.terms)
        self._visit()

    def _visit(self) -> None:
        """Meets nodes of items with nodes of documents, from both roots down, a level at a time."""
        stack = [(0, np.zeros(1, np.int64))]
        while stack:
            node, docs = stack.pop()
            terms, most = self.nodes[node]
            lo, hi = self.tree.low[node], self.tree.high[node]
            # Products of whole numbers: a margin covers what their sums in floating point may lack.
            bound = (most.astype(float) @ self.most[np.ix_(terms, docs)]) * (1 + 1e-9)
            docs = docs[bound >= max(1, self.kth[lo:hi].min())]
            if not len(docs):
                continue
            inner = self.docs.left[docs] >= 0
            below = np.concatenate([self.docs.left[docs[inner]], self.docs.right[docs[inner]], docs[~inner]]) if inner.any() else docs
            if self.tree.left[node] >= 0:
                stack += [(self.tree.right[node], below), (self.tree.left[node], below)]
            elif inner.any():
                stack.append((node, below))
            else:
                self._score(range(lo, hi), np.concatenate([np.arange(self.docs.low[v], self.docs.high[v]) for v in docs]))

    def _score(self, items: range, docs: np.ndarray) -> None:
        self.met[1] += len(items) * len(docs)
        for i in items:
            scores = self.weights[i] @ self.values[np.ix_(self.terms[i], docs)].astype(np.int64)
            good = scores >= max(1, self.kth[i])
            if not good.any():
                continue
            s, m, d = (np.concatenate(x) for x in zip(self.best[i], (scores[good], self.missing[docs[good]], self.ids[docs[good]]), strict=True))
            first = np.lexsort((d, m, -s))[: self.k]
            self.best[i] = s[first], m[first], d[first]
            if len(first) == self.k:
                self.kth[i] = max(self.kth[i], s[first[-1]])


def values_of(n: np.ndarray, tf: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A term's value in a document of n terms, tf of which are the term, in a corpus of so many documents and terms."""
    m = 100 - 75 + (75 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _best(held: DataFrame, items: Items, idf: np.ndarray, least: np.ndarray, docs: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task's documents those that may be among an item's k best; item is its place in the block."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Search(items, idf, least, k)
        rows = max(LEAF, min(DOCS, CELLS // max(1, len(items.vocabulary))))
        for b in batches:
            for i in range(0, len(b), rows):
                part = b.iloc[i : i + rows]
                sizes = part["terms"].map(len).to_numpy()
                owner = np.repeat(np.arange(len(part)), sizes)
                term, tf = np.concatenate([*part["terms"], np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*part["tf"], np.empty(0, np.int64)]).astype(np.int64)
                value = values_of(np.repeat(part["n"].to_numpy(), sizes), tf, docs, terms)
                found.add(part["doc_id"].fillna(0).to_numpy(np.int64), part["doc_id"].isna().to_numpy(), owner, term, value)
        out = [(int(at), None if m else int(d), int(s)) for at, best in zip(found.tree.order, found.best, strict=True) for s, m, d in zip(*best, strict=True)]
        yield pd.DataFrame(out, columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    tops = held.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tf").mapInPandas(search, "item long, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return tops.withColumn("rank", rank).filter(F.col("rank") <= k)


def ranked(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text), by op12_ranked_search's scores.

    Ties go to the smaller doc_id, null last. Null and empty texts have no terms:
    as items they find nothing, as documents they are never found. Repeated rows of
    either are items and documents of their own. No documents give no rows.
    """
    spark = docs.sparkSession
    items = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("row")), "items")
    blocks = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 1) / ITEM_CHARS)
    out = [_searched(_block(items, i, blocks), docs, k) for i in range(blocks)]
    forget(items)
    return reduce(DataFrame.unionAll, [x for x in out if x is not None] or [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")])


def _block(items: DataFrame, i: int, blocks: int) -> Items:
    rows = items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i) if blocks > 1 else items
    return items_of([tuple(r) for r in rows.select("item_id", "row", "text").orderBy("row").collect()])


def _searched(items: Items, docs: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    if not items.vocabulary:
        return None
    held = written(counts(docs.select("doc_id", text_or_empty().alias("text")), items.vocabulary), "counts")
    n, terms = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not terms:
        return None
    df = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = np.full(len(items.vocabulary), math.floor(1000 * math.log(2 * n + 2)), dtype=np.int64)
    for t, c in df.collect():  # the vocabulary of a block of items
        idf[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1)))
    least = np.zeros(len(items.ids), dtype=np.int64)
    first = held.filter(F.pmod(F.xxhash64("terms", "n"), F.lit(FIRST)) == 0)
    for item, score in _best(first, items, idf, least, n, terms, k).filter(F.col("rank") == k).select("item", "score").collect():
        least[item] = score
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], "item long, item_id long")
    best = _best(held, items, idf, least, n, terms, k).join(F.broadcast(names), "item")
    return best.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents."""
    return ranked(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
z AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, sum(len(t))::BIGINT AS terms FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, z GROUP BY term, docs),
i AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score FROM i JOIN w USING (term) JOIN f USING (term), z GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
