"""Toxicity by multiple-instance learning: noisy-or of sentence scores, trained from document labels.

A sentence's score is a logistic function of the summed weights of its words; a
word's weight sums those of its hashed features (the word and its beginnings of
three to seven letters, marked where the word goes on). A document is toxic unless none of its sentences is:
1 - prod(1 - p). Only documents are labelled; the gradient through the noisy-or
tells which sentences to blame, so that a trained model also locates them.

The model is trained in numpy on the driver from hashed features of a bounded
sample: at most ``PER_LABEL`` rows of each label, weighed to the counts that all
labelled rows have. Scores cover every row and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, table, unused, written
from .langid import drawn, fold

BUCKETS, PER_LABEL, LEAST_DOCS, ROUNDS, RATE = 1 << 18, 1200, 2, 400, 0.15
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+")
BEGINNINGS = (3, 4, 5, 6, 7)


def features(word: str) -> list[int]:
    named = [f"={word}", *(word[:n] + "+" * (len(word) > n) for n in BEGINNINGS)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in named]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


class _Weights(dict):
    """Words' weights, kept by worker up to a bound."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.of = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 150_000:
            self.clear()
        got = self[word] = float(self.of[features(word)].sum())
        return got


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], ids: np.ndarray, words: np.ndarray, weight: dict[int, float]) -> Model:
    """A model from (label, id of each word, sentence of each word) rows; ids: of all words, sorted; words: their features; weight: of a row by label."""
    docs = [d for d in docs if len(d[1])]
    if not docs:
        return Model(np.zeros(BUCKETS, dtype=np.float32), -5.0)
    y = np.array([d[0] for d in docs], dtype=float)
    by_doc = np.array([weight.get(d[0], 1.0) for d in docs], dtype=float)
    by_doc /= by_doc.sum()
    which = [np.searchsorted(ids, d[1]) for d in docs]
    # A feature in few documents says nothing about others.
    in_docs = np.zeros(BUCKETS, dtype=np.int64)
    for x in which:
        in_docs[np.unique(words[np.unique(x)])] += 1
    frequent = in_docs >= LEAST_DOCS
    n_sentences = [int(d[2].max()) + 1 for d in docs]
    first = np.cumsum([0, *n_sentences])
    sentence = np.concatenate([d[2].astype(np.int64) + a for d, a in zip(docs, first, strict=False)])
    doc_of_sentence, which, base = np.repeat(np.arange(len(docs)), n_sentences), np.concatenate(which), int(first[-1])
    w, bias, k = np.zeros(BUCKETS), -np.log(base / len(docs) * 8), words.shape[1]
    m1, m2, b1, b2 = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        score = (w[words] * frequent[words]).sum(axis=1)
        z = bias + np.bincount(sentence, score[which], minlength=base)
        none = np.bincount(doc_of_sentence, _softplus(z), minlength=len(docs))  # -log(1 - P)
        blame = np.where(y > 0, -by_doc / np.expm1(np.clip(none, 1e-9, 50)), by_doc)
        slope = blame[doc_of_sentence] / (1 + np.exp(-np.clip(z, -500, 500)))
        by_word = np.bincount(which, slope[sentence], minlength=len(words))
        g = np.bincount(words.ravel(), np.repeat(by_word, k), minlength=BUCKETS) * frequent + 2e-5 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-5)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * 0.02, 0)  # leaves out what does not pay
        gb = slope.sum()
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        bias -= 0.05 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-5)
    return Model((w * frequent).astype(np.float32), float(bias))


def learned(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic); rows with a null in either count as unlabelled.

    The bounded sample of labels is joined to the documents' texts; a label of
    each kind, or of a repeated document, is a row of its own. The driver gets
    the ids of the sample's words, and the features of each word once.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # at most two rows
    some = drawn(known, "y", "doc_id", per_label)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id")  # 2 * per_label rows at most
    order = W.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = written(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label), "labelled").select("n", "y", "text").repartition("n")

    def worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, y, text in zip(b["n"], b["y"], b["text"], strict=True):
                found = [(word_id(word), i) for i, s in enumerate(SENTENCES.findall(text.lower())) for word in WORDS.findall(s)]
                out.append((n, y, np.array([x for x, _ in found], dtype=np.int64), np.array([i for _, i in found], dtype=np.int32)))
            yield pd.DataFrame(out, columns=["n", "y", "words", "sentences"])

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = sorted({word for text in b["text"] for word in WORDS.findall(text.lower())})
            yield pd.DataFrame({"id": [word_id(x) for x in words], "features": [features(x) for x in words]})

    got = rows.mapInPandas(worded, "n int, y int, words array<bigint>, sentences array<int>").toArrow().combine_chunks().sort_by([("n", "ascending"), ("y", "ascending")])
    words = rows.mapInPandas(listed, "id long, features array<int>").distinct().toArrow().combine_chunks().sort_by("id")
    table_of = np.zeros((0, 1 + len(BEGINNINGS)), dtype=np.int32)
    if words.num_rows:
        table_of = words["features"].combine_chunks().flatten().to_numpy().reshape(-1, 1 + len(BEGINNINGS))
    y = got["y"].to_pylist()
    weight = {k: counts.get(k, 0) / y.count(k) for k in set(y)}
    examples = [(k, a.values.to_numpy(), b.values.to_numpy()) for k, a, b in zip(y, got["words"], got["sentences"], strict=True)]
    return train(examples, words["id"].to_numpy(), table_of, weight)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct column out: score (0 to 1; 0 for null texts and texts without a sentence) and offending, the (start, end, score) in code points of the sentences above one half.

    Repeated rows each come back alike; docs keeps all its columns, and one named
    out is an error.
    """
    free(docs, out)
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = given.value
        known, bias = _Weights(m.weights), m.bias
        get, words = known.__getitem__, WORDS.findall
        for texts in batches:
            scores, offending = [], []
            for x in texts:
                low = (x or "").lower()
                z = np.array([bias + sum(map(get, words(s))) for s in SENTENCES.findall(low)])
                scores.append(-float(np.expm1(-_softplus(z).sum())))
                spans = []
                if len(z) and z.max() > 0:
                    places = [m.span() for m in SENTENCES.finditer(low if len(low) == len(x) else x)]
                    spans = [{"start": a, "end": b, "score": float(1 / (1 + np.exp(-v)))} for (a, b), v in zip(places, z, strict=False) if v > 0]
                offending.append(spans)
            yield pd.DataFrame({"score": scores, "offending": offending})

    return docs.withColumn(out, judge(F.col(text)))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose score is under one half, with their columns."""
    c = unused(docs, "toxicity")
    return score(docs, model, text, c).filter(F.col(c)["score"] < 0.5).select(*docs.columns)


def trained_on(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """A model of docs and the labels outside fold 0."""
    return learned(docs, table(spark, sf_dir, "labels").filter(fold() != 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    rows = score(docs.select("doc_id", "text"), trained_on(spark, sf_dir, docs))
    s = F.col("toxicity")["score"]
    return rows.select("doc_id", (fold() == 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.size(F.col("toxicity")["offending"]).cast("long").alias("n_offending"))
