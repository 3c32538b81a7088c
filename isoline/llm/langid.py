"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of one to three letters or word breaks of the lower-cased
text, hashed into ``BUCKETS``. A text is the mean of its subwords' embeddings;
a linear layer and a softmax give the languages. Both are trained by stochastic
gradient descent in numpy on the driver, from hashed counts of a bounded sample
of labelled rows: at most ``PER_LANGUAGE`` rows of each language, and ``ROWS`` in
all, shared evenly where there are many languages. Every language with labelled
rows is learned; more than ``VALUES`` of them are an error. A part of the
sample sets the softmax's temperature and the score under which an answer is
rejected (``accepted`` false). Prediction covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, table

BUCKETS, WIDTH, ORDERS = 1 << 14, 16, 3
PER_LANGUAGE, ROWS, VALUES, EPOCHS, BATCH, RATE = 600, 60_000, 5000, 12, 32, 20.0
CHUNK = 1 << 20
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def subwords(text: str | None) -> np.ndarray:
    """Counts of a whole text's subwords by bucket; all zero without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts, any_letter = np.zeros(BUCKETS, dtype=np.int64), False
    before, after_letter = codes[:0], True
    for i in range(0, len(codes), CHUNK):  # what is needed at a time stays small
        c = codes[i : i + CHUNK]
        letter = letter_table()[c]
        any_letter |= bool(letter.any())
        c = np.where(letter, c, 0)[letter | np.concatenate([[after_letter], letter[:-1]])]  # one break between words
        after_letter, c = bool(letter[-1]), np.concatenate([before, c])
        h = np.zeros(len(c), dtype=np.uint32)
        for n in range(min(ORDERS, len(c))):
            h = (h[: len(c) - n] * np.uint32(31) ^ c[n:]) * _MIX[n]
            new = h[max(0, len(before) - n) :]  # those that end in this chunk
            counts += np.bincount((new ^ (new >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        before = c[len(c) - min(len(c), ORDERS - 1) :]
    return counts if any_letter else np.zeros(BUCKETS, dtype=np.int64)


@dataclass
class Model:
    """logits of a text: mean over subwords of table, plus bias, over the temperature."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.table / max(1, counts.sum()) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """A model from (lang, buckets, counts) rows; None without any."""
    if not rows:
        return None
    langs = sorted({x[0] for x in rows})
    y = np.array([langs.index(x[0]) for x in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    check, learn = np.split(order, [len(rows) // 5]) if len(rows) >= 20 * len(langs) else (order, order)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), BUCKETS))
        for k, i in enumerate(ids):
            x[k, rows[i][1]] = rows[i][2] / max(1, rows[i][2].sum())
        return x

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for ids in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            if not len(ids):
                continue
            x = dense(ids)
            mean = x @ emb
            slope = _softmax(mean @ out + bias)
            slope[np.arange(len(ids)), y[ids]] -= 1
            slope /= len(ids)
            back = slope @ out.T
            out -= rate * 0.1 * mean.T @ slope
            bias -= rate * 0.01 * slope.sum(axis=0)
            hit = x.any(axis=0)
            emb[hit] -= rate * (x[:, hit].T @ back)
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    z = np.concatenate([dense(ids) @ model.table + bias for ids in np.array_split(check, max(1, len(check) // 256))])
    nll = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=nll))
    p = _softmax(z / model.temperature)
    right = p.argmax(axis=1) == y[check]
    # The least threshold above which 99 of 100 answers on these rows are right.
    best = p.max(axis=1)
    by = np.argsort(-best)
    fine = np.flatnonzero(np.cumsum(right[by]) >= 0.99 * np.arange(1, len(by) + 1))
    model.threshold = float(best[by[fine[-1]]]) if len(fine) else 1.0
    return model


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def drawn(rows: DataFrame, by: str, key: str, most: int, total: int = ROWS) -> DataFrame:
    """At most most rows of each value of by, and about total in all, by a hash of key; more than VALUES values are an error.

    Counts come first, so that about twice as many rows as wanted leave the
    tasks that read them, however many tasks there are; they are then cut to
    most exactly.
    """
    counts = rows.groupBy(by).count().limit(VALUES + 1).collect()
    if len(counts) > VALUES:
        raise ValueError(f"more than {VALUES} values of {by}: labels these can't be")
    if not counts:
        return rows.limit(0)
    most = max(1, min(most, total // len(counts)))
    share = rows.sparkSession.createDataFrame([(r[by], (2 * most + 50) / r["count"]) for r in counts], f"{by} {dict(rows.dtypes)[by]}, drawn_share double")
    h = F.xxhash64(F.col(key), F.lit(9))
    rows = rows.join(F.broadcast(share), by).filter(F.pmod(h, F.lit(1 << 30)) / (1 << 30) < F.col("drawn_share")).select(*rows.columns)
    n = F.row_number().over(W.partitionBy(by).orderBy(h, F.col(key)))
    return rows.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most per_language labelled rows (text, lang) of each language, by a hash of doc_id."""
    return drawn(docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang"), "lang", "doc_id", per_language).select("text", "lang")


def learned(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from labelled rows (doc_id, text, lang): hashed counts of the bounded sample come to the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(lang, np.flatnonzero(c).astype(np.int32), c[c > 0].astype(np.int32)) for lang, c in zip(b["lang"], map(subwords, b["text"]), strict=True) if c.any()]
            yield pd.DataFrame(rows, columns=["lang", "buckets", "counts"])

    rows = sample(labelled, per_language).mapInPandas(counted, "lang string, buckets array<int>, counts array<int>").toPandas()
    rows = rows.sort_values(["lang", "buckets", "counts"], key=lambda c: c.map(lambda x: x if isinstance(x, str) else bytes(np.asarray(x, dtype=np.int32))))
    return train([(a, np.asarray(b), np.asarray(c)) for a, b, c in rows.itertuples(index=False)])


def predict(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column out: lang_pred, score and accepted.

    Null texts, texts without letters and all texts without a model are und with
    score 0, not accepted. Of languages that score alike the first by name is
    answered. Repeated rows each come back alike; docs keeps all its columns,
    and one named out is an error.
    """
    free(docs, out)
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = given.value
        for texts in batches:
            out = []
            for x in texts:
                counts = subwords(x)
                if m is None or not counts.any():
                    out.append((UNKNOWN, 0.0, False))
                else:
                    p = m.scores(counts)
                    k = int(p.argmax())
                    out.append((m.langs[k], float(p[k]), bool(p[k] >= m.threshold)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    return docs.withColumn(out, guess(F.col(text)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.filter(fold() != 0))
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "language.*")
