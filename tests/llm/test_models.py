"""Language and toxicity: held-out accuracy, bounds and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.llm import langid as L
from isoline.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    rows = L.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    sure = [r for r in held if r.accepted]
    assert np.mean([r.lang == r.lang_pred for r in sure]) > 0.98 and len(sure) > 0.8 * len(held)


def test_language_of_odd_rows(spark, docs_of, stored):
    rows = [(i, "the cat and the dog went to town " * 3 if i % 2 else "der hund und die katze gehen in die stadt " * 3) for i in range(40)]
    docs = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    docs = docs.unionByName(docs_of([(100, None), (101, ""), (102, "123 !?"), (103, "the dog " * 300_000), (None, "katze"), (1, rows[1][1])]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.op9_language_id(spark, stored(documents=docs)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[None][0] == "de"
    empty = L.op9_language_id(spark, stored(documents=docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert L.op9_language_id(spark, stored(documents=docs.limit(0))).count() == 0


def test_toxicity_of_held_out_documents(spark):
    rows = X.op10_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = ([r.predicted for r in held if r.toxic == y] for y in (1, 0))
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02


def made(docs_of, spark):
    rng = np.random.default_rng(0)
    words = [f"word{i}x".replace("0", "o").replace("1", "i") for i in "abcdefghij"]
    rows = []
    for i in range(200):
        sentences = [" ".join(rng.choice(["wa", "be", "ko", "mi", "ru", "to", "ne", "sa"], 6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[i % 5] += " nasty"
        rows.append((i, ". ".join(sentences) + "."))
    assert words
    return docs_of(rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")


def test_offending_sentences_are_found(spark, docs_of):
    docs, labels = made(docs_of, spark)
    model = X.learned(docs, labels)
    odd = docs_of([(1, "wa be ko. NASTY mi ru! sa"), (2, "wa be ko"), (3, None), (4, ""), (5, "wa be. " * 50_000)])
    got = {r.doc_id: r.toxicity for r in X.score(odd, model).collect()}
    assert got[1].score > 0.5 and [(s.start, s.end) for s in got[1].offending] == [(9, 21)]
    assert got[2].score < 0.5 and not got[2].offending
    assert got[3].score == got[4].score == 0.0
    assert 0 <= got[5].score <= 1
    kept = X.drop_toxic(odd.withColumnRenamed("lang", "toxicity"), model)
    assert kept.columns == ["doc_id", "text", "toxicity", "source", "n_chars"] and 1 not in {r.doc_id for r in kept.collect()}


def test_without_labels(spark, docs_of):
    docs = docs_of([(1, "x"), (1, "x"), (None, None)])
    none = spark.createDataFrame([(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    assert X.score(docs, X.learned(docs, none)).count() == 3
    assert X.score(docs.limit(0), X.learned(docs.limit(0), none.limit(0))).count() == 0


def slow_subwords(text):
    """Counts by bucket, letter by letter, in plain numbers."""
    seq, after_letter = [], True
    for c in (text or "").lower():
        if c.isalpha():
            seq.append(ord(c))
        elif after_letter:
            seq.append(0)
        after_letter = c.isalpha()
    counts = np.zeros(L.BUCKETS, dtype=np.int64)
    for i in range(len(seq)):
        h = 0
        for n in range(min(L.ORDERS, len(seq) - i)):
            h = (h * 31 & 0xFFFFFFFF ^ seq[i + n]) * int(L._MIX[n]) & 0xFFFFFFFF
            counts[(h ^ h >> 15) & (L.BUCKETS - 1)] += 1
    return counts if any(seq) else counts * 0


def test_subwords_by_hand(monkeypatch):
    texts = ["", None, "12 .", "a", "Der Hund, die Katze!", "  x y  ", "ab" * 50 + "1" * 40 + "c" * 7, "日本語 and ÜBER 1a2b"]
    for size in (1 << 20, 1, 2, 3, 7):
        monkeypatch.setattr(L, "CHUNK", size)
        for x in texts:
            assert (L.subwords(x) == slow_subwords(x)).all(), (size, x)


def test_predictions_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.learned(docs.filter(L.fold() != 0))
    for r in L.predict(docs, model).collect():
        c = slow_subwords(r.text)
        z = ((c[:, None] * model.table).sum(axis=0) / c.sum() + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.language.lang_pred == model.langs[int(p.argmax())] and abs(r.language.score - p.max()) < 1e-9
        assert r.language.accepted == (r.language.score >= model.threshold)


def test_many_languages_and_clashing_names(spark, docs_of):
    rows = [(k * 10 + i, f"{chr(0x4E00 + k)} {chr(0x4E00 + k)}x") for k in range(300) for i in range(2)]
    docs = docs_of(rows).withColumn("lang", F.concat(F.lit("l"), F.floor(F.col("doc_id") / 10)))
    assert len(L.learned(docs).langs) == 300
    named = docs.withColumnsRenamed({"source": "score", "lang": "lang_pred"}).withColumn("accepted", F.lit("mine")).withColumn("guessed__", F.lit(1))
    got = L.predict(named, None)
    assert got.columns == [*named.columns, "language"] and got.filter("accepted = 'mine' and score = 's'").count() == 600
    for f in (lambda d: L.predict(d, None, out="Score"), lambda d: X.score(d.withColumn("toxicity", F.lit(1)), X.Model(np.zeros(X.BUCKETS), 0.0))):
        with pytest.raises(ValueError):
            f(named)


def test_toxicity_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = X.trained_on(spark, sf, docs)
    got = {r.doc_id: r for r in X.op10_toxicity(spark, sf).collect()}
    for r in docs.collect():
        clean, offending = 1.0, 0
        for s in X.re.split(r"[.!?\n]+", r.text.lower()):
            z = model.bias + sum(float(model.weights[i]) for w in X.WORDS.findall(s) for i in X.features(w)) if s else -np.inf
            clean *= 1 - 1 / (1 + np.exp(-z))
            offending += z > 0
        assert abs(got[r.doc_id].score - (1 - clean)) < 1e-6 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].n_offending == offending
