import random

import pytest
from pyspark.sql import functions as F

from isoline.llm import bpe


@pytest.fixture(scope="module")
def library():
    return bpe.load("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    return [
        None, "", " ", "\n\t ", "Hello  WÖRLD", "don't we'll 'st ''s '''s", pick("ab", 3000), pick("abcdefgh", 3000), pick("'s", 2000), pick("!?.,'", 2000), pick("1a", 2000),
        pick("aé́ ", 3000), pick("日本語a", 2000), "x" * 5000, "the" * 1500, pick("ab \n", 3000), "<|endoftext|>" * 200, "!!<|startoftext|>s" * 100, pick("😀🏳️‍🌈a", 800),
        pick("the of and'll ", 4000), "İSTANBUL ΣΑΣ ΟΔΟΣ " * 100, "a b c\x0bd\x0ce\x1cf\x85g" * 100, "Straße" * 500,
        pick("".join(map(chr, bpe._PLAIN)), 4000), pick("aAÀÿ'sTµª²¼×÷ \n", 4000), pick("".join(map(chr, range(1, 0x250))), 4000),
    ]


@pytest.mark.parametrize(("leaf", "spread"), [(32, 32), (57, 57), (1000, 1000), (32, 10**6), (300, 2500), (1100, 10**6), (1024, 2048)])
def test_as_the_library(spark, library, leaf, spread):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(docs, ["doc_id"], leaf=leaf, spread=spread).withColumn("said", bpe.decode(F.col("ids"))).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        want = library.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == want, (i, leaf)
        assert got[i].said == library.decode(want, skip_special_tokens=False)


def test_documents(spark, library, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, ["doc_id"], leaf=500, spread=4000).collect()}
    for r in rows:
        assert got[r.doc_id] == library.encode(r.text, add_special_tokens=False).ids


def test_digests_repeated_and_empty(spark, docs_of, library):
    from hashlib import sha256

    docs = docs_of([(1, "Same text"), (1, "Same text"), (None, None)])
    got = bpe.digest(docs).collect()
    assert len(got) == 3
    ids = library.encode("Same text", add_special_tokens=False).ids
    for r in got:
        want = ids if r.doc_id == 1 else []
        assert (r.n_tokens, r.ids_sha256) == (len(want), sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(library.decode(want).encode()).hexdigest()
    assert bpe.digest(docs.limit(0)).count() == 0
