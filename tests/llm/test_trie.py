"""The prefix trie against one of nested dictionaries."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from isoline.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def sequences(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """Rows of the contract from every prefix of every conversation."""
    if not convs:
        return []
    members, ends, children = {}, {}, {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        leaves, saved, stack = 0, 0, [p]
        while stack:
            q = stack.pop()
            below = children.get(q, [])
            leaves += not below
            saved += (len(members[q]) - 1) * (words(q[-1][1]) if q else 0)
            stack += below
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, digest))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_random_conversations(spark, monkeypatch, block):
    """Shared beginnings, ends inside of others, long and equal conversations, over blocks of any size."""
    monkeypatch.setattr(T, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for c in [*range(-3, 90), 1000, 10**15]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), " ".join(rng.choice(["a", "b\tc", ""]) for _ in range(2))))
    rows += [(500, i, "user", f"turn {i}") for i in range(300)] + [(501, i, "user", f"turn {i}") for i in range(299)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    convs = sequences(rows)
    assert got(T.trie(T.rooted(T.numbered(df)))) == sorted(plain(convs), key=str)
    assert got(T.trie(T.rebuilt(T.numbered(df)))) == sorted(plain(rebuilt(convs)), key=str)


def test_odd_rows(spark, stored):
    """Nulls anywhere, ties, repeated rows, a null turn first, further columns; rows without conv_id are left out."""
    rows = [(40, 1, "user", None), (40, None, None, "first"), (41, 1, "user", ""), (41, 1, "user", ""), (None, 1, "user", "x"), (45, 2, "b", "same"), (45, 2, "a", "same"), (60, 3, "user", "x " * 50_000), (61, 0, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("clash")).withColumn("words", F.lit(1))
    d = stored(conversations=df)
    assert got(T.op11_conversation_trie(spark, d)) == sorted(plain(rebuilt(sequences(rows))), key=str)
    empty = stored(conversations=df.limit(0))
    assert T.op11_conversation_trie(spark, empty).count() == 0


def test_a_turnless_conversation_ends_at_the_root(spark):
    """An id whose own turns all go and whose base has none stays a member of the root alone."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "one"), (c, 1, "user", "two")]
    out = got(T.trie(T.rebuilt(T.numbered(spark.createDataFrame(rows, SCHEMA)))))
    assert out == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_bitmaps_of_a_block():
    having, ending = T.vertical([[b"x", b"y"], [b"x"], [b"z", b"y"]])
    assert having == {(0, b"x"): 0b011, (1, b"y"): 0b101, (0, b"z"): 0b100}
    assert ending == {2: 0b101, 1: 0b010}


def test_a_hot_beginning(spark, monkeypatch):
    """One prefix and one end that all conversations share, over many blocks."""
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(c, i, "user", f"t{i}") for c in range(700) for i in range(2)]
    assert got(T.trie(T.rooted(T.numbered(spark.createDataFrame(rows, SCHEMA))))) == sorted(plain(sequences(rows)), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(T.op11_conversation_trie(spark, sf)) == sorted(plain(rebuilt(sequences(rows))), key=str)


def test_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    df = T.op11_conversation_trie(spark, sf)
    assert got(df) == sorted(c.execute(f"select {', '.join(df.columns)} from ({T.OP11_SQL})").fetchall(), key=str)
