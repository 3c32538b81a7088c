"""A prefix trie of conversations by vertical bitmaps.

Conversations are sorted and cut into blocks, the shards. A block has for each
(position, turn) the bitset of its conversations that have that turn there. From
the root, which all share, a node's bitset is met with the postings of the turns
at the next position: what is left of it gives the child, its popcount the
members, and those that stop there the node's list of ends. The turn to meet next
is that of the node's lowest unassigned conversation, so no meeting is empty and
there are as many as there are children.

A node is named by a digest of its turns, so blocks agree on it. Counts of equal
nodes are summed over the blocks; each node belongs to the first block that holds
it, with all that lead to it, and its leaves and savings are added to those in
one walk per block. End lists come as one piece per block, in their order, and
are hashed as they pass by, never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Conversations and turns of a block at most; a conversation longer than that is a block of its own.
BLOCK, TURNS = 1024, 1 << 16
LOCAL = "block long, pre long, depth long, node binary, n long, least long, words long, inner boolean, ends string"
PARTS = "node binary, block long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, words) of turns (conv_id, turn, role, text): pos counts from 1 by turn (null first; equal turns by role, then by digest), turn is a digest of role and text, nulls of which are empty. Rows without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = turns.filter("conv_id is not null").select("conv_id", F.col("turn").alias("at"), role.alias("role"), said.alias("turn"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("at", "role", "turn")).alias("pos"), "turn", "words")


def rebuilt(rows: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Of numbered() rows: each conversation with its first turns replaced by those of the conversation at the multiple of every below it, as many as its id's CRC-32 modulo heads says, followed by what is left of its own. A row at position 0 stands for each, even for one without turns."""
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = rows.filter(F.col("pos") < heads).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("first"))
    convs = rows.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(first, "base", "left")
    none = F.array().cast(first.schema["first"].dataType)
    convs = convs.withColumn("taken", F.slice(F.coalesce("first", none), F.lit(1), own.cast("int")))
    root = F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words")))
    head = convs.select("conv_id", F.explode(F.concat(root, "taken")).alias("t")).select("conv_id", "t.*")
    shift = convs.select("conv_id", (F.size("taken") - own).alias("shift"))
    tail = rows.filter(F.col("pos") > own).join(shift, "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).cast("int").alias("pos"), "turn", "words")
    return head.unionByName(tail)


def rooted(rows: DataFrame) -> DataFrame:
    """numbered() rows with a row at position 0 for each conversation."""
    root = rows.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words")).distinct()
    return root.unionByName(rows)


def vertical(paths: list[list[bytes]]) -> tuple[dict[tuple[int, bytes], int], dict[int, int]]:
    """The bitsets of a block: of those that have a turn at a position, and of those that have so many turns."""
    having: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for i, path in enumerate(paths):
        for at in enumerate(path):
            having[at] = having.get(at, 0) | 1 << i
        ending[len(path)] = ending.get(len(path), 0) | 1 << i
    return having, ending


def descend(ids: list[int], paths: list[list[bytes]], words: dict[bytes, int]) -> list[tuple]:
    """A block's nodes depth first, children by their least conversation, as LOCAL's columns. ids ascend."""
    having, ending = vertical(paths)
    out, stack = [], [(0, b"", (1 << len(ids)) - 1, 0)]
    while stack:
        depth, node, members, w = stack.pop()
        over = members & ending.get(depth, 0)
        left, children = members ^ over, []
        while left:
            turn = paths[(left & -left).bit_length() - 1][depth]
            child = left & having[depth, turn]
            children.append((depth + 1, hashlib.blake2b(node + turn, digest_size=16).digest(), child, words[turn]))
            left ^= child
        stack += reversed(children)
        ends, more = [], over
        while more:
            ends.append(str(ids[(more & -more).bit_length() - 1]))
            more &= more - 1
        out.append((ids[0], len(out), depth, node, members.bit_count(), ids[(members & -members).bit_length() - 1], w, bool(children), ",".join(ends) if ends else None))
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conv_id and pos: the nodes of each block of whole conversations."""
    names = [c.split()[0] for c in LOCAL.split(", ")]
    ids: list[int] = []
    paths: list[list[bytes]] = []
    words: dict[bytes, int] = {}
    turns = 0
    for b in batches:
        for conv, pos, turn, w in zip(b["conv_id"].tolist(), b["pos"].tolist(), b["turn"], b["words"].tolist(), strict=True):
            if pos:
                turn = bytes(turn)
                paths[-1].append(turn)
                words[turn] = w
                turns += 1
                continue
            if len(ids) == BLOCK or turns >= TURNS:
                yield pd.DataFrame(descend(ids, paths, words), columns=names)
                ids, paths, words, turns = [], [], {}, 0
            ids.append(conv)
            paths.append([])
    if ids:
        yield pd.DataFrame(descend(ids, paths, words), columns=names)


class _Open:
    """A node of the walk whose subtree is not over yet."""

    __slots__ = ("depth", "row", "children", "leaves", "saved")

    def __init__(self, depth: int, row: tuple, leaves: int, saved: int):
        self.depth, self.row, self.children, self.leaves, self.saved = depth, row, 0, leaves, saved

    def closed(self) -> tuple:
        *head, ends = self.row
        return (*head, self.children, self.leaves, self.saved, ends)


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block and pre, with what all blocks know of their nodes: each node's children, leaves and savings among the nodes that belong to the block."""
    names = [c.split()[0] for c in PARTS.split(", ")]
    open_: list[_Open] = []
    done: list[tuple] = []

    def close(depth: int) -> None:
        while open_ and open_[-1].depth >= depth:
            last = open_.pop()
            done.append(last.closed())
            if open_:
                open_[-1].leaves += last.leaves
                open_[-1].saved += last.saved

    for b in batches:
        for block, depth, node, w, ends, n, conv, owner, inner in zip(*(b[c].tolist() for c in ("block", "depth", "node", "words", "ends", "n_convs", "conv_id", "owner", "inner")), strict=True):
            close(depth)
            own = owner == block
            parent = open_[-1].row[2] if open_ else None
            if open_:
                open_[-1].children += own
            open_.append(_Open(depth, (node, block, conv, depth, parent, n, ends), int(own and not inner), (n - 1) * w if own else 0))
        if done:
            yield pd.DataFrame(done, columns=names).astype({"parent_conv_id": "Int64"})
            done.clear()
    close(0)
    if done:
        yield pd.DataFrame(done, columns=names).astype({"parent_conv_id": "Int64"})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts sorted by node and block: one row a node, its ends hashed as they come."""
    names = [c.split()[0] for c in NODES.split(", ")]
    now, head, sums, sha = None, (), [0, 0, 0], hashlib.sha256()
    for b in batches:
        done = []
        for node, conv, depth, parent, n, ends, *parts in zip(b["node"].map(bytes), *(b[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "ends", "n_children", "n_leaves", "saved_tokens")), strict=True):
            if node != now:
                if now is not None:
                    done.append((*head, *sums, sha.hexdigest()))
                now, head, sums, sha, some = node, (conv, depth, None if pd.isna(parent) else int(parent), n), [0, 0, 0], hashlib.sha256(), False
            sums = [x + y for x, y in zip(sums, parts, strict=True)]
            if ends is not None:
                sha.update((("," if some else "") + ends).encode())
                some = True
        if done:
            yield pd.DataFrame(done, columns=names).astype({"parent_conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([(*head, *sums, sha.hexdigest())], columns=names).astype({"parent_conv_id": "Int64"})


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of rows (conv_id, pos, turn, words), as NODES' columns: see op11_conversation_trie.

    Each conversation has a row at position 0, so that one without turns ends at
    the root; positions then count from 1 without gaps. Equal turns are equal
    digests with equal words. No rows give no nodes. A conversation is held whole
    by one task, as digests; a block of many is not larger than BLOCK and TURNS.
    """
    sorted_ = written(rows, "turns").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    local = written(sorted_.mapInPandas(_blocks, LOCAL), "nodes")
    facts = local.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.min("block").alias("owner"), F.max("inner").alias("inner"))
    walk = local.drop("n", "least", "inner").join(facts, "node").repartition("block").sortWithinPartitions("block", "pre")
    parts = walk.mapInPandas(_subtrees, PARTS)
    return parts.repartition("node").sortWithinPartitions("node", "block").mapInPandas(_summed, NODES)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations: its least member, depth, parent's least member, members, children, leaves under it, words that its subtree says more than once, and a digest of those that end there."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(written(numbered(turns), "numbered")))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos,
    length(role) || ':' || role || length(text) || ':' || text AS said, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
    ), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), s AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
r AS (
  SELECT c.conv_id, pos, said, words FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL
  SELECT c.conv_id, pos - h + least(h, coalesce(n, 0)), said, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h LEFT JOIN s ON s.conv_id = c.base
), m AS (
  SELECT conv_id, pos AS depth, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node, md5(coalesce(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS parent, words FROM r
  UNION ALL SELECT conv_id, 0, md5(''), NULL, 0 FROM c
), l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY 1),
e AS (SELECT depth, node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM m JOIN l USING (conv_id, depth) GROUP BY ALL),
n AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY ALL),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
u AS (SELECT a.depth, a.node, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens FROM f JOIN m a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM f JOIN u USING (depth, node) LEFT JOIN e USING (depth, node) LEFT JOIN n p ON p.depth = f.depth - 1 AND p.node = f.parent
"""
