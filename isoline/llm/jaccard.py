"""Exact Jaccard join of word n-gram sets by skipping over relations of sets.

Equal sets are one set, under a 64-bit digest. Shingles are ordered by how often
they occur (by the cells of one count-min row over the whole corpus, then by
value), and sets that link share one among the first fifth of each, their prefix.
Entries of prefixes form the index: a list per shingle, sorted by size and
position. Two relations keep it from being expanded into pairs:

* Blocks: a list is walked in blocks, and block pairs are skipped where sizes are
  too far apart, where positions leave too few shingles to reach the overlap, or
  where both hold one component.
* Answers: the first set of each stretch of a list answers for it. Its overlaps
  with the others are computed first; what links to it needs no further links to
  each other, so only pairs across components are left: first as many as would
  join them, then those that this leaves apart. Of these, a pair of a set and
  another is settled without a look at either where a very similar set's answer
  is too far off for it: distances of sets obey the triangle inequality.

A parity bitmap of each set bounds an overlap from above; what passes is verified
on the whole sets, which are made again from their texts. Lists longer than
``CHUNK`` are cut into pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, text_or_empty, written
from .components import components

WORDS = 5
#: Cells of the count-min row, as a power of two, and of each piece of it.
CELLS, PIECE = 20, 1 << 16
#: Entries of a block, and of a chunk of a long list, about.
BLOCK, CHUNK = 256, 4096
#: A set within this distance of a list's first set has its answers derived from it.
CLOSE = 0.1
#: Rows of one set from which its component travels to them: at most a 2^-20 share of all rows have such sets to broadcast.
HOT = 1 << 20
#: Fixed odd numbers that tell a shingle's places apart.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
SETS = "doc_id long, key long, sid long, n long, bits binary, piece int, cells binary"
LISTS = "token long, sid long, n long, pos long, first_sid long, first_n long, first_pos long"


class _Words(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: _Words | None = None, words: int = WORDS) -> np.ndarray:
    """The hashes of a whole text's distinct shingles, ascending: of its whole sequence where it has fewer words, none where it has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64)
    h = np.fromiter(map((_Words() if hashes is None else hashes).__getitem__, w), dtype=np.uint64, count=len(w))
    out = np.zeros(len(w) - words + 1, dtype=np.uint64)
    for i in range(words):
        out += h[i : len(h) - words + 1 + i] * _PLACES[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def digest(tokens: np.ndarray) -> int:
    """A set's name: signed, 64 bits."""
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).astype(np.int64))


def least_overlap(a, b):
    """Shingles that sets of these sizes share at least where they link: 100 * i >= 80 * (a + b - i)."""
    return (4 * (a + b) + 8) // 9


def prefix(n: int) -> int:
    """The first shingles of a set of n among which it shares one with each set that it links to."""
    return n - (4 * n + 4) // 5 + 1


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap with each bit the parity of the shingles that fall on it: two or more bits a shingle, a power of two."""
    size = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def most_overlap(a: bytes, b: bytes, an: int, bn: int) -> int:
    """An upper bound of two sets' overlap: bits in which their bitmaps differ are shingles that only one has. The longer bitmap is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return (an + bn - int(np.bitwise_count(x ^ y).sum())) // 2


def sets(docs: DataFrame) -> DataFrame:
    """Rows of SETS: one for each of docs (doc_id, key, text), with the bitmap where its task meets the set first, and the pieces of each task's count-min row of sets that it met."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen, cells = _Words(), set(), np.zeros(1 << CELLS, dtype=np.uint32)
        for b in batches:
            rows, met = [], [np.empty(0, np.uint64)]
            for doc, key, text in zip(b["doc_id"], b["key"], b["text"], strict=True):
                tokens = shingles(text, hashes)
                sid, bits = digest(tokens), None
                if len(tokens) and sid not in seen:
                    seen.add(sid)
                    bits = parity(tokens)
                    met.append(tokens)
                    if len(met) == 1024 or len(tokens) > 1 << 20:
                        cells += np.bincount((np.concatenate(met) >> np.uint64(64 - CELLS)).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
                        met = [np.empty(0, np.uint64)]
                rows.append((None if pd.isna(doc) else int(doc), key, sid, len(tokens), bits, None, None))
            cells += np.bincount((np.concatenate(met) >> np.uint64(64 - CELLS)).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SETS.split(", ")]).astype({"doc_id": "Int64", "piece": "Int32"})
        pieces = [(i // PIECE, cells[i : i + PIECE].tobytes()) for i in range(0, 1 << CELLS, PIECE)]
        yield pd.DataFrame({c.split()[0]: [None] * len(pieces) for c in SETS.split(", ")[:5]} | {"piece": [p for p, _ in pieces], "cells": [c for _, c in pieces]}).astype({c: "Int64" for c in ("doc_id", "key", "sid", "n")} | {"piece": "Int32"})

    return docs.mapInPandas(make, SETS)


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by number: one row each, summed."""
    now, total = None, None
    for b in batches:
        for piece, cells in zip(b["piece"].tolist(), b["cells"], strict=True):
            if piece != now:
                if now is not None:
                    yield pd.DataFrame([(now, total.tobytes())], columns=["piece", "cells"])
                now, total = piece, np.zeros(PIECE, dtype=np.uint32)
            more = np.frombuffer(cells, np.uint32)
            total = np.where(total > np.uint32(0xFFFFFFFF) - more, np.uint32(0xFFFFFFFF), total + more)
    if now is not None:
        yield pd.DataFrame([(now, total.tobytes())], columns=["piece", "cells"])


def frequencies(made: DataFrame) -> np.ndarray:
    """The count-min row of the corpus, four megabytes whatever its size: added up by parts of the tasks, then over them."""
    pieces = made.filter("piece is not null").select("piece", "cells", (F.spark_partition_id() % 32).alias("part"))
    some = pieces.repartition("piece", "part").sortWithinPartitions("piece").mapInPandas(_added, "piece int, cells binary")
    rows = some.repartition("piece").sortWithinPartitions("piece").mapInPandas(_added, "piece int, cells binary").collect()
    out = np.zeros(1 << CELLS, dtype=np.uint32)
    for r in rows:
        out[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.cells, np.uint32)
    return out


def entries(docs: DataFrame, counts) -> DataFrame:
    """(token, sid, n, pos): the prefix of each set, in the order of counts (a broadcast count-min row)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen, often = _Words(), set(), np.minimum(counts.value, np.uint32(0xFFFFFF)).astype(np.uint64)
        held: list[tuple[np.ndarray, int, int]] = []
        rows = 0

        def out() -> pd.DataFrame:
            sizes = [len(t) for t, _, _ in held]
            of = lambda k: np.repeat(np.array([h[k] for h in held], dtype=np.int64), sizes)
            df = pd.DataFrame({"token": np.concatenate([t for t, _, _ in held]).view(np.int64), "sid": of(1), "n": of(2), "pos": np.concatenate([np.arange(s) for s in sizes])})
            held.clear()
            return df

        for b in batches:
            for text in b["text"]:
                tokens = shingles(text, hashes)
                sid = digest(tokens)
                if not len(tokens) or sid in seen:
                    continue
                seen.add(sid)
                n = len(tokens)
                p = prefix(n)
                # Tokens ascend, and a stable sort keeps them so where counts and upper bits are alike.
                order = often[(tokens >> np.uint64(64 - CELLS)).astype(np.int64)] << np.uint64(40) | tokens >> np.uint64(24)
                held.append((tokens[np.argsort(order, kind="stable")[:p]], sid, n))
                rows += p
                if rows > 1 << 18:
                    yield out()
                    rows = 0
        if held:
            yield out()

    return docs.select("text").mapInPandas(emit, "token long, sid long, n long, pos long")


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries sorted by token, n, pos and sid: those of lists of two sets or more, each with the first set of its stretch, which ends where sizes are too far apart."""
    names = ["token", "sid", "n", "pos"]
    rest, joined = pd.DataFrame({c: pd.Series(dtype="int64") for c in names}), False
    token = first = None
    for b in _with_end(batches):
        rows = rest if b is None else pd.concat([rest, b[names]], ignore_index=True)
        if not len(rows):
            continue
        a = {c: rows[c].to_numpy() for c in names}
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (a["token"][1:] != a["token"][:-1]) | (a["sid"][1:] != a["sid"][:-1])
        a = {c: v[new] for c, v in a.items()}
        same = a["token"][1:] == a["token"][:-1]
        keep = np.zeros(len(a["token"]), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= joined
        last = len(keep) if b is None else len(keep) - 1  # the last one waits for what follows it
        out = []
        for t, s, n, pos in zip(*(a[c][:last][keep[:last]].tolist() for c in names), strict=True):
            if t != token or 5 * first[1] < 4 * n:
                token, first = t, (s, n, pos)
            out.append((t, s, n, pos, *first))
        if b is not None:
            rest, joined = pd.DataFrame({c: v[last:] for c, v in a.items()}), bool(keep[last])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LISTS.split(", ")])


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def index(found: DataFrame) -> DataFrame:
    """Rows of LISTS of entries()."""
    return found.repartition("token").sortWithinPartitions("token", "n", "pos", "sid").mapInPandas(_lists, LISTS)


def first_pairs(lists: DataFrame) -> DataFrame:
    """(a, an, b, bn): each list's first sets with those after them, where sizes and positions allow a link."""
    left = F.least(F.col("n") - F.col("pos"), F.col("first_n") - F.col("first_pos"))
    pairs = lists.filter("sid <> first_sid").filter(left >= F.floor((4 * (F.col("n") + F.col("first_n")) + 8) / 9))
    return _ordered(pairs.select(F.col("first_sid").alias("a"), F.col("first_n").alias("an"), F.col("sid").alias("b"), F.col("n").alias("bn")))


def _ordered(pairs: DataFrame, *more: str) -> DataFrame:
    """Each pair once, the lesser name first."""
    swap = F.col("a") > F.col("b")
    return pairs.select(*(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("an", "bn"), ("b", "a"), ("bn", "an"))), *more).distinct()


def skipped(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, sid: np.ndarray, first: np.ndarray, own: np.ndarray | None = None, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of a list sorted by n and pos whose sets may link and are of different components, block pair by block pair; pairs with the first set of a stretch have been answered. own, where given, names each entry's chunk: pairs are then those across chunks."""
    left = n - pos
    starts = range(0, len(n), block)
    info = [(n[s : s + block].min(), n[s : s + block].max(), left[s : s + block].max(), comp[s] if (comp[s : s + block] == comp[s]).all() else None) for s in starts]
    for x, s in enumerate(starts):
        for y in range(x, len(info)):
            t = starts[y]
            if 5 * info[x][1] < 4 * info[y][0]:
                break
            if min(info[x][2], info[y][2]) < least_overlap(info[x][0], info[y][0]) or (info[x][3] is not None and info[x][3] == info[y][3]):
                continue
            i, j = np.arange(s, min(s + block, len(n)))[:, None], np.arange(t, min(t + block, len(n)))[None, :]
            ok = (i < j) & (5 * n[i] >= 4 * n[j]) & (np.minimum(left[i], left[j]) >= least_overlap(n[i], n[j])) & (comp[i] != comp[j]) & (first[j] != sid[i])
            if own is not None:
                ok &= own[i] != own[j]
            at = np.nonzero(ok)
            if len(at[0]):
                yield at[0] + s, at[1] + t


def most_overlaps(bits: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """most_overlap() of pairs of rows."""
    width = np.array([len(x) // 8 for x in bits])
    w, differ = np.minimum(width[i], width[j]), np.empty(len(i), np.int64)
    for c in np.unique(w).tolist():
        at = np.flatnonzero(w == c)
        step = max(1, (1 << 20) // c)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            rows, back = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
            m = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, c), axis=0) for r in rows.tolist()])
            differ[some] = np.bitwise_count(m[back[: len(some)]] ^ m[back[len(some) :]]).sum(1)
    return (n[i] + n[j] - differ) // 2


def _joining(g: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray, joined: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (i, j) of rows join components of their group that no pair before has joined; joined remembers."""

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while (up := joined.get(x, x)) != x:
            joined[x] = joined.get(up, up)
            x = up
        return x

    out = np.zeros(len(i), dtype=bool)
    for k, (group, a, b) in enumerate(zip(g[i].tolist(), comp[i].tolist(), comp[j].tolist(), strict=True)):
        x, y = root((group, a)), root((group, b))
        if x != y:
            joined[x] = y
            out[k] = True
    return out


def _pairs(rows: pd.DataFrame, forest: bool, few: int = 32) -> Iterator[pd.DataFrame]:
    """Pairs (a, an, b, bn, most) within groups of rows, sorted by group, n and pos: small groups all at once, row against the row k below, others by blocks. With forest, only as many as join a group's components if they all link."""
    g, n, pos, comp, sid, first, own, cross = (rows[c].to_numpy() for c in ("g", "n", "pos", "comp", "sid", "first_sid", "own", "cross"))
    bits, left, joined = rows["bits"].tolist(), n - pos, {}
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])

    def out(i: np.ndarray, j: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(i):
            most = most_overlaps(bits, n, i, j)
            ok = most >= least_overlap(n[i], n[j])
            if forest:
                ok[ok] = _joining(g, comp, i[ok], j[ok], joined)
            i, j = i[ok], j[ok]
            yield pd.DataFrame({"a": sid[i], "an": n[i], "b": sid[j], "bn": n[j], "most": most[ok]})

    small = np.flatnonzero(np.repeat(sizes <= few, sizes))
    for k in range(1, int(sizes[sizes <= few].max(initial=1))):
        i, j = small[:-k], small[k:]
        ok = (g[i] == g[j]) & (5 * n[i] >= 4 * n[j]) & (np.minimum(left[i], left[j]) >= least_overlap(n[i], n[j])) & (comp[i] != comp[j]) & (first[j] != sid[i]) & ~(cross[i] & (own[i] == own[j]))
        yield from out(i[ok], j[ok])
    for s, m in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
        part = slice(s, s + m)
        for i, j in skipped(n[part], pos[part], comp[part], sid[part], first[part], own[part] if cross[s] else None):
            yield from out(i + s, j + s)


def _across(batches: Iterator[pd.DataFrame], forest: bool) -> Iterator[pd.DataFrame]:
    """_pairs() of rows as they come; the last group waits for the rest of it."""
    rest = None
    for b in batches:
        rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if len(rows):
            g = rows["g"].to_numpy()
            last = len(g) - int(np.argmax(g[::-1] != g[-1])) if (g != g[-1]).any() else 0
            if last:
                yield from _pairs(rows.iloc[:last], forest)
            rest = rows.iloc[last:]
    if rest is not None:
        yield from _pairs(rest, forest)


def later_pairs(lists: DataFrame, comps: DataFrame, reps: DataFrame, forest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(a, an, b, bn, most): pairs of lists that hold more than one component of comps (node, root), across these, whose bitmaps allow a link: all of them, or with forest as many as join each list's components if they all link."""
    rows = lists.select("token", "sid", "n", "pos", "first_sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("token", F.ceil(F.col("m") / chunk).cast("int").alias("parts"))
    rows = rows.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("if(parts = 1, array(0), sequence(0, parts - 1))")))
    group = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    # A chunk has a group of its own and one with each other chunk, in which only pairs across the two count.
    cross = F.col("own") != F.col("other")
    rows = rows.select(group.alias("g"), cross.alias("cross"), "own", "sid", "n", "pos", "comp", "first_sid").join(reps.select("sid", "bits"), "sid")
    return _ordered(rows.repartition("g").sortWithinPartitions("g", "n", "pos", "sid").mapInPandas(partial(_across, forest=forest), "a long, an long, b long, bn long, most long"), "most")


def bounded(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs with most, an upper bound of their overlap."""

    @F.pandas_udf("long")
    def most(a: pd.Series, b: pd.Series, an: pd.Series, bn: pd.Series) -> pd.Series:
        return pd.Series([most_overlap(*x) for x in zip(a, b, an, bn, strict=True)], dtype="int64")

    bits = reps.select("sid", "bits")
    for side in "ab":
        pairs = pairs.join(bits.select(F.col("sid").alias(side), F.col("bits").alias(f"{side}bits")), side)
    return pairs.select("a", "an", "b", "bn", most("abits", "bbits", "an", "bn").alias("most"))


def linking(overlap: str):
    return F.expr(f"9 * {overlap} >= 4 * (an + bn)")


def whole_sets(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, tokens) of the sets in pairs, made from one text of each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    keys = reps.join(wanted, "sid", "left_semi").select("key")
    texts = docs.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Words()
        for b in batches:
            made = [shingles(t, hashes) for t in b["text"]]
            yield pd.DataFrame({"sid": [digest(t) for t in made], "tokens": [t.tobytes() for t in made]})

    return texts.mapInPandas(make, "sid long, tokens binary")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs with overlap, counted on the whole sets."""

    @F.pandas_udf("long")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    for side in "ab":
        pairs = pairs.join(held.select(F.col("sid").alias(side), F.col("tokens").alias(f"{side}tokens")), side)
    return pairs.select("a", "an", "b", "bn", overlap("atokens", "btokens").alias("overlap"))


def derived(pairs: DataFrame, answers: DataFrame, close: float = CLOSE) -> DataFrame:
    """pairs without those that an answer settles: where x is close to a, and x is further from b than a fifth and what lies between x and a, then a and b don't link. answers: pairs with overlap, exact or its upper bound, and exact telling which."""
    both = answers.unionByName(answers.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"), "overlap", "exact"))
    both = both.withColumn("d", 1 - F.col("overlap") / (F.col("an") + F.col("bn") - F.col("overlap")))
    near = both.filter("exact").filter(F.col("d") <= close).groupBy(F.col("b").alias("y")).agg(F.min(F.struct("d", F.col("a").alias("x"))).alias("m")).select("y", F.col("m.x").alias("x"), F.col("m.d").alias("e"))
    far = both.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("d"))
    for y, z in (("a", "b"), ("b", "a")):
        led = pairs.join(near.withColumnRenamed("y", y), y).join(far.withColumnRenamed("z", z), ["x", z]).filter(F.col("d") - F.col("e") > 0.2 + 1e-9)
        pairs = pairs.join(led.select("a", "b"), ["a", "b"], "left_anti")
    return pairs


def links(docs: DataFrame, reps: DataFrame, counts: np.ndarray) -> DataFrame:
    """Edges (a, b) between sets that connect what all links would; docs have key and text, reps sid, n, key and bits."""
    lists = written(index(entries(docs, docs.sparkSession.sparkContext.broadcast(counts))), "lists")
    known = written(bounded(first_pairs(lists), reps), "first_bounds")
    held = written(whole_sets(docs, reps, known.filter(linking("most"))), "first_sets")
    checked = written(verified(known.filter(linking("most")), held), "first_overlaps")
    forget(held)
    answers = checked.withColumn("exact", F.lit(True)).unionByName(known.filter(~linking("most")).select("a", "an", "b", "bn", F.col("most").alias("overlap"), F.lit(False).alias("exact")))
    edges = checked.filter(linking("overlap")).select("a", "b")
    for forest in (True, False):
        # What may link to several of a component is tried with one of them first, and with the others only where that fails.
        pairs = written(later_pairs(lists, written(components(edges), "components"), reps, forest), "later_pairs")
        more = written(derived(pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti"), answers), "later_pairs")
        if not more.isEmpty():
            checked = written(verified(more, whole_sets(docs, reps, more)), "later_overlaps")
            answers = answers.unionByName(checked.withColumn("exact", F.lit(True)))
            edges = edges.unionByName(checked.filter(linking("overlap")).select("a", "b"))
    return edges


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    component_id is the least id reachable over links, the row's own included;
    null ids count as none, so a component of null ids alone has null. Null and
    empty texts have no shingles and link with nothing, not with each other
    either. Repeated rows each come back. Other columns of docs play no part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    made = written(sets(docs.select("doc_id", "key", "text")), "sets")
    rows = made.filter("piece is null").select("doc_id", "key", "sid", "n", "bits")
    reps = written(rows.filter("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("bits", ignorenulls=True).alias("bits"), F.count("*").alias("m")), "distinct_sets")
    roots = components(links(docs.select("key", "text"), reps, frequencies(made))).withColumnRenamed("node", "sid")
    least = reps.select("sid", "least", "m").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = written(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "m", "component_id"), "named_sets")
    few, hot = named.filter(F.col("m") < HOT).drop("m"), named.filter(F.col("m") >= HOT).drop("m")
    some = rows.filter("n > 0").select("doc_id", "sid", "n")
    out = some.join(few, "sid").unionByName(some.join(F.broadcast(hot), "sid")).drop("sid").unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component."""
    return linked(table(spark, sf_dir, "documents"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
