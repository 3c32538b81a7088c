"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight bytes at eight positions. Two that differ in
at most three bits differ in at most three bytes, so they share at least five
positional bytes. A posting list of one byte would hold a 256th of all
fingerprints, so the lists are composite: keyed by sets of four positions with
their bytes. ``POSITION_SETS`` holds fourteen sets of which every five positions
contain one whole, so each wanted pair meets in some list of a 2^-32 share. Four
shared bytes are known there from the list's key; the postings' other four
positional bytes are tallied for each pair, pairs with no fifth are dropped, and
only the rest are verified by their differing bits.

A list is never expanded into its pairs: tasks walk it from fingerprint to
unreached fingerprint and emit a spanning forest of its links, which joins
exactly what all links would. Lists are counted by an aggregation; a long one is
cut into chunks before it is shuffled, and each two chunks form a group of
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, written
from .components import components

BITS, SHARED_BYTES = 3, 5
#: Fingerprints of a posting list that one chunk holds at most, about; a group has two chunks.
CHUNK = 2048
#: Rows of one fingerprint from which its name travels to them: at most a 2^-20 share of all rows have such fingerprints to broadcast.
HOT = 1 << 20


def _position_sets() -> list[tuple[int, ...]]:
    """Sets of four of the eight positions such that any five positions hold one: both halves, and the pairs of each half's three perfect matchings combined with the other half's same matching."""
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    crossed = [(*p, *(x + 4 for x in q)) for m in matchings for p in m for q in m]
    sets = [(0, 1, 2, 3), (4, 5, 6, 7), *crossed]
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))
    return sets


POSITION_SETS = _position_sets()


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The signed SimHash of a text; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """docs with the signed 64-bit fingerprint of each whole text as column out (a null text is empty, an empty one has 0)."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(x, words) for x in texts], dtype="int64")

    return docs.withColumn(out, simhash(F.col(text)))


def other_bytes(fps: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """The bytes of each fingerprint at the positions that a posting list's key does not have."""
    return fps.view(np.uint8).reshape(-1, 8)[:, [p for p in range(8) if p not in positions]]


def spanning_links(fps: np.ndarray, positions: tuple[int, ...] = (), seen: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of a list keyed by positions, by walking from each reached one to the unreached ones it links to.

    seen, where given, counts the pairs met and those whose tally of shared
    positional bytes lets them be verified.
    """
    out, left = [], fps.astype(np.int64)
    tail = other_bytes(left, positions)
    while len(left) > 1:
        queue, left, tail = [(left[0], tail[0])], left[1:], tail[1:]
        while queue and len(left):
            here, its = queue.pop()
            hit = len(positions) + np.count_nonzero(tail == its, axis=1) >= SHARED_BYTES
            if seen is not None:
                seen[0] += len(left)
                seen[1] += int(hit.sum())
            hit[hit] = np.bitwise_count((left[hit] ^ here).view(np.uint64)) <= BITS
            if hit.any():
                found = left[hit]
                out += [(int(here), int(x)) for x in found]
                queue += zip(found, tail[hit], strict=True)
                left, tail = left[~hit], tail[~hit]
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (group, number of the position set, fp): the links of each run of equal groups."""
    held: list[np.ndarray] = []
    name, positions = None, ()
    for b in batches:
        group, which, fp, edges = b["g"].to_numpy(), b["s"].to_numpy(), b["fp"].to_numpy(), []
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if name is not None and group[i] != name:
                edges += spanning_links(np.unique(np.concatenate(held)), positions)
                held = []
            name, positions = group[i], POSITION_SETS[which[i]]
            held.append(fp[i:j])
        if edges:
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")
    if held and (edges := spanning_links(np.unique(np.concatenate(held)), positions)):
        yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that connect what fingerprints at three or fewer differing bits connect; distinct has one row per fingerprint fp."""
    keys = []
    for n, s in enumerate(POSITION_SETS):
        mask = sum(255 << (8 * p) for p in s)
        mask -= (mask >> 63) << 64
        keys.append(F.col("fp").bitwiseAND(F.lit(mask)))
    posts = distinct.select("fp", F.posexplode(F.array(*keys)).alias("s", "key"))
    posts = posts.join(posts.groupBy("s", "key").agg(F.count("*").alias("n")).filter("n > 1"), ["s", "key"])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    posts = posts.withColumn("parts", parts).withColumn("own", own)
    other = F.explode(F.expr("if(parts = 1, array(0), sequence(0, parts - 1))"))
    pairs = posts.select("fp", "s", "key", "parts", "own", other.alias("other"))
    # A chunk meets itself once and each other chunk once. Should two groups share a hash, the tally lets more pairs pass and their bits still decide.
    group = F.xxhash64("s", "key", F.least("own", "other"), F.greatest("own", "other"))
    rows = pairs.select(group.alias("g"), "s", "fp").repartition("g").sortWithinPartitions("g", "s")
    return rows.mapInPandas(_runs, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for every row of docs.

    component_id is the least id reachable over links, the row's own included;
    null ids count as none, so a component of null ids alone has null. Empty
    and null texts share fingerprint 0. Repeated rows each come back. Other
    columns of docs play no part.
    """
    fps = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).select("id", "fp"), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    least = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "component_id"), "named")
    few, hot = named.filter(F.col("n") < HOT).drop("n"), named.filter(F.col("n") >= HOT).drop("n")
    out = fps.join(few, "fp").unionByName(fps.join(F.broadcast(hot), "fp"))
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the first by id (nulls last, then in the order read)."""
    row, fp_col = unused(docs, "row_key"), unused(docs, "fp")
    with_fp = written(fingerprints(docs, text, out=fp_col).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    least = written(with_fp.groupBy(F.col(fp_col).alias("fp")).agg(F.min(first).alias("first")), "distinct")
    roots = components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    least = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = least.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return with_fp.join(kept, row, "left_semi").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
