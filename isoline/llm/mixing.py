"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows are dealt by hash into blocks, as many as shards call for. A
source whose target is, say, 2.3 times its size draws all its blocks twice and
then blocks in a permuted order until the target is met. Texts are taken whole: of
the last block rows are drawn in a permuted order while they fit, and what is
then missing is filled with rows of it and of the ``NEXT`` blocks after it, the
greatest that fits first. So each source has an exact quota of block draws, and
its taken words miss its target by less than the least row left there has. The
tree halves the
output shards again and again: of the draws at a node, as many as the left half
of its shards holds are taken by a multivariate hypergeometric draw over the
sources, the others go right. At the leaves each shard knows how many blocks of
each source it gets, and takes them, disjoint, from the source's permuted
draws. Within a shard rows are ordered by a hash of row and draw, so each shard
is shuffled by itself.

Only the table of blocks and that of sources move, never texts. A shard holds
about ``SHARD_WORDS`` words, and a source has ``PER_SHARD`` blocks a shard, so
shards and blocks grow with the corpus and what one task holds does not. A task
of the tree holds one row per source, as does the one that ranks sources by
name: sources are to be collections, not hosts or files.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, unused, written

WEIGHTS, SHARDS, PER_SHARD, SHARD_WORDS, NEXT, MOST, SEED = (5, 2, 1), 64, 64, 1 << 27, 64, 3, 11
#: Halvings that one task of the tree makes.
DEPTH = 3
DRAW = "array<struct<epoch:int,shard:int,part:boolean,cut_hash:bigint,also:array<bigint>>>"
#: From so many on, numpy has no hypergeometric draws.
NUMPY_MOST = 10**9


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space in a whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, size, one row each) with target: shares of the total by weight, at most most times the size.

    Sources by code point, null last, weigh as weights repeats. With sources by
    the ratio of limit to weight, the level that the last uncapped ones share is
    the greatest of what would be left per weight if all before were capped.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    limit = F.col("size").cast("double") * most
    rows = rows.withColumn("limit", limit)
    by_ratio = W.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    left = F.sum(F.col("size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("w").over(after))
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(level * F.col("w"), "limit")).select("source", "size", "target")


def half(q: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each of q are among n drawn from all of them: a multivariate hypergeometric draw, for any numbers.

    Where numpy has none, each is first drawn with a binomial; of the sets of one
    size these give, all are alike, and they stay so when the few too many or too
    few are taken from or added to them at random.
    """
    total = int(q.sum())
    if total < NUMPY_MOST:
        return rng.multivariate_hypergeometric(q, n, method="marginals")
    got = rng.binomial(q, n / total)
    off = n - int(got.sum())
    pool = q - got if off > 0 else got
    ends, picks = np.cumsum(pool), np.zeros(0, dtype=np.int64)
    while len(picks) < abs(off):
        picks = np.unique(np.concatenate([picks, rng.integers(0, ends[-1], abs(off) - len(picks))]))
    return got + np.sign(off) * np.bincount(np.searchsorted(ends, picks, side="right"), minlength=len(q))


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """quotas (source, q) as (source, shard, q): the splitting tree, a few halvings a round."""

    def halved(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("source", na_position="last")
        out: list[pd.DataFrame] = []

        def go(q: np.ndarray, lo: int, hi: int, depth: int) -> None:
            if depth == 0 or hi - lo == 1:
                out.append(pd.DataFrame({"source": nodes["source"], "q": q, "lo": lo, "hi": hi})[q > 0])
                return
            total, mid = int(q.sum()), (lo + hi) // 2
            left = half(q, total * (mid - lo) // (hi - lo), np.random.default_rng([seed, lo, hi]))
            go(left, lo, mid, depth - 1)
            go(q - left, mid, hi, depth - 1)

        go(nodes["q"].to_numpy(dtype=np.int64), int(nodes["lo"].iloc[0]), int(nodes["hi"].iloc[0]), DEPTH)
        return pd.concat(out)

    tree = quotas.select("source", F.col("q").cast("long").alias("q"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    rounds = -(-int(np.ceil(np.log2(max(shards, 1)))) // DEPTH)
    tree = reduce(lambda t, _: t.groupBy("lo", "hi").applyInPandas(halved, "source string, q long, lo int, hi int"), range(rounds), tree)
    return tree.select("source", F.col("lo").alias("shard"), "q")


def fitted(units: pd.DataFrame) -> pd.DataFrame:
    """Of a source's units (block, epoch, place of the block, h, left, unit) near the end of its target, those that meet what is left at place 1: cut_hash and also of each block that has any."""
    units = units.sort_values(["place", "h"]).reset_index(drop=True)
    first = units[units["place"] == 1]
    left = int(first["left"].iloc[0]) if len(first) else 0
    fits = first["unit"].cumsum() <= left
    left -= int(first["unit"][fits].sum())
    rest = units.drop(index=first.index[fits]).sort_values(["unit", "place", "h"])
    sizes, index, also = rest["unit"].tolist(), rest.index.tolist(), []
    while sizes and left > 0:
        i = bisect_right(sizes, left) - 1
        if i < 0:
            if sizes[0] - left < left:  # nearer with it than without
                also.append(index[0])
            break
        left -= sizes.pop(i)
        also.append(index.pop(i))
    out = [(*first[["s", "block", "epoch"]].iloc[0], int(first["h"][fits].max()), [])] if fits.any() else []
    at = {(r[1], r[2]): r[4] for r in out}
    for k in also:
        r = units.loc[k]
        key = (r["block"], r["epoch"])
        if key not in at:
            out.append((r["s"], *key, None, []))
            at[key] = out[-1][4]
        at[key].append(int(r["h"]))
    names = ["s", "block", "epoch", "cut_hash", "also"]
    return pd.DataFrame({n: pd.array([r[i] for r in out], dtype="Int64") if n == "cut_hash" else pd.Series([r[i] for r in out], dtype=object) for i, n in enumerate(names)})


def shards_for(words: int) -> int:
    """SHARDS, doubled until a shard has at most about SHARD_WORDS."""
    shards = SHARDS
    while words > shards * SHARD_WORDS:
        shards *= 2
    return shards


def dealt(docs: DataFrame, key: str, size: Column, seed: int = SEED) -> DataFrame:
    """docs with size and hash columns (mix_size, mix_hash)."""
    return docs.withColumns({"mix_size": size, "mix_hash": F.xxhash64(F.col(key), F.lit(seed))})


def _block(h: str | Column, shards: int) -> Column:
    return F.pmod(h, F.lit(shards * PER_SHARD)).cast("int")


def plan(rows: DataFrame, shards: int, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """What to draw of each block of dealt() rows: mix_source, mix_block, source_size, target and draws.

    A draw has its epoch and shard, and whether it is of a part of the block: of
    the rows up to cut_hash, if there are any, and of those whose hashes are in
    also.
    """
    rows = rows.select(F.col(source).cast("string").alias("source"), F.col("mix_size").alias("size"), F.col("mix_hash").alias("h"), _block("mix_hash", shards).alias("block"))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sizes = targets(blocks.groupBy("source").agg(F.sum("words").alias("size")), weights, most)
    sizes = written(sizes, "sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    b = blocks.join(sizes, same(blocks, sizes)).select(blocks["source"], "block", "words", "size", "target")
    goal = F.round("target").cast("long")
    whole = F.when(F.col("size") > 0, F.floor(goal / F.col("size"))).otherwise(0).cast("int")
    b = b.withColumn("goal", goal).withColumn("epoch", F.explode(F.sequence(F.lit(0), whole)))
    permuted = F.xxhash64("source", "block", "epoch", F.lit(seed + 1))
    in_epoch = W.partitionBy("source", "epoch").orderBy(permuted, "block").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("goal") - F.col("epoch") * F.col("size") - F.coalesce(F.sum("words").over(in_epoch), F.lit(0))
    b = b.withColumn("left", left).filter("words > 0").select("source", "block", "words", "left", "epoch")

    # Each source's target ends in one block. Its rows, and those of the blocks after it, are chosen one by one.
    ends = b.filter("left < words").withColumn("place", F.row_number().over(W.partitionBy("source").orderBy(F.desc("left"), permuted, "block")))
    ends = ends.filter(F.col("place") <= 1 + NEXT).select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "left", "place")
    units = rows.filter("size > 0").join(ends, rows["source"].eqNullSafe(ends["s"]) & (rows["block"] == ends["b"])).groupBy("s", "block", "epoch", "place", "h").agg(F.max("left").alias("left"), F.sum("size").alias("unit"))
    parts = units.groupBy("s").applyInPandas(fitted, "s string, block int, epoch int, cut_hash bigint, also array<bigint>").select(F.col("s").alias("source"), "block", "epoch", F.lit(True).alias("part"), "cut_hash", "also")
    b = b.filter("left >= words").select("source", "block", "epoch", F.lit(False).alias("part"), F.lit(None).cast("bigint").alias("cut_hash"), F.lit(None).cast("array<bigint>").alias("also")).unionByName(parts)
    b = b.withColumn("d", F.row_number().over(W.partitionBy("source").orderBy(F.xxhash64("source", "block", "epoch", F.lit(seed + 2)), "block", "epoch")) - 1)
    b = written(b, "draws")

    leaves = split(b.groupBy("source").agg(F.count("*").alias("q")), shards, seed)
    first = F.coalesce(F.sum("q").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slots = leaves.withColumn("first", first).withColumn("d", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("q") - 1))).select(F.col("source").alias("s"), "shard", F.col("d").cast("int").alias("d"))
    b = b.join(slots, b["source"].eqNullSafe(slots["s"]) & (b["d"] == slots["d"])).select("source", "block", F.struct("epoch", "shard", "part", "cut_hash", "also").alias("draw"))
    b = b.groupBy("source", "block").agg(F.sort_array(F.collect_list("draw")).cast(DRAW).alias("draws"))

    every = blocks.select(F.col("source").alias("s"), F.col("block").alias("mix_block"))
    every = every.join(b, every["s"].eqNullSafe(b["source"]) & (every["mix_block"] == b["block"]), "left").select("s", "mix_block", "draws")
    every = every.join(sizes, every["s"].eqNullSafe(sizes["source"]))
    return written(every.select(F.col("s").alias("mix_source"), "mix_block", F.col("size").alias("source_size"), "target", F.coalesce("draws", F.array().cast(DRAW)).alias("draws")), "mix")


def drawn(rows: DataFrame, of: DataFrame, shards: int, has_words: Column, source: str = "source") -> DataFrame:
    """dealt() rows with source_size, target and draws: array of (epoch, shard, order), one for each time that the mix takes the row; order is its place in the shard."""
    out = rows.join(of, F.col(source).cast("string").eqNullSafe(F.col("mix_source")) & (_block("mix_hash", shards) == F.col("mix_block"))).drop("mix_source", "mix_block")
    taken = F.filter("draws", lambda d: has_words & (~d["part"] | F.coalesce(F.col("mix_hash") <= d["cut_hash"], F.lit(False)) | F.array_contains(d["also"], F.col("mix_hash"))))
    return out.withColumn("draws", F.transform(taken, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.xxhash64("mix_hash", d["epoch"], F.lit(SEED + 3)).alias("order"))))


def _counted(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, int]:
    """Sizes and hashes of all rows, without their texts, and the number of shards for them."""
    narrow = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("n"))
    rows = written(dealt(narrow, "key", F.col("n")).drop("n"), "dealt")
    return rows, shards_for(rows.agg(F.sum("mix_size")).first()[0] or 0)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, **options) -> DataFrame:
    """docs with one row per draw, its shard and place in it as mix_shard and mix_order (longer names where docs has these).

    Texts are taken whole. Null texts and texts without words have size 0 and
    are never drawn. Null sources form one source. Repeated rows are drawn alike.
    """
    narrow, fit = _counted(docs, key, text, source)
    shards = shards or fit
    # The row travels as one column: its names can't clash with those made here.
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("doc"), F.col(key).alias("key"), F.col(source).cast("string").alias("source"))
    rows = dealt(rows, "key", F.lit(None).cast("long"))
    rows = drawn(rows, plan(narrow, shards, **options), shards, F.coalesce(F.col("doc")[text].rlike(WORD), F.lit(False))).withColumn("draw", F.explode("draws"))
    return rows.select(*(F.col("doc")[c].alias(c) for c in docs.columns), F.col("draw.shard").alias(unused(docs, "mix_shard")), F.col("draw.order").alias(unused(docs, "mix_order")))


def shuffled(mix: DataFrame, shard: str = "mix_shard", order: str = "mix_order") -> DataFrame:
    """mixed() rows with each shard in one partition, in its order."""
    return mix.repartition(shard).sortWithinPartitions(shard, order)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and for each draw its shard and place there."""
    rows, shards = _counted(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    out = drawn(rows, plan(rows, shards), shards, F.col("mix_size") > 0)
    listed = lambda k: F.array_join(F.transform("draws", lambda d: d[k].cast("string")), ",").alias(f"{k}s")
    return out.select(F.col("key").alias("doc_id"), F.col("mix_size").alias("size"), "source_size", "target", (F.size("draws") * F.col("mix_size")).alias("taken"), listed("shard"), listed("order"))
