"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``TREES`` trees hashes a vector to a string of ``BITS`` signs of random
projections, and keeps the strings as sorted arrays. A query descends in every
tree to its longest matching prefix, then all trees ascend together, one bit at
a time and within the last bit tree by tree, until the rows under the query's
prefixes, summed over trees, number ``SHARE * n ** POWER`` of all n vectors, and
so many that the wanted number of them must be distinct; those rows are its candidates, and their cosines are computed exactly. As with
any such hashing, candidates grow as a power of n under one. The constants suit
vectors without any structure, as in the test tables, where the nearest are at
cosines of 0.35 to 0.45 and only many candidates give recall.

In Spark the vectors are dealt into blocks of about ``BLOCK`` rows, and a block
has the sorted arrays of all trees over its rows. The stated query set is held
against all blocks, in slices of ``QUERIES``: a first pass counts the rows under
each length of a query's prefixes in each block, the sums over blocks tell where
to stop, and a second pass scores the rows under those prefixes and keeps a
block's best. A vector travels once a slice, candidates never. Equal vectors are
one entry with its ``k + 1`` least ids, which are all that a result can hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

TREES, BITS, SHARE, POWER, BLOCK, QUERIES, SEED = 128, 32, 6.0, 0.72, 16384, 8192, 5


def usable(vector: Column) -> Column:
    """Whether a vector has only finite numbers and isn't zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(v: Column) -> Column:
    """A usable vector over the power of two that brings its largest component to 1 or 2: an exact step, after which no square over- or underflows."""
    wide = v.cast("array<double>")
    most = F.array_max(F.transform(wide, F.abs))
    size = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(most)), F.lit(-1022)).cast("double"))
    return F.transform(wide, lambda x: x / size)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two scaled() vectors in double precision, summed in their order."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def signs(x: np.ndarray, planes: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Codes of vectors, one row per tree: the first sign is the code's highest bit."""
    place = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
    out = np.empty((trees, len(x)), dtype=np.int64)
    for i in range(0, len(x), 512):
        on = (x[i : i + 512] @ planes > 0).reshape(-1, trees, bits)
        out[:, i : i + 512] = (on * place).sum(axis=2).T
    return out


def _planes(dims: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, trees * bits))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.abs(x).max(axis=1, keepdims=True)


def _under(code: np.ndarray, query: np.ndarray, bits: int) -> np.ndarray:
    """For each query the number of sorted codes under its prefix of each length, 0 to bits."""
    out = np.empty((len(query), bits + 1), dtype=np.int64)
    for n in range(bits + 1):
        low = (query >> (bits - n)) << (bits - n)
        out[:, n] = np.searchsorted(code, low + (np.int64(1) << np.int64(bits - n))) - np.searchsorted(code, low)
    return out


def searched(entries: DataFrame, asked: DataFrame, dims: int, best: int, trees: int = TREES, bits: int = BITS, share: float = SHARE, power: float = POWER, block: int = BLOCK, queries: int = QUERIES, seed: int = SEED) -> DataFrame:
    """(query, rep, near): of each query (rep, v) of asked the best entries (rep, v) that the forest finds in each block, and the number of its candidates there."""
    total = entries.count()
    # Of so many rows summed over trees, the query's own left out, best are distinct.
    least = max(best * trees, int(np.ceil(share * total**power)))
    n_blocks, n_slices = max(1, -(-total // block)), max(1, -(-asked.count() // queries))
    index = entries.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("part"))
    asked = asked.select(F.col("rep").alias("query"), F.col("v").alias("q"), F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(n_slices)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    key = ["block", "part"]

    def trees_of(rows: pd.DataFrame, asking: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        planes, x, q = _planes(dims, trees, bits, seed), _units(rows["v"]), _units(asking["q"])
        return x, q, signs(x, planes, trees, bits), signs(q, planes, trees, bits)

    def descended(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(rows):
            return pd.DataFrame({"query": [], "under": []})
        _, _, code, of = trees_of(rows, asking)
        under = sum(_under(np.sort(c), o, bits) for c, o in zip(code, of, strict=True))
        return pd.DataFrame({"query": asking["query"].to_numpy(), "under": list(under)})

    under = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(descended, "query long, under array<long>")
    sums = under.groupBy("query").agg(*((F.sum(F.col("under")[n]) - trees).alias(f"n{n}") for n in range(bits + 1)))
    # Counts fall with the length: trees and blocks ascend to the longest prefixes that have enough rows. The last bit is taken by as many trees as are needed for what is still missing.
    counts = F.array(*(F.col(f"n{n}") for n in range(bits + 1)))
    length = F.greatest(F.size(F.filter(counts, lambda n: n >= least)) - 1, F.lit(0))
    sums = sums.select("query", length.alias("length"), F.get(counts, length).alias("under"), F.coalesce(F.get(counts, length + 1), F.lit(0)).alias("over"))
    missing = (least - F.col("over")) / F.greatest(F.col("under") - F.col("over"), F.lit(1))
    asked = asked.join(sums.select("query", "length", F.least(F.ceil(missing * trees), F.lit(trees)).cast("int").alias("risen")), "query")

    def ascended(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(rows):
            return pd.DataFrame({"query": [], "rep": [], "near": []})
        x, q, code, of = trees_of(rows, asking)
        rep, order = rows["rep"].to_numpy(), np.argsort(code, axis=1)
        length, risen = (asking[c].to_numpy(dtype=np.int64) for c in ("length", "risen"))
        shift = bits - np.minimum(bits, length + (np.arange(trees)[:, None] >= risen))
        low = (of >> shift) << shift
        spans = [(np.searchsorted(c[o], a), np.searchsorted(c[o], a + (np.int64(1) << s))) for c, o, a, s in zip(code, order, low, shift, strict=True)]
        size = np.sqrt((x * x).sum(axis=1))
        out = []
        for i, query in enumerate(asking["query"].to_numpy()):
            near = np.zeros(len(x), dtype=bool)
            for (a, b), o in zip(spans, order, strict=True):
                near[o[a[i] : b[i]]] = True
            at = np.flatnonzero(near)
            if len(at):
                score = x[at] @ q[i] / (size[at] * np.sqrt(q[i] @ q[i]))
                if len(at) > best:  # all at the last score that counts, and a hair below
                    keep = score >= np.partition(score, -best)[-best] - 1e-9
                    at, score = at[keep], score[keep]
                out.append(pd.DataFrame({"query": query, "rep": rep[at], "near": int(near.sum())}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "rep": [], "near": []})

    return index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(ascended, "query long, rep long, near long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", **forest) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each query row, itself left out, ties to lesser ids.

    Vectors null, zero, of another length than most or with null or non-finite
    components take no part, nor do null ids; a query without candidates has no
    rows. Rows with equal ids and vectors are one. Other columns play no part.
    Components may be of any finite size: vectors are scaled before they are squared.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    sized = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if sized is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
    dims = sized["n"]
    rows = rows.filter(F.size("v") == dims)
    # Each distinct vector is named by its least id and lists its k + 1 least.
    same = W.partitionBy("v").orderBy("id")
    few = rows.select("v", "id").distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    entries = written(few.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asking = written(rows.filter("asks").select("v", F.col("id").alias("query_id")).distinct().join(entries.select("v", "rep"), "v").select("rep", "query_id"), "queries")
    asked_reps = asking.select("rep").distinct()
    ours = written(asked_reps.join(entries.select("rep", "v"), "rep"), "asked")
    found = searched(entries.select("rep", "v"), ours, dims, k + 1, **forest)
    scored = found.join(ours.select(F.col("rep").alias("query"), F.col("v").alias("q")), "query").join(entries, "rep").select("query", "ids", cosine(scaled(F.col("q")), scaled(F.col("v"))).alias("score"))
    # The k + 1 best of each distinct query; a copy of the query itself may be among them.
    scored = scored.select("query", "score", F.explode("ids").alias("id"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    scored = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    out = asking.withColumnRenamed("rep", "query").join(scored, "query").filter("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
