"""Projections, surface joins, neighbourhoods and alignment over points and frames."""

from __future__ import annotations

import tempfile
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.functions import exprs as E

XYZ = ("x", "y", "z")


def cols(prefix: str = "", names: tuple[str, ...] = XYZ) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def mapped(points: DataFrame, frames: DataFrame, key: str, corners: list[list[Column]]) -> DataFrame:
    """Barycentric points (key, u, v, ...) on the frames of their key: x, y, z. Points without a frame or with a missing landmark go, as nothing can be drawn there."""
    p = E.barycentric_point(F.col("u"), F.col("v"), *corners)
    return points.join(frames, key).select(*points.columns, *(c.alias(n) for c, n in zip(p, XYZ, strict=True))).filter("x is not null and y is not null and z is not null")


def facing(vector: Column, triangles: int, corners, nose: set[int], hidden: set[int], threshold: float = -0.05, least_area: float = 0.0) -> Column:
    """For each triangle of a frame whether it faces the viewer: the sign is that of the mean normal of the nose's triangles. A row needs no other: no shuffle."""

    def nz(t: Column) -> Column:
        a, b, c = corners(vector, t)
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    normals = F.transform(F.sequence(F.lit(0), F.lit(triangles - 1)), nz)
    near = [F.get(normals, F.lit(t)) for t in sorted(nose)]
    sign = F.when(sum(near, F.lit(0.0)) >= 0, 1.0).otherwise(-1.0) if nose else F.lit(1.0)
    off = F.array(*(F.lit(t) for t in sorted(hidden))) if hidden else F.array().cast("array<int>")
    return F.transform(normals, lambda n, t: (n * sign >= threshold) & (F.abs(n) >= least_area) & ~F.array_contains(off, t.cast("int")))


#: Ordered rules on normalised coordinates; the first that holds names region, subunit and confidence.
REGIONS = (
    ("ny >= 0.80", "forehead", "forehead", 0.56),
    ("(nx <= 0.12 or nx >= 0.88) and ny between 0.30 and 0.76", "ear_region", "preauricular_or_postauricular", 0.42),
    ("(nx < 0.22 or nx > 0.78) and ny >= 0.58", "temple_cheek", "lateral_face", 0.54),
    ("ny >= 0.68 and ny < 0.80 and nx between 0.22 and 0.78", "upper_eyelid", "upper_eyelid", 0.58),
    ("ny >= 0.55 and ny < 0.68 and nx between 0.43 and 0.57", "inner_canthus", "medial_canthal_region", 0.50),
    ("ny >= 0.53 and ny < 0.68 and (nx between 0.20 and 0.42 or nx between 0.58 and 0.80)", "lower_eyelid", "free_margin", 0.66),
    ("ny >= 0.50 and ny < 0.62 and nx between 0.43 and 0.57", "nasal_dorsum", "nasal_root_or_dorsum", 0.56),
    ("ny >= 0.39 and ny < 0.47 and nx between 0.44 and 0.56", "nasal_tip", "nasal_tip", 0.54),
    ("ny >= 0.40 and ny < 0.56 and nx between 0.36 and 0.64", "nasal_ala", "nose", 0.62),
    ("ny >= 0.34 and ny < 0.49 and (nx between 0.24 and 0.38 or nx between 0.62 and 0.76)", "nasolabial_fold", "midface_crease", 0.52),
    ("ny >= 0.28 and ny < 0.40 and ((nx >= 0.30 and nx < 0.39) or (nx > 0.61 and nx <= 0.70))", "oral_commissure", "oral_commissure", 0.54),
    ("ny >= 0.34 and ny < 0.42 and nx between 0.39 and 0.61", "upper_lip", "white_lip", 0.58),
    ("ny >= 0.24 and ny < 0.34 and nx between 0.34 and 0.66", "lip_vermilion", "oral_free_margin", 0.66),
    ("ny < 0.22 and nx between 0.28 and 0.72", "chin", "chin", 0.58),
    ("ny < 0.30 or nx < 0.18 or nx > 0.82", "jawline", "mandibular_border", 0.50),
    ("true", "cheek", "midface", 0.64),
)
SENSITIVE = ("lower_eyelid", "lip_vermilion", "nasal_ala", "nasal_tip", "oral_commissure")


def region() -> Column:
    """(region, subunit, confidence) of columns nx and ny."""
    return F.expr("case " + " ".join(f"when {c} then named_struct('region', '{r}', 'subunit', '{s}', 'confidence', {k}D)" for c, r, s, k in REGIONS) + " end")


def boxed(df: DataFrame, by: list[str], names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with its group's bounding box (x0, x1, y0, y1), a small table joined back."""
    x, y = names
    box = df.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return df.join(box, by)


def normalised(v: Column, low: Column, high: Column) -> Column:
    return E.clamp((v - low) / F.greatest(high - low, F.lit(1e-9)), 0.0, 1.0)


def nearest_k(points: DataFrame, others: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k others nearest each point of the same by columns, with d and rank n; ties by other_id. points: id, x..z; others: other_id, ox..oz.

    Others are met by blocks and come as one list a point, so that no pairs are
    shuffled. Of others at the same place, the k + 1 of least id are enough.
    """
    names = [c for c in others.columns if c not in by]
    near = nearest_lists(points, others, by, k).select(*points.columns, F.posexplode("near").alias("n", "o"))
    return near.select(*by, *(c for c in points.columns if c not in by), *(F.col(f"o.{c}").alias(c) for c in names), "o.d", (F.col("n") + 1).alias("n"))


def nearest_lists(points: DataFrame, others: DataFrame, by: list[str], k: int) -> DataFrame:
    """nearest_k() as one row a point, with the array near of structs (d, other_id, ...) in order."""
    from isoline.operators.blocks import nearest

    same = W.partitionBy(*by, *cols("o")).orderBy("other_id")
    others = others.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    return nearest(points, others, by, k)


def direction_field(near: DataFrame, by: list[str], reach: Column) -> DataFrame:
    """Of nearest_k() rows with tangents otx..otz: each point's sign-aligned, inverse-distance weighted mean direction, support and confidence."""
    first = W.partitionBy(*by, "id").orderBy("n")
    rows = near.withColumns({f"f{n}": F.first(f"ot{n}").over(first) for n in XYZ})
    sign = F.when(E.dot(cols("ot"), cols("f")) < 0, -1.0).otherwise(1.0)
    w = 1 / (F.col("d") + 1e-6)
    sums = rows.groupBy(*by, "id").agg(*(F.sum(w * sign * F.col(f"ot{n}")).alias(f"s{n}") for n in XYZ), F.min("d").alias("nearest"), F.count("*").alias("support"), F.max(reach).alias("reach"))
    size = F.sqrt(E.dot(cols("s"), cols("s")))
    out = [F.when(size > 1e-12, F.col(f"s{n}") / size).otherwise(1.0 if n == "x" else 0.0).alias(f"d{n}") for n in XYZ]
    return sums.select(*by, "id", *out, "support", "nearest", E.clamp(1 - F.col("nearest") / F.greatest("reach", F.lit(1e-9)), 0.0, 1.0).alias("confidence"))


def medoid_fused(views: DataFrame, by: list[str], inlier: float) -> DataFrame:
    """Fused point and support of each small group of weighted views (id, w, x..z): the weighted mean of those within inlier of the medoid. Groups are pairs-joined: keep them to a few views."""
    other = views.select(*by, *(F.col(c).alias(f"o{c}") for c in ("id", *XYZ)))
    pairs = views.join(other, by).withColumn("d", E.distance(cols(), cols("o")))
    sums = pairs.groupBy(*by, "id").agg(F.round(F.sum("d"), 9).alias("total"))
    medoid = sums.groupBy(*by).agg(F.min(F.struct("total", "id"))["id"].alias("medoid"))
    near = pairs.join(medoid, by).filter((F.col("id") == F.col("medoid")) & (F.col("d") <= inlier))
    weights = views.select(*by, F.col("id").alias("oid"), "w")
    near = near.drop("w").join(weights, [*by, "oid"])
    return near.groupBy(*by).agg(F.max("medoid").alias("medoid"), F.count("*").alias("support"), *((F.sum(F.col("w") * F.col(f"o{n}")) / (F.sum("w") + 1e-12)).alias(n) for n in XYZ))


def residual_field(points: DataFrame, anchors: DataFrame, by: list[str], sigma: float, cutoff: float, most: float) -> DataFrame:
    """Gaussian-weighted mean of anchors' residuals (rx..rz) at each point, clipped to length most; anchors beyond cutoff don't count."""
    near = _near(points, anchors, by, cutoff)
    w = F.exp(-0.5 * (F.col("d") / sigma) ** 2)
    sums = near.groupBy(*by, "id").agg(F.sum(w).alias("w"), *(F.sum(w * F.col(f"r{n}")).alias(f"m{n}") for n in XYZ))
    mean = [F.col(f"m{n}") / F.greatest("w", F.lit(1e-12)) for n in XYZ]
    size = F.sqrt(E.dot(mean, mean))
    clip = F.when(size > most, most / size).otherwise(1.0)
    return sums.select(*by, "id", *((c * clip).alias(f"d{n}") for c, n in zip(mean, XYZ, strict=True)))


def cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"c{n}": F.floor(F.col(n) / size) for n in XYZ})


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (id) and others (other_id) within radius: an equi-join on grid cells, each point asking its 27 cells."""
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"e{n}") for n, v in zip(XYZ, (i, j, k), strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    asked = cells(points, radius).withColumn("e", around).withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"e.e{n}") for n in XYZ}).drop("e")
    there = cells(others.select(F.col("other_id"), *(F.col(f"o{n}").alias(n) for n in XYZ)), radius).select("other_id", *(F.col(n).alias(f"o{n}") for n in XYZ), "cx", "cy", "cz")
    return asked.join(there, ["cx", "cy", "cz"]).withColumn("d", E.distance(cols(), cols("o"))).filter(F.col("d") <= radius)


def _near(points: DataFrame, others: DataFrame, by: list[str], radius: float) -> DataFrame:
    """points (x..z) joined with the others (ox..oz) of the same by columns within radius, at distance d, by grid cells."""
    size, names = radius * (1 + 1e-9), ["cx", "cy", "cz"]
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"e{n}") for n, v in zip(XYZ, (i, j, k), strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    asked = cells(points, size).withColumn("e", around).withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"e.e{n}") for n in XYZ}).drop("e")
    there = others.withColumns({f"c{n}": F.floor(F.col(f"o{n}") / size) for n in XYZ})
    return asked.join(there, [*by, *names]).drop(*names).withColumn("d", E.distance(cols(), cols("o"))).filter(F.col("d") <= radius)


def moments(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted means and second moments of sources (x..z) and targets (qx..qz) by group: all that an alignment needs of its points."""
    w = F.lit(1.0) if weight is None else weight
    sums = {f"m_{a}": F.sum(w * F.col(a)) for a in ("x", "y", "z", "qx", "qy", "qz")}
    sums |= {f"m_{a}{b}": F.sum(w * F.col(a) * F.col(b)) for a in XYZ for b in ("qx", "qy", "qz")}
    sums["m_ss"] = F.sum(w * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    sums["m_qq"] = F.sum(w * (F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2))
    return df.groupBy(*by).agg(F.sum(w).alias("w"), *(v.alias(k) for k, v in sums.items()))


def similarity(df: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """Scale, rotation (r00..r22), translation (t0..t2) and root mean square error of each group's best similarity. Points are summed in the JVM; Python sees one row per group."""
    names = [*(f"r{i}{j}" for i in range(3) for j in range(3)), "scale", "t0", "t1", "t2", "rmse"]

    def solved(batches):
        for b in batches:
            rows = []
            for _, m in b.iterrows():
                w = m["w"]
                if not w > 0:
                    continue
                s, q = (np.array([m[f"m_{p}{n}"] for n in XYZ]) / w for p in ("", "q"))
                cov = np.array([[m[f"m_{a}q{n}"] for a in XYZ] for n in XYZ]) / w - np.outer(q, s)
                u, d, vt = np.linalg.svd(cov)
                flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1])
                rot = u @ flip @ vt
                var = m["m_ss"] / w - s @ s
                k = float((d * np.diag(flip)).sum() / var) if var > 1e-15 else 1.0
                rmse = np.sqrt(max(0.0, m["m_qq"] / w - q @ q - k * k * var)) if var > 1e-15 else 0.0
                rows.append([m[by], *rot.ravel(), k, *(q - k * rot @ s), rmse])
            yield pd.DataFrame(rows, columns=[by, *names])

    kind = dict(df.dtypes)[by]
    return moments(df, [by], weight).mapInPandas(solved, f"{by} {kind}, " + ", ".join(f"{n} double" for n in names))


def boundary_edges(faces: DataFrame, by: list[str]) -> DataFrame:
    """Undirected edges (a, b) of faces (i0, i1, i2) that only one face has."""
    return edges(faces, by).groupBy(*by, "a", "b").agg(F.count("*").alias("n")).filter("n = 1").drop("n")


def edges(faces: DataFrame, by: list[str]) -> DataFrame:
    sides = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))))
    return faces.select(*by, F.explode(sides).alias("e")).select(*by, "e.a", "e.b")


def tension(springs: DataFrame, by: list[str]) -> DataFrame:
    """Each vertex's weighted mean strain over its springs (a, b, rest, length, w)."""
    strain = (F.col("length") - F.col("rest")) / F.greatest("rest", F.lit(1e-9))
    ends = springs.withColumn("strain", strain).withColumn("v", F.explode(F.array("a", "b")))
    return ends.groupBy(*by, "v").agg((F.sum(F.col("w") * F.col("strain")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("tension"), F.count("*").alias("n"))


def shortest_paths(edge_table: DataFrame, sources: DataFrame, rounds: int | None = None, block: int = 65536) -> DataFrame:
    """(v, d): the least length from any source (v) over undirected edges (a, b, w); with rounds, of paths of at most so many edges. Each round is a join and a partial minimum; lineage is cut by checkpoints."""
    if rounds is None:
        return _settled_paths(edge_table, sources, block)
    both = edge_table.select("a", "b", "w").unionByName(edge_table.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    best = sources.select("v", F.lit(0.0).alias("d"))
    for i in range(rounds):
        step = best.join(both, best["v"] == both["a"]).select(F.col("b").alias("v"), (F.col("d") + F.col("w")).alias("d"))
        best = best.unionByName(step).groupBy("v").agg(F.min("d").alias("d"))
        if i % 4 == 3:
            best = checkpointed(best)
    return best


def _settled_paths(edge_table: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """All least lengths: vertices, which are numbers, are cut into ranges of about block edges; each round settles every range by itself and hands lengths on to the others, until a round changes nothing. The driver holds the cuts and a count."""
    both = edge_table.select("a", "b", "w").unionByName(edge_table.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = checkpointed(both.groupBy("a", "b").agg(F.min("w").cast("double").alias("w")))
    n, low = both.agg(F.count("*"), F.min("w")).first()
    if low is not None and low < 0:
        raise ValueError("shortest_paths: a negative edge has no least length")
    m = n // block + 1
    cuts = both.approxQuantile("a", [i / m for i in range(1, m)], 0.25 / m) if m > 1 else []
    held = lambda v: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(v))) if cuts else F.lit(0)
    both = checkpointed(both.withColumn("part", held("a")))
    kind = dict(both.dtypes)["a"]

    def settled(known: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        best = dict(zip(known["v"].tolist(), known["d"].tolist(), strict=True))
        near: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in zip(links["a"].tolist(), links["b"].tolist(), links["w"].tolist(), strict=True) if best else ():
            near.setdefault(a, []).append((b, w))
        heap = [(d, v) for v, d in best.items()]
        heapify(heap)
        while heap:
            d, v = heappop(heap)
            if d > best[v]:
                continue
            for b, w in near.get(v, ()):
                if d + w < best.get(b, float("inf")):
                    best[b] = d + w
                    heappush(heap, (d + w, b))
        return pd.DataFrame({"v": list(best), "d": list(best.values())}).astype({"v": links["a"].dtype if len(links) else known["v"].dtype, "d": "float64"})

    best = checkpointed(sources.select(F.col("v").cast(kind), F.lit(0.0).alias("d")).distinct())
    while True:
        step = best.withColumn("part", held("v")).groupBy("part").cogroup(both.groupBy("part")).applyInPandas(settled, f"v {kind}, d double")
        new = step.groupBy("v").agg(F.min("d").alias("d")).join(best.withColumnRenamed("d", "old"), "v", "left")
        new = checkpointed(new)
        changed = new.filter("old is null or d < old").limit(1).count()
        best = new.select("v", "d")
        if not changed:
            return best


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the cluster's shared folder. Where none is set, in a fresh one on a local master, as in tests; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
