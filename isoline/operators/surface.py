"""Points met with the triangles of their mesh, by a grid of several cell sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators.blocks import closest, located
from isoline.operators.geometry import XYZ, cols

__all__ = ["closest", "corner_bound", "located", "met"]

CORNERS = (0, 1, 2)


def met(points: DataFrame, triangles: DataFrame, by: list[str], names: tuple[str, ...], radius: Column) -> DataFrame:
    """Points (x..z) and triangles (x0..z2) of the same by columns whose boxes along names meet, a point's reaching radius each way: each pair once, and with it some whose boxes are only close.

    Cells double in width from level to level, up to the mesh's own, and their
    levels grow with the logarithm of its triangles. A triangle lies in the cells
    of its box, two or three a side, at each level as wide as itself or wider; a
    point asks the level as wide as its own box, and on wider ones those triangles
    that start there.
    """
    low = {n: F.least(*(F.col(f"{n}{j}") for j in CORNERS)) for n in names}
    high = {n: F.greatest(*(F.col(f"{n}{j}") for j in CORNERS)) for n in names}
    tris = triangles.withColumns({f"lo_{n}": low[n] for n in names} | {f"hi_{n}": high[n] for n in names})
    mesh = tris.groupBy(*by).agg(F.count("*").alias("tris"), *(F.min(f"lo_{n}").alias(f"at_{n}") for n in names), *(F.max(f"hi_{n}").alias(f"to_{n}") for n in names))
    span = F.greatest(*(F.col(f"to_{n}") - F.col(f"at_{n}") for n in names))
    top = F.ceil(F.log2(F.greatest("tris", F.lit(1))) / len(names)).cast("int") + 1
    mesh = mesh.withColumn("top", top).withColumn("base", F.when(span > 0, span / F.pow(F.lit(2.0), "top")).otherwise(1.0))
    level_of = lambda width: F.least(F.greatest(F.coalesce(F.ceil(F.log2(width / F.col("base"))).cast("int"), F.lit(0)), F.lit(0)), F.col("top"))
    size = F.col("base") * F.pow(F.lit(2.0), "level")

    def celled(df: DataFrame, first: str, prefix: str) -> DataFrame:
        """df once for each cell of its box, at each level from first."""
        df = df.withColumn("level", F.explode(F.sequence(first, "top")))
        for n in names:
            df = df.withColumn(f"{prefix}_{n}", F.floor((F.col(f"lo_{n}") - F.col(f"at_{n}")) / size))
            df = df.withColumn(f"c_{n}", F.explode(F.sequence(F.col(f"{prefix}_{n}"), F.floor((F.col(f"hi_{n}") - F.col(f"at_{n}")) / size))))
        return df.drop("top", "base", *(f"{p}_{n}" for p in ("lo", "hi", "at", "to") for n in names))

    wide = F.greatest(*(F.col(f"hi_{n}") - F.col(f"lo_{n}") for n in names))
    there = celled(tris.join(mesh.drop("tris"), by).withColumn("own", level_of(wide)), "own", "t")
    asked = points.join(mesh.drop("tris"), by).withColumn("radius", radius)
    asked = asked.withColumns({f"lo_{n}": F.greatest(F.col(n) - F.col("radius"), F.col(f"at_{n}")) for n in names} | {f"hi_{n}": F.least(F.col(n) + F.col("radius"), F.col(f"to_{n}")) for n in names})
    for n in names:
        asked = asked.filter(F.col(n).isNotNull() & ~F.isnan(n) & (F.col(f"lo_{n}") <= F.col(f"hi_{n}")))
    asked = celled(asked.withColumn("ask", level_of(F.col("radius") * 2)), "ask", "p")
    pairs = asked.join(there, [*by, "level", *(f"c_{n}" for n in names)])
    # A pair shares several cells; the one at its boxes' common low corner stands for all.
    pairs = pairs.filter((F.col("own") == F.col("level")) | (F.col("ask") == F.col("level")))
    for n in names:
        pairs = pairs.filter(F.col(f"c_{n}") == F.greatest(f"p_{n}", f"t_{n}"))
    return pairs.drop("level", "own", "ask", "radius", *(f"{p}_{n}" for p in "cpt" for n in names))


def corner_bound(points: DataFrame, triangles: DataFrame, by: list[str]) -> DataFrame:
    """For each point (by, id, x..z) the distance to some corner near it (bound), which its closest triangle can't exceed.

    One corner stands for each cell of a grid at each of its levels; a point
    measures those of its own cells, the widest of which holds the whole mesh.
    """
    corner = F.explode(F.array(*(F.struct(*(F.col(f"{n}{j}").alias(f"o{n}") for n in XYZ)) for j in CORNERS)))
    corners = triangles.select(*by, corner.alias("c")).select(*by, "c.*")
    mesh = corners.groupBy(*by).agg(F.count("*").alias("n"), *(F.min(f"o{n}").alias(f"at_{n}") for n in XYZ), *(F.max(f"o{n}").alias(f"to_{n}") for n in XYZ))
    span = F.greatest(*(F.col(f"to_{n}") - F.col(f"at_{n}") for n in XYZ))
    mesh = mesh.withColumns({"top": F.ceil(F.log2("n") / 3).cast("int") + 1, "span": F.when(span > 0, span).otherwise(1.0)})

    def celled(df: DataFrame, prefix: str) -> DataFrame:
        df = df.join(mesh, by).withColumn("level", F.explode(F.sequence(F.lit(0), "top")))
        parts = F.pow(F.lit(2.0), "level")
        inside = lambda n: F.least(F.greatest(F.col(f"{prefix}{n}"), F.col(f"at_{n}")), F.col(f"to_{n}")) - F.col(f"at_{n}")
        return df.withColumns({f"c_{n}": F.least(F.floor(inside(n) / F.col("span") * parts), parts - 1) for n in XYZ}).drop("n", "top", "span", *(f"{p}_{n}" for p in ("at", "to") for n in XYZ))

    cell = [*by, "level", *(f"c_{n}" for n in XYZ)]
    stands = celled(corners, "o").groupBy(*cell).agg(F.min(F.struct(*cols("o"))).alias("o")).select(*cell, "o.*")
    near = celled(points, "").join(stands, cell).withColumn("d", E.distance(cols(), cols("o")))
    return near.groupBy(*by, "id").agg(F.min("d").alias("bound"))
