"""Rays, lines and normals on triangle meshes, distances between them, and directions handed from one to another."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators import geometry as G
from isoline.operators import surface as U
from isoline.operators.geometry import XYZ, cols

CORNERS = (0, 1, 2)


def corner(j: int, names: tuple[str, ...] = XYZ) -> list[Column]:
    return [F.col(f"{n}{j}") for n in names]


def gridded(triangles: DataFrame, by: list[str], names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The grid of each mesh, as (by, base, at_*, to_*, levels), and its triangles once for each cell that their box along names touches.

    Cells double in width from level to level, from at most the triangles' mean
    width. A triangle lies on the one level whose cells are as wide as itself, so in
    a few cells; those who look for it walk the cells of each level that the mesh
    uses. Triangles with a missing or
    infinite coordinate are left out.
    """
    low = {n: F.least(*(F.col(f"{n}{j}") for j in CORNERS)) for n in names}
    high = {n: F.greatest(*(F.col(f"{n}{j}") for j in CORNERS)) for n in names}
    finite = F.lit(True)
    for n in XYZ:
        for j in CORNERS:
            finite = finite & F.coalesce(F.abs(f"{n}{j}") < float("inf"), F.lit(False))
    tris = triangles.filter(finite).withColumns({f"lo_{n}": low[n] for n in names} | {f"hi_{n}": high[n] for n in names})
    wide = F.greatest(*(F.col(f"hi_{n}") - F.col(f"lo_{n}") for n in names))
    mesh = tris.groupBy(*by).agg(F.count("*").alias("tris"), F.avg(wide).alias("wide"), *(F.min(f"lo_{n}").alias(f"at_{n}") for n in names), *(F.max(f"hi_{n}").alias(f"to_{n}") for n in names))
    span = F.greatest(*(F.col(f"to_{n}") - F.col(f"at_{n}") for n in names))
    bits = F.log2(F.greatest("tris", F.lit(1)))
    # A long or flat mesh fills few of its cube's cells: its triangles' width tells how fine they must be.
    fine = F.when((span > 0) & (F.col("wide") > 0), F.least(F.log2(span / F.col("wide")), bits))
    top = F.ceil(F.greatest(bits / len(names), fine)).cast("int") + 1
    mesh = mesh.withColumn("top", top).drop("wide").withColumn("base", F.when(span > 0, span / F.pow(F.lit(2.0), "top")).otherwise(1.0)).withColumn("slack", span * 1e-9 + 1e-12)
    own = F.least(F.greatest(F.coalesce(F.ceil(F.log2(wide / F.col("base"))).cast("int"), F.lit(0)), F.lit(0)), F.col("top"))
    cells = tris.join(mesh.drop("tris"), by).withColumn("level", own).withColumn("size", F.col("base") * F.pow(F.lit(2.0), "level"))
    for n in names:
        at = lambda v, sign, n=n: F.floor((F.col(v) + sign * F.col("slack") - F.col(f"at_{n}")) / F.col("size"))
        cells = cells.withColumn(f"c_{n}", F.explode(F.sequence(at(f"lo_{n}", -1), at(f"hi_{n}", 1))))
    cells = cells.drop("size", "top", "base", "slack", *(f"{p}_{n}" for p in ("lo", "hi", "at", "to") for n in names))
    levels = cells.groupBy(*by).agg(F.collect_set("level").alias("levels"))
    return mesh.drop("tris", "top").join(levels, by), cells


def walked(df: DataFrame, mesh: DataFrame, by: list[str], names: tuple[str, ...], first: Column, last: Column) -> DataFrame:
    """df once for each cell (level, c_*) that the lines from o* along d* touch between the parameters first and last, in the row: sorted crossings of the grid's planes cut a line into stretches, and each one's middle tells its cell."""
    df = df.join(mesh, by)
    start, end, meets = first, last, F.lit(True)
    for n in names:
        o, d, low, high = F.col(f"o{n}"), F.col(f"d{n}"), F.col(f"at_{n}") - F.col("slack"), F.col(f"to_{n}") + F.col("slack")
        a, b = F.when(d != 0, (low - o) / d), F.when(d != 0, (high - o) / d)
        start, end = F.greatest(start, F.least(a, b)), F.least(end, F.greatest(a, b))
        meets = meets & ((d != 0) | o.between(low, high))
    df = df.withColumns({"t_in": start, "t_out": end}).filter(meets & (F.col("t_in") <= F.col("t_out")))
    df = df.withColumn("level", F.explode("levels")).withColumn("size", F.col("base") * F.pow(F.lit(2.0), "level"))
    cuts = [F.array("t_in", "t_out")]
    for n in names:
        o, d, at, size = F.col(f"o{n}"), F.col(f"d{n}"), F.col(f"at_{n}"), F.col("size")
        a, b = (o + F.col("t_in") * d - at) / size, (o + F.col("t_out") * d - at) / size
        low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
        planes = F.when((d != 0) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        cuts.append(F.transform(planes, lambda p: F.least(F.greatest((at + p * size - o) / d, F.col("t_in")), F.col("t_out"))))
    df = df.withColumn("cuts", F.array_sort(F.concat(*cuts)))
    count = F.size("cuts") - 1
    middles = F.zip_with(F.slice("cuts", F.lit(1), count), F.slice("cuts", F.lit(2), count), lambda a, b: (a + b) / 2)
    cell = lambda m: F.struct(*(F.floor((F.col(f"o{n}") + m * F.col(f"d{n}") - F.col(f"at_{n}")) / F.col("size")).alias(f"c_{n}") for n in names))
    df = df.withColumn("cell", F.explode(F.array_distinct(F.transform(middles, cell))))
    return df.withColumns({f"c_{n}": F.col(f"cell.c_{n}") for n in names}).drop("cell", "cuts", "size", "levels", "base", "slack", "t_in", "t_out", *(f"{p}_{n}" for p in ("at", "to") for n in names))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def met_at(o: list[Column], d: list[Column], corners: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Parameter along a ray and weights of the second and third corner where it meets a triangle's plane; null where they are parallel."""
    e1, e2 = E.sub(corners[1], corners[0]), E.sub(corners[2], corners[0])
    p, s = cross(d, e2), E.sub(o, corners[0])
    det = E.dot(e1, p)
    det = F.when(F.abs(det) > 1e-12, det)
    q = cross(s, e1)
    return E.dot(e2, q) / det, E.dot(s, p) / det, E.dot(d, q) / det


def first_hits(rays: DataFrame, triangles: DataFrame, by: list[str]) -> DataFrame:
    """Where rays (id, ox..oz, dx..dz) first meet a triangle (tri, x0..z2) of their by columns, as (by, id, tri, t, x, y, z): the least t at or beyond the origin, ties to the smaller tri. Rays that meet none, or have no direction, have no row.

    Rays walk the cells of the mesh's grid and meet what lies there in an equi-join:
    no product of rays and triangles.
    """
    mesh, cells = gridded(triangles.select(*by, "tri", *(f"{n}{j}" for j in CORNERS for n in XYZ)), by, XYZ)
    asked = walked(rays.select(*by, "id", *(f"{p}{n}" for p in "od" for n in XYZ)), mesh, by, XYZ, F.lit(0.0), F.lit(float("inf")))
    pairs = asked.join(cells, [*by, "level", *(f"c_{n}" for n in XYZ)])
    t, u, v = met_at(cols("o"), cols("d"), [corner(j) for j in CORNERS])
    pairs = pairs.withColumns({"t": t, "u": u, "v": v}).filter("t >= 0 and u >= 0 and v >= 0 and u + v <= 1")
    at = F.struct(F.round("t", 9).alias("near"), "tri", "t", *((F.col(f"o{n}") + F.col("t") * F.col(f"d{n}")).alias(n) for n in XYZ))
    best = pairs.groupBy(*by, "id").agg(F.min(at).alias("b"))
    return best.select(*by, "id", "b.tri", "b.t", *(F.col(f"b.{n}").alias(n) for n in XYZ))


def distorted(x: Column, y: Column, k: tuple[float, float, float, float, float]) -> tuple[Column, Column]:
    """A lens' image of normalised coordinates: radial k1, k2, k3 and tangential p1, p2, given as (k1, k2, p1, p2, k3)."""
    k1, k2, p1, p2, k3 = k
    r = x * x + y * y
    radial = 1 + ((k3 * r + k2) * r + k1) * r
    return x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y


def undistorted(df: DataFrame, u: Column, v: Column, camera: list[list[float]], k: tuple[float, float, float, float, float], rounds: int = 5) -> DataFrame:
    """df with the normalised coordinates nx, ny whose distorted image lies at pixel u, v: a fixed-point iteration of so many rounds."""
    k1, k2, p1, p2, k3 = k
    df = df.withColumns({"seen_x": (u - camera[0][2]) / camera[0][0], "seen_y": (v - camera[1][2]) / camera[1][1]})

    def nearer(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        r = x * x + y * y
        shrink = 1 / (1 + ((k3 * r + k2) * r + k1) * r)
        return F.struct(((F.col("seen_x") - (2 * p1 * x * y + p2 * (r + 2 * x * x))) * shrink).alias("x"), ((F.col("seen_y") - (p1 * (r + 2 * y * y) + 2 * p2 * x * y)) * shrink).alias("y"))

    # A fold, not a chain of columns: each round names the last one's result several times over.
    df = df.withColumn("at", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col("seen_x").alias("x"), F.col("seen_y").alias("y")), nearer))
    return df.withColumns({"nx": F.col("at.x"), "ny": F.col("at.y")}).drop("seen_x", "seen_y", "at")


def world_ray(x: Column, y: Column, rotation: list[list[float]], t: list[Column], to_camera: bool = True) -> tuple[list[Column], list[Column]]:
    """Origin and unit direction in the world of a ray through normalised coordinates. rotation and t take the world to the camera, or, if not to_camera, the camera to the world."""
    size = F.sqrt(x * x + y * y + 1)
    d = [x / size, y / size, 1 / size]
    r = [[rotation[j][i] for j in range(3)] for i in range(3)] if to_camera else rotation  # turns camera to world
    turn = lambda p: [p[0] * m[0] + p[1] * m[1] + p[2] * m[2] for m in r]
    return ([-c for c in turn(t)] if to_camera else list(t)), turn(d)


def vertex_normals(faces: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """(by, v, nx, ny, nz, faces): the unit sum of the normals, each as long as its triangle is wide, of the faces (i0, i1, i2) around each vertex (v, x..z); zero where they cancel. Faces with a missing vertex are left out. Sums are taken on the map side before they are shuffled."""
    df = faces.select(*by, "i0", "i1", "i2")
    for j in CORNERS:
        df = df.join(vertices.select(*by, F.col("v").alias(f"i{j}"), *(F.col(n).alias(f"{n}{j}") for n in XYZ)), [*by, f"i{j}"])
    n = cross(E.sub(corner(1), corner(0)), E.sub(corner(2), corner(0)))
    ends = df.select(*by, F.explode(F.array("i0", "i1", "i2")).alias("v"), *(c.alias(f"s{m}") for c, m in zip(n, XYZ, strict=True)))
    sums = ends.groupBy(*by, "v").agg(*(F.sum(f"s{m}").alias(f"s{m}") for m in XYZ), F.count("*").alias("faces"))
    size = F.sqrt(E.dot(cols("s"), cols("s")))
    return sums.select(*by, "v", *(F.when(size > 0, F.col(f"s{m}") / size).otherwise(0.0).alias(f"n{m}") for m in XYZ), "faces")


def edge_lengths(faces: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """(by, edges, mean_length) of each mesh's distinct undirected edges."""
    e = G.edges(faces, by).distinct()
    for s in "ab":
        e = e.join(vertices.select(*by, F.col("v").alias(s), *(F.col(n).alias(f"{s}{n}") for n in XYZ)), [*by, s])
    return e.groupBy(*by).agg(F.count("*").alias("edges"), F.avg(E.distance(cols("a"), cols("b"))).alias("mean_length"))


def surface_distance(vertices: dict[str, DataFrame], meshes: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(by, way, n, mean, p95, max): how far one surface's vertices (id, x..z) lie from the other's triangles, both ways round. vertices and meshes have the same two names."""
    a, b = vertices
    each = [U.closest(vertices[x], meshes[y], by).withColumn("way", F.lit(f"{x} to {y}")) for x, y in ((a, b), (b, a))]
    d = each[0].unionByName(each[1])
    return d.groupBy(*by, "way").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.percentile("distance", F.lit(0.95)).alias("p95"), F.max("distance").alias("max"))


def clipped(lines: DataFrame, triangles: DataFrame, by: list[str], least: float = 1e-9) -> DataFrame:
    """Flat lines rebuilt on a surface seen along z: pieces (by, line, seg, t0, t1, tri, u0, v0, u1, v1, length) of segments (line, seg, ax, ay, bx, by_) in the triangles (tri, x0..z2) that they cross.

    t0 and t1 run along the segment, u and v are the weights of the triangle's first
    two corners at the piece's ends, length is flat. A piece along an edge goes to
    the smaller tri; where triangles lie over each other all have their piece.
    Pieces shorter than least of their segment are left out, as are segments of no
    length and triangles of no area. Segments walk the grid's cells and meet
    triangles there.
    """
    flat = ("x", "y")
    mesh, cells = gridded(triangles.select(*by, "tri", *(f"{n}{j}" for j in CORNERS for n in XYZ)), by, flat)
    segs = lines.select(*by, "line", "seg", F.col("ax").alias("ox"), F.col("ay").alias("oy"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by_") - F.col("ay")).alias("dy")).filter("dx <> 0 or dy <> 0")
    pairs = walked(segs, mesh, by, flat, F.lit(0.0), F.lit(1.0)).join(cells, [*by, "level", "c_x", "c_y"]).drop("level", "c_x", "c_y")
    # Only pairs whose boxes meet are shuffled, to count once those that share several cells.
    for n in flat:
        o, e, ends = F.col(f"o{n}"), F.col(f"o{n}") + F.col(f"d{n}"), [F.col(f"{n}{j}") for j in CORNERS]
        pairs = pairs.filter((F.least(o, e) <= F.greatest(*ends) + 1e-6) & (F.greatest(o, e) >= F.least(*ends) - 1e-6))
    pairs = pairs.dropDuplicates([*by, "line", "seg", "tri"])
    (ax, ay), (bx, by_), (cx, cy) = (corner(j, flat) for j in CORNERS)
    area = (bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)
    weight = lambda x, y: [((bx - x) * (cy - y) - (cx - x) * (by_ - y)) / area, ((cx - x) * (ay - y) - (ax - x) * (cy - y)) / area]
    pairs = pairs.filter(area != 0)
    start, end = weight(F.col("ox"), F.col("oy")), weight(F.col("ox") + F.col("dx"), F.col("oy") + F.col("dy"))
    pairs = pairs.withColumns({"wa": start[0], "wb": start[1], "ea": end[0], "eb": end[1]}).withColumns({"wc": 1 - F.col("wa") - F.col("wb"), "ec": 1 - F.col("ea") - F.col("eb")})
    # Each weight is linear along the segment: where it isn't negative bounds the piece.
    enter, leave, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for c in "abc":
        s, e = F.col(f"w{c}"), F.col(f"e{c}")
        zero = s / (s - e)
        enter.append(F.when((s < 0) & (e > s), zero))
        leave.append(F.when((e < 0) & (s > e), zero))
        out = out | ((s < 0) & (e < 0))
    pairs = pairs.filter(~out).withColumns({"t0": F.greatest(*enter), "t1": F.least(*leave)}).filter(F.col("t1") - F.col("t0") > least)
    at = lambda c, t: F.col(f"w{c}") + F.col(t) * (F.col(f"e{c}") - F.col(f"w{c}"))
    mid = F.least(*((at(c, "t0") + at(c, "t1")) / 2 for c in "abc"))
    pieces = pairs.withColumns({"u0": at("a", "t0"), "v0": at("b", "t0"), "u1": at("a", "t1"), "v1": at("b", "t1"), "length": (F.col("t1") - F.col("t0")) * F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2), "edge": mid < 1e-9})
    names = [*by, "line", "seg", "t0", "t1", "tri", "u0", "v0", "u1", "v1", "length"]
    inner = pieces.filter("not edge").select(*names)
    shared = pieces.filter("edge").groupBy(*by, "line", "seg", F.round("t0", 9).alias("r0"), F.round("t1", 9).alias("r1")).agg(F.min(F.struct("tri", *(c for c in names if c not in (*by, "line", "seg", "tri")))).alias("p"))
    return inner.unionByName(shared.select(*by, "line", "seg", "p.*").select(*names))


def transferred(source: DataFrame, triangles: DataFrame, by: list[str], k: int = 7, reach: float = 0.18, wide: float = 45.0) -> DataFrame:
    """Directions of a source surface handed to another's triangles: (by, tri, dx, dy, dz, angle, confidence, nearest, distance, support, spread).

    source has samples (id, x..z, tx..tz, confidence), triangles (tri, x0..z2). The
    source is first laid over the target's box, centre on centre and by the ratio of
    diagonals. A triangle's direction is the mean of its k nearest samples', turned
    to the side of the nearest one's and weighted by confidence over distance. Its
    confidence is the samples' mean, or what the nearest one's distance leaves of
    reach times the target's diagonal where that is less; it falls by a quarter
    where directions spread by more than wide degrees. Samples without a direction
    count as along x. Targets without samples have no row.
    """
    low = lambda p: [F.min(f"{p}{n}").alias(f"{p}lo_{n}") for n in XYZ]
    high = lambda p: [F.max(f"{p}{n}").alias(f"{p}hi_{n}") for n in XYZ]
    ends = triangles.select(*by, F.explode(F.array(*(F.struct(*(F.col(f"{n}{j}").alias(f"t{n}") for n in XYZ)) for j in CORNERS))).alias("c")).select(*by, "c.*")
    target = ends.groupBy(*by).agg(*low("t"), *high("t"))
    named = source.select(*by, F.col("id"), *(F.col(n).alias(f"s{n}") for n in XYZ), *(F.col(f"t{n}").alias(f"v{n}") for n in XYZ), E.clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0).alias("confidence"))
    boxes = named.groupBy(*by).agg(*low("s"), *high("s")).join(target, by)
    diagonal = lambda p: F.sqrt(sum(((F.col(f"{p}hi_{n}") - F.col(f"{p}lo_{n}")) ** 2 for n in XYZ), F.lit(0.0)))
    boxes = boxes.withColumn("diagonal", diagonal("t")).withColumn("ratio", F.col("diagonal") / F.greatest(diagonal("s"), F.lit(1e-9)))
    centre = lambda p, n: (F.col(f"{p}lo_{n}") + F.col(f"{p}hi_{n}")) / 2
    size = F.sqrt(E.dot(cols("v"), cols("v")))
    laid = named.join(boxes, by).select(
        *by, (-1 - F.col("id")).alias("other_id"), *(((F.col(f"s{n}") - centre("s", n)) * F.col("ratio") + centre("t", n)).alias(f"o{n}") for n in XYZ),
        *(F.when(size > 1e-12, F.col(f"v{n}") / size).otherwise(1.0 if n == "x" else 0.0).alias(f"ot{n}") for n in XYZ), "confidence",
    )
    centres = triangles.select(*by, F.col("tri").alias("id"), *((sum((F.col(f"{n}{j}") for j in (1, 2)), F.col(f"{n}0")) / 3).alias(n) for n in XYZ))
    # All that a triangle needs is in its row: pairs aren't shuffled.
    near = G.nearest_lists(centres, laid, by, k).join(boxes.select(*by, "diagonal"), by).withColumn("first", F.get("near", F.lit(0)))
    ot = lambda o: [o[f"ot{n}"] for n in XYZ]
    sign = lambda o: F.when(E.dot(ot(o), [F.col(f"first.ot{n}") for n in XYZ]) < 0, -1.0).otherwise(1.0)
    rows = near.withColumn("all", F.transform("near", lambda o: F.struct((1 / (o["d"] + 1e-6)).alias("p"), (o["confidence"] / (o["d"] + 1e-6)).alias("w"), o["confidence"].alias("confidence"), *((sign(o) * g).alias(n) for g, n in zip(ot(o), XYZ, strict=True)))))
    weighed = F.aggregate("all", F.lit(0.0), lambda s, a: s + a["w"]) > 1e-12
    rows = rows.withColumn("q", F.when(weighed, F.transform("all", lambda a: a["w"])).otherwise(F.transform("all", lambda a: a["p"])))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("q", *XYZ, "c")))
    add = lambda s, a: F.struct((s["q"] + a["q"]).alias("q"), *((s[n] + a["q"] * a["a"][n]).alias(n) for n in XYZ), (s["c"] + a["q"] * a["a"]["confidence"]).alias("c"))
    rows = rows.withColumn("s", F.aggregate(F.arrays_zip(F.col("q"), F.col("all").alias("a")), zero, add))
    size = F.sqrt(E.dot([F.col(f"s.{n}") for n in XYZ], [F.col(f"s.{n}") for n in XYZ]))
    sums = rows.withColumns({f"d{n}": F.when(size > 1e-12, F.col(f"s.{n}") / size).otherwise(1.0 if n == "x" else 0.0) for n in XYZ} | {"own": F.col("s.c") / F.col("s.q")})
    away = F.transform("all", lambda a: F.degrees(F.acos(E.clamp(a["x"] * F.col("dx") + a["y"] * F.col("dy") + a["z"] * F.col("dz"), -1.0, 1.0))))
    out = sums.withColumn("spread", F.when(F.size("all") > 1, F.array_max(away)).otherwise(0.0))
    far = E.clamp(1 - F.col("first.d") / F.greatest(F.col("diagonal") * reach, F.lit(1e-9)), 0.0, 1.0)
    confidence = F.least("own", far) * F.when(F.col("spread") > wide, 0.75).otherwise(1.0)
    return out.select(*by, F.col("id").alias("tri"), "dx", "dy", "dz", F.degrees(F.atan2("dy", "dx")).alias("angle"), confidence.alias("confidence"), (-1 - F.col("first.other_id")).alias("nearest"), F.col("first.d").alias("distance"), F.size("near").cast("long").alias("support"), "spread")


def coverage(transfer: DataFrame, by: list[str], low: float = 0.35) -> DataFrame:
    """What transferred() covers: samples, how many have low confidence and their share, least and mean confidence, the widest spread."""
    few = F.sum((F.col("confidence") < low).cast("long"))
    return transfer.groupBy(*by).agg(F.count("*").alias("samples"), few.alias("low"), (few / F.count("*")).alias("low_share"), F.min("confidence").alias("least"), F.avg("confidence").alias("mean"), F.max("spread").alias("widest"))


def excised(vertices: DataFrame, by: list[str], centre: tuple[float, float, float], axis: tuple[float, float, float], la: float, lb: float, release: float | None = None) -> DataFrame:
    """vertices (v, x..z) with removed, whether they lie in the ellipse of half axes la along axis and lb across it, and mask, how much of their tether is left: none within 0.4 of release (three times la if not given), all beyond it."""
    length = math.sqrt(sum(a * a for a in axis)) or 1.0
    unit, release = [a / length for a in axis], la * 3 if release is None else release
    d = [F.col(n) - c for n, c in zip(XYZ, centre, strict=True)]
    along = E.dot(d, [F.lit(a) for a in unit])
    across = E.sub(d, [along * a for a in unit])
    removed = along * along / (la * la) + E.dot(across, across) / (lb * lb) <= 1
    mask = E.clamp((F.sqrt(E.dot(d, d)) / release - 0.4) / 0.6, 0.0, 1.0)
    return vertices.withColumns({"removed": removed, "mask": F.when(removed, 1.0).otherwise(mask)})


def tethered_step(vertices: DataFrame, springs: DataFrame, by: list[str], stiffness: float = 0.2, tether: float = 0.15, damping: float = 0.9, dt: float = 0.5) -> DataFrame:
    """One step of a cut body: vertices (v, x..z, rx..rz, vx..vz, anchored, removed, mask), springs (a, b, rest, k). Springs of removed vertices don't pull; tethers draw vertices to where they rest; anchored and removed ones stay. Forces are summed by vertex, on the map side first."""
    ends = springs
    live = vertices.filter("not removed")
    for s in "ab":
        ends = ends.join(live.select(*by, F.col("v").alias(s), *(F.col(n).alias(f"{s}_{n}") for n in XYZ)), [*by, s])
    d = [F.col(f"b_{n}") - F.col(f"a_{n}") for n in XYZ]
    length = F.sqrt(E.dot(d, d))
    length = F.when(length == 0, 1e-9).otherwise(length)
    pull = stiffness * F.col("k") * (length - F.col("rest")) / length
    sides = F.array(*(F.struct(F.col(e).alias("v"), *((c * pull * sign).alias(f"f{n}") for c, n in zip(d, XYZ, strict=True))) for e, sign in (("a", 1.0), ("b", -1.0))))
    force = ends.select(*by, F.explode(sides).alias("e")).select(*by, "e.*").groupBy(*by, "v").agg(*(F.sum(f"f{n}").alias(f"f{n}") for n in XYZ))
    out = vertices.join(force, [*by, "v"], "left")
    still = F.col("anchored") | F.col("removed")
    speed = {n: F.when(still, 0.0).otherwise((F.col(f"v{n}") + (F.coalesce(f"f{n}", F.lit(0.0)) + tether * F.col("mask") * (F.col(f"r{n}") - F.col(n))) * dt) * damping) for n in XYZ}
    return out.select(*by, "v", *((F.col(n) + speed[n] * dt).alias(n) for n in XYZ), *(f"r{n}" for n in XYZ), *(speed[n].alias(f"v{n}") for n in XYZ), "anchored", "removed", "mask")


def settled(vertices: DataFrame, springs: DataFrame, by: list[str], rest: float = 1e-3, most: int = 200, **how: float) -> DataFrame:
    """tethered_step() until no vertex is faster than rest, or most steps are made. Each step reads the body three times, so each is written to the shared folder, which cuts its lineage; the driver sees its greatest speed."""
    springs = G.checkpointed(springs)
    for _ in range(most):
        vertices = G.checkpointed(tethered_step(vertices, springs, by, **how))
        fastest = vertices.agg(F.max(F.sqrt(E.dot(cols("v"), cols("v"))))).first()[0]
        if fastest is None or fastest <= rest:
            break
    return vertices


def fusiform_length(ring: Column, angle: Column, diameter: Column, margin: Column, units: float, ratio: float, shortest: float, longest: float) -> Column:
    """Size of a spindle about a boundary ring of (x, y), along an axis at angle: a struct of cx, cy (the ring's mean), axis_mm and perp_mm (its widths along and across the axis, in units of so many a millimetre), width, covering, length, deficit (what the longest allowed length leaves uncovered), short and long (whether a limit holds). The length is that of the given ratio to the width or what covers the ring with its margins, whichever is greater. A ring of fewer than three points counts as the disk of the diameter about its mean."""
    n = F.size(ring)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.greatest(n, F.lit(1))
    width = lambda ux, uy: F.when(n >= 3, F.array_max(F.transform(ring, lambda p: p["x"] * ux + p["y"] * uy)) - F.array_min(F.transform(ring, lambda p: p["x"] * ux + p["y"] * uy))).otherwise(0.0) / units
    axis, perp = width(F.cos(angle), F.sin(angle)), width(-F.sin(angle), F.cos(angle))
    wide, covering = F.greatest(diameter, perp) + 2 * margin, F.greatest(diameter, axis) + 2 * margin
    target = F.greatest(wide * ratio, covering)
    length = E.clamp(target, shortest, longest)
    return F.struct(mean("x").alias("cx"), mean("y").alias("cy"), axis.alias("axis_mm"), perp.alias("perp_mm"), wide.alias("width"), covering.alias("covering"), length.alias("length"), F.greatest(covering - length, F.lit(0.0)).alias("deficit"), (target < shortest).alias("short"), (target > longest).alias("long"))
