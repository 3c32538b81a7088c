"""Frame gates, rasters, cameras, springs, hulls and fitted maps."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators.geometry import checkpointed
from isoline.operators.sequence import arc_length

# Fixed values of the gates.
LEAST_PRESENCE, MOST_YAW, MOST_MOTION, MOST_JAW, MOST_BLINK = 0.45, 0.42, 0.045, 0.5, 0.7
DIM_MOTION, FREEZE_MOTION, DIM_OPACITY = 0.025, 0.045, 0.36


def pose_gate(df: DataFrame, key: str, order: str) -> DataFrame:
    """Frames (key, order, ax.., ay.. of anchors as arrays, nose, left, right, diagonal, presence, jaw, blink) with yaw, motion since the frame before, and the ordered reasons of what is off."""
    w = W.partitionBy(key).orderBy(order)
    before = F.lag("anchors").over(w)
    square = F.aggregate(F.zip_with("anchors", before, lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2), F.lit(0.0), lambda s, v: s + v)
    motion = F.when(before.isNotNull() & (F.col("diagonal") > 0), F.sqrt(square / F.size("anchors")) / F.col("diagonal"))
    wide = F.abs(F.col("right") - F.col("left"))
    yaw = F.when(wide > 0, (F.col("nose") - (F.col("left") + F.col("right")) / 2) / wide)
    df = df.withColumns({"motion": motion, "yaw": yaw})
    reasons = F.concat_ws(
        ",", F.when(F.col("yaw").isNull(), "invalid_pose_yaw").when(F.abs("yaw") > MOST_YAW, "side_pose_yaw_too_large"), F.when(F.coalesce("presence", F.lit(0.0)) < LEAST_PRESENCE, "low_face_presence"),
        F.when(F.col("motion") > MOST_MOTION, "rapid_frame_motion"), F.when(F.col("jaw") > MOST_JAW, "jaw_open_expression"), F.when(F.col("blink") > MOST_BLINK, "eye_blink_expression"),
    )
    return df.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def region_action(motion: Column) -> Column:
    """normal, dim or freeze by a region's motion."""
    return F.when(motion > FREEZE_MOTION, "freeze").when(motion > DIM_MOTION, "dim").otherwise("normal")


def most_severe(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each point (id, nx, ny) the most severe action and least opacity of the boxes (x0..y1, severity, opacity) that hold it: a range join with a small dimension."""
    inside = F.col("nx").between(F.col("x0"), F.col("x1")) & F.col("ny").between(F.col("y0"), F.col("y1"))
    return points.join(boxes, inside).groupBy("id").agg(F.max("severity").alias("severity"), F.min("opacity").alias("opacity"), F.count("*").alias("n"))


def bilinear(raster: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """A row-major raster's value between its pixels, clamped to its edges; no row needs another."""
    x, y = F.least(F.greatest(x, F.lit(0.0)), F.lit(width - 1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(height - 1.0))
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    at = lambda i, j: F.get(raster, j * width + i).cast("double")
    u, v = x - x0, y - y0
    return (at(x0, y0) * (1 - u) + at(x1, y0) * u) * (1 - v) + (at(x0, y1) * (1 - u) + at(x1, y1) * u) * v


def best_offset(raster: Column, width: int, height: int, x: Column, y: Column, nx: Column, ny: Column, reach: int) -> Column:
    """The whole offset along a normal, -reach to reach, where the raster is greatest (the first of equals)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    tried = F.transform(steps, lambda s: F.struct(F.round(bilinear(raster, width, height, x + nx * s, y + ny * s), 9).alias("v"), (-s).alias("s")))
    return -F.array_max(tried)["s"]


def projected(p: list[Column], k: list[list[float]], rt: list[list[float]]) -> list[Column]:
    """Pixels of a world point through rotation and translation rt and intrinsics k, and its depth."""
    c = [sum((p[j] * r[j] for j in range(1, 3)), p[0] * r[0]) + r[3] for r in rt]
    return [(c[0] * k[0][0] + c[1] * k[0][1] + c[2] * k[0][2]) / c[2], (c[1] * k[1][1] + c[2] * k[1][2]) / c[2], c[2]]


def spring_step(vertices: DataFrame, springs: DataFrame, by: list[str], dt: float, damping: float) -> DataFrame:
    """One step of a mass-spring body: vertices (v, x..z, vx..vz, anchored), springs (a, b, rest, k). Forces are summed by vertex before they meet it."""
    ends = springs
    for s in ("a", "b"):
        ends = ends.join(vertices.select(*by, F.col("v").alias(s), *(F.col(n).alias(f"{s}_{n}") for n in "xyz")), [*by, s])
    d = [F.col(f"b_{n}") - F.col(f"a_{n}") for n in "xyz"]
    length = F.greatest(F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2), F.lit(1e-9))
    pull = F.col("k") * (length - F.col("rest")) / length
    sides = F.array(*(F.struct(F.col(e).alias("v"), *((c * pull * sign).alias(f"f{n}") for c, n in zip(d, "xyz", strict=True))) for e, sign in (("a", 1.0), ("b", -1.0))))
    force = ends.select(*by, F.explode(sides).alias("e")).select(*by, "e.*").groupBy(*by, "v").agg(*(F.sum(f"f{n}").alias(f"f{n}") for n in "xyz"))
    out = vertices.join(force, [*by, "v"], "left")
    speed = {n: F.when(F.col("anchored"), 0.0).otherwise((F.col(f"v{n}") + F.coalesce(f"f{n}", F.lit(0.0)) * dt) * damping) for n in "xyz"}
    return out.select(*by, "v", *((F.col(n) + speed[n] * dt).alias(n) for n in "xyz"), *(speed[n].alias(f"v{n}") for n in "xyz"), "anchored")


def hull(df: DataFrame, by: str, most: int = 1 << 16) -> DataFrame:
    """The convex hull of each group's points (x, y), counter-clockwise: (by, hull: array of (x, y)). Tasks send on only the hulls of what they hold, so that one group's task meets few points; a task holds at most about most of them. A group without a point has no hull."""

    def ring(xy: np.ndarray) -> np.ndarray:
        """Corners of the hull, by splitting each side at the point farthest outside of it."""
        xy = np.unique(xy[np.isfinite(xy).all(axis=1)], axis=0)
        if len(xy) < 3:
            return xy
        out, todo = [], [(xy[0], xy[-1], xy), (xy[-1], xy[0], xy)]
        while todo:
            a, b, p = todo.pop(0)
            out_by = (p[:, 0] - a[0]) * (b[1] - a[1]) - (p[:, 1] - a[1]) * (b[0] - a[0])
            p, out_by = p[out_by > 0], out_by[out_by > 0]
            if len(p):
                far = p[out_by.argmax()]
                todo[:0] = [(a, far, p), (far, b, p)]
            else:
                out.append(a)
        return np.array(out)

    def partial(batches):
        held: dict[object, np.ndarray] = {}
        for g in batches:
            for k, rows in g.groupby(by, dropna=False):
                xy = rows[["x", "y"]].to_numpy(dtype=float)
                held[k] = ring(np.vstack([held[k], xy]) if k in held else xy)
            if sum(map(len, held.values())) > most:
                yield sent(held)
                held = {}
        yield sent(held)

    def sent(held):
        xy = np.vstack([np.empty((0, 2)), *held.values()])
        return pd.DataFrame({by: pd.Series([k for k, v in held.items() for _ in v], dtype=object), "x": xy[:, 0], "y": xy[:, 1]})

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: g[by].iloc[:1].astype(object).tolist(), "hull": [[{"x": x, "y": y} for x, y in ring(g[["x", "y"]].to_numpy(dtype=float))]]})

    kind = dict(df.dtypes)[by]
    few = df.filter(F.col(by).isNotNull()).select(by, "x", "y").mapInPandas(partial, f"{by} {kind}, x double, y double")
    return few.groupBy(by).applyInPandas(whole, f"{by} {kind}, hull array<struct<x:double,y:double>>")


def expanded(ring: Column, margin: float) -> Column:
    """A ring with each corner moved by margin away from the corners' mean, or towards it, but not beyond, where margin is negative."""
    mean = lambda n: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[n]) / F.size(ring)
    centre = F.struct(mean("x").alias("x"), mean("y").alias("y"))

    def moved(p: Column) -> Column:
        dx, dy = p["x"] - centre["x"], p["y"] - centre["y"]
        d = F.hypot(dx, dy)
        return F.struct(*((p[n] + F.when(d > 0, F.greatest(F.lit(margin), -d) * c / d).otherwise(0.0)).alias(n) for n, c in (("x", dx), ("y", dy))))

    return F.when(F.size(ring) > 2, F.transform(ring, moved)).otherwise(ring)


def in_capsule(x: Column, y: Column, a: list[Column], b: list[Column], radius: Column | float) -> Column:
    """Whether a point is within radius of the segment from a to b."""
    return E.closest_on_segment([x, y], a, b) <= radius


def inside_hull(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a counter-clockwise convex ring (its edge included)."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    sides = F.zip_with(ring, turned, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= 0)
    return (F.size(ring) > 2) & F.forall(sides, lambda s: s)


def spline_fitted(controls: DataFrame, points: DataFrame, by: str, smoothing: float = 1e-6) -> DataFrame:
    """Points (by, id, x..z) moved by the polyharmonic spline (kernel r, affine part) that takes each group's few controls (x..z) to their targets (qx..qz). Controls are solved by group; points only meet the coefficients."""

    def solved(g: pd.DataFrame) -> pd.DataFrame:
        src, dst = g[["x", "y", "z"]].to_numpy(), g[["qx", "qy", "qz"]].to_numpy()
        n = len(src)
        if n < 5:
            return pd.DataFrame({by: [], "c": [], "w": [], "affine": []})
        kern = np.linalg.norm(src[:, None] - src[None], axis=2) + smoothing * np.eye(n)
        one = np.hstack([np.ones((n, 1)), src])
        full = np.block([[kern, one], [one.T, np.zeros((4, 4))]])
        sol = np.linalg.lstsq(full, np.vstack([dst, np.zeros((4, 3))]), rcond=None)[0]
        return pd.DataFrame({by: g[by].iloc[:1], "c": [src.tolist()], "w": [sol[:n].tolist()], "affine": [sol[n:].tolist()]})

    kind = dict(controls.dtypes)[by]
    coef = controls.groupBy(by).applyInPandas(solved, f"{by} {kind}, c array<array<double>>, w array<array<double>>, affine array<array<double>>")
    p = [F.col(n) for n in "xyz"]
    r = lambda c: F.sqrt(sum((p[i] - c[i]) ** 2 for i in range(3)))

    def moved(k: int) -> Column:
        a = [F.col("affine")[i][k] for i in range(4)]
        kernel = F.aggregate(F.zip_with("c", "w", lambda c, w: r(c) * w[k]), F.lit(0.0), lambda s, v: s + v)
        return a[0] + a[1] * p[0] + a[2] * p[1] + a[3] * p[2] + kernel

    out = points.join(coef, by).select(by, "id", *(moved(k).alias(f"moved_{n}") for k, n in enumerate("xyz")))
    return out.select(by, "id", *(F.col(f"moved_{n}").alias(n) for n in "xyz"))


def gridded_controls(df: DataFrame, by: str, cells: int = 4) -> DataFrame:
    """Controls of spline_fitted() that stand for all points (by, x..z, qx..qz) of a group: their means in cells cells a side of its box, cells ** 3 at most, whatever the group's size."""
    box = df.groupBy(by).agg(*(f(n).alias(f"{p}_{n}") for n in "xyz" for p, f in (("lo", F.min), ("hi", F.max))))
    at = lambda n: F.least(F.floor(cells * (F.col(n) - F.col(f"lo_{n}")) / F.greatest(F.col(f"hi_{n}") - F.col(f"lo_{n}"), F.lit(1e-12))), F.lit(cells - 1))
    placed = df.join(box, by).withColumns({f"c_{n}": at(n) for n in "xyz"})
    return placed.groupBy(by, "c_x", "c_y", "c_z").agg(*(F.avg(n).alias(n) for n in ("x", "y", "z", "qx", "qy", "qz"))).drop("c_x", "c_y", "c_z")


def centreline(df: DataFrame, by: str, step: float) -> DataFrame:
    """Medians of x and y in each step-wide bin along x."""
    return df.groupBy(by, F.floor(F.col("x") / step).alias("bin")).agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count("*").alias("n"))


def least_labels(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(v, label): the least vertex that each vertex of edges (a, b) reaches; a null stays by itself. Where a bound of rounds is given and isn't enough, an error says so.

    Vertices stand in a random order, by their hashes, of which no two are equal.
    Each round hooks a vertex to its first neighbour if that comes earlier, goes up
    to three hooks to one that hooks to none, and replaces the ends of the edges by
    those. So a round leaves a fraction of the edges, of long paths as well, and all
    rounds together shuffle about as much as the first few. Lineage is cut each round.
    Edges are read once, and repeated ones leave before anything else is made of them.
    """
    a, b = (F.col(c).cast("long") for c in "ab")
    h = F.xxhash64  # one to one on single numbers
    later = h(a) > h(b)
    pairs = checkpointed(edges.select(F.when(later, a).otherwise(b).alias("a"), F.when(later, b).otherwise(a).alias("b")).distinct())
    vertices = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    links = pairs.filter("a <> b").select(h("a").alias("a"), h("b").alias("b"))
    hooked = []
    while not links.isEmpty():
        if len(hooked) == rounds:
            raise RuntimeError(f"least_labels: labels still change after {rounds} rounds")
        # Only the first vertices of a neighbourhood have no row here.
        up = links.groupBy("a").agg(F.min("b").alias("t"))
        next_ = up.select(F.col("a").alias("t"), F.col("t").alias("t2"))
        twice = up.join(next_, "t", "left").select("a", F.coalesce("t2", "t").alias("t"), F.col("t2").isNull().alias("ends"))
        then = twice.select(F.col("a").alias("t"), F.col("t").alias("t2"), F.col("ends").alias("ends2"))
        tops = twice.join(then, "t", "left").select("a", F.when(F.col("ends"), F.col("t")).otherwise(F.coalesce("t2", "t")).alias("t"), (F.col("ends") | F.coalesce("ends2", F.lit(True))).alias("ends"))
        tops = checkpointed(tops.filter("ends").select("a", "t"))
        hooked.append(tops)
        of = lambda end, tops=tops: tops.select(F.col("a").alias(end), F.col("t").alias(f"{end}_"))
        moved = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        links = checkpointed(_later_first(moved.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")).filter("a <> b")))
    # Vertices hook to such as hook in later rounds, if at all.
    top = None
    for tops in reversed(hooked):
        ends = top.select(F.col("a").alias("t"), F.col("t").alias("t2")) if top is not None else None
        top = checkpointed(tops.join(ends, "t", "left").select("a", F.coalesce("t2", "t").alias("t")).unionAll(top)) if top is not None else tops
    if top is None:
        return vertices.select("v", F.col("v").alias("label"))
    own = vertices.withColumn("a", F.when(F.col("v").isNotNull(), h("v")))
    own = checkpointed(own.join(top, "a", "left").select("v", F.coalesce("t", "a").alias("t")))
    return own.join(own.groupBy("t").agg(F.min("v").alias("label")), "t", "left").select("v", "label")


def _later_first(links: DataFrame) -> DataFrame:
    """Links (a, b) once each, with the greater end as a."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def respaced(df: DataFrame, key: str, spacing: float) -> DataFrame:
    """Points of each key's polyline (seq, x, y) at arc lengths 0, spacing, 2 * spacing and so on, as (key, k, x, y), and its end where that is over a quarter of spacing from the last of them. Lines of one or two points stay as they are. Each segment makes the points that lie on it."""
    w = W.partitionBy(key).orderBy("seq")
    line = arc_length(df.select(key, "seq", "x", "y"), key, ["x", "y"])
    line = line.withColumns({"ahead": F.lead("s").over(w), "x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "at": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(key))})
    first = F.when(F.col("at") == 0, 0).otherwise(F.floor(F.col("s") / spacing) + 1)
    last = F.floor(F.col("ahead") / spacing)
    on = line.filter((F.col("n") > 2) & (first <= last)).withColumn("k", F.explode(F.sequence(first, last)))
    part = F.when(F.col("ahead") > F.col("s"), (F.col("k") * spacing - F.col("s")) / (F.col("ahead") - F.col("s"))).otherwise(0.0)
    on = on.select(key, F.col("k").cast("long").alias("k"), *((F.col(c) + part * (F.col(f"{c}1") - F.col(c))).alias(c) for c in "xy"))
    ends = line.groupBy(key).agg(F.max("n").alias("n"), F.max_by(F.struct("x", "y"), "seq").alias("end")).filter("n > 2")
    placed = ends.join(on.groupBy(key).agg(F.max("k").alias("k"), F.max_by(F.struct("x", "y"), "k").alias("last")), key)
    beyond = F.hypot(F.col("end.x") - F.col("last.x"), F.col("end.y") - F.col("last.y")) > spacing * 0.25
    few = line.filter("n <= 2").select(key, F.col("at").cast("long").alias("k"), "x", "y")
    return on.unionByName(placed.filter(beyond).select(key, (F.col("k") + 1).alias("k"), "end.x", "end.y")).unionByName(few)
