"""Ordered-sequence operators: rows of a key in a total order (t, then an id)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_order(key: str, order: str = "seq") -> W:
    return W.partitionBy(key).orderBy(order)


def tangents(df: DataFrame, key: str, names: list[str], order: str = "seq") -> DataFrame:
    """Central differences, one-sided at the ends, as t_<name>."""
    w = in_order(key, order)
    return df.withColumns({f"t_{n}": F.coalesce(F.lead(n).over(w), F.col(n)) - F.coalesce(F.lag(n).over(w), F.col(n)) for n in names})


def arc_length(df: DataFrame, key: str, names: list[str], order: str = "seq") -> DataFrame:
    """Cumulative length s along each key's points, and s01, its share of the whole (0 where all is one point)."""
    w = in_order(key, order)
    step = F.sqrt(sum((F.col(n) - F.lag(n).over(w)) ** 2 for n in names))
    df = df.withColumn("step", F.coalesce(step, F.lit(0.0)))
    df = df.withColumn("s", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = F.max("s").over(W.partitionBy(key))
    return df.withColumn("s01", F.when(total > 0, F.col("s") / total).otherwise(0.0)).drop("step")


def resampled(df: DataFrame, key: str, names: list[str], n: int, order: str = "seq") -> DataFrame:
    """n points evenly spaced along each key's polyline, by linear interpolation: each target is made by the one segment that holds it, so no join is needed."""
    w = in_order(key, order)
    line = arc_length(df, key, names, order)
    line = line.withColumns({f"n_{c}": F.lead(c).over(w) for c in [*names, "s01"]} | {"first": F.row_number().over(w) == 1, "points": F.count("*").over(W.partitionBy(key))})
    first = F.when(F.col("first"), 0).otherwise(F.floor(F.col("s01") * (n - 1)) + 1)
    last = F.floor(F.col("n_s01") * (n - 1))
    line = line.filter(F.col("n_s01") > F.col("s01")).withColumns({"k0": first, "k1": last}).filter("k0 <= k1")
    line = line.withColumn("k", F.explode(F.sequence("k0", "k1")))
    part = (F.col("k") / (n - 1) - F.col("s01")) / (F.col("n_s01") - F.col("s01"))
    return line.select(key, F.col("k").cast("long").alias("k"), *((F.col(c) + part * (F.col(f"n_{c}") - F.col(c))).alias(c) for c in names))


def runs(df: DataFrame, key: str, visible: Column, least: int = 2, order: str = "seq") -> DataFrame:
    """Unbroken runs of visible rows of at least least rows: first, last and n."""
    seen = df.withColumn("vis", visible).filter("vis")
    seen = seen.withColumn("island", F.col(order) - F.row_number().over(in_order(key, order)))
    out = seen.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).drop("island")


def moving_average(df: DataFrame, key: str, value: str, width: int = 5, order: str = "seq") -> DataFrame:
    """Centred mean over width rows (an even width counts one more), ends repeated beyond the edge."""
    half = width // 2
    w = in_order(key, order)
    inside = w.rowsBetween(-half, half)
    at, size = F.row_number().over(w) - 1, F.count("*").over(W.partitionBy(key))
    whole = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({"at": at, "size": size, "sum": F.sum(value).over(inside), "first": F.first(value).over(whole), "last": F.last(value).over(whole)})
    before, after = F.greatest(half - F.col("at"), F.lit(0)), F.greatest(F.col("at") + half - F.col("size") + 1, F.lit(0))
    mean = (F.col("sum") + before * F.col("first") + after * F.col("last")) / (2 * half + 1)
    return df.withColumn("mean", mean).drop("at", "size", "sum", "first", "last")


def rolling(df: DataFrame, key: str, value: str, rows: int = 8, order: str = "seq") -> DataFrame:
    """Root mean square and greatest of the last rows values."""
    w = in_order(key, order).rowsBetween(1 - rows, 0)
    return df.withColumns({"rms": F.sqrt(F.avg(F.col(value) ** 2).over(w)), "most": F.max(value).over(w)})


def displacement(df: DataFrame, key: str, names: list[str], order: str = "seq") -> DataFrame:
    """Distance to the row before, null for the first."""
    w = in_order(key, order)
    return df.withColumn("moved", F.sqrt(sum((F.col(n) - F.lag(n).over(w)) ** 2 for n in names)))


def latest(df: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """The last n rows of each key."""
    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def scanned(df: DataFrame, key: str, order: list[str], values: list[str], start, step, out: str) -> DataFrame:
    """step(state, values) -> (state, result) along each key's rows in order, from start() on: (key, the last of order, *values, out: double).

    A key's rows come to one task, sorted, and its state is carried from batch to
    batch, so that memory is bounded and time is linear. A null value leaves the
    state as it is and gives null; rows that repeat are steps of their own.
    """
    fields = list(dict.fromkeys([key, order[-1], *values]))
    kinds = dict(df.dtypes)

    def run(batches):
        now, state, begun = None, None, False
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (key, *values)]
            results = []
            for k, *v in zip(*cols, strict=True):
                if not begun or k != now:
                    now, state, begun = k, start(), True
                got = None
                if None not in v:
                    state, got = step(state, v)
                results.append(got)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(results, pa.float64())], [*fields, out])

    rows = df.select(*dict.fromkeys([key, *order, *values])).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in fields) + f", `{out}` double")


def one_euro(df: DataFrame, key: str, value: str, t: str, order: str, min_cutoff: float = 1.5, beta: float = 0.05, dcutoff: float = 1.0) -> DataFrame:
    """The one-euro filter along each key: order, raw, smooth. A step of no or negative time counts as 1 ms."""
    alpha = lambda cutoff, dt: 1 / (1 + 1 / (cutoff * (2 * math.pi)) / dt)

    def step(s, v):
        x, now = float(v[0]), v[1]
        if s is None:
            return (x, 0.0, now), x
        last, slope, before = s
        dt = now - before if now > before else 1e-3
        a = alpha(dcutoff, dt)
        slope = a * (x - last) / dt + (1 - a) * slope
        b = alpha(min_cutoff + beta * abs(slope), dt)
        smooth = b * x + (1 - b) * last
        return (smooth, slope, now), smooth

    out = scanned(df, key, [t, order], [value, t], lambda: None, step, "smooth")
    return out.select(key, order, F.col(value).alias("raw"), "smooth")


def anchored_one_euro(df: DataFrame, key: str, point: str, anchors: list[int], names: list[str], t: str, order: str, whole: tuple[float, float] = (1.25, 0.012), local: tuple[float, float] = (1.5, 0.05)) -> DataFrame:
    """Each point's coordinates, steadied in two parts: (key, order, point, axis, raw, smooth).

    The mean of a frame's anchors says how the whole moves and is filtered by
    itself, a row a frame; what is left of each point is filtered along the point;
    both are added up. A frame is a key's rows of one t and order. Frames without
    anchors count as not moved (mean 0). Null coordinates are left out.
    """
    axes = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), F.col(n).cast("double").alias("raw")) for n in names)))
    rows = df.select(key, point, t, order, axes.alias("a")).select(key, point, t, order, "a.*").filter("raw is not null")
    track = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    mean = rows.groupBy(key, "axis", t, order).agg(F.coalesce(F.avg(F.when(F.col(point).isin(anchors), F.col("raw"))), F.lit(0.0)).alias("mean_")).withColumn("whole_", track(key, "axis"))
    moved = one_euro(mean, "whole_", "mean_", t, order, *whole).select("whole_", order, F.col("smooth").alias("steady_"))
    rest = rows.withColumn("whole_", track(key, "axis")).join(mean.select("whole_", t, order, "mean_"), ["whole_", t, order])
    rest = rest.withColumns({"track_": track(key, point, "axis"), "left_": F.col("raw") - F.col("mean_")})
    own = one_euro(rest, "track_", "left_", t, order, *local).select("track_", order, F.col("smooth").alias("own_"))
    out = rest.join(own, ["track_", order]).join(moved, ["whole_", order])
    return out.select(key, order, point, "axis", "raw", (F.col("steady_") + F.col("own_")).alias("smooth"))


def presence(df: DataFrame, key: str, hit: str, order: list[str], up: float, down: float) -> DataFrame:
    """Presence that rises by up on a hit and falls by down on a miss, within 0 and 1."""

    def step(s, v):
        s = min(1.0, s + up) if v[0] else max(0.0, s - down)
        return s, s

    return scanned(df, key, order, [hit], lambda: 0.0, step, "presence").select(key, order[-1], "presence")


def ema(df: DataFrame, key: str, value: str, order: list[str], keep: float = 0.9, seed: float = 30.0) -> DataFrame:
    """keep * previous + (1 - keep) * value from seed, the state after each row."""

    def step(s, v):
        s = s * keep + v[0] * (1 - keep)
        return s, s

    return scanned(df, key, order, [value], lambda: seed, step, "ema").select(key, order[-1], "ema")


def order_gate(df: DataFrame, key: str, action: str, at: str, required: list[str]) -> DataFrame:
    """Whether each key's first occurrences of the required actions are all there, in that order; missing lists the others."""
    firsts = df.filter(F.col(action).isin(required)).groupBy(key, action).agg(F.min(at).alias("at"))
    seen = firsts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(action, "at"))).alias("m"))
    seen = df.select(key).distinct().join(seen, key, "left")
    places = [F.element_at("m", F.lit(a)) for a in required]
    ordered = F.lit(True)
    for a, b in zip(places, places[1:], strict=False):
        ordered = ordered & (a <= b)
    missing = F.array_compact(F.array(*(F.when(p.isNull(), F.lit(a)) for p, a in zip(places, required, strict=True))))
    return seen.select(key, (F.size(missing) == 0).alias("complete"), F.coalesce(ordered, F.lit(False)).alias("ordered"), F.array_join(missing, ",").alias("missing"))


def catmull_rom(df: DataFrame, key: str, names: list[str], per_segment: int, order: str = "seq") -> DataFrame:
    """per_segment points of the centripetal Catmull-Rom curve through each key's points for each segment, and the last point."""
    w = in_order(key, order)
    here = lambda c: (F.lag(c).over(w), F.col(c), F.lead(c).over(w), F.lead(c, 2).over(w))
    around = {}
    for c in names:
        before, this, after, later = here(c)
        around |= {f"p0_{c}": F.coalesce(before, this), f"p1_{c}": this, f"p2_{c}": F.coalesce(after, this), f"p3_{c}": F.coalesce(later, after, this)}
    rows = df.withColumns(around | {"more": F.lead(order).over(w).isNotNull()})
    gap = lambda i, j: F.greatest(F.sqrt(F.sqrt(sum((F.col(f"p{j}_{c}") - F.col(f"p{i}_{c}")) ** 2 for c in names))), F.lit(1e-4))
    rows = rows.withColumn("t1", gap(0, 1)).withColumn("t2", F.col("t1") + gap(1, 2)).withColumn("t3", F.col("t2") + gap(2, 3))
    rows = rows.withColumn("j", F.explode(F.when(F.col("more"), F.sequence(F.lit(0), F.lit(per_segment - 1))).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("tt", F.col("t1") + (F.col("t2") - F.col("t1")) * F.col("j") / per_segment)

    def curve(c: str) -> Column:
        p = [F.col(f"p{i}_{c}") for i in range(4)]
        t = [F.lit(0.0), F.col("t1"), F.col("t2"), F.col("t3")]
        mid = lambda a, b, x, y: a * (y - F.col("tt")) / (y - x) + b * (F.col("tt") - x) / (y - x)
        a1, a2, a3 = (mid(p[i], p[i + 1], t[i], t[i + 1]) for i in range(3))
        return mid(mid(a1, a2, t[0], t[2]), mid(a2, a3, t[1], t[3]), t[1], t[2])

    return rows.select(key, order, F.col("j").cast("long").alias("j"), *(F.when(F.col("more"), curve(c)).otherwise(F.col(c)).alias(c) for c in names))


def axial(x: Column, y: Column) -> tuple[Column, Column]:
    """A direction as an undirected axis: turned around where it points left, or straight down."""
    sign = F.when((x < 0) | ((F.abs(x) < 1e-6) & (y < 0)), -1.0).otherwise(1.0)
    return x * sign, y * sign


def outward_tangents(df: DataFrame, key: str, ahead: int = 5, order: str = "seq") -> DataFrame:
    """(key, side, tx, ty): unit directions out of the first and last of each key's points (x, y), from the point ahead places further in, or the farthest there is; (1, 0) where both are one."""
    w = in_order(key, order)
    rows = df.withColumns({"at": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(key))})
    k = F.least(F.lit(ahead), F.col("n") - 1)
    point = F.struct("x", "y")
    at = lambda place: F.max(F.when(F.col("at") == place, point))
    ends = rows.groupBy(key).agg(at(0).alias("a"), at(k).alias("a_in"), at(F.col("n") - 1).alias("b"), at(F.col("n") - 1 - k).alias("b_in"))
    sides = F.array(*(F.struct(F.lit(name).alias("side"), (F.col(f"{e}.x") - F.col(f"{e}_in.x")).alias("x"), (F.col(f"{e}.y") - F.col(f"{e}_in.y")).alias("y")) for name, e in (("first", "a"), ("last", "b"))))
    out = ends.select(key, F.explode(sides).alias("s")).select(key, "s.*").withColumn("m", F.hypot("x", "y"))
    return out.select(key, "side", F.when(F.col("m") < 1e-9, 1.0).otherwise(F.col("x") / F.col("m")).alias("tx"), F.when(F.col("m") < 1e-9, 0.0).otherwise(F.col("y") / F.col("m")).alias("ty"))


def ticks(df: DataFrame, key: str, every: int, length: float, order: str = "seq") -> DataFrame:
    """Ends (ax, ay, bx, by) of the tick across every every-th segment of each key's points (x, y), length to both sides of its first point; order counts from 0. Segments without length have none."""
    w = in_order(key, order)
    rows = df.withColumns({"dx": F.lead("x").over(w) - F.col("x"), "dy": F.lead("y").over(w) - F.col("y")}).filter((F.col(order) % every == 0) & F.col("dx").isNotNull())
    rows = rows.withColumn("m", F.hypot("dx", "dy")).filter("m >= 1e-6")
    px, py = -F.col("dy") / F.col("m") * length, F.col("dx") / F.col("m") * length
    return rows.select(key, order, (F.col("x") - px).alias("ax"), (F.col("y") - py).alias("ay"), (F.col("x") + px).alias("bx"), (F.col("y") + py).alias("by"))
