"""Column builders that several operators share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def numeric(c: Column) -> Column:
    """A finite double, else null (also for text that isn't a number)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def axis_difference(a: Column, b: Column) -> Column:
    """Degrees between undirected axes, 0 to 90."""
    return F.abs(F.pmod(a - b + 90, F.lit(180.0)) - 90)


def add(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def sub(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def scale(a: Sequence[Column], s: Column) -> list[Column]:
    return [x * s for x in a]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    d = sub(a, b)
    return F.sqrt(dot(d, d))


def xyz(array: Column, at: int = 0, n: int = 3) -> list[Column]:
    """n elements of an array as doubles."""
    return [F.get(array, F.lit(at + i)).cast("double") for i in range(n)]


def barycentric_point(u: Column, v: Column, a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> list[Column]:
    return [u * x + v * y + (1 - u - v) * z for x, y, z in zip(a, b, c, strict=True)]


def barycentric_coordinates(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Weights of a, b and c at p (projected to their plane); a vanishing triangle counts as of area 1e-12."""
    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(ab, ab), dot(ab, ac), dot(ac, ac), dot(ap, ab), dot(ap, ac)
    area = d00 * d11 - d01 * d01
    area = F.when(F.abs(area) < 1e-12, F.lit(1e-12)).otherwise(area)
    v, w = (d11 * d20 - d01 * d21) / area, (d00 * d21 - d01 * d20) / area
    return 1 - v - w, v, w


def closest_on_segment(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance from p to the segment a b."""
    ab = sub(b, a)
    size = dot(ab, ab)
    t = F.when(size <= 1e-12, F.lit(0.0)).otherwise(clamp(dot(sub(p, a), ab) / F.greatest(size, F.lit(1e-12)), 0.0, 1.0))
    return distance(p, add(a, scale(ab, t)))


def distance_to_triangle(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Distance from p to the triangle a b c: to its plane where p projects inside, else to the nearest edge."""
    u, v, w = barycentric_coordinates(p, a, b, c)
    foot = [u * x + v * y + w * z for x, y, z in zip(a, b, c, strict=True)]
    edge = F.least(closest_on_segment(p, a, b), closest_on_segment(p, b, c), closest_on_segment(p, c, a))
    return F.when((u >= 0) & (v >= 0) & (w >= 0), distance(p, foot)).otherwise(edge)


def weights_on_triangle(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Weights (u, v, w) of a, b and c at the point of their triangle nearest p: at its foot where that lies inside, else on the nearest edge, the earlier of two as near."""
    u, v, w = barycentric_coordinates(p, a, b, c)
    zero = F.lit(0.0)

    def edge(s: Sequence[Column], e: Sequence[Column], weights) -> Column:
        along = sub(e, s)
        size = dot(along, along)
        t = F.when(size <= 1e-12, zero).otherwise(clamp(dot(sub(p, s), along) / F.greatest(size, F.lit(1e-12)), 0.0, 1.0))
        return F.struct(distance(p, add(s, scale(along, t))).alias("d"), *(x.alias(n) for x, n in zip(weights(t), "uvw", strict=True)))

    edges = (edge(a, b, lambda t: (1 - t, t, zero)), edge(b, c, lambda t: (zero, 1 - t, t)), edge(c, a, lambda t: (t, zero, 1 - t)))
    near = F.reduce(F.array(*edges[1:]), edges[0], lambda best, e: F.when(e["d"] < best["d"], e).otherwise(best))
    inside = (u >= 0) & (v >= 0) & (w >= 0)
    return F.when(inside, F.struct(u.alias("u"), v.alias("v"), w.alias("w"))).otherwise(F.struct(*(near[n].alias(n) for n in "uvw")))


def one_euro_alpha(cutoff: Column, dt: Column) -> Column:
    return 1 / (1 + 1 / (cutoff * (2 * math.pi)) / dt)


def fingerprint31(text: Column) -> Column:
    """The 32-bit hash h * 31 + c over UTF-16 units of ASCII text, unsigned, to base 36."""
    units = F.transform(F.filter(F.split(text, ""), lambda s: s != ""), lambda s: F.ascii(s).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(h.cast("string"), 10, 36))
