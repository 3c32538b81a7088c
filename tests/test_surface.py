"""Points met with meshes, hulls and controls of whole groups, against brute force."""

import numpy as np
import pytest

from isoline.functions import exprs as E
from isoline.operators import frames as K
from isoline.operators import surface as U
from pyspark.sql import functions as F

CORNERS = ", ".join(f"{n}{j} double" for j in range(3) for n in "xyz")


def mesh(rng, n, wide):
    """n triangles of about a width around places all over a cube."""
    return [(i, *map(float, (rng.uniform(-1, 1, 3) + wide * rng.normal(size=(3, 3))).ravel())) for i in range(n)]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    tris = mesh(rng, 300, 0.03) + [(300 + i, *t[1:]) for i, t in enumerate(mesh(rng, 3, 1.0))]
    rows = [("a", *t) for t in tris] + [("b", 0, *[0.0] * 9), ("b", 1, *[0.0] * 9)]
    pts = [("a", i, *map(float, rng.uniform(-1.2, 1.2, 3))) for i in range(150)] + [("a", 900, 40.0, -30.0, 2.0), ("a", 901, None, 0.0, 0.0), ("b", 0, 1.0, 2.0, 2.0), ("c", 0, 0.0, 0.0, 0.0)]
    triangles = spark.createDataFrame(rows, f"g string, tri long, {CORNERS}")
    return spark.createDataFrame(pts, "g string, id long, x double, y double, z double"), triangles


def test_closest_of_all_triangles(cloud):
    points, triangles = cloud
    d = E.distance_to_triangle([F.col(n) for n in "xyz"], *([F.col(f"{n}{j}") for n in "xyz"] for j in range(3)))
    all_pairs = points.filter("x is not null").join(triangles, "g").groupBy("g", "id").agg(F.min(F.struct(F.round(d, 9).alias("d"), "tri")).alias("b"))
    want = {(r.g, r.id): (r.b.tri, r.b.d) for r in all_pairs.collect()}
    got = {(r.g, r.id): (r.tri, r.distance) for r in U.closest(points, triangles, ["g"]).collect()}
    assert got == want and len(want) == 152


def test_located_in_all_triangles(cloud):
    points, triangles = cloud
    triangles = triangles.filter("g = 'a'")
    u, v, w = E.barycentric_coordinates([F.col(n) for n in "xy"], *([F.col(f"{n}{j}") for n in "xy"] for j in range(3)))
    inside = (u >= 0) & (v >= 0) & (w >= 0)
    depth = F.when(inside, -F.round((F.col("z0") + F.col("z1") + F.col("z2")) / 3, 9)).otherwise(-F.round(F.least(u, v, w), 9))
    best = F.min(F.struct((~inside).cast("int").alias("o"), depth.alias("d"), "tri")).alias("b")
    want = {r.id: (r.b.tri, r.b.o == 0) for r in points.filter("x is not null").join(triangles, "g").groupBy("g", "id").agg(best).collect()}
    got = {r.id: (r.tri, r.inside) for r in U.located(points, triangles, ["g"]).collect()}
    assert got == want and {True, False} == {x[1] for x in want.values()}


def test_each_pair_is_met_once(cloud):
    points, triangles = cloud
    pairs = U.met(points, triangles, ["g"], ("x", "y", "z"), F.lit(0.1))
    assert pairs.groupBy("g", "id", "tri").count().filter("count > 1").isEmpty()
    close = F.lit(True)
    for n in "xyz":
        corners = [F.col(f"{n}{j}") for j in range(3)]
        close = close & (F.col(n) + 0.1 >= F.least(*corners)) & (F.col(n) - 0.1 <= F.greatest(*corners))
    missing = points.join(triangles, "g").filter(close).join(pairs, ["g", "id", "tri"], "left_anti")
    assert missing.isEmpty()
    # Far from all pairs, though three triangles span the whole mesh.
    assert pairs.filter("g = 'a'").count() < 0.1 * 151 * 303
    assert U.met(points, triangles.limit(0), ["g"], ("x", "y"), F.lit(0.1)).isEmpty()


def test_hull_of_a_whole_group(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([("g", *map(float, p)) for p in xy] + [("h", 1.0, 1.0), ("h", 1.0, 1.0), ("n", None, None)], "g string, x double, y double").repartition(5)
    rings = {r.g: [(p.x, p.y) for p in r.hull] for r in K.hull(df, "g", most=8).collect()}
    ring = np.array(rings["g"])
    for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):  # all points lie left of each side
        assert ((b[0] - a[0]) * (xy[:, 1] - a[1]) - (b[1] - a[1]) * (xy[:, 0] - a[0]) >= -1e-12).all()
    assert {tuple(p) for p in ring} <= {tuple(p) for p in xy} and len(set(map(tuple, ring))) == len(ring)
    assert rings["h"] == [(1.0, 1.0)] and "n" not in rings
    assert K.hull(df.limit(0), "g").isEmpty()


def test_expanded_hulls_and_capsules(spark):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    r = spark.range(1).select(K.expanded(square, 2**0.5).alias("out"), K.expanded(square, -9.0).alias("none")).first()
    assert np.allclose([(p.x, p.y) for p in r.out], [(-1, -1), (3, -1), (3, 3), (-1, 3)])
    assert np.allclose([(p.x, p.y) for p in r.none], 1.0)
    at = lambda x, y: K.in_capsule(F.lit(x), F.lit(y), [F.lit(0.0), F.lit(0.0)], [F.lit(4.0), F.lit(0.0)], 1.0)
    assert list(spark.range(1).select(at(2.0, 0.9), at(-0.8, 0.8), at(4.5, 0.5)).first()) == [True, False, True]


def test_controls_stand_for_all_points(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), *((F.rand(i) * 2).alias(n) for i, n in enumerate(("x", "y", "z", "qx", "qy", "qz"))))
    n = K.gridded_controls(df, "g").groupBy("g").count().collect()
    assert len(n) == 2 and all(50 < r["count"] <= 64 for r in n)
    same = K.gridded_controls(df.filter("id < 2").crossJoin(df.select(F.lit(1).alias("k")).limit(9)).drop("k"), "g")
    assert same.count() == 2  # repeated points are one control


def test_blocks_meet_a_wide_mesh_in_parts(spark, monkeypatch):
    """Triangles as large as their mesh, in small blocks and several parts a block: the same answers as all pairs."""
    from isoline.operators import blocks as B

    rng = np.random.default_rng(11)
    monkeypatch.setattr(B, "MOST", 150)
    p = rng.normal(size=(900, 3)).round(2)
    pts = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(p)] + [("a", 950, 9.0, 9.0, 9.0), ("a", 951, float("nan"), 0.0, 0.0), ("a", 952, float("inf"), 0.0, 0.0)], "g string, id long, x double, y double, z double")
    tris = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(p.reshape(300, 9))] + [("a", 300 + i, *map(float, v)) for i, v in enumerate(p.reshape(300, 9))], f"g string, tri long, {CORNERS}")
    sound = pts.filter("id < 951")
    real, small = B.blocked, lambda df, by, at, low, high, size=64: real(df, by, at, low, high, 64)
    monkeypatch.setattr(B, "blocked", small)
    d = E.distance_to_triangle([F.col(n) for n in "xyz"], *([F.col(f"{n}{j}") for n in "xyz"] for j in range(3)))
    want = {r.id: (r.b.tri, r.b.d) for r in sound.join(tris, "g").groupBy("id").agg(F.min(F.struct(F.round(d, 9).alias("d"), "tri")).alias("b")).collect()}
    assert {r.id: (r.tri, r.distance) for r in B.closest(pts, tris, ["g"]).collect()} == want
    u, v, w = E.barycentric_coordinates([F.col(n) for n in "xy"], *([F.col(f"{n}{j}") for n in "xy"] for j in range(3)))
    inside = (u >= 0) & (v >= 0) & (w >= 0)
    depth = F.when(inside, -F.round((F.col("z0") + F.col("z1") + F.col("z2")) / 3, 9)).otherwise(-F.round(F.least(u, v, w), 9))
    best = F.min(F.struct((~inside).cast("int").alias("o"), depth.alias("d"), "tri")).alias("b")
    want = {r.id: (r.b.tri, r.b.o == 0) for r in sound.join(tris, "g").groupBy("id").agg(best).collect()}
    assert {r.id: (r.tri, r.inside) for r in B.located(pts, tris, ["g"]).collect()} == want and len(want) == 901
    others = sound.select("g", F.col("id").alias("other_id"), *(F.col(n).alias(f"o{n}") for n in "xyz"))
    gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    got = {r.id: [(o.other_id, o.d) for o in r.near] for r in B.nearest(pts, others, ["g"], 5).collect()}
    assert set(got) == {*range(900), 950}
    for i in range(900):
        d = sorted((gap[i, j], j) for j in range(900) if j != i)[:5]
        assert [j for j, _ in got[i]] == [j for _, j in d] and np.allclose([x for _, x in got[i]], [x for x, _ in d], atol=1e-12)


def test_blocks_are_bounded_and_whole(spark):
    from isoline.operators import blocks as B

    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id", F.lit(1.0).alias("x"))
    rows, boxes = B.blocked(df, ["g"], *[[F.col("x"), F.col("x")]] * 3, 64)
    sizes = [r.n for r in boxes.collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 64 and rows.select("id").distinct().count() == 1000
