"""Rays, lines, directions, cuts and files of meshes against brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.operators import meshing as T
from isoline.sources import meshes as M

CORNERS = ", ".join(f"{n}{j} double" for j in range(3) for n in "xyz")


def triangles(rng, n, wide):
    return (rng.uniform(-1, 1, (n, 1, 3)) + wide * rng.normal(size=(n, 3, 3))).round(6)


def frame(spark, tris, key="a"):
    return spark.createDataFrame([(key, i, *map(float, t.ravel())) for i, t in enumerate(tris)], f"g string, tri long, {CORNERS}")


def hit(o, d, t):
    """Parameters along the ray for all triangles, infinite where missed."""
    e1, e2, s = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0], o - t[:, 0]
    p, q = np.cross(d, e2), np.cross(s, e1)
    with np.errstate(divide="ignore", invalid="ignore"):
        det = (e1 * p).sum(1)
        k, u, v = (e2 * q).sum(1) / det, (s * p).sum(1) / det, q @ d / det
    return np.where((np.abs(det) > 1e-12) & (k >= 0) & (u >= 0) & (v >= 0) & (u + v <= 1), k, np.inf)


def test_first_hits_of_ten_thousand_rays(spark):
    """Small and mesh-wide triangles, rays from inside and outside, along axes, and without direction."""
    rng = np.random.default_rng(1)
    tris = np.concatenate([triangles(rng, 400, 0.05), triangles(rng, 4, 0.8)])
    o, d = rng.uniform(-2, 2, (10_000, 3)), rng.normal(size=(10_000, 3))
    d[:300] = np.eye(3)[rng.integers(0, 3, 300)] * rng.choice([-1, 1], (300, 1))
    d[300] = 0
    rows = [("a", i, *map(float, (*o[i], *d[i]))) for i in range(len(o))] + [("none", 0, *[1.0] * 6), ("a", -1, None, *[1.0] * 5)]
    rays = spark.createDataFrame(rows, "g string, id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.id: (r.tri, r.t) for r in T.first_hits(rays, frame(spark, tris), ["g"]).collect()}
    want = {}
    for i in range(len(o)):
        t = hit(o[i], d[i], tris)
        if np.isfinite(t.min()):
            want[i] = (int(np.argmin(t.round(9))), t.min())
    assert 500 < len(want) < 9000
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_hits_without_triangles(spark):
    rays = spark.createDataFrame([("a", 1, *[1.0] * 6)], "g string, id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert T.first_hits(rays, frame(spark, np.zeros((1, 3, 3))).limit(0), ["g"]).count() == 0
    flat = frame(spark, np.array([[[0, 0, 2], [4, 0, 2], [0, 4, 2]]], dtype=float)).unionByName(frame(spark, np.full((1, 3, 3), np.nan)))
    assert [(r.tri, r.z) for r in T.first_hits(rays, flat, ["g"]).collect()] == [(0, 2.0)]


def test_lens_and_rays_lead_back_to_the_point(spark):
    lens, camera = (0.05, -0.01, 0.001, -0.0005, 0.002), [[500.0, 0, 320.0], [0, 480.0, 240.0]]
    a = math.radians(20)
    turn, move = [[math.cos(a), -math.sin(a), 0.0], [math.sin(a), math.cos(a), 0.0], [0.0, 0.0, 1.0]], [0.1, -0.2, 3.0]
    rng = np.random.default_rng(2)
    pts = rng.uniform(-0.5, 0.5, (50, 3))
    seen = pts @ np.array(turn).T + move
    df = spark.createDataFrame([(i, *map(float, (*p, *(c[:2] / c[2])))) for i, (p, c) in enumerate(zip(pts, seen, strict=True))], "id long, x double, y double, z double, cx double, cy double")
    x, y = T.distorted(F.col("cx"), F.col("cy"), lens)
    df = T.undistorted(df.withColumns({"u": x * 500 + 320, "v": y * 480 + 240}), F.col("u"), F.col("v"), camera, lens, rounds=20)
    o, d = T.world_ray(F.col("nx"), F.col("ny"), turn, [F.lit(m) for m in move])
    for r in df.select("x", "y", "z", "cx", "nx", F.array(*o).alias("o"), F.array(*d).alias("d")).collect():
        assert r.nx == pytest.approx(r.cx, abs=1e-9)
        p, o_, d_ = np.array([r.x, r.y, r.z]), np.array(r.o), np.array(r.d)
        assert np.linalg.norm(np.cross(p - o_, d_)) < 1e-9 and np.linalg.norm(d_) == pytest.approx(1)
    o, d = T.world_ray(F.lit(0.0), F.lit(0.0), turn, [F.lit(m) for m in move], to_camera=False)
    r = spark.range(1).select(F.array(*o).alias("o"), F.array(*d).alias("d")).first()
    assert r.o == move and r.d == pytest.approx([0, 0, 1])


def test_pieces_rejoin_to_their_lines(spark):
    """On a triangulated square pieces follow each other without gaps, lie where they say, and keep the length; what is outside goes."""
    grid = [[(x, y) for y in range(9)] for x in range(9)]
    tris = [[(*grid[x][y], 0), (*grid[x + 1][y], 0), (*grid[x][y + 1], 1)] for x in range(8) for y in range(8)] + [[(*grid[x + 1][y + 1], 0), (*grid[x][y + 1], 0), (*grid[x + 1][y], 0)] for x in range(8) for y in range(8)]
    mesh = np.array(tris, dtype=float)
    rng = np.random.default_rng(3)
    segs = [("a", i, 0, *map(float, rng.uniform(0.1, 7.9, 4))) for i in range(60)]
    segs += [("a", 100, 0, 2.0, 1.0, 2.0, 5.0), ("a", 101, 0, 1.0, 1.0, 6.0, 6.0), ("a", 102, 0, 4.0, 4.0, 4.0, 4.0), ("a", 103, 0, -2.0, 3.3, 3.0, 3.3), ("a", 104, 0, 20.0, 20.0, 30.0, 30.0), ("a", 105, 0, 1.0, 7.0, 7.0, 1.0), ("a", 106, 0, None, 7.0, 7.0, 1.0)]
    lines = spark.createDataFrame(segs, "g string, line long, seg long, ax double, ay double, bx double, by_ double")
    pieces = {}
    for r in T.clipped(lines, frame(spark, mesh), ["g"]).collect():
        pieces.setdefault(r.line, []).append(r)
    assert not {102, 104, 106} & pieces.keys()
    for _, line, _, ax, ay, bx, by in segs:
        if line not in pieces:
            continue
        ps = sorted(pieces[line], key=lambda r: r.t0)
        size = math.hypot(bx - ax, by - ay)
        inside = 0.6 if line == 103 else 1.0
        assert sum(p.length for p in ps) == pytest.approx(size * inside)
        assert ps[0].t0 == pytest.approx(1 - inside) and ps[-1].t1 == pytest.approx(1)
        assert all(p.t1 == pytest.approx(q.t0) for p, q in zip(ps, ps[1:], strict=False))
        for p in ps:
            for t, u, v in ((p.t0, p.u0, p.v0), (p.t1, p.u1, p.v1)):
                at = u * mesh[p.tri, 0] + v * mesh[p.tri, 1] + (1 - u - v) * mesh[p.tri, 2]
                assert at[:2] == pytest.approx([ax + t * (bx - ax), ay + t * (by - ay)], abs=1e-9) and min(u, v, 1 - u - v) > -1e-9


def test_normals_and_edges_of_a_box(spark):
    box = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    sides = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = spark.createDataFrame([("m", *t) for a, b, c, d in sides for t in ((a, b, c), (a, c, d))] + [("m", 0, 1, 99)], "g string, i0 long, i1 long, i2 long")
    vertices = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(box)], "g string, v long, x double, y double, z double")
    rows = {r.v: r for r in T.vertex_normals(faces, vertices, ["g"]).collect()}
    want = {i: np.zeros(3) for i in range(8)}
    for a, b, c, d in sides:
        for t in ((a, b, c), (a, c, d)):
            n = np.cross(np.subtract(box[t[1]], box[t[0]]), np.subtract(box[t[2]], box[t[0]]))
            for i in t:
                want[i] = want[i] + n
    for i, n in want.items():
        assert (rows[i].nx, rows[i].ny, rows[i].nz) == pytest.approx(tuple(n / np.linalg.norm(n)))
    whole = T.edge_lengths(faces.filter("i2 < 99"), vertices, ["g"]).first()
    assert whole.edges == 18 and whole.mean_length == pytest.approx((12 + 6 * math.sqrt(2)) / 18)


def test_surface_distance_both_ways(spark):
    tri = frame(spark, np.array([[[0, 0, 0], [4, 0, 0], [0, 4, 0]]], dtype=float))
    far = frame(spark, np.array([[[0, 0, 1], [4, 0, 3], [0, 4, 1]]], dtype=float))
    corners = lambda ps: spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(ps)], "g string, id long, x double, y double, z double")
    out = {r.way: r for r in T.surface_distance({"own": corners([(0, 0, 0), (4, 0, 0), (0, 4, 0)]), "far": corners([(0, 0, 1), (4, 0, 3), (0, 4, 1)])}, {"own": tri, "far": far}, ["g"]).collect()}
    assert out["far to own"].n == 3 and out["far to own"].mean == pytest.approx(5 / 3) and out["far to own"].max == pytest.approx(3) and out["far to own"].p95 == pytest.approx(2.8)
    assert out["own to far"].max < 3


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 1e-12 else np.array([1.0, 0, 0])


def handed(points, vectors, confidence, tris, k=7):
    """The transfer for each triangle by all distances."""
    lo, hi = tris.reshape(-1, 3).min(0), tris.reshape(-1, 3).max(0)
    slo, shi = points.min(0), points.max(0)
    laid = (points - (slo + shi) / 2) * np.linalg.norm(hi - lo) / max(np.linalg.norm(shi - slo), 1e-9) + (lo + hi) / 2
    vectors = np.array([unit(v) for v in vectors])
    out = []
    for c in tris.mean(1):
        d = np.linalg.norm(laid - c, axis=1)
        near = np.argsort(d, kind="stable")[:k]
        signed = np.array([v if v @ vectors[near[0]] >= 0 else -v for v in vectors[near]])
        w = confidence[near] / (d[near] + 1e-6)
        if w.sum() <= 1e-12:
            w = 1 / (d[near] + 1e-6)
        v = unit((signed * w[:, None]).sum(0))
        spread = float(np.degrees(np.arccos(np.clip(signed @ v, -1, 1))).max()) if len(near) > 1 else 0.0
        own = min((confidence[near] * w).sum() / w.sum(), max(0.0, min(1.0, 1 - d[near[0]] / (np.linalg.norm(hi - lo) * 0.18))))
        out.append((*v, math.degrees(math.atan2(v[1], v[0])), own * (0.75 if spread > 45 else 1), near[0], d[near[0]], len(near), spread))
    return out


@pytest.mark.parametrize("n", [3, 60])
def test_directions_of_another_surface(spark, n):
    rng = np.random.default_rng(n)
    points, vectors, conf = rng.uniform(-3, 5, (n, 3)), rng.normal(size=(n, 3)), rng.uniform(0, 1, n)
    vectors[0], conf[: n // 3] = 0, 0
    tris = triangles(rng, 80, 0.2)
    source = spark.createDataFrame([("a", i, *map(float, (*p, *v)), float(c)) for i, (p, v, c) in enumerate(zip(points, vectors, conf, strict=True))], "g string, id long, x double, y double, z double, tx double, ty double, tz double, confidence double")
    df = T.transferred(source, frame(spark, tris), ["g"])
    got = {r.tri: r for r in df.collect()}
    want = handed(points, vectors, conf, tris)
    assert len(got) == 80
    for i, w in enumerate(want):
        r = got[i]
        assert (r.dx, r.dy, r.dz, r.angle, r.confidence, r.nearest, r.distance, r.support, r.spread) == pytest.approx(w, abs=1e-6)
    c = T.coverage(df, ["g"]).first()
    assert c.samples == 80 and c.low == sum(w[4] < 0.35 for w in want) and c.mean == pytest.approx(np.mean([w[4] for w in want]))
    assert T.transferred(source.limit(0), frame(spark, tris), ["g"]).count() == 0


def body(spark, side=7):
    pts = [(i * side + j, float(i), float(j), 0.1 * ((i * j) % 3)) for i in range(side) for j in range(side)]
    edges = [(a, a + 1) for a, *_ in pts if a % side < side - 1] + [(a, a + side) for a, *_ in pts if a < side * (side - 1)]
    vertices = spark.createDataFrame([("m", *p) for p in pts], "g string, v long, x double, y double, z double")
    return np.array([p[1:] for p in pts]), edges, vertices


@pytest.fixture
def one_partition(spark):
    """Many small steps: a shuffle of a few rows needs one task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_steps_of_a_cut_body(spark, one_partition):
    from isoline.operators import geometry as G

    xyz, edges, vertices = body(spark)
    la, lb, centre, axis = 2.0, 0.9, np.array([3.0, 3.0, 0.0]), np.array([0.6, 0.8, 0.0])
    rest = [np.linalg.norm(xyz[a] - xyz[b]) * 0.88 for a, b in edges]
    springs = spark.createDataFrame([("m", a, b, float(r), 2.0) for (a, b), r in zip(edges, rest, strict=True)], "g string, a long, b long, rest double, k double")
    cut = T.excised(vertices, ["g"], tuple(centre), tuple(axis * 3), la, lb)
    cut = cut.select("g", "v", *"xyz", *(F.col(n).alias(f"r{n}") for n in "xyz"), *(F.lit(0.0).alias(f"v{n}") for n in "xyz"), F.col("v").isin(0, 48).alias("anchored"), "removed", "mask")
    d = xyz - centre
    along = d @ axis
    removed = along**2 / la**2 + ((d - np.outer(along, axis)) ** 2).sum(1) / lb**2 <= 1
    mask = np.where(removed, 1, np.clip((np.linalg.norm(d, axis=1) / (la * 3) - 0.4) / 0.6, 0, 1))
    assert 0 < removed.sum() < 20
    pos, vel, still = xyz.copy(), np.zeros_like(xyz), removed.copy()
    still[[0, 48]] = True
    for _ in range(5):
        force = mask[:, None] * 0.15 * (xyz - pos)
        for (a, b), r in zip(edges, rest, strict=True):
            if not (removed[a] or removed[b]):
                delta = pos[b] - pos[a]
                size = np.linalg.norm(delta) or 1e-9
                f = 0.2 * 2.0 * (size - r) / size * delta
                force[a] += f
                force[b] -= f
        vel = np.where(still[:, None], 0, (vel + force * 0.5) * 0.9)
        pos = pos + vel * 0.5
    for _ in range(5):
        cut = G.checkpointed(T.tethered_step(cut, springs, ["g"]))
    for r in cut.collect():
        assert (r.x, r.y, r.z) == pytest.approx(tuple(pos[r.v])) and r.removed == removed[r.v] and r.mask == pytest.approx(mask[r.v])
    fast = lambda df: df.agg(F.max(F.hypot("vx", "vy"))).first()[0]
    assert fast(T.settled(cut, springs, ["g"], most=1, damping=0.3)) < fast(cut)


def ply(order, quality):
    """Five vertices with a further property, a triangle, a quad, a pentagon, one that leads out of range, a pair, and an edge element."""
    o = ">" if order == "big" else "<"
    head = f"ply\nformat binary_{order}_endian 1.0\ncomment x\nelement vertex 5\nproperty {quality} q\nproperty float x\nproperty double y\nproperty short z\nelement face 5\nproperty uchar flag\nproperty list uchar int vertex_indices\nelement edge 1\nproperty int a\nend_header\n"
    kind = {"uchar": "B", "int": "i"}[quality]
    body = b"".join(struct.pack(f"{o}{kind}fdh", 7, i * 0.5, -i * 0.25, i) for i in range(5))
    return head.encode() + body + b"".join(struct.pack(f"{o}BB{len(f)}i", 1, len(f), *f) for f in ((0, 1, 2), (0, 1, 2, 3), (4, 3, 2, 1, 0), (0, 1, 9), (0, 1))) + struct.pack(f"{o}i", 3)


def test_ply_files_of_both_byte_orders_and_ascii(spark, tmp_path):
    """What binaryFile reads gives the same mesh however it is stored; broken files are told."""
    verts = [(i * 0.5, -i * 0.25, float(i)) for i in range(5)]
    tris = [(0, 1, 2), (0, 1, 2), (0, 2, 3), (4, 3, 2), (4, 2, 1), (4, 1, 0)]
    text = "ply\nformat ascii 1.0\nelement vertex 5\nproperty float x\nproperty float y\nproperty float z\nelement face 5\nproperty list uchar int vertex_index\nend_header\n" + "\n".join(" ".join(map(str, v)) for v in verts) + "\n3 0 1 2\n4 0 1 2 3\n5 4 3 2 1 0\n3 0 1 9\n2 0 1\n"
    files = {"little": ply("little", "uchar"), "big": ply("big", "int"), "text": text.encode(), "short": ply("big", "int")[:-40], "no": b"solid", "odd": b"ply\nformat binary_middle 1.0\nend_header\n", "none": b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nproperty float x\nproperty float y\nproperty float z\nend_header\n"}
    for name, content in files.items():
        (tmp_path / f"{name}.ply").write_bytes(content)
    df = M.binary_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"(\w+)\.ply$", 1))
    rows = {}
    for r in M.ply_parts(df, "path", "content").collect():
        rows.setdefault(r.path, []).append(r)
    for name in ("little", "big", "text"):
        assert sorted((r.vid, r.x, r.y, r.z) for r in rows[name] if r.vid is not None) == [(i, *v) for i, v in enumerate(verts)]
        assert [(r.i0, r.i1, r.i2) for r in rows[name] if r.i0 is not None] == tris
    assert all(len(rows[n]) == 1 and rows[n][0].error for n in ("short", "no", "odd")) and "none" not in rows


def test_a_spindle_holds_its_ring(spark):
    """Along and across its axis the length and width reach every point with the margins, unless a limit holds."""
    rng = np.random.default_rng(8)
    rows = [(i, [tuple(map(float, p)) for p in rng.uniform(-1, 1, (rng.integers(0, 9), 2)) * (9, 2)], float(a)) for i, a in enumerate(np.radians([0, 30, 90, 170, 45] * 6))]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>, a double")
    size = T.fusiform_length(F.col("ring"), F.col("a"), F.lit(2.0), F.lit(1.5), 1.0, 3.0, 10.0, 21.0)
    held = 0
    for r in df.select("ring", "a", size.alias("s")).collect():
        p = np.array([tuple(x) for x in r.ring]).reshape(-1, 2)
        axis, across = np.array([math.cos(r.a), math.sin(r.a)]), np.array([-math.sin(r.a), math.cos(r.a)])
        wide = [float(np.ptp(p @ u)) if len(p) >= 3 else 0.0 for u in (axis, across)]
        width, cover = max(2.0, wide[1]) + 3, max(2.0, wide[0]) + 3
        target = max(3 * width, cover)
        assert (r.s.axis_mm, r.s.perp_mm, r.s.width, r.s.covering) == pytest.approx((*wide, width, cover))
        assert r.s.length == pytest.approx(min(max(target, 10), 21)) and r.s.deficit == pytest.approx(max(0, cover - r.s.length))
        assert (r.s.short, r.s.long) == (target < 10, target > 21)
        held += r.s.long
    assert held


def test_cells_of_a_long_mesh_stay_small(spark):
    """A ribbon fills few of its cube's cells, yet a cell holds few of its triangles, in space and seen along z."""
    f = lambda v: F.lit(float(v))
    y = F.col("tri").cast("double")
    ribbon = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").alias("tri")).select("g", "tri", *(c.alias(f"{n}{j}") for j, p in enumerate(((f(0), y, f(0)), (f(1), y, f(0)), (f(0), y + 1, f(1)))) for n, c in zip("xyz", p, strict=True)))
    for names in (("x", "y", "z"), ("x", "y")):
        _, cells = T.gridded(ribbon, ["g"], names)
        assert cells.groupBy("level", *(f"c_{n}" for n in names)).count().agg(F.max("count")).first()[0] <= 12
