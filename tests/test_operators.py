"""Geometry and sequences against closed forms and numpy."""

import json
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators import frames as K
from isoline.operators import geometry as G
from isoline.operators import payloads as A
from isoline.operators import review as V
from isoline.operators import rules as R
from isoline.operators import sequence as Q
from isoline.plans import QUERIES, SQL
from isoline.sources import meshes as M


def test_barycentric_points_and_coordinates(spark):
    lits = lambda p: [F.lit(float(v)) for v in p]
    a, b, c = (0, 0, 0), (10, 0, 0), (0, 10, 5)
    p = E.barycentric_point(F.lit(0.2), F.lit(0.3), lits(a), lits(b), lits(c))
    u, v, w = E.barycentric_coordinates(p, lits(a), lits(b), lits(c))
    r = spark.range(1).select(*p, u, v, w, E.distance_to_triangle(lits((0, 0, 3)), lits(a), lits(b), lits((0, 10, 0))), E.distance_to_triangle(lits((-3, -4, 0)), lits(a), lits(b), lits((0, 10, 0)))).first()
    assert np.allclose(list(r), [3.0, 5.0, 2.5, 0.2, 0.3, 0.5, 3.0, 5.0])


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    y = 2.5 * x @ q.T + [1, -2, 3]
    df = spark.createDataFrame([("g", *map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double, z double, qx double, qy double, qz double")
    r = G.similarity(df, "g").first()
    assert r.scale == pytest.approx(2.5) and r.rmse < 1e-6
    assert np.allclose([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)], q)
    assert np.allclose([r.t0, r.t1, r.t2], [1, -2, 3])


def test_resampling_is_even(spark):
    line = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (3, 0), (3, 0), (3, 4), (10, 4)])] + [("b", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0)], "k string, seq int, x double, y double")
    got = [(r.x, r.y) for r in Q.resampled(line, "k", ["x", "y"], 15).orderBy("k").collect() if r.k == r.k]
    assert len(got) == 15
    assert np.allclose(sorted(got)[-1], (10, 4)) and np.allclose(sorted(got)[0], (0, 0))
    gaps = np.hypot(*np.diff(np.array(sorted(got)), axis=0).T)
    assert gaps.max() <= 1 + 1e-9


def test_spacing_resample(spark):
    line = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate([0, 1, 5, 9.4])], "line int, seq int, x double, y double")
    assert [r.x for r in K.respaced(line, "line", 2.0).orderBy("x").collect()] == pytest.approx([0, 2, 4, 6, 8, 9.4])


def test_hull_and_containment(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 0.0), (1, 4.0, 4.0), (1, 0.0, 4.0), (1, 2.0, 2.0), (1, 4.0, 2.0)], "g int, x double, y double")
    h = K.hull(pts, "g")
    assert [(p.x, p.y) for p in h.first().hull] == [(0, 0), (4, 0), (4, 4), (0, 4)]
    at = lambda x, y: h.select(K.inside_hull(F.col("hull"), F.lit(x), F.lit(y))).first()[0]
    assert at(1.0, 1.0) and at(4.0, 4.0) and not at(4.1, 1.0)


def test_spline_passes_through_its_controls(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 3)), rng.normal(size=(12, 3))
    df = spark.createDataFrame([(1, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "g int, id int, x double, y double, z double, qx double, qy double, qz double")
    got = {r.id: (r.x, r.y, r.z) for r in K.spline_fitted(df, df.select("g", "id", "x", "y", "z"), "g", 0.0).collect()}
    assert np.allclose([got[i] for i in range(12)], y, atol=1e-6)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.v: r.label for r in K.least_labels(edges).collect()}
    assert set(got[i] for i in range(201)) == {0} and got[501] == 500


def test_thresholds_by_name_then_part(spark):
    names = ["lower_eyelid", "left_nasal_tip_x", "cheek", "LIP_VERMILION_MARGIN"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(R.threshold(F.col("n"))).collect()] == [16.0, 10.0, None, 14.0]


def test_decisions(spark):
    rows = [(" Approve ", None, False, "accepted"), ("", True, False, "accepted"), ("", False, True, "corrected"), (None, False, False, "rejected"), ("accepted", False, True, "corrected"), ("not-usable", None, False, "rejected"), ("huh", None, False, None)]
    df = spark.createDataFrame(rows, "raw string, acc boolean, cor boolean, want string")
    assert all(r[0] == r[1] for r in df.select(V.decision(F.col("raw"), F.col("acc"), F.col("cor")), "want").collect())


def test_self_crossing_polygons(spark):
    ring = lambda ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
    square, bow = [(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (2, 2), (2, 0), (0, 2)]
    r = spark.range(1).select(R.shoelace(ring(square)), R.crosses(ring(square)), R.crosses(ring(bow)), R.crosses(ring(square[:3]))).first()
    assert list(r) == [4.0, False, True, False]


def test_obj_reader(spark):
    text = "# c\nv 0 0 0\nv 1 0 0 # inline\nv 1 1 0\nv 0 1 0\nvt 0 0\nf 1/1 2/1 3/1 4/1\nf -1 -2 -3\nf 1 2 9\n"
    parts = M.obj_parts(spark.createDataFrame([("m", text)], "m string, text string"), "m", "text")
    vs = M.obj_vertices(parts, "m")
    assert vs.count() == 4
    assert sorted((r.i0, r.i1, r.i2) for r in M.obj_triangles(parts, vs, "m").collect()) == [(0, 1, 2), (0, 2, 3), (3, 2, 1)]


def test_hash_of_edits(spark):
    def want(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        digits = ""
        while h:
            h, d = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        return digits or "0"

    df = spark.createDataFrame([("abc",), ("rotate|12.5|x" * 5,)], "s string")
    assert all(r[0] == want(r[1]) for r in df.select(E.fingerprint31(F.col("s")), "s").collect())


def test_one_euro_against_a_loop(spark):
    rng = np.random.default_rng(0)
    t, x = np.cumsum(rng.choice([0.0, 0.03, 0.05], 40)), rng.normal(size=40).cumsum()
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x, strict=True))], "k int, i int, t double, x double")
    got = [r.smooth for r in sorted(Q.one_euro(df, "k", "x", "t", "i").collect(), key=lambda r: r.i)]
    alpha = lambda c, dt: 1 / (1 + 1 / (2 * np.pi * c) / dt)
    f, dx, want = x[0], 0.0, [x[0]]
    for i in range(1, 40):
        dt = t[i] - t[i - 1] if t[i] > t[i - 1] else 1e-3
        a = alpha(1.0, dt)
        dx = a * (x[i] - f) / dt + (1 - a) * dx
        b = alpha(1.5 + 0.05 * abs(dx), dt)
        f = b * x[i] + (1 - b) * f
        want.append(f)
    assert np.allclose(got, want, atol=1e-12)


def test_shortest_paths_settle(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1, 1.0) for i in range(60)] + [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 61, 20), rng.integers(0, 61, 20), rng.integers(1, 40, 20), strict=True)] + [(100, 101, 1.0)]
    want = {0: 0.0}
    for _ in range(61):
        for a, b, w in [*links, *((b, a, w) for a, b, w in links)]:
            if a in want and want[a] + w < want.get(b, 1e9):
                want[b] = want[a] + w
    e, start = spark.createDataFrame(links, "a long, b long, w double"), spark.createDataFrame([(0,)], "v long")
    for block in (65536, 40):
        assert {r.v: r.d for r in G.shortest_paths(e, start, block=block).collect()} == want
    with pytest.raises(ValueError):
        G.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "a long, b long, w double"), start)


def test_nearest_of_all_points(spark):
    rng = np.random.default_rng(6)
    xyz = np.vstack([rng.normal(size=(120, 3)), rng.normal(size=(30, 3)) * 0.01 + 3, np.ones((20, 3)), [[40, 0, 0], [0, -90, 5]]])
    rows = [("a" if i % 3 else "b", i, *map(float, p)) for i, p in enumerate(xyz)] + [("c", 500, 0.0, 0.0, 0.0), ("c", 501, 1.0, 0.0, 0.0), ("d", 600, 0.0, 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "label string, id long, x double, y double, z double")
    others = pts.select("label", F.col("id").alias("other_id"), *(F.col(n).alias(f"o{n}") for n in "xyz"))
    for k in (1, 7):
        want = []
        for g, i, *p in rows:
            d = sorted((sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) ** 0.5, j) for h, j, *q in rows if h == g and j != i)
            want += [(i, n + 1, j) for n, (_, j) in enumerate(d[:k])]
        assert sorted((r.id, r.n, r.other_id) for r in G.nearest_k(pts, others, ["label"], k).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["nearest_one", "knn_direction", "gaussian_residual", "bary_locate", "closest_triangle"])
def test_whole_queries_have_all_candidates(spark, name):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert "%10" not in SQL[name] and "r<15" not in SQL[name]
    r = c.execute(SQL[name])
    names = [x[0] for x in r.description]
    text = lambda v: f"{v + 0.0:.4f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(text, x)) for x in r.fetchall())
    assert sorted(tuple(text(x[n]) for n in names) for x in QUERIES[f"{name}_whole"](spark, sf).collect()) == want


def test_components_of_all_orders(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for k, c in duckdb.sql(f"select o_orderkey, o_custkey from '{sf}/orders.parquet'").fetchall():
        a, b = top(c), top(c + k % 3 * 7)
        root[max(a, b)] = min(a, b)
    assert {r.v: r.label for r in QUERIES["connected_components_whole"](spark, sf).collect()} == {v: top(v) for v in list(root)}


def test_labels_that_have_not_settled_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        K.least_labels(chain, 2)
    assert {r.label for r in K.least_labels(chain).collect()} == {0}


def test_faces_of_many_corners_and_calibration_texts(spark):
    n = 1500
    text = "\n".join(["v 0 0 0"] * n + ["f " + " ".join(str(i + 1) for i in range(n))])
    parts = M.obj_parts(spark.createDataFrame([("m", text)], "m string, text string"), "m", "text")
    assert M.obj_triangles(parts, M.obj_vertices(parts, "m"), "m").count() == n - 2
    said = "%F 1200.5\r\n %X -3e2\n%x 7\n# note\n%F 1300\nF 9\n%Y none\n%Z12"
    assert spark.createDataFrame([(said,)], "t string").select(M.calibration(F.col("t"))).first()[0] == {"X": -300.0, "x": 7.0, "F": 1300.0, "Z": 12.0}


def test_ply_reader(spark):
    text = "ply\r\nformat ascii 1.0\r\nelement vertex 4\r\nproperty float z\r\nproperty float x\r\nproperty float y\r\nelement face 3\r\nproperty list uchar int vertex_indices\r\nend_header\r\n9 0 0\r\n9 1 0\r\n9 1 1\r\n9 0 1\r\n4 0 1 2 3\r\n3 0 1 7\r\n3 3 2 1\r\n"
    df = spark.createDataFrame([("m", text), ("b", "ply\nformat binary_little_endian 1.0\nelement vertex 1\nend_header\nx"), ("n", None)], "m string, text string")
    assert sorted(map(tuple, M.ply_vertices(df, "m", "text").collect())) == [("m", 0, 0.0, 0.0, 9.0), ("m", 1, 1.0, 0.0, 9.0), ("m", 2, 1.0, 1.0, 9.0), ("m", 3, 0.0, 1.0, 9.0)]
    assert sorted(map(tuple, M.ply_triangles(df, "m", "text").collect())) == [("m", 0, 1, 2), ("m", 0, 2, 3), ("m", 3, 2, 1)]


def test_payload_leaves_of_any_depth(spark):
    deep = "1"
    for _ in range(30):
        deep = f'{{"a":[{deep}]}}'
    media = "R0lGODlh" * 40
    rows = [(1, deep), (2, "not json"), (3, None), (4, '{"A_Token":" REDACTED ","b":{"token":5,"mrn":"7","video":"%s"},"c":null,"d":"call +49 170 1234567"}' % media), (5, "[]"), (6, '"x@example.com"')]
    df = spark.createDataFrame(rows, "id long, js string")
    leaves = A.json_leaves(df, "id", "js")
    got = {(r.id, ".".join(r.path)): (r.kind, r.value) for r in leaves.collect()}
    assert got[1, ".".join(["a", "0"] * 30)][1] == "1" and {i for i, _ in got} == {1, 4, 6}
    assert sorted((r.id, ".".join(r.path), r.code) for r in A.payload_violations(leaves).collect()) == [
        (4, "b.mrn", "pii_field_present"), (4, "b.video", "embedded_media_payload"), (4, "d", "pii_pattern_present"), (6, "", "pii_pattern_present"),
    ]


def test_unknown_review_words_stop(spark):
    df = spark.createDataFrame([("huh",)], "w string").select(V.checked_decision(F.col("w"), F.lit(True), F.lit(False)))
    with pytest.raises(Exception, match="unknown review decision: huh"):
        df.collect()


def test_scans_are_linear_and_skip_nulls(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id"), F.when(F.col("id") != 7, F.lit(1.0)).alias("x"))
    got = Q.ema(df, "k", "x", ["id"]).orderBy("id").collect()
    assert len(got) == 40_000 and got[7].ema is None and got[8].ema == pytest.approx(1 + 29 * 0.9**8)


def test_order_statistics_by_narrowing(spark):
    """Every place of groups with ties, heavy tails, infinities, NaN, nulls and null keys, in passes with few buckets and little to sort."""
    import random

    from isoline.operators import stats as S

    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    groups = {
        "even": [rng.random() for _ in range(400)],
        "tail": [10.0 ** rng.uniform(-300, 300) * rng.choice((1, -1)) for _ in range(300)],
        "same": [2.5] * 500 + [3.5],
        "odd": [-inf] * 40 + [inf] * 30 + [nan] * 20 + [float(i % 7) for i in range(100)],
        "ends": [1.7e308, -1.7e308] * 50 + [0.0],
        None: [float(i) for i in range(150)],
        "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    shares = (0.0, 0.1, 0.5, 0.9, 0.95, 1.0)
    got = S.order_statistics(df, ["g"], "x", {f"p{i}": S._rank(p) for i, p in enumerate(shares)}, [], most=30, buckets=16).collect()
    assert len(got) == len(groups)
    for r in got:
        vs = sorted(groups[r.g], key=lambda v: (math.isnan(v), v if not math.isnan(v) else 0.0))
        want = [vs[max(0, math.ceil(len(vs) * p) - 1)] if vs else None for p in shares]
        assert r.n == len(vs) and [str(r[f"p{i}"]) for i in range(len(shares))] == list(map(str, want)), r.g
    plain = {r.g: r for r in S.interpolated(df.filter("g in ('even', 'same')"), ["g"], "x").collect()}
    for g, r in plain.items():
        assert [r.median, r.p90, r.p95] == pytest.approx([float(np.percentile(groups[g], p)) for p in (50, 90, 95)])
    assert S.summary(df.limit(0), ["g"], "x").count() == 0


def test_leaves_at_any_bound_of_depth_and_without_a_write(spark, monkeypatch):
    texts = ['{"a":{"b":[1,[],{},{"c":null}],"d":"]]}}\\\\"},"e\\"{":[[[["deep"]]]],"key":7,"pos":{"v":"x"}}', "[]", "{}", "3", '"[[["', "null", "no [json {{", "", None, "[" * 40 + "1" + "]" * 40, "[" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, js string")
    plain = lambda v, at=(): [(at, v)] if not isinstance(v, dict | list) else [x for k, w in (v.items() if isinstance(v, dict) else enumerate(v)) for x in plain(w, (*at, str(k)))]
    want = []
    for i, t in enumerate(texts):
        try:
            want += [(i, p, None if v is None else str(v)) for p, v in plain(json.loads(t))]
        except (TypeError, ValueError):
            pass
    assert [r[0] for r in df.select(A.nesting(F.col("js"))).collect()][:6] == [5, 1, 1, 0, 0, 0]
    for most in (0, 2, 16, 64):
        assert sorted((r.id, tuple(r.path), None if r.kind == "VOID" else r.value) for r in A.json_leaves(df, "id", "js", most).collect()) == sorted(want, key=lambda r: r[:2])
    monkeypatch.setattr(A, "checkpointed", None)
    assert A.json_leaves(df.filter("id < 9"), "id", "js").count() == len([w for w in want if w[0] < 9])


def test_payloads_of_one_file_are_audited_by_many_tasks(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    for name in ("payload_audit", "export_preflight"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() > 7


def test_components_write_a_few_times_the_path(spark, monkeypatch):
    written = []
    kept = K.checkpointed
    monkeypatch.setattr(K, "checkpointed", lambda df: written.append(kept(df)) or written[-1])
    n = 4000
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd = spark.createDataFrame([(-5, -5), (None, -7), (None, None), (-9, -8), (-8, -9), (-20, -21), (-20, -22), (-20, -23)], "a long, b long")
    got = {r.v: r.label for r in K.least_labels(path.unionAll(odd)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {-5: -5, -7: -7, None: None, -9: -9, -8: -9} | {v: -23 for v in (-20, -21, -22, -23)}
    assert sum(df.count() for df in written) < 7 * n


def test_components_shuffle_links_that_are_left(spark):
    """connected_components and its _whole are one query, whose links go as its rounds go."""
    assert QUERIES["connected_components"] is QUERIES["connected_components_whole"]
    left = []
    later = K._later_first
    try:
        K._later_first = lambda links: left.append(later(links)) or left[-1]
        K.least_labels(spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
    finally:
        K._later_first = later
    sizes = [df.count() for df in left]
    assert sizes[-1] == 0 and all(b <= a * 0.7 for a, b in zip(sizes, sizes[1:], strict=False))


def test_components_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(e):
        read.add(1)
        return e

    rows = [(1, 2), (2, 1), (1, 2), (2, 3), (None, 3), (7, 7), (7, 7)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "a long, b long")
    assert {r.v: r.label for r in K.least_labels(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, None: None}
    assert read.value == len(rows)
