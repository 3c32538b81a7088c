"""Fields, shape models and their fits, landmark sets and plans against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.operators import fields as D


def test_axes_blend_without_regard_to_sign(spark):
    one = lambda *t: spark.range(1).select(D.blended_axis([(F.lit(a), F.lit(w)) for a, w in t])).first()[0]
    assert one((0.3, 1.0), (0.3 + math.pi, 2.0)) == pytest.approx(0.3)
    assert one((0.0, 1.0), (math.pi / 2, 3.0)) == pytest.approx(math.pi / 2)
    a, w = D.around(F.lit(1.0), F.lit(0.0), (0.0, 0.0), 1.0, 2.0)
    assert np.allclose(list(spark.range(1).select(a, w).first()), [math.pi / 2, 2 * math.exp(-0.5)])


def test_shapes_and_hinges(spark):
    template = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 0.0, 0.0, 0.0)], "v long, x double, y double, z double")
    basis = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, 0.0, 1.0, 0.0)], "v long, k int, x double, y double, z double")
    coefficients = spark.createDataFrame([("a", 0, 2.0), ("a", 1, -1.0), ("b", 7, 5.0)], "g string, k int, c double")
    got = {(r.g, r.v): (r.x, r.y, r.z) for r in D.shaped(template, basis, coefficients, ["g"]).collect()}
    assert got == {("a", 0): (3.0, 1.0, 3.0), ("a", 1): (0.0, 0.0, 0.0), ("b", 0): (1.0, 2.0, 3.0), ("b", 1): (0.0, 0.0, 0.0)}
    assert D.shaped(template, basis, coefficients.limit(0), ["g"]).isEmpty()
    p = D.hinged([F.lit(1.0), F.lit(1.0), F.lit(0.0)], (0.0, 0.0, 0.0), F.lit(math.pi / 2), F.lit(0.5))
    assert np.allclose(list(spark.range(1).select(*p).first()), [1.0, 0.5, 0.5])


def test_fit_against_numpy(spark):
    rng = np.random.default_rng(4)
    n, k = 40, 2
    base, comp, beta = rng.normal(size=(n, 3)), 0.3 * rng.normal(size=(n, 3, k)), np.array([0.8, -0.5])
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    seen = 2.0 * (base + comp @ beta) @ turn.T + [1, 2, 3] + 0.01 * rng.normal(size=(n, 3))
    row = lambda g, i: (g, *map(float, seen[i]), *map(float, base[i]), *(comp[i, a].tolist() for a in range(3)))
    df = spark.createDataFrame([row("a", i) for i in range(n)] + [row("few", i) for i in range(3)], "g string, x double, y double, z double, x0 double, y0 double, z0 double, bx array<double>, by_ array<double>, bz array<double>")
    got = D.shape_fitted(df, "g", k, 1e-4, 4).collect()
    w, a = np.zeros(k), comp.reshape(-1, k)
    for _ in range(4):
        to = base + comp @ w
        sc, tc = seen - seen.mean(0), to - to.mean(0)
        u, d, vt = np.linalg.svd(tc.T @ sc / n)
        flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
        scale = (d * np.diag(flip)).sum() / (sc**2).sum() * n
        rest = scale * sc @ (u @ flip @ vt).T + to.mean(0) - base
        w = np.linalg.solve(a.T @ a + 1e-4 * np.eye(k), a.T @ rest.ravel())
    assert [r.g for r in got] == ["a"] and got[0].n == n
    assert np.allclose(got[0].beta, w) and got[0].rmse == pytest.approx(np.sqrt(np.mean((rest - comp @ w) ** 2)), abs=1e-7)


def test_landmark_sets_and_forms(spark):
    assert D.landmark_subset("all", 5) == [0, 1, 2, 3, 4]
    stable, fine = D.landmark_subset("stable_face", 468), D.landmark_subset("fine_only", 100)
    assert len(stable) == len(set(stable)) == sum(map(len, D.PARTS.values())) and stable[0] == 33
    assert fine == sorted(fine) and max(fine) < 100
    with pytest.raises(ValueError, match="unknown landmark set"):
        D.landmark_subset("chin", 9)
    texts = spark.createDataFrame([("2.5",), ("-7",), ("99",), ("x",), (None,), ("inf",)], "t string")
    assert [r[0] for r in texts.select(D.clamped_whole(F.col("t"), 1, 50, 8)).collect()] == [3.0, 1.0, 50.0, 8.0, 8.0, 8.0]


def test_plans_of_sessions_without_a_log(spark):
    context = spark.createDataFrame([(1, 0, False, 0, 0), (2, 1, True, 0, 0)], "s long, candidates int, comparison_ready boolean, retried int, recovered int")
    log = spark.createDataFrame([(2, i, a) for i, a in enumerate(a for groups, _ in D.STEPS.values() for g in groups for a in g[:1])], "s long, i int, action string")
    got = D.planned(log, context, "s", "i").collect()
    assert {(r.s, r.status) for r in got} == {(1, "failed"), (2, "completed")} and len(got) == 16
    last = next(r for r in got if r.s == 1 and r.step == D.COMPARED)
    assert last.issues == ["missing any of: propose_direction_variants", "missing any of: compare_candidates", "comparison missing", "no candidates"]


def test_poses_against_numpy(spark):
    rng = np.random.default_rng(8)
    n, parents = 12, (-1, 0, 0, 2)
    shape, at, skin, pose = rng.normal(size=(n, 3)), rng.random((4, n)), rng.random((n, 4)), rng.normal(size=(4, 3))
    at, skin, pose[3] = at / at.sum(1, keepdims=True), skin / skin.sum(1, keepdims=True), 0.0

    def motion(j):
        size = np.linalg.norm(pose[j])
        k = np.cross(np.eye(3), pose[j] / size if size else pose[j])
        turn = np.eye(3) + np.sin(size) * k + (1 - np.cos(size)) * k @ k
        place = at[j] @ shape
        own = np.block([[turn, (place - turn @ place)[:, None]], [np.zeros((1, 3)), np.ones((1, 1))]])
        return own if parents[j] < 0 else motion(parents[j]) @ own

    whole = np.hstack([shape, np.ones((n, 1))])
    want = sum(skin[:, j : j + 1] * (whole @ motion(j).T)[:, :3] for j in range(4))
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    shapes = frame([(g, v, *map(float, shape[v])) for g in ("a", "still") for v in range(n)], "g string, v long, x double, y double, z double")
    joints = frame([(j, v, float(at[j, v])) for j in range(4) for v in range(n)], "j int, v long, w double")
    poses = frame([("a", j, *map(float, pose[j])) for j in range(3)], "g string, j int, rx double, ry double, rz double")
    skins = frame([(v, j, float(skin[v, j])) for v in range(n) for j in range(4)], "v long, j int, w double")
    got = {(r.g, r.v): (r.x, r.y, r.z) for r in D.posed(shapes, joints, poses, skins, parents, ["g"]).collect()}
    assert np.allclose([got["a", v] for v in range(n)], want) and np.allclose([got["still", v] for v in range(n)], shape)
    assert D.posed(shapes.limit(0), joints, poses, skins, parents, ["g"]).isEmpty()
    with pytest.raises(ValueError, match="before its parent"):
        D.posed(shapes, joints, poses, skins, (1, -1), ["g"])
