import numpy as np
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators import overlays as O
from isoline.operators import payloads as A

TRI = "g long, tri long, " + ", ".join(f"{n}{j} double" for j in range(3) for n in "xyz")


def grid(spark, group=1, n=6):
    """A bumpy surface of n by n cells, two triangles each."""
    z = lambda x, y: 0.3 * np.sin(x) * np.cos(y)
    rows = []
    for i in range(n):
        for j in range(n):
            c = [(float(x), float(y), float(z(x, y))) for x, y in ((i, j), (i + 1, j), (i, j + 1), (i + 1, j + 1))]
            rows += [(group, len(rows), *c[0], *c[1], *c[2]), (group, len(rows) + 1, *c[3], *c[2], *c[1])]
    return spark.createDataFrame(rows, TRI), [(r[1], np.array(r[2:]).reshape(3, 3)) for r in rows]


def nearest(p, mesh):
    """The place of the mesh nearest p, from the foot on each triangle's plane and the nearest points of its edges."""
    best = None
    for tri, (a, b, c) in mesh:
        found = []
        m = np.stack([b - a, c - a], axis=1)
        vw = np.linalg.lstsq(m, p - a, rcond=None)[0]
        if vw.min() >= 0 and vw.sum() <= 1:
            found.append(a + m @ vw)
        for s, e in ((a, b), (b, c), (c, a)):
            found.append(s + (e - s) * np.clip((p - s) @ (e - s) / ((e - s) @ (e - s)), 0, 1))
        q = min(found, key=lambda f: np.linalg.norm(p - f))
        d = round(float(np.linalg.norm(p - q)), 9)
        if best is None or (d, tri) < best[:2]:
            best = (d, tri, q)
    return best


def test_weights_on_triangle(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, rng.normal(size=12))) for _ in range(200)] + [(5.0, 0, 0, 0, 0, 0, 1.0, 0, 0, 0, 1.0, 0), (0.0,) * 12]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{i} double" for i in range(12)))
    c = [F.col(f"c{i}") for i in range(12)]
    got = df.select("*", E.weights_on_triangle(c[:3], c[3:6], c[6:9], c[9:]).alias("at")).select("*", "at.*").collect()
    for r in got[:-1]:
        p, corners = np.array(r[:3]), np.array(r[3:12]).reshape(3, 3)
        place = r["u"] * corners[0] + r["v"] * corners[1] + r[-1] * corners[2]
        assert abs(np.linalg.norm(p - place) - nearest(p, [(0, corners)])[0]) < 1e-8
    assert got[-1]["u"] + got[-1]["v"] + got[-1][-1] == 1


def plainly_smoothed(points, mesh, rounds):
    for _ in range(rounds):
        out = [points[0]]
        for a, b in zip(points, points[1:], strict=False):
            for t in (0.25, 0.75):
                q = nearest(a * (1 - t) + b * t, mesh)[2]
                if np.linalg.norm(q - out[-1]) > 1e-9:
                    out.append(q)
        if np.linalg.norm(points[-1] - out[-1]) > 1e-9:
            out.append(points[-1])
        points = out
    return np.array(points)


def test_smoothed(spark):
    tris, mesh = grid(spark)
    rng = np.random.default_rng(2)
    lines = {k: [np.array([*rng.uniform(0, 6, 2), rng.normal()]) for _ in range(n)] for k, n in (("a", 7), ("b", 4), ("few", 3), ("long", 9))}
    rows = [(1, k, i * 3 - 2, *map(float, p)) for k, ps in lines.items() for i, p in enumerate(ps)]
    rows += [(1, "hole", i, float(i), None if i == 2 else 1.0, 0.0) for i in range(5)] + [(2, "bare", i, float(i), 1.0, 0.0) for i in range(5)]
    rows += [(1, "still", i, 1.0, 1.0, float(0.3 * np.sin(1) * np.cos(1))) for i in range(4)]
    df = spark.createDataFrame(rows, "g long, line string, seq long, x double, y double, z double").withColumn("tri", F.lit("clash"))
    got = {}
    for r in O.smoothed(df, tris, ["g"], most=16).orderBy("line", "seq").collect():
        got.setdefault(r["line"], []).append((r["seq"], r["x"], r["y"], r["z"]))
    for k, rounds in (("a", 2), ("b", 2), ("few", 0), ("long", 1)):
        want = plainly_smoothed(lines[k], mesh, rounds)
        assert [p[0] for p in got[k]] == list(range(len(want))), k
        assert np.allclose([p[1:] for p in got[k]], want, atol=1e-7), k
    assert [p[1] for p in got["hole"]] == [0, 1, 2, 3, 4] and got["hole"][2][2] is None
    assert len(got["bare"]) == 5 and len(got["still"]) == 1
    assert O.smoothed(df.limit(0), tris, ["g"]).count() == 0
    assert O.smoothed(df, tris.limit(0), ["g"]).count() == df.count()
    assert O.smoothed(df.filter("line = 'long'"), tris, ["g"], most=8).count() == 9


RECORD = "g long, record_id long, title string, candidate_type string, tumor_kind string, centre array<double>, boundary array<array<double>>, polyline array<array<double>>, diameter_mm double, margin_mm double, length_mm double, width_mm double, status string, reviewer string, notes string, passed boolean, high_codes array<string>, medium_codes array<string>, warnings array<struct<severity:string,code:string>>, approval_ready boolean, live_overlay_ready boolean"


def test_compiled(spark):
    tris, mesh = grid(spark)
    line, centre = [[0.5, 0.4, 1.0], [1.5, 0.7, 1.0], [9.0, 9.0, 0.0]], [2.0, 2.2, 0.1]
    more = [None] * 4
    rows = [
        (1, 1, "t", "k", "r", centre, [[1.0, 1.0, 1.0], [None, 1.0, 1.0]], line, *more, None, None, None, None, None, None, [("high", "a"), ("medium", "b"), ("high", "")], None, True),
        (1, 2, "t", "k", "r", centre, None, line, *more, "approved", "x", "", True, ["c"], [], None, True, True),
        (1, 3, "t", "k", "r", centre, None, line, *more, "approved", "x", "n", True, None, None, None, True, False),
        (1, 4, "t", "k", "r", None, None, line, *more, "approved", "x", "n", True, None, None, None, True, True),
        (1, 5, "t", "k", "r", centre, None, line[:1], *more, "approved", "x", "n", True, None, None, None, True, True),
        (1, 6, "t", "k", "r", centre, None, [*line, [1.0, float("nan"), 0.0]], *more, "approved", "x", "n", True, None, None, None, True, True),
        (1, 7, "t", "k", "r", centre, None, None, *more, "approved", "x", "n", True, None, None, None, True, None),
        (2, 8, "t", "k", "r", centre, None, line, *more, "approved", "x", "n", True, None, None, None, True, True),
        (1, 9, "t", "k", "r", [1.0], None, line, *more, "approved", "x", "n", True, None, None, None, True, True),
    ]
    got = {r["record_id"]: r["overlay"] for r in O.compiled(spark.createDataFrame(rows, RECORD), tris, ["g"]).collect()}
    assert sorted(got) == [1, 2]
    one, two = got[1], got[2]
    assert one["review"]["status"] == "pending_clinician_confirmation" and not one["review"]["notes_present"] and one["label"] == "t"
    assert one["guardrail_summary"]["high_codes"] == ["a"] and one["guardrail_summary"]["medium_codes"] == ["b"] and not one["guardrail_summary"]["passed"]
    assert two["candidate"]["high_guardrail_codes"] == ["c"] and two["guardrail_summary"]["medium_codes"] == []
    assert len(one["tumor"]["boundary_refs"]) == 1 and two["tumor"]["boundary_refs"] == []
    for p, ref in zip(line, one["candidate"]["polyline_refs"], strict=True):
        d, tri, q = nearest(np.array(p), mesh)
        assert (ref["tri"], round(ref["distance"], 6)) == (tri, round(d, 6))
        assert np.allclose(ref["u"] * mesh[tri][1][0] + ref["v"] * mesh[tri][1][1] + ref["w"] * mesh[tri][1][2], q, atol=1e-7)
    back = O.compiled(spark.createDataFrame(rows, RECORD), tris, ["g"]).select(F.to_json("overlay").alias("j")).select(O.valid_overlay(O.overlay_of(F.col("j"))).alias("ok"))
    assert [r["ok"] for r in back.collect()] == [True, True]
    texts = spark.createDataFrame([("",), ("{}",), ("[1]",), (None,)], "j string")
    assert not any(r["ok"] for r in texts.select(O.valid_overlay(O.overlay_of(F.col("j"))).alias("ok")).collect())


def test_carried(spark):
    """Against the closed form of the similarity and a search of all triangles."""
    tris, mesh = grid(spark)
    rng = np.random.default_rng(3)
    src = rng.normal(size=(12, 3))
    dst = src @ np.linalg.qr(rng.normal(size=(3, 3)))[0] * 1.7 + [3, 3, 0] + rng.normal(size=(12, 3)) * 0.05
    pts = rng.normal(size=(9, 3))
    pairs = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(src, dst, strict=True)] + [(2, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "g long, x double, y double, z double, qx double, qy double, qz double")
    lines = spark.createDataFrame([(g, i // 3, i % 3, *map(float, p)) for g in (1, 2, 3) for i, p in enumerate(pts)], "g long, line long, seq long, x double, y double, z double")
    s, d = src - src.mean(0), dst - dst.mean(0)
    u, k, vt = np.linalg.svd(d.T @ s / len(s))
    flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    turn, size = u @ flip @ vt, (k * np.diag(flip)).sum() / (s**2).sum() * len(s)
    moved = (pts - src.mean(0)) @ turn.T * size + dst.mean(0)
    got = O.carried(lines, pairs, tris, "g").orderBy("line", "seq").collect()
    assert [r["g"] for r in got] == [1] * 9
    for r, p in zip(got, moved, strict=True):
        assert np.allclose([r["x"], r["y"], r["z"]], nearest(p, mesh)[2], atol=1e-6)


def test_margins(spark):
    far = spark.range(1).select(F.inline(O.margin_distances([F.lit(0.5), F.lit(0.0)], {"a": (0.5, 0.5)}, {"e": ((0.0, 0.25), (1.0, 0.25))}, 200.0))).collect()
    assert [(r["name"], r["mm"]) for r in far] == [("a", 100.0), ("e", 50.0)]
    flat = spark.createDataFrame([(1, 0.0), (1, 360.0), (2, 5.0), (3, None)], "g long, y double")
    assert {r["g"]: r["units_per_mm"] for r in O.units_per_mm(flat, ["g"]).collect()} == {1: 2.0, 2: 1.0, 3: 1.0}


def test_export_audits_of_odd_payloads(spark):
    texts = [None, "", "no json", "[]", "5", '{"password":7}', '{"Token":{"kept_present":1,"a":true,"b":null,"c":" NULL "}}', '{"raw_image_sent":{"raw_video_sent":[false,1]}}', '{"a":["data:image/png,1"],"b":"data:image/png,1"}', '{"raw_image_sent":{}}', '{"made_at":"a@b.co","mail":"A@B.CO"}', '{"Raw_Image_Sent":true}', '{"token":["x_present",3]}']
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("path", F.lit(1))
    leaves = A.json_leaves(df, "k", "t")
    said = lambda out, *more: sorted((r["k"], ".".join(r["path"]), *(r[m] for m in more)) for r in out.collect())
    assert said(A.secret_leaks(leaves)) == [(5, "password"), (12, "token.0"), (12, "token.1")]
    assert said(A.raw_media_paths(leaves, "k")) == [(7, "raw_image_sent"), (7, "raw_image_sent.raw_video_sent"), (8, "b")]
    found = said(A.export_violations(leaves), "code")
    assert (10, "mail", "pii_pattern_present") in found and not [f for f in found if f[1] == "made_at"]
    assert (11, "Raw_Image_Sent", "raw_media_flag_true") in found and (5, "password", "secret_value_present") not in found and (12, "token.0", "secret_value_present") in found
