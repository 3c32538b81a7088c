"""Queries of the geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators import geometry as G
from isoline.operators import surface as U
from isoline.plans.registry import QUERIES, SQL, query, rounded
from isoline.sources.tables import LANDMARKS, frames, points, read, triangle_corners

TRIANGLES = LANDMARKS - 2
#: SQL of points(): a vector's first nine numbers.
POINTS = "p AS (SELECT vec_id id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE {n}" for i, n in enumerate(("x", "y", "z", "tx", "ty", "tz", "qx", "qy", "qz"))) + " FROM embeddings)"
DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


@query(f"""WITH pt AS (SELECT event_id, user_id frame, event_id % {TRIANGLES} tri, (event_id % 7)/14e0 u, (event_id % 5)/10e0 v FROM events)
 SELECT event_id, frame, tri, {", ".join(f"round(u*embedding[tri*3+{i + 1}]::DOUBLE*100+v*embedding[tri*3+{i + 4}]::DOUBLE*100+(1-u-v)*embedding[tri*3+{i + 7}]::DOUBLE*100,4)+0 {n}" for i, n in enumerate("xyz"))}
 FROM pt JOIN embeddings ON vec_id=frame""")
def bary_map_points(spark, d):
    e = F.col("event_id")
    pts = read(spark, d, "events").select("event_id", F.col("user_id").alias("frame"), (e % TRIANGLES).cast("int").alias("tri"), (e % 7 / 14).alias("u"), (e % 5 / 10).alias("v"))
    out = G.mapped(pts, frames(spark, d), "frame", triangle_corners(F.col("embedding"), F.col("tri")))
    return rounded(out.select("event_id", "frame", F.col("tri").cast("long").alias("tri"), "x", "y", "z"))


@query("""WITH t AS (SELECT vec_id frame, unnest(range(19)) tri, embedding e FROM embeddings),
 n AS (SELECT frame, tri, 1e4*((e[tri*3+4]::DOUBLE-e[tri*3+1]::DOUBLE)*(e[tri*3+8]::DOUBLE-e[tri*3+2]::DOUBLE)-(e[tri*3+5]::DOUBLE-e[tri*3+2]::DOUBLE)*(e[tri*3+7]::DOUBLE-e[tri*3+1]::DOUBLE)) nz FROM t),
 s AS (SELECT *, CASE WHEN avg(nz) FILTER (WHERE tri IN (0,1)) OVER (PARTITION BY frame)>=0 THEN 1 ELSE -1 END sg FROM n)
 SELECT frame, count(*) FILTER (WHERE sg*nz>=-0.05 AND abs(nz)>=1 AND tri NOT IN (12,13,14)) visible, string_agg(tri::VARCHAR, ',' ORDER BY tri) FILTER (WHERE sg*nz>=-0.05 AND abs(nz)>=1 AND tri NOT IN (12,13,14)) triangles FROM s GROUP BY 1""")
def visibility_cull(spark, d):
    inner = {13, 14, 15}
    hidden = {t for t in range(TRIANGLES) if len({t, t + 1, t + 2} & inner) >= 2}
    vis = G.facing(F.col("embedding"), TRIANGLES, triangle_corners, {t for t in range(TRIANGLES) if 1 in (t, t + 1, t + 2)}, hidden, -0.05, 1.0)
    out = frames(spark, d).select("frame", vis.alias("v"))
    seen = F.filter(F.transform("v", lambda x, t: F.when(x, t)), lambda t: t.isNotNull())
    return out.select("frame", F.size(seen).cast("long").alias("visible"), F.when(F.size(seen) > 0, F.array_join(seen.cast("array<string>"), ",")).alias("triangles"))


NORM = f"""{POINTS}, b AS (SELECT label, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p GROUP BY 1),
 n AS (SELECT p.*, least(greatest((x-x0)/greatest(x1-x0,1e-9),0),1) nx, least(greatest((y-y0)/greatest(y1-y0,1e-9),0),1) ny FROM p JOIN b USING(label))"""


def _normalised(spark, d):
    rows = G.boxed(points(spark, d), ["label"])
    return rows.withColumns({"nx": G.normalised(F.col("x"), F.col("x0"), F.col("x1")), "ny": G.normalised(F.col("y"), F.col("y0"), F.col("y1"))})


@query(f"WITH {NORM} SELECT id, round(nx*200,4)+0 px, round((1-ny)*300,4)+0 py, round(z*200,4)+0 pz FROM n")
def bbox_face_frame(spark, d):
    return rounded(_normalised(spark, d).select("id", (F.col("nx") * 200).alias("px"), ((1 - F.col("ny")) * 300).alias("py"), (F.col("z") * 200).alias("pz")))


@query(f"WITH {NORM} SELECT id, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _, _ in G.REGIONS) + " END region, CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, _, s, _ in G.REGIONS) + " END subunit, CASE " + " ".join(f"WHEN {c} THEN {k}" for c, _, _, k in G.REGIONS) + "::DOUBLE END confidence, round(least(" + ",".join(f"abs(nx-{b}e0)" for b in (0.12, 0.22, 0.43, 0.57, 0.78, 0.88)) + "," + ",".join(f"abs(ny-{b}e0)" for b in (0.22, 0.34, 0.47, 0.58, 0.68, 0.80)) + "),4) margin FROM n")
def region_classify(spark, d):
    rows = _normalised(spark, d).withColumn("r", G.region())
    margin = F.least(*(F.abs(F.col("nx") - b) for b in (0.12, 0.22, 0.43, 0.57, 0.78, 0.88)), *(F.abs(F.col("ny") - b) for b in (0.22, 0.34, 0.47, 0.58, 0.68, 0.80)))
    return rounded(rows.select("id", "r.region", "r.subunit", "r.confidence", margin.alias("margin")))


SEGMENTS = {"eyelid": ((0.2, 0.6), (0.42, 0.6)), "lip": ((0.34, 0.3), (0.66, 0.3)), "ala": ((0.36, 0.45), (0.36, 0.45))}


def _segment_sql(a, b):
    (x0, y0), (x1, y1) = a, b
    size = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = f"least(greatest(((nx-{x0}e0)*{x1 - x0!r}::DOUBLE+(ny-{y0}e0)*{y1 - y0!r}::DOUBLE)/{size!r}::DOUBLE,0),1)" if size > 1e-12 else "0"
    return f"sqrt(pow(nx-({x0}e0+{t}*{x1 - x0!r}::DOUBLE),2)+pow(ny-({y0}e0+{t}*{y1 - y0!r}::DOUBLE),2))*180"


@query(f"WITH {NORM}, s AS (SELECT id, unnest({list(SEGMENTS)}) margin, unnest([{', '.join(_segment_sql(*s) for s in SEGMENTS.values())}]) mm FROM n) SELECT id, arg_min(margin,(round(mm,9),margin)) nearest, round(min(mm),4) distance_mm, count(*) FILTER (WHERE mm<=28) nearby FROM s GROUP BY 1")
def margin_distance(spark, d):
    p = [F.col("nx"), F.col("ny")]
    lits = lambda q: [F.lit(v) for v in q]
    ds = F.array(*(F.struct(F.round(E.closest_on_segment(p, lits(a), lits(b)) * 180, 9).alias("mm"), F.lit(n).alias("margin")) for n, (a, b) in SEGMENTS.items()))
    rows = _normalised(spark, d).select("id", ds.alias("s"))
    return rounded(rows.select("id", F.array_min("s")["margin"].alias("nearest"), F.array_min("s")["mm"].alias("distance_mm"), F.size(F.filter("s", lambda s: s["mm"] <= 28)).cast("long").alias("nearby")))


TRI = f"""{POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id)-1 r FROM p), m AS (SELECT label, r//3 tri, {", ".join(f"max({n}) FILTER (WHERE r%3={j}) {n}{j}" for j in range(3) for n in "xyz")} FROM k GROUP BY 1,2)"""


def _triangles(spark, d):
    """Triangles of each label: its points in threes."""
    from pyspark.sql import Window as W

    rows = points(spark, d).withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("id")) - 1)
    return rows.groupBy("label", F.floor(F.col("r") / 3).alias("tri")).agg(*(F.max(F.when(F.col("r") % 3 == j, F.col(n))).alias(f"{n}{j}") for j in range(3) for n in "xyz")).na.drop()


@query(f"""WITH {TRI}, c AS (SELECT id, tri, x1-x0 e0, y1-y0 e1, x2-x0 f0, y2-y0 f1, x-x0 g0, y-y0 g1, z0, z1, z2 FROM p JOIN m USING(label) WHERE x2 IS NOT NULL AND x1 IS NOT NULL),
 w AS (SELECT id, tri, z0, z1, z2, e0*e0+e1*e1 d00, e0*f0+e1*f1 d01, f0*f0+f1*f1 d11, g0*e0+g1*e1 d20, g0*f0+g1*f1 d21 FROM c),
 q AS (SELECT id, tri, z0, z1, z2, (d11*d20-d01*d21)/CASE WHEN abs(d00*d11-d01*d01)<1e-12 THEN 1e-12 ELSE d00*d11-d01*d01 END v, (d00*d21-d01*d20)/CASE WHEN abs(d00*d11-d01*d01)<1e-12 THEN 1e-12 ELSE d00*d11-d01*d01 END w FROM w)
 SELECT id, CAST(arg_min(tri,(CASE WHEN v>=0 AND w>=0 AND 1-v-w>=0 THEN 0 ELSE 1 END, CASE WHEN v>=0 AND w>=0 AND 1-v-w>=0 THEN -round((z0+z1+z2)/3,9) ELSE -round(least(v,w,1-v-w),9) END, tri)) AS BIGINT) tri, bool_or(v>=0 AND w>=0 AND 1-v-w>=0) inside FROM q GROUP BY 1""")
def bary_locate(spark, d):
    """The triangle of its label that each point lies in; of several the one with the greatest mean z, of none the one missed least."""
    return U.located(points(spark, d), _triangles(spark, d), ["label"]).select("id", F.col("tri").cast("long").alias("tri"), "inside")


def _edge_sql(a, b):
    d = lambda n: f"({n}{b}-{n}{a})"
    t = "least(greatest((" + "+".join(f"({n}-{n}{a})*{d(n)}" for n in "xyz") + ")/greatest(" + "+".join(f"{d(n)}*{d(n)}" for n in "xyz") + ",1e-12),0),1)"
    return "sqrt(" + "+".join(f"pow({n}-({n}{a}+{t}*{d(n)}),2)" for n in "xyz") + ")"


@query(f"""WITH {TRI}, c AS (SELECT id, tri, x, y, z, {", ".join(f"{n}{j}" for j in range(3) for n in "xyz")}, {_edge_sql(0, 1)} g1, {_edge_sql(1, 2)} g2, {_edge_sql(2, 0)} g3,
 {"+".join(f"pow({n}1-{n}0,2)" for n in "xyz")} d00, {"+".join(f"({n}1-{n}0)*({n}2-{n}0)" for n in "xyz")} d01, {"+".join(f"pow({n}2-{n}0,2)" for n in "xyz")} d11, {"+".join(f"({n}-{n}0)*({n}1-{n}0)" for n in "xyz")} d20, {"+".join(f"({n}-{n}0)*({n}2-{n}0)" for n in "xyz")} d21 FROM p JOIN m USING(label) WHERE x2 IS NOT NULL AND x1 IS NOT NULL),
 q AS (SELECT *, (d11*d20-d01*d21)/(d00*d11-d01*d01) v, (d00*d21-d01*d20)/(d00*d11-d01*d01) w FROM c),
 r AS (SELECT id, tri, round(CASE WHEN v>=0 AND w>=0 AND 1-v-w>=0 THEN sqrt({"+".join(f"pow({n}-((1-v-w)*{n}0+v*{n}1+w*{n}2),2)" for n in "xyz")}) ELSE least(g1,g2,g3) END,9) dist FROM q)
 SELECT id, CAST(arg_min(tri,(dist,tri)) AS BIGINT) tri, round(min(dist),4) distance FROM r GROUP BY 1""")
def closest_triangle(spark, d):
    return rounded(U.closest(points(spark, d), _triangles(spark, d), ["label"]).select("id", F.col("tri").cast("long").alias("tri"), "distance"))


def _others(spark, d):
    return points(spark, d).select("label", F.col("id").alias("other_id"), *(F.col(n).alias(f"o{n}") for n in ("x", "y", "z", "tx", "ty", "tz")))


@query(f"""WITH {POINTS}, r AS (SELECT label, 0.18*sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)+pow(max(z)-min(z),2)) reach FROM p GROUP BY 1),
 q AS (SELECT a.label, a.id, b.tx, b.ty, b.tz, {DIST} dd, b.id oid FROM p a JOIN p b ON a.label=b.label AND a.id<>b.id),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dd, oid) n FROM q QUALIFY n<=7), f AS (SELECT *, first_value(tx) OVER w fx, first_value(ty) OVER w fy, first_value(tz) OVER w fz FROM k WINDOW w AS (PARTITION BY id ORDER BY n)),
 s AS (SELECT label, id, sum(sg*tx/(dd+1e-6)) sx, sum(sg*ty/(dd+1e-6)) sy, sum(sg*tz/(dd+1e-6)) sz, min(dd) nearest, count(*) support FROM (SELECT *, CASE WHEN tx*fx+ty*fy+tz*fz<0 THEN -1 ELSE 1 END sg FROM f) GROUP BY 1,2)
 SELECT id, round(sx/sqrt(sx*sx+sy*sy+sz*sz),4)+0 dx, round(sy/sqrt(sx*sx+sy*sy+sz*sz),4)+0 dy, round(sz/sqrt(sx*sx+sy*sy+sz*sz),4)+0 dz, support, round(nearest,4) nearest, round(least(greatest(1-nearest/greatest(reach,1e-9),0),1),4)+0 confidence FROM s JOIN r USING(label)""")
def knn_direction(spark, d):
    return _directions(spark, d, _others(spark, d))


def _directions(spark, d, others):
    pts = points(spark, d)
    reach = pts.groupBy("label").agg((0.18 * F.sqrt(sum((F.max(n) - F.min(n)) ** 2 for n in "xyz"))).alias("reach"))
    near = G.nearest_k(pts.select("label", "id", "x", "y", "z"), others, ["label"], 7).join(reach, "label")
    return rounded(G.direction_field(near, ["label"], F.col("reach")).drop("label"))


@query(f"""WITH {POINTS} SELECT a.id, arg_min(b.id,({DIST},b.id)) nearest_id, round(min({DIST}),4) distance FROM p a JOIN p b ON a.label=b.label AND a.id<>b.id GROUP BY 1""")
def nearest_one(spark, d):
    return _nearest(spark, d, _others(spark, d))


def _nearest(spark, d, others):
    near = G.nearest_k(points(spark, d).select("label", "id", "x", "y", "z"), others, ["label"], 1)
    return rounded(near.select("id", F.col("other_id").alias("nearest_id"), F.col("d").alias("distance")))


@query(f"""WITH {POINTS}, v AS (SELECT label, id//50 view, id, x, y, z, 1+id%3 w FROM p), q AS (SELECT a.label, a.view, a.id, b.x, b.y, b.z, b.w, {DIST} dd FROM v a JOIN v b USING(label, view)),
 t AS (SELECT label, view, id, round(sum(dd),9) total FROM q GROUP BY ALL), m AS (SELECT label, view, arg_min(id,(total,id)) medoid FROM t GROUP BY ALL)
 SELECT label, view, medoid, count(*) support, round(sum(w*x)/(sum(w)+1e-12),4)+0 x, round(sum(w*y)/(sum(w)+1e-12),4)+0 y, round(sum(w*z)/(sum(w)+1e-12),4)+0 z FROM q JOIN m USING(label, view) WHERE id=medoid AND dd<=0.25 GROUP BY ALL""")
def medoid_fuse(spark, d):
    views = points(spark, d).select("label", F.floor(F.col("id") / 50).alias("view"), "id", "x", "y", "z", (1 + F.col("id") % 3).cast("double").alias("w"))
    return rounded(G.medoid_fused(views, ["label", "view"], 0.25))


@query(f"""WITH {POINTS}, q AS (SELECT a.id, exp(-0.5*pow({DIST}/0.1,2)) w, b.tx, b.ty, b.tz FROM p a JOIN p b ON a.label=b.label WHERE {DIST}<=0.2),
 m AS (SELECT id, sum(w*tx)/greatest(sum(w),1e-12) x, sum(w*ty)/greatest(sum(w),1e-12) y, sum(w*tz)/greatest(sum(w),1e-12) z FROM q GROUP BY 1),
 c AS (SELECT *, CASE WHEN sqrt(x*x+y*y+z*z)>0.1 THEN 0.1/sqrt(x*x+y*y+z*z) ELSE 1 END k FROM m) SELECT id, round(x*k,4)+0 dx, round(y*k,4)+0 dy, round(z*k,4)+0 dz FROM c""")
def gaussian_residual(spark, d):
    return _residuals(spark, d, _others(spark, d))


def _residuals(spark, d, others):
    anchors = others.select("label", "ox", "oy", "oz", *(F.col(f"ot{n}").alias(f"r{n}") for n in "xyz"))
    return rounded(G.residual_field(points(spark, d).select("label", "id", "x", "y", "z"), anchors, ["label"], 0.1, 0.2, 0.1).drop("label"))


@query(f"""WITH {POINTS} SELECT label, round(sum(x),4)+0 m_x, round(sum(qx),4)+0 m_qx, round(sum(x*qx),4)+0 m_xqx, round(sum(y*qz),4)+0 m_yqz, round(sum(x*x+y*y+z*z),4) m_ss FROM p GROUP BY 1""")
def umeyama_moments(spark, d):
    return rounded(G.moments(points(spark, d), ["label"]).select("label", "m_x", "m_qx", "m_xqx", "m_yqz", "m_ss"))


@query()
def umeyama_fit(spark, d):
    return rounded(G.similarity(points(spark, d), "label"))


@query(f"""WITH {POINTS} SELECT a.id, count(*) neighbours, round(min({DIST}),4) nearest FROM p a JOIN p b ON a.id<>b.id AND {DIST}<=0.05 GROUP BY 1""")
def grid_bucket_join(spark, d):
    pts = points(spark, d).select("id", "x", "y", "z")
    other = pts.select(F.col("id").alias("other_id"), *(F.col(n).alias(f"o{n}") for n in "xyz"))
    return rounded(G.within(pts, other, 0.05).filter("id <> other_id").groupBy("id").agg(F.count("*").alias("neighbours"), F.min("d").alias("nearest")))


@query(f"""WITH {POINTS} SELECT id, label FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.id<a.id AND {DIST}<=0.04)""")
def hash_exclusion(spark, d):
    """Points that no earlier point is close to."""
    pts = points(spark, d).select("id", "label", "x", "y", "z")
    other = pts.select(F.col("id").alias("other_id"), *(F.col(n).alias(f"o{n}") for n in "xyz"))
    close = G.within(pts.drop("label"), other, 0.04).filter("other_id < id").select("id").distinct()
    return pts.select("id", "label").join(close, "id", "left_anti")


FACES = "f AS (SELECT vec_id % 40 mesh, vec_id i0, vec_id+40 i1, vec_id+80+40*(label%2) i2 FROM embeddings)"


def _faces(spark, d):
    v = F.col("vec_id")
    return read(spark, d, "embeddings").select((v % 40).alias("mesh"), v.alias("i0"), (v + 40).alias("i1"), (v + 80 + 40 * (F.col("label") % 2)).alias("i2"))


@query(f"WITH {FACES}, e AS (SELECT mesh, least(i0,i1) a, greatest(i0,i1) b FROM f UNION ALL SELECT mesh, least(i1,i2), greatest(i1,i2) FROM f UNION ALL SELECT mesh, least(i2,i0), greatest(i2,i0) FROM f) SELECT mesh, a, b FROM e GROUP BY ALL HAVING count(*)=1")
def edge_boundary(spark, d):
    return G.boundary_edges(_faces(spark, d), ["mesh"])


@query("""WITH e AS (SELECT l_suppkey a, l_partkey+1000000 b, 1e0 rest, l_quantity/25 length, l_discount+0.01 w FROM lineitem), v AS (SELECT a v, * FROM e UNION ALL SELECT b, * FROM e)
 SELECT v, round(sum(w*(length-rest))/greatest(sum(w),1e-9),4)+0 tension, count(*) n FROM v GROUP BY 1""")
def vertex_tension(spark, d):
    springs = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"), F.lit(1.0).alias("rest"), (F.col("l_quantity") / 25).alias("length"), (F.col("l_discount") + 0.01).alias("w"))
    return rounded(G.tension(springs, []))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey a, l_suppkey+1+l_partkey%3 b, min(l_quantity) w FROM lineitem GROUP BY ALL), s AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), z AS (SELECT count(DISTINCT a) z FROM s),
 r AS (SELECT 0 k, 0::BIGINT v, 0e0 d UNION ALL SELECT k+1, v, min(d) FROM (SELECT k, b v, d+w d FROM r JOIN s ON r.v=s.a JOIN z ON k<z UNION ALL SELECT k, v, d FROM r JOIN z ON k<z) GROUP BY k, v)
 SELECT v, round(min(d),4) d FROM r GROUP BY 1""")
def surface_path(spark, d):
    """Least lengths from vertex 0 over any number of edges."""
    return rounded(G.shortest_paths(*_surface(spark, d)))


def _surface(spark, d):
    e = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("b")).agg(F.min("l_quantity").alias("w"))
    start = read(spark, d, "supplier").filter("s_suppkey = 0").select(F.col("s_suppkey").alias("v"))
    return e, start


#: Names under which queries over all rows were registered beside bounded ones.
for name in ("bary_locate", "closest_triangle", "knn_direction", "nearest_one", "gaussian_residual", "surface_path"):
    QUERIES[f"{name}_whole"], SQL[f"{name}_whole"] = QUERIES[name], SQL[name]
