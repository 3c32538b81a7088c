"""Queries of rays, lines, normals and directions on meshes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isoline.operators import geometry as G
from isoline.operators import meshing as T
from isoline.plans.geometry import POINTS, TRI, _edge_sql, _triangles
from isoline.plans.registry import query, rounded
from isoline.sources import meshes as M
from isoline.sources.tables import cornered, points, read, terrain

#: SQL of terrain(): vertices tv, faces tf, triangles tm.
TERRAIN = f"""g AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 r, count(*) OVER (PARTITION BY label) n, embedding e FROM embeddings),
 tv AS (SELECT label, r*21+c v, c::DOUBLE x, r::DOUBLE y, e[c+1]::DOUBLE z FROM (SELECT label, r, e, unnest(range(21)) c FROM g)),
 tf AS (SELECT label, (r*20+c)*2+h tri, r*21+c+h*22 i0, r*21+c+1+h*20 i1, r*21+c+21-h*20 i2 FROM (SELECT *, unnest([0,1]) h FROM (SELECT label, r, n, unnest(range(20)) c FROM g WHERE r<n-1))),
 tm AS (SELECT f.label, f.tri, {", ".join(f"{t}.{n} {n}{j}" for j, t in enumerate("abc") for n in "xyz")} FROM tf f {" ".join(f"JOIN tv {t} ON {t}.label=f.label AND {t}.v=f.i{j}" for j, t in enumerate("abc"))})"""


def _mesh(spark, d):
    vertices, faces = terrain(spark, d)
    return cornered(faces, vertices, ["label"])


def _rows(spark, d):
    """Vectors with their row in their label's terrain."""
    from pyspark.sql import Window as W

    return read(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), "embedding", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("double").alias("r"))


def _cross(a, b):
    return [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]


def _dot(a, b):
    return "(" + "+".join(f"{x}*{y}" for x, y in zip(a, b, strict=True)) + ")"


_E1, _E2, _S, _D = ([f"({n}1-{n}0)" for n in "xyz"], [f"({n}2-{n}0)" for n in "xyz"], [f"(o{n}-{n}0)" for n in "xyz"], ["dx", "dy", "dz"])
CAMERA, LENS = [[500.0, 0.0, 320.0], [0.0, 500.0, 240.0]], (0.05, -0.01, 0.001, -0.0005, 0.0)
_LENS_SQL = ", ".join(
    f"q{i + 1} AS (SELECT * EXCLUDE (nx, ny), (sx-(2*0.001e0*nx*ny+(-0.0005e0)*((nx*nx+ny*ny)+2*nx*nx)))*(1/(1+((0e0*(nx*nx+ny*ny)+(-0.01e0))*(nx*nx+ny*ny)+0.05e0)*(nx*nx+ny*ny))) nx, (sy-(0.001e0*((nx*nx+ny*ny)+2*ny*ny)+2*(-0.0005e0)*nx*ny))*(1/(1+((0e0*(nx*nx+ny*ny)+(-0.01e0))*(nx*nx+ny*ny)+0.05e0)*(nx*nx+ny*ny))) ny FROM q{i})"
    for i in range(5)
)
RAYS = f"""q0 AS (SELECT label, vec_id id, r, (320e0+1600e0*e[1]::DOUBLE-320)/500 sx, (240e0+1600e0*e[2]::DOUBLE-240)/500 sy, sx nx, sy ny FROM g), {_LENS_SQL},
 ray AS (SELECT label, id, 10e0 ox, r::DOUBLE oy, 30e0 oz, nx/sqrt(nx*nx+ny*ny+1) dx, -(ny/sqrt(nx*nx+ny*ny+1)) dy, -(1/sqrt(nx*nx+ny*ny+1)) dz FROM q5)"""


def _rays(spark, d):
    """A ray for each vector: a camera above its row looks straight down, through the pixel that its first two numbers tell."""
    rows = _rows(spark, d)
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = T.undistorted(rows, 320 + 1600 * e(0), 240 + 1600 * e(1), CAMERA, LENS)
    o, way = T.world_ray(F.col("nx"), F.col("ny"), [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]], [F.lit(-10.0), F.col("r"), F.lit(30.0)])
    return rows.select("label", "id", *(c.alias(f"o{n}") for c, n in zip(o, "xyz", strict=True)), *(c.alias(f"d{n}") for c, n in zip(way, "xyz", strict=True)))


@query(f"""WITH {TERRAIN}, {RAYS}, h AS (SELECT label, id, ox, oy, oz, dx, dy, dz, tri, {_dot(_E1, _cross(_D, _E2))} det, {_dot(_E2, _cross(_S, _E1))} tt, {_dot(_S, _cross(_D, _E2))} uu, {_dot(_D, _cross(_S, _E1))} vv FROM ray JOIN tm USING(label)),
 k AS (SELECT *, tt/det t FROM h WHERE abs(det)>1e-12 AND tt/det>=0 AND uu/det>=0 AND vv/det>=0 AND uu/det+vv/det<=1),
 b AS (SELECT label, id, arg_min(struct_pack(tri:=tri, t:=t, x:=ox+t*dx, y:=oy+t*dy, z:=oz+t*dz), (round(t,9), tri)) b FROM k GROUP BY ALL)
 SELECT ray.id, b IS NOT NULL hit, CAST(b.tri AS BIGINT) tri, round(b.t,4) t, round(b.x,4)+0 x, round(b.y,4)+0 y, round(b.z,4)+0 z FROM ray LEFT JOIN b USING(label, id)""")
def ray_hits(spark, d):
    """Where the camera rays of all vectors first meet the terrain of their label, if they do."""
    rays = _rays(spark, d)
    hits = T.first_hits(rays, _mesh(spark, d), ["label"])
    return rounded(rays.select("label", "id").join(hits, ["label", "id"], "left").select("id", F.col("tri").isNotNull().alias("hit"), "tri", "t", "x", "y", "z"))


@query(f"""WITH {TERRAIN}, w AS (SELECT label, unnest([i0,i1,i2]) v, {", ".join(f"{c} s{n}" for c, n in zip(_cross(_E1, _E2), "xyz", strict=True))} FROM tm JOIN tf USING(label, tri)), s AS (SELECT label, v, sum(sx) sx, sum(sy) sy, sum(sz) sz, count(*) faces FROM w GROUP BY ALL)
 SELECT label, v, {", ".join(f"round(s{n}/sqrt(sx*sx+sy*sy+sz*sz),4)+0 n{n}" for n in "xyz")}, faces FROM s""")
def vertex_normals(spark, d):
    vertices, faces = terrain(spark, d)
    return rounded(T.vertex_normals(faces, vertices, ["label"]))


@query(f"""WITH {TERRAIN}, e AS (SELECT DISTINCT label, least(a,b) a, greatest(a,b) b FROM (SELECT label, unnest([i0,i1,i2]) a, unnest([i1,i2,i0]) b FROM tf)),
 l AS (SELECT label, sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2)) l FROM e JOIN tv p USING(label) JOIN tv q USING(label) WHERE p.v=a AND q.v=b) SELECT label, count(*) edges, round(avg(l),4) mean_length FROM l GROUP BY 1""")
def edge_lengths(spark, d):
    vertices, faces = terrain(spark, d)
    return rounded(T.edge_lengths(faces, vertices, ["label"]))


def _gap_sql(way: str, pts: str, tris: str) -> str:
    sq = lambda a, b: "+".join(f"({a.format(n=n)})*({b.format(n=n)})" for n in "xyz")
    return f"""(SELECT label, '{way}' way, id, min(round(CASE WHEN v>=0 AND w>=0 AND 1-v-w>=0 THEN sqrt({"+".join(f"pow({n}-((1-v-w)*{n}0+v*{n}1+w*{n}2),2)" for n in "xyz")}) ELSE least(g1,g2,g3) END,9)) dist FROM (
  SELECT *, (d11*d20-d01*d21)/(d00*d11-d01*d01) v, (d00*d21-d01*d20)/(d00*d11-d01*d01) w FROM (SELECT p.label, p.id, p.x, p.y, p.z, {", ".join(f"{n}{j}" for j in range(3) for n in "xyz")}, {_edge_sql(0, 1)} g1, {_edge_sql(1, 2)} g2, {_edge_sql(2, 0)} g3,
  {sq("{n}1-{n}0", "{n}1-{n}0")} d00, {sq("{n}1-{n}0", "{n}2-{n}0")} d01, {sq("{n}2-{n}0", "{n}2-{n}0")} d11, {sq("{n}-{n}0", "{n}1-{n}0")} d20, {sq("{n}-{n}0", "{n}2-{n}0")} d21 FROM {pts} p JOIN {tris} m ON m.label=p.label WHERE x2 IS NOT NULL AND x1 IS NOT NULL)) GROUP BY ALL)"""


@query(f"""WITH {TRI}, p2 AS (SELECT label-1 label, id, x, y, z FROM p), m2 AS (SELECT * REPLACE (label-1 AS label) FROM m), k2 AS ({_gap_sql("own to next", "p", "m2")} UNION ALL {_gap_sql("next to own", "p2", "m")})
 SELECT label, way, count(*) n, round(avg(dist),4) mean, round(quantile_cont(dist,0.95),4) p95, round(max(dist),4) "max" FROM k2 GROUP BY ALL""")
def surface_gap(spark, d):
    """How far the points of a label lie from the next one's triangles, and the other way round."""
    pts, tris = points(spark, d).select("label", "id", "x", "y", "z"), _triangles(spark, d)
    later = lambda df: df.withColumn("label", F.col("label") - 1)
    return rounded(T.surface_distance({"own": pts, "next": later(pts)}, {"own": tris, "next": later(tris)}, ["label"]))


_W = ["((x1-px)*(y2-py)-(x2-px)*(y1-py))/ar", "((x2-px)*(y0-py)-(x0-px)*(y2-py))/ar"]
_AT = lambda x, y: [w.replace("px", x).replace("py", y) for w in _W]


@query(f"""WITH {TERRAIN}, s AS (SELECT label, vec_id line, k seg, 10+40*e[2*k+1]::DOUBLE ax, r+20*e[2*k+2]::DOUBLE ay, 10+40*e[2*k+3]::DOUBLE bx, r+20*e[2*k+4]::DOUBLE by_ FROM (SELECT *, unnest(range(3)) k FROM g)),
 w AS (SELECT *, (x1-x0)*(y2-y0)-(x2-x0)*(y1-y0) ar FROM s JOIN tm USING(label) WHERE least(ax,bx)<=greatest(x0,x1,x2)+1e-6 AND greatest(ax,bx)>=least(x0,x1,x2)-1e-6 AND least(ay,by_)<=greatest(y0,y1,y2)+1e-6 AND greatest(ay,by_)>=least(y0,y1,y2)-1e-6),
 b AS (SELECT *, {_AT("ax", "ay")[0]} wa, {_AT("ax", "ay")[1]} wb, {_AT("(ax+(bx-ax))", "(ay+(by_-ay))")[0]} ea, {_AT("(ax+(bx-ax))", "(ay+(by_-ay))")[1]} eb, 1-wa-wb wc, 1-ea-eb ec FROM w),
 t AS (SELECT *, greatest(0e0, {", ".join(f"CASE WHEN w{c}<0 AND e{c}>w{c} THEN w{c}/(w{c}-e{c}) END" for c in "abc")}) t0, least(1e0, {", ".join(f"CASE WHEN e{c}<0 AND w{c}>e{c} THEN w{c}/(w{c}-e{c}) END" for c in "abc")}) t1 FROM b WHERE {" AND ".join(f"NOT (w{c}<0 AND e{c}<0)" for c in "abc")})
 SELECT line, seg, tri, round(t0,4) t0, round(t1,4) t1, {", ".join(f"round(w{a}+t{i}*(e{a}-w{a}),4)+0 {b}{i}" for i in (0, 1) for a, b in (("a", "u"), ("b", "v")))}, round((t1-t0)*sqrt(pow(bx-ax,2)+pow(by_-ay,2)),4) length FROM t WHERE t1-t0>1e-9""")
def surface_lines(spark, d):
    """Lines of three segments for each vector, drawn flat, rebuilt on the terrain of their label."""
    e = lambda i: F.get("embedding", i).cast("double")
    rows = _rows(spark, d).withColumn("seg", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("k", F.col("seg") * 2)
    lines = rows.select("label", F.col("id").alias("line"), F.col("seg").cast("long").alias("seg"), (10 + 40 * e(F.col("k"))).alias("ax"), (F.col("r") + 20 * e(F.col("k") + 1)).alias("ay"), (10 + 40 * e(F.col("k") + 2)).alias("bx"), (F.col("r") + 20 * e(F.col("k") + 3)).alias("by_"))
    return rounded(T.clipped(lines, _mesh(spark, d), ["label"]).drop("label"))


SOURCE = """so AS (SELECT label, vec_id id, e[1]::DOUBLE x, e[2]::DOUBLE y, e[3]::DOUBLE z, e[4]::DOUBLE tx, e[5]::DOUBLE ty, e[6]::DOUBLE tz, least(greatest(coalesce(abs(e[7]::DOUBLE)*5,0),0),1) confidence FROM g)"""
TRANSFER = f"""{TERRAIN}, {SOURCE}, bs AS (SELECT label, {", ".join(f"min({n}) l{n}, max({n}) h{n}" for n in "xyz")} FROM so GROUP BY 1),
 bt AS (SELECT label, {", ".join(f"min(least({n}0,{n}1,{n}2)) m{n}, max(greatest({n}0,{n}1,{n}2)) k{n}" for n in "xyz")} FROM tm GROUP BY 1), bo AS (SELECT *, sqrt({"+".join(f"pow(k{n}-m{n},2)" for n in "xyz")}) dg, sqrt({"+".join(f"pow(k{n}-m{n},2)" for n in "xyz")})/greatest(sqrt({"+".join(f"pow(h{n}-l{n},2)" for n in "xyz")}),1e-9) ra FROM bs JOIN bt USING(label)),
 la AS (SELECT so.label, id, {", ".join(f"({n}-(l{n}+h{n})/2)*ra+(m{n}+k{n})/2 o{n}" for n in "xyz")}, {", ".join(f"t{n}/sqrt(tx*tx+ty*ty+tz*tz) v{n}" for n in "xyz")}, confidence FROM so JOIN bo USING(label)),
 ce AS (SELECT label, tri, {", ".join(f"({n}0+{n}1+{n}2)/3 {n}" for n in "xyz")} FROM tm),
 pa AS (SELECT ce.label, tri, id, vx, vy, vz, confidence, sqrt(pow(x-ox,2)+pow(y-oy,2)+pow(z-oz,2)) dd FROM ce JOIN la USING(label)), ne AS (SELECT *, row_number() OVER (PARTITION BY label, tri ORDER BY dd, id DESC) n FROM pa QUALIFY n<=7),
 fi AS (SELECT label, tri, id nearest, dd distance, vx fx, vy fy, vz fz FROM ne WHERE n=1), sg AS (SELECT *, CASE WHEN vx*fx+vy*fy+vz*fz<0 THEN -1 ELSE 1 END s, confidence/(dd+1e-6) w, 1/(dd+1e-6) p FROM ne JOIN fi USING(label, tri)),
 su AS (SELECT label, tri, nearest, distance, count(*) support, sum(w) w, sum(w*s*vx) mx, sum(w*s*vy) my, sum(w*s*vz) mz, sum(w*confidence)/sum(w) own FROM sg GROUP BY ALL), un AS (SELECT *, mx/sqrt(mx*mx+my*my+mz*mz) dx, my/sqrt(mx*mx+my*my+mz*mz) dy, mz/sqrt(mx*mx+my*my+mz*mz) dz FROM su),
 sp AS (SELECT label, tri, max(degrees(acos(least(greatest(s*(vx*dx+vy*dy+vz*dz),-1),1)))) spread FROM sg JOIN un USING(label, tri) GROUP BY ALL),
 tr AS (SELECT label, tri, dx, dy, dz, degrees(atan2(dy,dx)) angle, least(own, least(greatest(1-un.distance/greatest(dg*0.18,1e-9),0),1))*CASE WHEN spread>45 THEN 0.75 ELSE 1 END confidence, un.nearest, un.distance, support, spread FROM un JOIN sp USING(label, tri) JOIN bo USING(label))"""


def _transfer(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    source = _rows(spark, d).select("label", "id", *(e(i).alias(n) for i, n in enumerate(("x", "y", "z", "tx", "ty", "tz"))), (F.abs(e(6)) * 5).alias("confidence"))
    return T.transferred(source, _mesh(spark, d), ["label"])


@query(f"WITH {TRANSFER} SELECT label, tri, round(dx,3)+0 dx, round(dy,3)+0 dy, round(dz,3)+0 dz, round(angle,3)+0 angle, round(confidence,3)+0 confidence, nearest, round(distance,3)+0 distance, support, round(spread,3)+0 spread FROM tr")
def prior_transfer(spark, d):
    """The directions of each label's vectors handed to the triangles of its terrain."""
    return rounded(_transfer(spark, d), 3)


@query(f"WITH {TRANSFER} SELECT label, count(*) samples, CAST(count(*) FILTER (WHERE confidence<0.35) AS BIGINT) low, round(count(*) FILTER (WHERE confidence<0.35)/count(*),4) low_share, round(min(confidence),4)+0 least, round(avg(confidence),4)+0 mean, round(max(spread),4)+0 widest FROM tr GROUP BY 1")
def prior_transfer_coverage(spark, d):
    return rounded(T.coverage(_transfer(spark, d), ["label"]))


CUT = f"""{TERRAIN}, c AS (SELECT *, x-10 cx, y-10 cy, z cz, (x-10)*0.6e0+(y-10)*0.8e0 al FROM tv), ex AS (SELECT *, al*al/36e0+(pow(cx-al*0.6e0,2)+pow(cy-al*0.8e0,2)+pow(cz,2))/4e0<=1 removed, sqrt(cx*cx+cy*cy+cz*cz) far FROM c),
 ma AS (SELECT label, v, x, y, z, removed, CASE WHEN removed THEN 1 ELSE least(greatest((far/18-0.4e0)/0.6e0,0),1) END mask, (v%21 IN (0,20)) anchored FROM ex),
 ed AS (SELECT DISTINCT label, least(a,b) a, greatest(a,b) b FROM (SELECT label, unnest([i0,i1,i2]) a, unnest([i1,i2,i0]) b FROM tf)), sp AS (SELECT e.label, a, b, q.x-p.x dx, q.y-p.y dy, q.z-p.z dz, sqrt(pow(q.x-p.x,2)+pow(q.y-p.y,2)+pow(q.z-p.z,2)) l FROM ed e JOIN ma p ON p.label=e.label AND p.v=a JOIN ma q ON q.label=e.label AND q.v=b WHERE NOT p.removed AND NOT q.removed),
 fo AS (SELECT label, v, {", ".join(f"sum(f{n}) f{n}" for n in "xyz")} FROM (SELECT label, a v, {", ".join(f"0.2e0*3*(l-l*0.88e0)/l*d{n} f{n}" for n in "xyz")} FROM sp UNION ALL SELECT label, b, {", ".join(f"-0.2e0*3*(l-l*0.88e0)/l*d{n}" for n in "xyz")} FROM sp) GROUP BY ALL)"""


def _cut(spark, d):
    """Terrains with an ellipse about (10, 10, 0) cut out, held along two of their sides, and their edges as springs a tenth or so too short."""
    vertices, faces = terrain(spark, d)
    body = T.excised(vertices, ["label"], (10.0, 10.0, 0.0), (0.6, 0.8, 0.0), 6.0, 2.0)
    body = body.select("label", "v", *"xyz", *(F.col(n).alias(f"r{n}") for n in "xyz"), *(F.lit(0.0).alias(f"v{n}") for n in "xyz"), (F.col("v") % 21).isin(0, 20).alias("anchored"), "removed", "mask")
    ends = G.edges(faces, ["label"]).distinct()
    for s in "ab":
        ends = ends.join(vertices.select("label", F.col("v").alias(s), *(F.col(n).alias(f"{s}{n}") for n in "xyz")), ["label", s])
    rest = F.sqrt(sum(((F.col(f"b{n}") - F.col(f"a{n}")) ** 2 for n in "xyz"), F.lit(0.0))) * 0.88
    return body, ends.select("label", "a", "b", rest.alias("rest"), F.lit(3.0).alias("k"))


@query(f"""WITH {CUT} SELECT label, v, removed, round(mask,4)+0 mask, {", ".join(f"round({n}+CASE WHEN anchored OR removed THEN 0 ELSE coalesce(f{n},0)*0.5*0.9*0.5 END,5)+0 {n}" for n in "xyz")} FROM ma LEFT JOIN fo USING(label, v)""")
def excision_step(spark, d):
    """One step of the cut terrains: at rest, no tether pulls yet."""
    return rounded(T.tethered_step(*_cut(spark, d), ["label"]).select("label", "v", "removed", F.round("mask", 4).alias("mask"), "x", "y", "z"), 5)


RING = [(8 + 2 * i, 9 + 2 * i) for i in range(8)]


@query(f"""WITH k AS (SELECT vec_id, embedding e, vec_id%180*{math.pi!r}/180 an, 2+vec_id%5 dm, 1+vec_id%3 mg FROM embeddings), o AS (SELECT *, {", ".join(f"{f} {n}" for n, f in (("px", "list_transform(range(8), lambda i: e[9+2*i]::DOUBLE*40)"), ("py", "list_transform(range(8), lambda i: e[10+2*i]::DOUBLE*40)")))} FROM k),
 w AS (SELECT vec_id, dm, mg, list_sum(px)/8 cx, list_sum(py)/8 cy, list_transform(range(1,9), lambda i: px[i]*cos(an)+py[i]*sin(an)) a, list_transform(range(1,9), lambda i: -px[i]*sin(an)+py[i]*cos(an)) b FROM o),
 s AS (SELECT *, (list_max(a)-list_min(a))/1.5 axis_mm, (list_max(b)-list_min(b))/1.5 perp_mm FROM w), t AS (SELECT *, greatest(dm,perp_mm)+2*mg width, greatest(dm,axis_mm)+2*mg covering FROM s), l AS (SELECT *, greatest(width*3,covering) target FROM t)
 SELECT vec_id, round(cx,4)+0 cx, round(cy,4)+0 cy, round(axis_mm,4)+0 axis_mm, round(perp_mm,4)+0 perp_mm, round(width,4)+0 width, round(covering,4)+0 covering, round(least(greatest(target,12),40),4)+0 length, round(greatest(covering-least(greatest(target,12),40),0),4)+0 deficit, target<12 short, target>40 long FROM l""")
def spindle_length(spark, d):
    """Size of a spindle about each vector's ring of eight points, along an axis of its own."""
    at = lambda i: (F.get("embedding", F.lit(i)).cast("double") * 40)
    ring = F.array(*(F.struct(at(i).alias("x"), at(j).alias("y")) for i, j in RING))
    v = F.col("vec_id")
    size = T.fusiform_length(ring, F.radians((v % 180).cast("double")), (2 + v % 5).cast("double"), (1 + v % 3).cast("double"), 1.5, 3.0, 12.0, 40.0)
    return rounded(read(spark, d, "embeddings").select("vec_id", size.alias("s")).select("vec_id", "s.*"))


@query("""WITH f AS (SELECT vec_id%40 mesh, embedding[1]::DOUBLE x FROM embeddings) SELECT mesh, count(*) vertices, CAST(CASE WHEN count(*)>=3 THEN count(*)-1 ELSE 0 END AS BIGINT) triangles, round(sum(x),4)+0 sum_x FROM f GROUP BY 1""")
def ply_binary(spark, d):
    """Meshes written as binary PLY, every other one with its greatest bytes first, a polygon over all vertices and a triangle each, and read from that."""
    rows = read(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("mesh"), F.struct("vec_id", F.slice("embedding", 1, 3).alias("p")).alias("r"))
    whole = rows.groupBy("mesh").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["p"]).alias("points"))
    n = F.size("points")
    ring = F.sequence(F.lit(0), n - 1)
    whole = whole.withColumn("faces", F.when(n >= 3, F.array(ring, F.array(F.lit(0), F.lit(1), F.lit(2)))).otherwise(F.array().cast("array<array<int>>"))).withColumn("big", F.col("mesh") % 2 == 1)
    parts = M.ply_parts(M.ply_encoded(whole, "mesh", "points", "faces", "big"), "mesh", "content")
    return rounded(parts.groupBy("mesh").agg(F.count("x").alias("vertices"), F.count("i0").alias("triangles"), F.sum("x").alias("sum_x")))
