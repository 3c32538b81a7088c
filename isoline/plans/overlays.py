"""Queries of lines and overlays taken to a surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import overlays as O
from isoline.plans.geometry import NORM, _normalised, _segment_sql
from isoline.plans.meshing import TERRAIN, _mesh, _rows
from isoline.plans.registry import query, rounded
from isoline.sources.tables import points, read


def _nearest_sql(pts: str) -> str:
    """SQL of the place of its label's terrain nearest each row of pts (label, line, pos, x, y, z): f (tri, u, v, w, x, y, z) and distance, from all pairs."""
    d = lambda a, b: "+".join(f"({a.format(n=n)})*({b.format(n=n)})" for n in "xyz")
    t = lambda a, b: f"least(greatest(({d('{n}-{n}' + str(a), '{n}' + str(b) + '-{n}' + str(a))})/greatest({d('{n}' + str(b) + '-{n}' + str(a), '{n}' + str(b) + '-{n}' + str(a))},1e-12),0),1)"
    g = lambda a, b, s: "+".join(f"pow({n}-{n}{a}-{s}*({n}{b}-{n}{a}),2)" for n in "xyz")
    return f"""(SELECT label, line, pos, arg_min({{'tri':tri,'u':fu,'v':fv,'w':fw,'x':fx,'y':fy,'z':fz}}, (round(dist,9),tri)) f, min(round(dist,9)) distance FROM (
 SELECT *, sqrt(pow(x-fx,2)+pow(y-fy,2)+pow(z-fz,2)) dist FROM (SELECT *, {", ".join(f"fu*{n}0+fv*{n}1+fw*{n}2 f{n}" for n in "xyz")} FROM (
 SELECT *, CASE WHEN ins THEN 1-v-w WHEN e=1 THEN 1-s1 WHEN e=2 THEN 0 ELSE s3 END fu, CASE WHEN ins THEN v WHEN e=1 THEN s1 WHEN e=2 THEN 1-s2 ELSE 0 END fv, CASE WHEN ins THEN w WHEN e=1 THEN 0 WHEN e=2 THEN s2 ELSE 1-s3 END fw FROM (
 SELECT *, v>=0 AND w>=0 AND 1-v-w>=0 ins, CASE WHEN g1<=g2 AND g1<=g3 THEN 1 WHEN g2<=g3 THEN 2 ELSE 3 END e FROM (
 SELECT *, (d11*d20-d01*d21)/(d00*d11-d01*d01) v, (d00*d21-d01*d20)/(d00*d11-d01*d01) w, {g(0, 1, "s1")} g1, {g(1, 2, "s2")} g2, {g(2, 0, "s3")} g3 FROM (
 SELECT q.label, line, pos, x, y, z, tri, {", ".join(f"{n}{j}" for j in range(3) for n in "xyz")}, {t(0, 1)} s1, {t(1, 2)} s2, {t(2, 0)} s3,
 {d("{n}1-{n}0", "{n}1-{n}0")} d00, {d("{n}1-{n}0", "{n}2-{n}0")} d01, {d("{n}2-{n}0", "{n}2-{n}0")} d11, {d("{n}-{n}0", "{n}1-{n}0")} d20, {d("{n}-{n}0", "{n}2-{n}0")} d21 FROM {pts} q JOIN tm ON tm.label=q.label)))))) GROUP BY ALL)"""


#: SQL of each vector's row in its label's terrain, as r of k.
ROWS = "k AS (SELECT label, vec_id id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 r, embedding e FROM embeddings)"


def _round_sql(i: int) -> str:
    """SQL of a round of smoothing, from l{i} (label, line, pos, n, x, y, z) to l{i+1}."""
    return f"""s{i} AS MATERIALIZED (SELECT *, {", ".join(f"lead({n}) OVER o n{n}" for n in "xyz")} FROM l{i} WINDOW o AS (PARTITION BY label, line ORDER BY pos)),
 q{i} AS MATERIALIZED (SELECT label, line, n, pos*2+k pos, {", ".join(f"{n}+(n{n}-{n})*(k*0.5e0-0.25e0) {n}" for n in "xyz")} FROM s{i}, (SELECT unnest([1,2]) k) WHERE nx IS NOT NULL AND n>=4), h{i} AS MATERIALIZED {_nearest_sql(f"q{i}")},
 u{i} AS (SELECT label, line, pos, n, f.x x, f.y y, f.z z FROM h{i} JOIN (SELECT DISTINCT label, line, n FROM q{i}) USING(label, line) UNION ALL SELECT label, line, CASE WHEN n<4 THEN pos WHEN pos>0 THEN pos*2+1 ELSE 0 END, n, x, y, z FROM s{i} WHERE n<4 OR pos=0 OR nx IS NULL),
 w{i} AS (SELECT *, {"+".join(f"pow({n}-lag({n}) OVER o,2)" for n in "xyz")} far FROM u{i} WINDOW o AS (PARTITION BY label, line ORDER BY pos)),
 l{i + 1} AS MATERIALIZED (SELECT label, line, row_number() OVER (PARTITION BY label, line ORDER BY pos)-1 pos, n, x, y, z FROM w{i} WHERE n<4 OR far IS NULL OR sqrt(far)>1e-9)"""


@query(f"""WITH {TERRAIN}, {ROWS}, l0 AS (SELECT label, r//30 line, r%30 pos, count(*) OVER (PARTITION BY label, r//30) n, 10+e[30]::DOUBLE*20 x, r::DOUBLE+e[31]::DOUBLE*3 y, e[32]::DOUBLE z FROM k), {_round_sql(0)}, {_round_sql(1)}
 SELECT label, line, pos seq, round(x,4)+0 x, round(y,4)+0 y, round(z,4)+0 z FROM l2""")
def smoothed_lines(spark, d):
    """Lines of thirty vectors over their label's terrain, their corners cut twice on its surface."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    r = F.col("r").cast("long")
    lines = _rows(spark, d).select("label", F.floor(r / 30).alias("line"), (r % 30).alias("seq"), (10 + at(29) * 20).alias("x"), (F.col("r") + at(30) * 3).alias("y"), at(31).alias("z"))
    return rounded(O.smoothed(lines, _mesh(spark, d), ["label"]).withColumn("seq", F.col("seq").cast("long")))


@query(f"""WITH {TERRAIN}, {ROWS}, rec AS (SELECT * FROM k WHERE id%3>0 AND id%17>0 AND id%13>0),
 pts AS (SELECT label, id line, 0 pos, 10+e[1]::DOUBLE*20 x, r::DOUBLE y, e[2]::DOUBLE z FROM rec UNION ALL SELECT label, id, 100+i, 10+e[1]::DOUBLE*20+i-1.5e0, r+e[4+i]::DOUBLE*5, e[8+i]::DOUBLE FROM rec, (SELECT unnest(range(4)) i) UNION ALL SELECT label, id, 200+i, 10+e[1]::DOUBLE*20+i, r::DOUBLE-i, e[12+i]::DOUBLE FROM rec, (SELECT unnest(range(3)) i) WHERE id%4>0 AND (i<>1 OR id%7>0)),
 h AS {_nearest_sql("pts")}, o AS (SELECT line, max(f) FILTER (WHERE pos=0) c, string_agg(f.tri::VARCHAR,',' ORDER BY pos) FILTER (WHERE pos>=100 AND pos<200) tris, max(distance) FILTER (WHERE pos>=100 AND pos<200) furthest, count(*) FILTER (WHERE pos>=200) boundary FROM h GROUP BY 1)
 SELECT line id, CASE WHEN line%5=0 THEN 'pending_clinician_confirmation' ELSE 'approved' END status, line%2=0 notes_present, coalesce(line%11>5,false) passed, CASE WHEN line%6=0 THEN 'set,more' WHEN line%2=0 THEN 'near' ELSE '' END high, CASE WHEN line%2=0 THEN 'wide' ELSE '' END medium, c.tri::BIGINT center_tri, round(c.u,4)+0 center_u, round(c.v,4)+0 center_v, tris, round(furthest,4)+0 furthest, boundary FROM o""")
def compiled_overlays(spark, d):
    """Overlays of the vectors' records that may be shown, on their label's terrain."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = _rows(spark, d)
    i, r, x = F.col("id"), F.col("r"), 10 + at(0) * 20
    warnings = F.array(F.struct(F.lit("high").alias("severity"), F.lit("near").alias("code")), F.struct(F.lit("medium").alias("severity"), F.lit("wide").alias("code")), F.struct(F.lit("high").alias("severity"), F.lit("").alias("code")))
    line = F.array(*(F.array(x + k - 1.5, r + at(3 + k) * 5, F.when((i % 13 == 0) & (F.lit(k) == 2), None).otherwise(at(7 + k))) for k in range(4)))
    ring = F.array(*(F.array(x + k, r - k, F.when((i % 7 == 0) & (F.lit(k) == 1), float("nan")).otherwise(at(11 + k))) for k in range(3)))
    records = rows.select(
        "label", i.alias("record_id"), F.when(i % 17 > 0, F.array(x, r, at(1))).alias("centre"), F.when(i % 4 > 0, ring).alias("boundary"), line.alias("polyline"),
        F.when(i % 5 > 0, "approved").alias("status"), F.lit("r").alias("reviewer"), F.when(i % 2 == 0, "seen").alias("notes"), F.when(i % 11 > 5, True).alias("passed"),
        F.when(i % 6 == 0, F.array(F.lit("set"), F.lit("more"))).alias("high_codes"), F.lit(None).cast("array<string>").alias("medium_codes"), F.when(i % 2 == 0, warnings).alias("warnings"),
        (i % 3 == 1).alias("approval_ready"), F.when(i % 3 > 0, True).alias("live_overlay_ready"), F.lit("line").alias("candidate_type"), F.lit("round").alias("tumor_kind"), F.lit("a").alias("title"),
        *(F.lit(v).alias(n) for n, v in (("diameter_mm", 4.0), ("margin_mm", 2.0), ("length_mm", 12.0), ("width_mm", 4.0))),
    )
    out = O.compiled(records, _mesh(spark, d), ["label"]).select(F.col("record_id").alias("id"), "overlay.*")
    line = F.col("candidate.polyline_refs")
    whole = lambda r: r["tri"].cast("long").cast("string")
    return rounded(out.select(
        "id", "review.status", "review.notes_present", "guardrail_summary.passed", F.array_join("guardrail_summary.high_codes", ",").alias("high"), F.array_join("guardrail_summary.medium_codes", ",").alias("medium"),
        F.col("tumor.center_ref.tri").cast("long").alias("center_tri"), F.col("tumor.center_ref.u").alias("center_u"), F.col("tumor.center_ref.v").alias("center_v"), F.array_join(F.transform(line, whole), ",").alias("tris"),
        F.array_max(F.transform(line, lambda r: r["distance"])).alias("furthest"), F.size("tumor.boundary_refs").cast("long").alias("boundary")))


#: SQL of an overlay of each order k, with a fault for some.
OVERLAY = """'{"schema_version":"incision-overlay/v0.'||CASE WHEN k%11=0 THEN 2 ELSE 1 END||'","tumor":{"center_ref":'||CASE k%7 WHEN 0 THEN 'null' WHEN 1 THEN '{"tri":1.5,"u":0.5,"v":0.25}' ELSE '{"tri":1,"u":0.5,"v":0.25,"w":0.25}' END||'},"candidate":{"polyline_refs":[{"tri":0,"u":0.25,"v":0.25}'||CASE k%5 WHEN 0 THEN '' WHEN 1 THEN ',{"tri":2,"u":0.75,"v":0.75}' WHEN 2 THEN ',{"tri":2,"u":0.75,"v":0.75,"w":-0.5}' ELSE ',{"tri":2,"u":0.75,"v":0.2,"w":0.05,"distance":0.5}' END||']}'
||CASE k%3 WHEN 0 THEN '' WHEN 1 THEN ',"review_gate":{"live_overlay_ready":true}' ELSE ',"review_gate":{"live_overlay_ready":'||CASE WHEN k%13=0 THEN 'false' ELSE 'true' END||'}' END||',"audit":{"raw_image_sent":'||CASE WHEN k%17=0 THEN 'true' ELSE 'false' END||CASE WHEN k%19=0 THEN '' ELSE ',"review_required":true' END||'}}'"""


@query("""SELECT o_orderkey, o_orderkey%11<>0 AND o_orderkey%7>1 AND o_orderkey%5>2 AND (o_orderkey%3<>2 OR o_orderkey%13<>0) AND o_orderkey%17<>0 AND o_orderkey%19<>0 valid FROM orders""")
def overlay_validity(spark, d):
    """Whether the overlay of each order's JSON text stands."""
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("k")).withColumn("o", O.overlay_of(F.expr(OVERLAY)))
    return rows.select("o_orderkey", O.valid_overlay(F.col("o")).alias("valid"))


@query()
def carried_lines(spark, d):
    """Each label's vectors as lines of ten, carried to its terrain by the similarity between their places and their rows on it."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = _rows(spark, d).withColumns({n: at(k) for k, n in enumerate("xyz")})
    pairs = rows.select("label", *"xyz", (10 + at(3) * 20).alias("qx"), F.col("r").alias("qy"), at(4).alias("qz"))
    lines = rows.select("label", F.floor(F.col("r") / 10).alias("line"), (F.col("r").cast("long") % 10).alias("seq"), *"xyz")
    return rounded(O.carried(lines, pairs, _mesh(spark, d), "label").drop("tri", "u", "v", "w"))


#: Places of the margins that distances are taken to.
ANCHORS = {"canthus": (0.36, 0.6), "tip": (0.5, 0.43), "chin": (0.5, 0.1)}
EDGES = {"eyelid": ((0.2, 0.6), (0.42, 0.6)), "lip": ((0.34, 0.3), (0.66, 0.3))}


@query(f"""WITH {NORM}, s AS (SELECT id, label, unnest({[*ANCHORS, *EDGES]}) name, unnest([{", ".join(f"sqrt(pow(nx-{x}e0,2)+pow(ny-{y}e0,2))*180" for x, y in ANCHORS.values())}, {", ".join(_segment_sql(*s) for s in EDGES.values())}]) mm FROM n), h AS (SELECT label, (max(y)-min(y))/180 u FROM p GROUP BY 1)
 SELECT id, name, round(mm,4) mm, round(mm*u,4) units FROM s JOIN h USING(label)""")
def margin_list(spark, d):
    """How far each point lies from every margin of its label's face, in millimetres and in the mesh's units."""
    far = O.margin_distances([F.col("nx"), F.col("ny")], ANCHORS, EDGES)
    rows = _normalised(spark, d).select("id", "label", F.inline(far))
    return rounded(rows.join(O.units_per_mm(points(spark, d), ["label"]), "label").select("id", "name", "mm", (F.col("mm") * F.col("units_per_mm")).alias("units")))
