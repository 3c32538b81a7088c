"""Queries of frame gates, rasters, cameras, springs, hulls, fitted maps, mesh texts and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import frames as K
from isoline.operators import geometry as G
from isoline.operators import review as V
from isoline.operators import stats as S
from isoline.plans.geometry import POINTS, _faces
from isoline.plans.registry import QUERIES, SQL, query, rounded
from isoline.plans.sequence import SAMPLES
from isoline.sources import meshes as M
from isoline.sources.tables import frames, points, read, samples


@query("""WITH f AS (SELECT vec_id frame, label, embedding e FROM embeddings), a AS (SELECT *, lag(e) OVER (PARTITION BY label ORDER BY frame) b, abs(e[7]::DOUBLE-e[5]::DOUBLE) wide FROM f),
 m AS (SELECT frame, label, CASE WHEN b IS NOT NULL THEN sqrt((pow(e[1]::DOUBLE-b[1]::DOUBLE,2)+pow(e[2]::DOUBLE-b[2]::DOUBLE,2)+pow(e[3]::DOUBLE-b[3]::DOUBLE,2)+pow(e[4]::DOUBLE-b[4]::DOUBLE,2))/2)/4 END motion, CASE WHEN wide>0 THEN (e[6]::DOUBLE-(e[5]::DOUBLE+e[7]::DOUBLE)/2)/wide END yaw, 0.5e0+e[8]::DOUBLE presence, abs(e[9]::DOUBLE)*3 jaw, abs(e[10]::DOUBLE)*4 blink FROM a),
 r AS (SELECT *, concat_ws(',', CASE WHEN yaw IS NULL THEN 'invalid_pose_yaw' WHEN abs(yaw)>0.42 THEN 'side_pose_yaw_too_large' END, CASE WHEN presence<0.45 THEN 'low_face_presence' END, CASE WHEN motion>0.045 THEN 'rapid_frame_motion' END, CASE WHEN jaw>0.5 THEN 'jaw_open_expression' END, CASE WHEN blink>0.7 THEN 'eye_blink_expression' END) reasons FROM m)
 SELECT frame, round(motion,4) motion, round(yaw,4)+0 yaw, reasons, reasons='' passed, CASE WHEN motion>0.045 THEN 'freeze' WHEN motion>0.025 THEN 'dim' ELSE 'normal' END "action" FROM r""")
def pose_gate(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    anchors = F.array(*(F.struct(e(2 * i).alias("x"), e(2 * i + 1).alias("y")) for i in range(2)))
    rows = frames(spark, d).select("frame", "label", anchors.alias("anchors"), e(5).alias("nose"), e(4).alias("left"), e(6).alias("right"), F.lit(4.0).alias("diagonal"), (0.5 + e(7)).alias("presence"), (F.abs(e(8)) * 3).alias("jaw"), (F.abs(e(9)) * 4).alias("blink"))
    out = K.pose_gate(rows, "label", "frame").withColumn("action", K.region_action(F.col("motion")))
    return rounded(out.select("frame", "motion", "yaw", "reasons", "passed", "action"))


@query(f"""WITH {POINTS}, b AS (SELECT r_regionkey k, r_regionkey*0.1e0-0.3e0 x0, r_regionkey*0.1e0 x1, -0.2e0 y0, 0.05e0*r_regionkey y1, r_regionkey%3 severity, 1-r_regionkey/10e0 opacity FROM region)
 SELECT id, max(severity) severity, round(min(opacity),4) opacity, count(*) n FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def local_actions(spark, d):
    k = F.col("r_regionkey")
    boxes = read(spark, d, "region").select((k * 0.1 - 0.3).alias("x0"), (k * 0.1).alias("x1"), F.lit(-0.2).alias("y0"), (k * 0.05).alias("y1"), (k % 3).alias("severity"), (1 - k / 10).alias("opacity"))
    return rounded(K.most_severe(points(spark, d).select("id", F.col("x").alias("nx"), F.col("y").alias("ny")), boxes))


@query("""WITH q AS (SELECT vec_id, embedding e, (vec_id%15)/2e0 x, (vec_id%11)*0.7e0 y FROM embeddings), c AS (SELECT *, CAST(floor(x) AS INT) i, CAST(floor(y) AS INT) j, x-floor(x) u, y-floor(y) v FROM q)
 SELECT vec_id, round((e[j*8+i+1]::DOUBLE*(1-u)+e[j*8+least(i+1,7)+1]::DOUBLE*u)*(1-v)+(e[least(j+1,7)*8+i+1]::DOUBLE*(1-u)+e[least(j+1,7)*8+least(i+1,7)+1]::DOUBLE*u)*v,4)+0 "value" FROM c""")
def bilinear_sample(spark, d):
    """A vector as a raster of 8 by 8, sampled between its pixels."""
    v = F.col("vec_id")
    return rounded(read(spark, d, "embeddings").select("vec_id", K.bilinear(F.col("embedding"), 8, 8, v % 15 / 2, v % 11 * 0.7).alias("value")))


@query("""WITH q AS (SELECT vec_id, embedding e, vec_id%8 x, vec_id//8%8 y, unnest([-3,-2,-1,0,1,2,3]) s FROM embeddings), v AS (SELECT vec_id, s, round(e[least(greatest(y+s,0),7)*8+x+1]::DOUBLE,9) v FROM q) SELECT vec_id, arg_max(s,(v,-s)) "offset" FROM v GROUP BY 1""")
def texture_offset(spark, d):
    """The offset along the vertical normal at which a raster is greatest."""
    v = F.col("vec_id")
    out = K.best_offset(F.col("embedding"), 8, 8, (v % 8).cast("double"), (F.floor(v / 8) % 8).cast("double"), F.lit(0.0), F.lit(1.0), 3)
    return read(spark, d, "embeddings").select("vec_id", out.alias("offset"))


@query(f"""WITH {POINTS}, c AS (SELECT id, 0.8e0*x-0.6e0*y+0.1e0 a, 0.6e0*x+0.8e0*y b, z+2e0 c FROM p) SELECT id, round((a*500+c*320)/c,4) u, round((b*500+c*240)/c,4) v, round(c,4) depth FROM c""")
def camera_project(spark, d):
    u, v, depth = K.projected(G.cols(), [[500.0, 0.0, 320.0], [0.0, 500.0, 240.0]], [[0.8, -0.6, 0.0, 0.1], [0.6, 0.8, 0.0, 0.0], [0.0, 0.0, 1.0, 2.0]])
    return rounded(points(spark, d).select("id", u.alias("u"), v.alias("v"), depth.alias("depth")))


SPRINGS = "s AS (SELECT i0 a, i1 b, 0.2e0 rest, 3e0 k FROM f)"


@query(f"""WITH {POINTS}, f AS (SELECT vec_id i0, vec_id+40 i1 FROM embeddings), {SPRINGS}, e AS (SELECT s.*, q.x-p.x dx, q.y-p.y dy, q.z-p.z dz FROM s JOIN p ON p.id=a JOIN p q ON q.id=b), g AS (SELECT *, greatest(sqrt(dx*dx+dy*dy+dz*dz),1e-9) l FROM e),
 h AS (SELECT a v, dx*k*(l-rest)/l fx, dy*k*(l-rest)/l fy, dz*k*(l-rest)/l fz FROM g UNION ALL SELECT b, -dx*k*(l-rest)/l, -dy*k*(l-rest)/l, -dz*k*(l-rest)/l FROM g), t AS (SELECT v, sum(fx) fx, sum(fy) fy, sum(fz) fz FROM h GROUP BY 1)
 SELECT id v, round(x+CASE WHEN id%7=0 THEN 0 ELSE coalesce(fx,0)*0.05*0.9*0.05 END,6)+0 x, round(y+CASE WHEN id%7=0 THEN 0 ELSE coalesce(fy,0)*0.05*0.9*0.05 END,6)+0 y FROM p LEFT JOIN t ON t.v=id""")
def soft_body_step(spark, d):
    vs = points(spark, d).select(F.col("id").alias("v"), "x", "y", "z", *(F.lit(0.0).alias(f"v{n}") for n in "xyz"), (F.col("id") % 7 == 0).alias("anchored"))
    springs = _faces(spark, d).select(F.col("i0").alias("a"), F.col("i1").alias("b"), F.lit(0.2).alias("rest"), F.lit(3.0).alias("k"))
    return rounded(K.spring_step(vs, springs, [], 0.05, 0.9).select("v", "x", "y"), 6)


@query()
def hull_occlusion(spark, d):
    """Points seen past an occluder: the hull of all points of the label before theirs, drawn in by a fifth of a unit, and a capsule along the middle. Labels without one before them are seen."""
    pts = points(spark, d).select("id", "label", "x", "y")
    hulls = K.hull(pts, "label").select((F.col("label") + 1).alias("label"), K.expanded(F.col("hull"), -0.2).alias("hull"))
    rows = pts.join(hulls, "label", "left")
    capsule = K.in_capsule(F.col("x"), F.col("y"), [F.lit(-0.1), F.lit(0.0)], [F.lit(0.1), F.lit(0.0)], 0.05)
    hidden = F.coalesce(K.inside_hull(F.col("hull"), F.col("x"), F.col("y")), F.lit(False)) | capsule
    return rows.filter(~hidden).select("id", "label")


@query()
def spline_map(spark, d):
    """Points moved by the spline through controls that stand for all points of their label."""
    pts = points(spark, d)
    return rounded(K.spline_fitted(K.gridded_controls(pts, "label"), pts.select("label", "id", "x", "y", "z"), "label"), 6)


@query("SELECT l_returnflag, CAST(floor(l_quantity/2) AS BIGINT) bin, round(median(l_quantity),4) x, round(median(l_extendedprice),4) y, count(*) n FROM lineitem GROUP BY ALL")
def binned_centreline(spark, d):
    return rounded(K.centreline(read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "l_returnflag", 2.0))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey a, o_custkey+o_orderkey%3*7 b FROM orders), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT 0 k, a v, a l, true "on" FROM s GROUP BY ALL UNION ALL SELECT k+1, v, min(l), bool_or("on") FROM (SELECT r.k, r.v, min(least(r.l,coalesce(t.l,r.l))) l, bool_or(t.l<r.l) "on" FROM r JOIN s ON s.a=r.v JOIN r t ON t.v=s.b GROUP BY ALL) WHERE (SELECT bool_or("on") FROM r) GROUP BY k, v)
 SELECT v, min(l) AS "label" FROM r GROUP BY 1""")
def connected_components(spark, d):
    return K.least_labels(_links(read(spark, d, "orders")))


def _links(orders):
    c = F.col("o_custkey")
    return orders.select(c.alias("a"), (c + F.col("o_orderkey") % 3 * 7).alias("b"))


@query(f"""WITH {SAMPLES}, p AS (SELECT user_id, seq, t/86400-19723 x, value y FROM e), g AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)),0) st FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 a AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY seq) s, count(*) OVER (PARTITION BY user_id) n FROM g), l AS (SELECT *, lead(s) OVER w s1, lead(x) OVER w x1, lead(y) OVER w y1 FROM a WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 o AS (SELECT *, unnest(range(CASE WHEN seq=0 THEN 0 ELSE floor(s/25)::BIGINT+1 END, floor(s1/25)::BIGINT+1)) k FROM l WHERE n>2 AND s1 IS NOT NULL), q AS (SELECT user_id, k, CASE WHEN s1>s THEN x+(k*25-s)/(s1-s)*(x1-x) ELSE x END x, CASE WHEN s1>s THEN y+(k*25-s)/(s1-s)*(y1-y) ELSE y END y FROM o),
 z AS (SELECT user_id, arg_max(x,seq) x, arg_max(y,seq) y FROM p GROUP BY 1 HAVING count(*)>2), m AS (SELECT user_id, max(k) k, arg_max(x,k) lx, arg_max(y,k) ly FROM q GROUP BY 1)
 SELECT user_id, k, round(x,3)+0 x, round(y,3)+0 y FROM (SELECT * FROM q UNION ALL SELECT z.user_id, k+1, x, y FROM z JOIN m USING(user_id) WHERE sqrt(pow(x-lx,2)+pow(y-ly,2))>6.25 UNION ALL SELECT user_id, seq, x, y FROM a WHERE n<=2)""")
def spacing_resample(spark, d):
    rows = samples(spark, d).select("user_id", "seq", (F.col("t") / 86400 - 19723).alias("x"), F.col("value").alias("y"))
    return rounded(K.respaced(rows, "user_id", 25.0), 3)


@query("""WITH f AS (SELECT vec_id%40 mesh, vec_id, row_number() OVER (PARTITION BY vec_id%40 ORDER BY vec_id)-1 r, count(*) OVER (PARTITION BY vec_id%40) n, embedding[1]::DOUBLE x FROM embeddings)
 SELECT mesh, count(*) vertices, CAST(2*(count(*)-3) AS BIGINT) triangles, round(sum(x),4)+0 sum_x FROM f GROUP BY 1""")
def mesh_text(spark, d):
    """Meshes written as OBJ texts by Spark and read from them: vertices and fanned quads."""
    from pyspark.sql import Window as W

    v = F.col("vec_id")
    num = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 9).cast("string")
    rows = read(spark, d, "embeddings").select((v % 40).alias("mesh"), "vec_id", F.concat_ws(" ", F.lit("v"), num(0), num(1), num(2)).alias("line"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("mesh").orderBy("vec_id")))
    face = F.when(F.col("r") > 3, F.concat_ws(" ", F.lit("f"), F.col("r") - 3, F.concat(F.col("r") - 2, F.lit("/1")), F.col("r") - 1, F.lit("-1"))).otherwise(F.lit("# no face"))
    texts = rows.groupBy("mesh").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("vs"), F.array_join(F.sort_array(F.collect_list(face)), "\n").alias("fs"))
    texts = texts.select("mesh", F.concat_ws("\n", F.lit("# mesh"), "vs", "fs").alias("text"))
    parts = M.obj_parts(texts, "mesh", "text")
    vs = M.obj_vertices(parts, "mesh")
    tris = M.obj_triangles(parts, vs, "mesh").groupBy("mesh").agg(F.count("*").alias("triangles"))
    out = vs.groupBy("mesh").agg(F.count("*").alias("vertices"), F.sum("x").alias("sum_x")).join(tris, "mesh", "left")
    return rounded(out.select("mesh", "vertices", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"), "sum_x"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus st, o_orderpriority pr, o_totalprice/10000 len FROM orders) SELECT o_orderkey k, 'r'||o_orderkey id, st status, CASE WHEN pr<'3' THEN 'linear' ELSE 'fusiform' END "type", round(len,2) length_mm, st='F' passed, CASE WHEN st='F' THEN 0 ELSE 1 END warnings FROM o
 UNION ALL SELECT o_orderkey, 's'||o_orderkey, st, CASE WHEN pr<'3' THEN 'linear' ELSE 'fusiform' END, round(len,2), st='F', CASE WHEN st='F' THEN 0 ELSE 1 END FROM o WHERE o_orderkey%3>0""")
def review_records(spark, d):
    """Records of three shapes of JSON payloads, made from orders and read back."""
    k = F.col("o_orderkey")

    def record(prefix):
        warn = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<struct<code:string,severity:string>>")).otherwise(F.array(F.struct(F.lit("low_rstl_confidence").alias("code"), F.lit("medium").alias("severity"))))
        return F.struct(F.concat(F.lit(prefix), k).alias("id"), F.col("o_orderstatus").alias("review_status"), F.struct(F.when(F.col("o_orderpriority") < "3", "linear").otherwise("fusiform").alias("type"), F.round(F.col("o_totalprice") / 10000, 2).alias("length_mm")).alias("candidate"), F.struct((F.col("o_orderstatus") == "F").alias("passed"), warn.alias("warnings")).alias("guardrails"))

    one, export, listed = F.to_json(record("r")), F.to_json(F.struct(F.lit("incision-review-export/v0.3").alias("schema_version"), record("r").alias("current"), F.array(record("s")).alias("saved"))), F.to_json(F.array(record("r"), record("s")))
    rows = read(spark, d, "orders").select(k.alias("k"), F.when(k % 3 == 0, one).when(k % 3 == 1, export).otherwise(listed).alias("payload"))
    r = M.records(rows, "k", "payload")
    return rounded(r.select("k", "record.id", F.col("record.review_status").alias("status"), "record.candidate.type", "record.candidate.length_mm", "record.guardrails.passed", F.size("record.guardrails.warnings").alias("warnings")))


@query("""WITH s AS (SELECT l_returnflag, count(*)::VARCHAR n, CAST(CAST(round(sum(l_quantity)) AS BIGINT) AS VARCHAR) quantity FROM lineitem GROUP BY 1) SELECT 'line' section, l_returnflag AS "name", 'n' metric, n AS "value" FROM s UNION ALL SELECT 'line', l_returnflag, 'quantity', quantity FROM s""")
def summary_rows(spark, d):
    s = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"))
    return M.flat_rows(s, "line", ["l_returnflag"]).withColumn("value", M.csv_field(F.col("value")))


@query("""WITH s AS (SELECT user_id, count(*) n, avg(value) m FROM events GROUP BY 1), b AS (SELECT min(m) lo, max(m) hi FROM s), t AS (SELECT user_id, n, least(greatest((m-lo)/greatest(hi-lo,1e-9),0),1) y FROM s, b)
 SELECT user_id, n, round(y,4)+0 y, CASE WHEN y<0.36 THEN 'upper' WHEN y<0.66 THEN 'middle' ELSE 'lower' END band FROM t WHERE user_id%2=0""")
def line_bands(spark, d):
    """Every second line, by the band that its mean height falls in."""
    s = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    b = s.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    y = G.normalised(F.col("m"), F.col("lo"), F.col("hi"))
    rows = s.filter(F.pmod("user_id", F.lit(2)) == 0).crossJoin(F.broadcast(b)).withColumn("y", y)  # b is one row
    return rounded(rows.select("user_id", "n", "y", F.when(F.col("y") < 0.36, "upper").when(F.col("y") < 0.66, "middle").otherwise("lower").alias("band")))


@query("""SELECT label, vec_id, CAST(r AS BIGINT) AS "rank", round(s,4) score FROM (SELECT label, vec_id, s, row_number() OVER (PARTITION BY label ORDER BY round(s,9) DESC, vec_id) r FROM (SELECT label, vec_id, sqrt(abs(embedding[1]::DOUBLE))*exp(-5*abs(embedding[2]::DOUBLE))*exp(-2.5*abs(embedding[3]::DOUBLE))*exp(-3*abs(embedding[4]::DOUBLE))*CASE WHEN embedding[5]::DOUBLE>-0.2 THEN 1 ELSE 0 END s FROM embeddings)) WHERE r<=6""")
def best_views(spark, d):
    """The six best-scored views of each label: a top-k report."""
    from pyspark.sql import Window as W

    e = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    inside = F.when(F.get("embedding", F.lit(4)).cast("double") > -0.2, 1.0).otherwise(0.0)
    rows = read(spark, d, "embeddings").select("label", "vec_id", (F.sqrt(e(0)) * F.exp(-5 * e(1)) * F.exp(-2.5 * e(2)) * F.exp(-3 * e(3)) * inside).alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "vec_id")).cast("long")).filter("rank <= 6")
    return rounded(rows.select("label", "vec_id", "rank", "score"))


@query("""SELECT label, round((2*sum(p*t)+1e-6)/(sum(p)+sum(t)+1e-6),4) dice, round(avg(-t*ln(p)-(1-t)*ln(1-p)),4) entropy FROM (SELECT label, 1/(1+exp(-embedding[1]::DOUBLE*5)) p, CASE WHEN embedding[2]>0 THEN 1e0 ELSE 0e0 END t FROM embeddings) GROUP BY 1""")
def soft_dice(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = read(spark, d, "embeddings").select("label", (1 / (1 + F.exp(-e(0) * 5))).alias("p"), F.when(e(1) > 0, 1.0).otherwise(0.0).alias("t"))
    p, t = F.col("p"), F.col("t")
    return rounded(rows.groupBy("label").agg(((2 * F.sum(p * t) + 1e-6) / (F.sum(p) + F.sum(t) + 1e-6)).alias("dice"), F.avg(-t * F.log(p) - (1 - t) * F.log(1 - p)).alias("entropy")))


@query("""WITH i AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), r AS (SELECT c_custkey k, c_acctbal FROM customer WHERE c_custkey%2=0)
 SELECT o_orderkey, CASE WHEN c_acctbal>5000 THEN 'F' WHEN c_acctbal>0 THEN 'O' WHEN c_acctbal IS NOT NULL THEN 'X' ELSE o_orderstatus END status, c_acctbal IS NOT NULL reviewed FROM i LEFT JOIN r ON o_custkey=k""")
def apply_review(spark, d):
    """Orders updated by the review of their customer, where there is one."""
    r = read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("b"))
    b = F.col("b")
    out = read(spark, d, "orders").join(r, "o_custkey", "left")
    return out.select("o_orderkey", F.when(b > 5000, "F").when(b > 0, "O").when(b.isNotNull(), "X").otherwise(F.col("o_orderstatus")).alias("status"), b.isNotNull().alias("reviewed"))


@query("""SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_custkey*10 END k, c_custkey*10+1 f FROM customer) WHERE (k IS NOT NULL AND k NOT IN (SELECT o_orderkey FROM orders)) OR (k IS NULL AND f NOT IN (SELECT o_orderkey FROM orders))""")
def unmatched_reviews(spark, d):
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(F.when(k % 3 != 0, k * 10).alias("k"), (k * 10 + 1).alias("f"), "c_custkey")
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("f"))
    return V.unmatched(items, rows, "k", "f").select("c_custkey")


@query("""WITH f AS (SELECT event_type, user_id, value>20 ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 seq FROM events)
 SELECT user_id, count(*) frames, round(count(*) FILTER (WHERE ok)/count(*)::DOUBLE,4) pass_rate, min(seq) FILTER (WHERE NOT ok) first_failed, count(DISTINCT event_type) FILTER (WHERE NOT ok) reasons, bool_and(ok) passed FROM f GROUP BY 1""")
def replay_qa(spark, d):
    """Per stream: the share of frames that pass, the first that doesn't, and how many reasons there were."""
    rows = samples(spark, d).withColumn("ok", F.col("value") > 20)
    return rounded(rows.groupBy("user_id").agg(F.count("*").alias("frames"), (F.count_if("ok") / F.count("*")).alias("pass_rate"), F.min(F.when(~F.col("ok"), F.col("seq"))).cast("long").alias("first_failed"), F.countDistinct(F.when(~F.col("ok"), F.col("event_type"))).alias("reasons"), F.bool_and("ok").alias("passed")))


@query("""WITH w AS (SELECT lm, v, (CASE WHEN lm%3=0 THEN 0.25 ELSE 1 END*CASE WHEN lm<6 THEN 4 ELSE 1 END*CASE WHEN lm>=6 THEN 0.2 ELSE 1 END)::DOUBLE w FROM (SELECT unnest(range(21)) lm, embedding, vec_id FROM embeddings) t, LATERAL (SELECT embedding[lm*3+1]::DOUBLE v)) SELECT lm, round(sum(w*v)/sum(w),4)+0 mean, round(any_value(w),4) w, count(*) n FROM w GROUP BY 1""")
def landmark_weights(spark, d):
    """Weighted means of landmarks: contour ones count a quarter, fine ones four times, others a fifth in the fine preset."""
    rows = frames(spark, d).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("lm"), "embedding").select("lm", F.get("embedding", (F.col("lm") * 3).cast("int")).cast("double").alias("v"))
    lm = F.col("lm")
    w = F.when(lm % 3 == 0, 0.25).otherwise(1.0) * F.when(lm < 6, 4.0).otherwise(1.0) * F.when(lm >= 6, 0.2).otherwise(1.0)
    rows = rows.withColumn("w", w)
    return rounded(rows.groupBy("lm").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"), F.max("w").alias("w"), F.count("*").alias("n")))


@query("SELECT event_type, round(avg(gap),4) mean, round(quantile_disc(gap,0.9),4) p90, count(gap) n FROM (SELECT event_type, value-lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) gap FROM events) GROUP BY 1")
def metric_changes(spark, d):
    from pyspark.sql import Window as W

    rows = read(spark, d, "events").select("event_type", (F.col("value") - F.lag("value").over(W.partitionBy("event_type").orderBy("ts", "event_id"))).alias("gap"))
    return rounded(rows.groupBy("event_type").agg(F.avg("gap").alias("mean"), S.nearest_rank("gap", 0.9).alias("p90"), F.count("gap").alias("n")))


#: The name under which the query over all orders was registered beside a bounded one.
QUERIES["connected_components_whole"], SQL["connected_components_whole"] = QUERIES["connected_components"], SQL["connected_components"]
