"""Queries of direction fields, masks, shape models, landmark sets, registries and plans of steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import fields as D
from isoline.plans.geometry import NORM, POINTS, _normalised
from isoline.plans.registry import query, rounded
from isoline.plans.sequence import SAMPLES
from isoline.sources.tables import points, read, samples

#: The field of the query: three bands, two circles and one bundle of rays; and the ellipse of its mask with the holes in it.
FIELD = (("band", 1.0, 0.0, "y", 0.2, 0.15), ("band", 0.8, 90.0, "x", 0.4, 0.25), ("band", 0.6, 30.0, "y", 0.75, 0.3), ("circle", 2.0, 0.25, 0.5, 0.1), ("circle", 1.5, 0.75, 0.5, 0.1), ("rays", 1.8, 0.5, 0.2, 0.12))
OUTER, HOLES = (0.5, 0.5, 0.45, 0.48), [(0.25, 0.5, 0.1, 0.06), (0.75, 0.5, 0.1, 0.06), (0.5, 0.2, 0.12, 0.07)]


@query(f"""WITH {NORM}, t AS (SELECT id, nx, ny, unnest([{{'a':0e0,'w':exp(-pow((ny-0.2)/0.15,2))}},{{'a':pi()/2,'w':0.8*exp(-pow((nx-0.4)/0.25,2))}},{{'a':pi()/6,'w':0.6*exp(-pow((ny-0.75)/0.3,2))}},
 {{'a':atan2(ny-0.5,nx-0.25)+pi()/2,'w':2*exp(-(pow(nx-0.25,2)+pow(ny-0.5,2))/0.02)}},{{'a':atan2(ny-0.5,nx-0.75)+pi()/2,'w':1.5*exp(-(pow(nx-0.75,2)+pow(ny-0.5,2))/0.02)}},{{'a':atan2(ny-0.2,nx-0.5),'w':1.8*exp(-(pow(nx-0.5,2)+pow(ny-0.2,2))/0.0288)}}]) t FROM n),
 s AS (SELECT id, any_value(nx) nx, any_value(ny) ny, sum(t.w*cos(2*t.a)) c, sum(t.w*sin(2*t.a)) s FROM t GROUP BY 1)
 SELECT id, round(c/sqrt(c*c+s*s),4)+0 cos2, round(s/sqrt(c*c+s*s),4)+0 sin2, pow((nx-0.5)/0.45,2)+pow((ny-0.5)/0.48,2)<=1 AND pow((nx-0.25)/0.1,2)+pow((ny-0.5)/0.06,2)>=1 AND pow((nx-0.75)/0.1,2)+pow((ny-0.5)/0.06,2)>=1 AND pow((nx-0.5)/0.12,2)+pow((ny-0.2)/0.07,2)>=1 inside FROM s""")
def direction_blend(spark, d):
    """Directions blended of bands, circles and rays, as the double angle's cosine and sine, and whether the place is inside the mask."""
    x, y = F.col("nx"), F.col("ny")
    a = D.blended_axis(D.field_terms(x, y, FIELD))
    return rounded(_normalised(spark, d).select("id", F.cos(2 * a).alias("cos2"), F.sin(2 * a).alias("sin2"), D.in_mask(x, y, OUTER, HOLES).alias("inside")))


@query(f"""WITH {POINTS}, c AS (SELECT n_nationkey subject, k, ((n_nationkey*7+k*3)%5-2)/10e0 c FROM nation, range(3) t(k) WHERE (n_nationkey+k)%4>0), d AS (SELECT subject, id, sum(c*[tx,ty,tz][k+1]) dx, sum(c*[ty,tz,tx][k+1]) dy, sum(c*[tz,tx,ty][k+1]) dz FROM c, p GROUP BY 1,2),
 v AS (SELECT subject, id, x+dx x, y+dy y, z+dz z, subject*0.02e0 a, (id%4)/3e0 w FROM d JOIN p USING(id))
 SELECT subject, round(avg(x),4)+0 x, round(avg(y+w*(0.1+cos(a)*(y-0.1)-sin(a)*(z+0.05)-y)),4)+0 y, round(avg(z+w*(-0.05+sin(a)*(y-0.1)+cos(a)*(z+0.05)-z)),4)+0 z, count(*) n FROM v GROUP BY 1""")
def shape_model(spark, d):
    """A shape model of three components over all points, for each subject, with a hinge opened by the subject's angle: means of its vertices."""
    pts = points(spark, d)
    parts = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"t{'xyz'[(i + k) % 3]}").alias(n) for i, n in enumerate("xyz"))) for k in range(3)))
    basis = pts.select(F.col("id").alias("v"), F.explode(parts).alias("b")).select("v", "b.*")
    s = F.col("n_nationkey")
    coefficients = read(spark, d, "nation").select(s.alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).filter((F.col("subject") + F.col("k")) % 4 > 0)
    coefficients = coefficients.withColumn("c", ((F.col("subject") * 7 + F.col("k") * 3) % 5 - 2) / 10)
    shape = D.shaped(pts.select(F.col("id").alias("v"), "x", "y", "z"), basis, coefficients, ["subject"])
    p = D.hinged([F.col(n) for n in "xyz"], (0.0, 0.1, -0.05), F.col("subject") * 0.02, F.col("v") % 4 / 3)
    return rounded(shape.select("subject", *(c.alias(n) for n, c in zip("xyz", p, strict=True))).groupBy("subject").agg(*(F.avg(n).alias(n) for n in "xyz"), F.count("*").alias("n")))


#: SQL of a pose: joint 0 turns about z, joint 1 on it about x, joint 2 on that about y; a joint's motion is its parent's after its own.
_TURN = (("cos(a0)*x-sin(a0)*y", "sin(a0)*x+cos(a0)*y", "z"), ("x", "cos(a1)*y-sin(a1)*z", "sin(a1)*y+cos(a1)*z"), ("cos(a2)*x+sin(a2)*z", "y", "-sin(a2)*x+cos(a2)*z"))


def _about(j: int, p: str) -> str:
    """A query of all points p (subject, v, x..z) turned about joint j's place."""
    return "(SELECT subject, v, " + ", ".join(f"j{n}{j}+{f} {n}" for n, f in zip("xyz", _TURN[j], strict=True)) + f" FROM (SELECT q.subject, v, {', '.join(f'q.{n}-jo.j{n}{j} {n}' for n in 'xyz')}, COLUMNS('^(j[xyz][0-2]|a[0-2])$') FROM {p} q JOIN jo USING(subject)))"


@query(f"""WITH {POINTS}, c AS (SELECT n_nationkey subject, k, ((n_nationkey*5+k*3)%7-3)/10e0 c FROM nation, range(3) t(k)), d AS (SELECT subject, id, sum(c*[tx,ty,tz][k+1]) dx, sum(c*[ty,tz,tx][k+1]) dy, sum(c*[tz,tx,ty][k+1]) dz FROM c, p GROUP BY 1,2),
 s AS (SELECT subject, id v, x+dx x, y+dy y, z+dz z FROM d JOIN p USING(id)), n AS (SELECT {", ".join(f"count(*) FILTER (WHERE id%3={j}) n{j}" for j in range(3))} FROM p),
 jo AS (SELECT subject, {", ".join(f"sum({x}) FILTER (WHERE v%3={j})/any_value(n{j}) j{x}{j}" for j in range(3) for x in "xyz")}, {", ".join(f"(subject%{5 + j})/{8 + j}e0 a{j}" for j in range(3))} FROM s, n GROUP BY subject),
 m0 AS {_about(0, "s")}, b1 AS {_about(1, "s")}, m1 AS {_about(0, "b1")}, c1 AS {_about(2, "s")}, c2 AS {_about(1, "c1")}, m2 AS {_about(0, "c2")}, w AS (SELECT v, (1+v%4)/10e0 w0, (1+v%2)/10e0 w1 FROM (SELECT DISTINCT id v FROM p))
 SELECT subject, v%10 part, count(*) n, {", ".join(f"round(avg(w0*m0.{x}+w1*m1.{x}+(1-w0-w1)*m2.{x}),4)+0 {x}" for x in "xyz")} FROM m0 JOIN m1 USING(subject, v) JOIN m2 USING(subject, v) JOIN w USING(v) GROUP BY 1, 2""")
def forward_model(spark, d):
    """A model of three components and a chain of three joints over all points, shaped and posed for each subject: means of its vertices by ten parts."""
    pts = points(spark, d).withColumnRenamed("id", "v")
    parts = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"t{'xyz'[(i + k) % 3]}").alias(n) for i, n in enumerate("xyz"))) for k in range(3)))
    subjects = read(spark, d, "nation").select(F.col("n_nationkey").alias("subject"))
    number = F.explode(F.sequence(F.lit(0), F.lit(2)))
    coefficients = subjects.select("subject", number.alias("k")).withColumn("c", ((F.col("subject") * 5 + F.col("k") * 3) % 7 - 3) / 10)
    shape = D.shaped(pts.select("v", "x", "y", "z"), pts.select("v", F.explode(parts).alias("b")).select("v", "b.*"), coefficients, ["subject"])
    j, v, s = F.col("j"), F.col("v"), F.col("subject")
    held = pts.select("v", (v % 3).cast("int").alias("j"))
    joints = held.join(held.groupBy("j").agg(F.count("*").alias("n")), "j").select("j", "v", (1 / F.col("n")).alias("w"))
    w0, w1 = (1 + v % 4) / 10, (1 + v % 2) / 10
    skin = pts.select("v", F.posexplode(F.array(w0, w1, 1 - w0 - w1)).alias("j", "w"))
    turn = lambda k: F.when(j == k, (s % (5 + k)) / (8 + k)).otherwise(0.0)
    pose = subjects.select("subject", number.alias("j")).select("subject", "j", turn(1).alias("rx"), turn(2).alias("ry"), turn(0).alias("rz"))
    out = D.posed(shape, joints, pose, skin, (-1, 0, 1), ["subject"])
    return rounded(out.groupBy("subject", (v % 10).alias("part")).agg(F.count("*").alias("n"), *(F.avg(n).alias(n) for n in "xyz")))


@query()
def shape_fit(spark, d):
    """Two shape coefficients of each label, fitted to its points in turns with an alignment."""
    rows = points(spark, d).select("label", "x", "y", "z", F.col("qx").alias("x0"), F.col("qy").alias("y0"), F.col("qz").alias("z0"), F.array("tx", "ty").alias("bx"), F.array("ty", "tz").alias("by_"), F.array("tz", "tx").alias("bz"))
    out = D.shape_fitted(rows, "label", 2, 1e-2)
    return rounded(out.select("label", *(F.col("beta")[i].alias(f"beta{i}") for i in range(2)), "rmse", "n"))


@query("""SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'mediapipe-canonical-468-v1' WHEN p_size%3=1 THEN 'flame-2023-v1' END version, CASE WHEN p_size%3=0 THEN true WHEN p_size%3=1 THEN false END bundled, CASE WHEN p_partkey%5=0 THEN 8e0 ELSE least(greatest(floor(p_retailprice/10+0.5),4),95) END diameter, CASE WHEN p_partkey%468 IN (8,9,10,151,108,109,337,338) THEN 'forehead' WHEN p_partkey%468 IN (1,2,4,5,6,19,94,98,168,195,197,236,327,456) THEN 'nose' END part FROM part""")
def registry_lookup(spark, d):
    """Known topologies, a form's whole numbers, and the landmark set that a part's number is in."""
    k, s = F.col("p_partkey"), F.col("p_size")
    t = D.topology(F.when(s % 3 == 0, "mediapipe-468").when(s % 3 == 1, "flame-2023").otherwise("other"))
    raw = F.when(k % 5 == 0, "nan").otherwise((F.col("p_retailprice") / 10).cast("string"))
    lm = k % 468
    part = F.when(lm.isin(*D.PARTS["central_forehead"]), "forehead").when(lm.isin(*D.PARTS["nose"]), "nose")
    return read(spark, d, "part").select("p_partkey", t.alias("t"), D.clamped_whole(raw, 4, 95, 8).alias("diameter"), part.alias("part")).select("p_partkey", "t.version", "t.bundled", "diameter", "part")


ACTIONS = ("summarize_tumor_input_quality", "classify_region", "query_rstl_direction", "inspect_sensitive_structures", "linear_subcutaneous_incision", "evaluate_guardrails", "preview_incision_on_face", "propose_direction_variants", "compare_candidates", "retry_tool_failure", "other")


@query("""WITH e AS (SELECT event_id//24 s, event_id, (['summarize_tumor_input_quality','classify_region','query_rstl_direction','inspect_sensitive_structures','linear_subcutaneous_incision','evaluate_guardrails','preview_incision_on_face','propose_direction_variants','compare_candidates','retry_tool_failure','other'])[(event_id*7+user_id)%11+1] a FROM events), l AS (SELECT s, list(a ORDER BY event_id) acts FROM e GROUP BY 1),
 g(step, gs, own) AS (VALUES ('inspect_tumor_input',[['summarize_tumor_input_quality']],[]::VARCHAR[]), ('localize_anatomy',[['classify_region']],[]), ('query_direction',[['query_rstl_direction']],[]), ('inspect_sensitive_structures',[['inspect_sensitive_structures']],[]), ('generate_primary_candidate',[['linear_subcutaneous_incision','fusiform_cutaneous_incision']],[]), ('check_guardrails',[['evaluate_guardrails']],[]), ('preview_candidates',[['preview_incision_on_face']],[]),
 ('compare_direction_variants',[['propose_direction_variants'],['compare_candidates']],['linear_subcutaneous_incision','fusiform_cutaneous_incision','inspect_sensitive_structures','evaluate_guardrails','preview_incision_on_face','retry_tool_failure','recover_tool_failure'])),
 r AS (SELECT s, step, len([x for x in gs if NOT list_has_any(acts,x)]) lacks, len([x for x in acts if list_contains(list_concat(flatten(gs),own),x)]) observed, list_min([i-1 for i in range(1,len(acts)+1) if list_contains(list_concat(flatten(gs),own),acts[i])]) f, step='compare_direction_variants' last FROM l, g)
 SELECT s "session", step, CASE WHEN NOT last THEN CASE WHEN lacks>0 THEN 'failed' ELSE 'completed' END WHEN s%5=0 OR s%4=0 THEN 'failed' ELSE CASE WHEN lacks>0 THEN 'failed' ELSE 'completed' END||CASE WHEN s%7=0 THEN '_with_recovery' WHEN s%3=1 THEN '_after_retry' ELSE '' END END status, observed, f "first", lacks+CASE WHEN last THEN CASE WHEN s%7=0 OR s%3=1 THEN 1 ELSE 0 END+CASE WHEN s%5=0 THEN 1 ELSE 0 END+CASE WHEN s%4=0 THEN 1 ELSE 0 END ELSE 0 END issues FROM r""")
def plan_steps(spark, d):
    """Sessions of two dozen events held to the eight steps of the plan."""
    i = F.col("event_id")
    log = read(spark, d, "events").select(F.floor(i / 24).alias("session"), "event_id", F.get(F.array(*map(F.lit, ACTIONS)), ((i * 7 + F.col("user_id")) % 11).cast("int")).alias("action"))
    s = F.col("session")
    context = log.select("session").distinct().select("session", (s % 4).alias("candidates"), (s % 5 > 0).alias("comparison_ready"), (s % 3 == 1).cast("int").alias("retried"), (s % 7 == 0).cast("int").alias("recovered"))
    out = D.planned(log, context, "session", "event_id")
    return out.select("session", "step", "status", "observed", "first", F.size("issues").cast("long").alias("issues"))


@query(f"""WITH {SAMPLES}, c AS (SELECT user_id, event_id, seq, value, seq//5%3 k, CASE WHEN seq//5%3 IS DISTINCT FROM lag(seq//5%3) OVER (PARTITION BY user_id ORDER BY seq) THEN 1 ELSE 0 END ch FROM e), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY seq) run FROM c)
 SELECT user_id, event_id, round(sqrt(avg(value*value) OVER w),4) rms, round(max(value) OVER w,4) most FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def rolling_reset(spark, d):
    """Stability over eight frames, started anew when the overlay's key changes."""
    rows = samples(spark, d).withColumn("overlay", F.floor(F.col("seq") / 5) % 3)
    return rounded(D.rolling_until(rows, "user_id", "overlay", "value").select("user_id", "event_id", "rms", "most"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1,2) SELECT user_id, '{"counters":{'||string_agg('"'||event_type||'":'||n, ',' ORDER BY event_type)||'},"events":[{"event":"'||max(event_type)||'"}]}' json FROM c GROUP BY 1""")
def diagnostics_export(spark, d):
    """Each user's counters and last event's name as JSON."""
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    rows = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counters"), F.max("event_type").alias("event"))
    return rows.select("user_id", D.diagnostics_json(F.col("counters"), F.array(F.struct("event"))).alias("json"))
