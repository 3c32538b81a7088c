"""Queries of reviews, atlas contracts, outline quality and roll-ups of review records."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import contracts as C
from isoline.plans.geometry import POINTS
from isoline.plans.registry import query, rounded
from isoline.sources.tables import dealt, points, read


def _picked(words, k):
    """One of some words, by a number's remainder."""
    return F.get(F.array(*map(F.lit, words)), F.pmod(k, F.lit(len(words))).cast("int"))


@query("""SELECT p_partkey, ([true,false,NULL,true,false,NULL,true,false])[p_partkey%8+1] flag, p_partkey%8<>5 flag_ok, ([1.5e0,NULL,NULL,NULL,-2000e0,7e0])[p_partkey%6+1] "number", p_partkey%6 NOT IN (1,3) number_ok, ([6e0,6e0,NULL,1.5e0,NULL,NULL,NULL])[p_partkey%7+1] total, p_partkey%7<4 vector_ok FROM part""")
def csv_values(spark, d):
    """Texts of a reviewer's table read as yes or no, numbers and vectors."""
    k = F.col("p_partkey")
    f, n, v = C.flag(F.col("f")), C.number(F.col("n")), C.vector(F.col("v"))
    rows = read(spark, d, "part").select("p_partkey", _picked((" Yes", "n", "", "accepted", "Correction ", "maybe", "1", "FALSE"), k).alias("f"), _picked(("1.5", "nan", "", "abc", "-2e3", " 7 "), k).alias("n"), _picked(("[1, 2,3]", "1;2;3", " ", "0.5,-1,,2", '{"a":1}', '[1,"x",2]', "a,b"), k).alias("v"))
    rows = rows.select("p_partkey", f.alias("f"), n.alias("n"), v.alias("v"))
    total = F.aggregate("v.value", F.lit(0.0), lambda s, x: s + x)
    return rows.select("p_partkey", F.col("f.value").alias("flag"), F.col("f.ok").alias("flag_ok"), F.col("n.value").alias("number"), F.col("n.ok").alias("number_ok"), total.alias("total"), F.col("v.ok").alias("vector_ok"))


#: SQL of the samples and of the review items made from customers, and of their decisions.
REVIEWS = f"""{POINTS}, s AS (SELECT id "index", id%19 tri, x, y, z FROM p), i AS (SELECT c_custkey k, CASE WHEN c_custkey%17=1 THEN c_custkey-1 ELSE c_custkey END "index", CASE WHEN c_custkey%13=0 THEN -1 WHEN c_custkey%3>0 THEN (CASE WHEN c_custkey%17=1 THEN c_custkey-1 ELSE c_custkey END)%19 END tri, (['accept','needs-correction','reject','','Approved','huh'])[c_custkey%6+1] word, c_custkey%4=0 refused, c_custkey%11=0 unnamed, c_custkey%7=0 undated,
 c_custkey%5=0 angled, c_custkey%2=0 vectored, c_custkey%10=0 void FROM customer),
 w AS (SELECT *, CASE word WHEN 'accept' THEN CASE WHEN refused AND (angled OR vectored) THEN 'corrected' ELSE 'accepted' END WHEN 'Approved' THEN CASE WHEN refused AND (angled OR vectored) THEN 'corrected' ELSE 'accepted' END WHEN 'needs-correction' THEN 'corrected' WHEN 'reject' THEN 'rejected' WHEN '' THEN CASE WHEN refused AND (angled OR vectored) THEN 'corrected' WHEN refused THEN 'rejected' ELSE 'pending' END END decision, count(*) OVER (PARTITION BY "index") n FROM i),
 c AS (SELECT k, unnest([CASE WHEN decision IS NULL THEN 'unknown_decision' END, CASE WHEN decision<>'pending' AND unnamed THEN 'reviewer_required' END, CASE WHEN decision<>'pending' AND undated THEN 'reviewed_at_required' END, CASE WHEN decision='corrected' AND NOT angled AND NOT vectored THEN 'correction_missing' END, CASE WHEN decision='corrected' AND vectored AND void THEN 'correction_invalid' END,
 CASE WHEN n>1 THEN 'duplicate_index' END, CASE WHEN s.tri IS NULL THEN 'index_out_of_range' END, CASE WHEN w.tri<>s.tri THEN 'tri_mismatch' END]) code FROM w LEFT JOIN s USING("index")), v AS (SELECT * FROM c WHERE code IS NOT NULL)"""


def _reviews(spark, d):
    k = F.col("c_custkey")
    samples = points(spark, d).select(F.col("id").alias("index"), (F.col("id") % 19).alias("tri"), F.array("x", "y", "z").alias("vector"))
    at = F.when(k % 17 == 1, k - 1).otherwise(k)
    items = read(spark, d, "customer").select(
        k.alias("review_id"), at.alias("index"), F.when(k % 13 == 0, -1).when(k % 3 > 0, at % 19).alias("tri"), _picked(("accept", "needs-correction", "reject", "", "Approved", "huh"), k).alias("word"), F.when(k % 4 == 0, False).alias("accepted"),
        F.when(k % 11 == 0, " ").otherwise("r").alias("reviewer"), F.when(k % 7 > 0, "2024-05-01").alias("reviewed_at"), F.when(k % 5 == 0, (k % 360).cast("double")).alias("angle"),
        F.when(k % 10 == 0, F.array(*[F.lit(0.0)] * 3)).when(k % 2 == 0, F.array((k % 3).cast("double"), F.lit(1.0), F.lit(0.5))).alias("correction"),
    )
    return samples, items


@query(f"WITH {REVIEWS} SELECT k review_id, code FROM v")
def review_violations(spark, d):
    samples, items = _reviews(spark, d)
    return C.review_violations(items, samples)


@query(f"""WITH {REVIEWS}, g AS (SELECT * FROM w WHERE k NOT IN (SELECT k FROM v)), r AS (SELECT s.*, g.k, g.decision, g.vectored, coalesce(g.decision='corrected',false) fixed FROM s LEFT JOIN g USING("index")),
 t AS (SELECT *, CASE WHEN fixed AND vectored THEN (k%3)::DOUBLE WHEN fixed THEN cos(radians(k%360)) ELSE x END a, CASE WHEN fixed AND vectored THEN 1e0 WHEN fixed THEN sin(radians(k%360)) ELSE y END b, CASE WHEN fixed AND vectored THEN 0.5e0 ELSE z END c FROM r),
 q AS (SELECT *, CASE WHEN fixed THEN sqrt(a*a+b*b+c*c) ELSE 1 END m FROM t)
 SELECT "index", decision, round(a/m,4)+0 x, round(b/m,4)+0 y, round(c/m,4)+0 z, round(degrees(CASE WHEN fixed THEN atan2(round(b/m,6),round(a/m,6)) ELSE atan2(b,a) END),3)+0 angle, coalesce(decision IN ('accepted','corrected'),false) applied, coalesce(decision='rejected',false) excluded, CASE WHEN fixed THEN round(x,4)+0 END before_x FROM q""")
def reviewed_prior(spark, d):
    """Directions as reviewed, by the items that violate nothing."""
    samples, items = _reviews(spark, d)
    sound = items.join(C.review_violations(items, samples).select("review_id").distinct(), "review_id", "left_anti")
    out = C.reviewed(samples, sound)
    v = F.col("vector")
    return rounded(out.select("index", "decision", *(F.get(v, F.lit(i)).alias(n) for i, n in enumerate("xyz")), "angle", "applied", "excluded", F.get("before", F.lit(0)).alias("before_x")))


@query("""WITH p AS (SELECT l_orderkey//4 atlas, l_orderkey line, l_partkey%100 tri, l_discount*5 u, l_tax*7 v FROM lineitem), l AS (SELECT atlas, line, count(*) n, max(tri) t, bool_or(greatest(u,v,1-u-v)>1.001 OR least(u,v,1-u-v)<-0.001) w FROM p GROUP BY 1,2)
 SELECT atlas, 'version_mismatch' code, NULL line FROM l WHERE atlas%5=0 GROUP BY 1 UNION ALL SELECT atlas, 'topologyId_mismatch', NULL FROM l WHERE atlas%7=0 GROUP BY 1 UNION ALL SELECT atlas, 'few_points', line::VARCHAR FROM l WHERE n<2 UNION ALL SELECT atlas, 'triangle_out_of_range', line::VARCHAR FROM l WHERE t>=98 UNION ALL SELECT atlas, 'weights_out_of_range', line::VARCHAR FROM l WHERE w""")
def atlas_contract(spark, d):
    """Atlases of a few orders' lines each, written as JSON, read back and checked."""
    point = F.struct("l_linenumber", (F.col("l_partkey") % 100).cast("double").alias("tri"), (F.col("l_discount") * 5).alias("u"), (F.col("l_tax") * 7).alias("v"))
    lines = read(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 4).alias("atlas"), "l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("points"))
    line = F.struct(F.col("l_orderkey").cast("string").alias("name"), F.lit(None).cast("string").alias("region"), "points")
    atlases = lines.groupBy("atlas").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    a = F.col("atlas")
    header = {"system": F.lit("lines"), "version": F.when(a % 5 == 0, "0.2"), "topologyId": F.when(a % 7 == 0, "other").otherwise("mesh"), "topologyVersion": F.lit("1")}
    text = atlases.select("atlas", C.atlas_json(header, F.col("lines")).alias("json"))
    read_back = text.select("atlas", C.atlas_read(F.col("json")).alias("a"))
    issues = C.atlas_issues(F.col("a"), 98, {"version": "0.1", "topologyId": "mesh", "topologyVersion": "1"})
    return read_back.select("atlas", F.explode(issues).alias("i")).select("atlas", "i.code", "i.line")


@query("""WITH r AS (SELECT event_type, event_id%9-1+CASE WHEN event_id%11=0 THEN 0.5e0 ELSE 0e0 END tri, (event_id%7)/8e0 u, (event_id%5)/8e0 v, CASE WHEN event_id%2=0 THEN (event_id%3)/4e0 END w, CASE WHEN event_id%10=0 THEN 'inf'::DOUBLE WHEN event_id%10=1 THEN 0.2e0 END distance FROM events)
 SELECT event_type, count(*) n, count(*) FILTER (WHERE tri>=0 AND tri=floor(tri) AND abs(u+v+coalesce(w,1-u-v)-1)<=1e-4 AND coalesce(w,1-u-v)>=-1e-4 AND (distance IS NULL OR NOT isinf(distance))) valid FROM r GROUP BY 1""")
def surface_refs(spark, d):
    """How many surface references of each kind of event stand."""
    i = F.col("event_id")
    ok = C.valid_ref(i % 9 - 1 + F.when(i % 11 == 0, 0.5).otherwise(0.0), i % 7 / 8, i % 5 / 8, F.when(i % 2 == 0, i % 3 / 4), F.when(i % 10 == 0, float("inf")).when(i % 10 == 1, 0.2))
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


@query("""WITH w AS (SELECT p_partkey k, p_size s, [abs(least(i,8-i)*(1+p_size%3)-CASE WHEN p_partkey%5=0 AND i=2 THEN 2 ELSE 0 END)::DOUBLE for i in range(9)] w FROM part),
 b AS (SELECT k, s, w, j, (k+j*3)%11-1 c, abs(j-1.5e0)*(s%4) y FROM w, range(4) t(j) WHERE k%7>0), m AS (SELECT k, round(min(e),4)+0 least_margin, count(*) FILTER (WHERE e<-1e-6) outside FROM (SELECT k, CASE WHEN c<0 THEN c+0.5e0 WHEN c>7 THEN 7.5e0-c ELSE (w[c+1]+w[c+2])/2 END-y e FROM b) GROUP BY 1)
 SELECT w.k p_partkey, len([i for i in range(8) if (i<4 AND w[i+2]-w[i+1]<-1e-7) OR (i>=4 AND w[i+2]-w[i+1]>1e-7)])=0 monotone, round((w.k%4)*0.25e0,4) symmetry_error, least_margin, coalesce(outside,0) outside FROM w LEFT JOIN m USING(k)""")
def outline_quality(spark, d):
    """Outlines of nine points a side and how well boundary points lie within."""
    k, s = F.col("p_partkey"), F.col("p_size")
    at = F.sequence(F.lit(0), F.lit(8))
    y = lambda i: F.least(i, 8 - i) * (1 + s % 3) - F.when((k % 5 == 0) & (i == 2), 2).otherwise(0)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    # Dealt over the tasks first: a part's outlines cost far more than its row, and one file of parts is one task.
    parts = dealt(read(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    sides = parts.select(
        "p_partkey", F.transform(at, lambda i: point(i, y(i))).alias("upper"), F.transform(at, lambda i: point(i, -y(i) + k % 4 * 0.25)).alias("lower"),
        F.slice(F.array(*(point((k + j * 3) % 11 - 0.5, (j - 1.5) * (s % 4)) for j in range(4))), F.lit(1), F.when(k % 7 == 0, 2).otherwise(4)).alias("boundary"),
    )
    out = sides.select("p_partkey", C.outline_quality(F.col("upper"), F.col("lower"), F.col("boundary")).alias("q"))
    return rounded(out.select("p_partkey", "q.monotone", "q.symmetry_error", "q.least_margin", F.col("q.outside").cast("long").alias("outside")))


_STABILITY = """{"schema_version":"incision-overlay-stability/v0.'||CASE WHEN k%15=10 THEN 2 ELSE 1 END||'","passed":'||CASE WHEN k%4=0 THEN 'false' ELSE 'true' END||',"overall":{"rms_px":'||k%50||'}}"""
#: SQL of a review record of each order k: sections at each of the places where they may be, one in fifteen of another schema.
RECORD = f"""'{{"candidate":{{"type":"'||CASE WHEN k%2=0 THEN 'linear' ELSE 'fusiform' END||'","direction_confidence":0.'||k%10||',"metrics":{{"diameter_coverage_deficit_mm":'||k%6||',"length_to_width_ratio":"3.'||k%9||'","rstl_deviation_deg":true}}}},'
||CASE WHEN k%3=0 THEN '"incision_overlay_stability":{_STABILITY},' WHEN k%3=1 THEN '"incision_overlay_stability":{{}},"overlay_stability":{_STABILITY},' ELSE '"incision_overlay":{{"stability":{_STABILITY},"registration":{{"schema_version":"incision-overlay-registration/v0.1","passed":"yes","mapped_point_count":'||k%40||'}}}},' END
||'"diagnostics":{{"sections":{{"incision_overlay_runtime":{{"schema_version":"incision-overlay-runtime-diagnostics/v0.1","local_region_quality":{{"schema_version":"rstl-local-region-quality-gate/v0.1","passed":'||CASE WHEN k%5=0 THEN 'null' WHEN k%5>2 THEN 'true' ELSE 'false' END||',"active_region_count":'||k%4||',"regions":[{{"action":"normal","motion_norm":9}},{{"action":"dim","motion_norm":'||k%10||'}}]}}}}}}}},'
||'"overlay_3d_view":{{"schema_version":"incision-overlay-3d-view/v0.1","rendered":'||CASE WHEN k%4=1 THEN 'false' ELSE 'true' END||',"candidate_point_count":'||k%30||'}},"secondary_cues":{{"present":'||CASE WHEN k%6=0 THEN 'true' ELSE 'false' END||',"lesion":{{"iou":0.'||k%8||'}}}}}}'"""


def _sections(spark, d):
    """Sections of all records. Keys are dealt over the tasks first, as a record's paths cost far more than its row and one file is one task."""
    keys = dealt(read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k")
    return C.sections(keys.withColumn("record", F.expr(RECORD)), "record")


@query("""WITH o AS (SELECT o_orderkey k FROM orders), m AS (SELECT 'direction_confidence' metric, (k%10)/10e0 v FROM o UNION ALL SELECT 'diameter_coverage_deficit_mm', k%6 FROM o WHERE k%2=0 UNION ALL SELECT 'length_to_width_ratio', 3+(k%9)/10e0 FROM o WHERE k%2=1 UNION ALL SELECT 'jitter_rms_px', k%50 FROM o WHERE k%15<>10 UNION ALL SELECT 'mapped_point_count', k%40 FROM o WHERE k%3=2
 UNION ALL SELECT 'active_region_count', k%4 FROM o UNION ALL SELECT 'region_motion_norm', k%10 FROM o UNION ALL SELECT 'view_candidate_point_count', k%30 FROM o UNION ALL SELECT 'lesion_iou', (k%8)/10e0 FROM o WHERE k%6=0)
 SELECT metric, count(*) n, round(avg(v),4) mean, round(median(v),4) median, round(quantile_disc(v,0.9),4) p90, round(min(v),4) "least", round(max(v),4) "most" FROM m GROUP BY 1""")
def record_rollup(spark, d):
    """Number summaries of all metrics of review records, in one pass over them."""
    return rounded(C.rolled_up(_sections(spark, d)))


@query("""WITH o AS (SELECT o_orderkey k FROM orders), r AS (SELECT unnest([{'s':'stability','h':k%15<>10,'ok':k%4<>0},{'s':'registration','h':k%3=2,'ok':NULL},{'s':'replay','h':false,'ok':NULL},{'s':'local_region','h':true,'ok':CASE WHEN k%5>0 THEN k%5>2 END},{'s':'smoothing','h':false,'ok':NULL},{'s':'view_3d','h':true,'ok':k%4<>1}]) r FROM o)
 SELECT r.s section, count(*) FILTER (WHERE r.h) present, count(*) FILTER (WHERE r.h AND r.ok) passed, count(*) FILTER (WHERE r.h AND NOT r.ok) failed FROM r GROUP BY 1""")
def record_gates(spark, d):
    """How many review records have each section, and pass and fail it."""
    return C.section_gates(_sections(spark, d))


@query("""WITH e AS (SELECT user_id, (['photo','video','camera'])[event_id%3+1] kind, event_id%4>0 reg, event_id%5=0 stab, event_id%9=1 rep, event_id%7=4 play, CASE WHEN event_id%199=0 THEN 1 ELSE 0 END+CASE WHEN event_id%211=0 THEN 2 ELSE 0 END err, CASE WHEN event_id%6=0 THEN event_id%12=0 END res, CASE WHEN event_id%223=0 THEN 1 END leak FROM events),
 c AS (SELECT user_id, count(*) entries, bool_or(kind='photo' AND reg) a, bool_or(kind='video' AND (rep OR (reg AND stab))) b, bool_or(kind='video' AND play) c, bool_or(kind='camera' AND reg AND stab) d, sum(err)=0 e, coalesce(bool_or(res),false) f, count(leak)=0 g FROM e GROUP BY 1)
 SELECT user_id, entries, concat_ws(',', CASE WHEN NOT a THEN 'photo_overlay_ready' END, CASE WHEN NOT b THEN 'video_overlay_stable' END, CASE WHEN NOT c THEN 'video_export_playable' END, CASE WHEN NOT d THEN 'camera_overlay_stable' END, CASE WHEN NOT e THEN 'runtime_error_free' END, CASE WHEN NOT f THEN 'resources_available' END, CASE WHEN NOT g THEN 'sanitized_evidence_only' END) failures, a AND b AND c AND d AND e AND f AND g passed FROM c""")
def acceptance_audit(spark, d):
    """Each user's events as evidence, held to seven checks."""
    i = F.col("event_id")
    errors = C.runtime_errors(F.create_map(F.lit("runtime.error"), F.when(i % 199 == 0, 1).otherwise(0), F.lit("other"), F.lit(5)), F.when(i % 211 == 0, F.array(F.lit("runtime.unhandledrejection"), F.lit("started"), F.lit("runtime.error"))))
    rows = read(spark, d, "events").select("user_id", _picked(("photo", "video", "camera"), i).alias("kind"), (i % 4 > 0).alias("registration"), (i % 5 == 0).alias("stability"), (i % 9 == 1).alias("replay"), (i % 7 == 4).alias("playable"), errors.alias("runtime_errors"), F.when(i % 6 == 0, i % 12 == 0).alias("resources"), F.when(i % 223 == 0, 1).alias("leaks"))
    return C.acceptance(rows, ["user_id"]).select("user_id", "entries", F.array_join("failures", ",").alias("failures"), "passed")


@query("""SELECT o_orderkey, concat_ws(',', 'lip', CASE WHEN o_custkey%3=0 THEN 'ala' END) structures, CASE WHEN o_custkey%3=0 THEN 2 ELSE 1 END::BIGINT overrides, o_custkey%4>=2 AND o_custkey%5>0 renderable, CASE WHEN o_custkey%2=0 THEN 'import' ELSE 'synthetic' END source, false used_for_geometry FROM orders""")
def override_previews(spark, d):
    """Suggested directions, one for each structure, whether a candidate can be drawn, and its cue as review alone may use it."""
    c = F.col("o_custkey")
    each = lambda s, w: F.struct(F.lit(s).alias("structure"), F.lit(w).alias("source_warning"))
    asked = F.array_compact(F.array(each("lip", "near"), F.when(c % 3 == 0, each("ala", "near")), each("lip", "centre"), F.when(c % 3 == 0, each("ala", "centre"))))
    kept = C.first_of_each(asked, "structure")
    cue = C.review_only_cue(F.when(c % 2 == 0, F.lit("import")), F.lit(None).cast("string"))
    drawn = C.renderable(F.array_repeat(F.lit(0.0), (c % 4).cast("int")), F.when(c % 5 > 0, F.array_repeat(F.lit(0.0), 3)))
    rows = read(spark, d, "orders").select("o_orderkey", kept.alias("kept"), drawn.alias("renderable"), cue.alias("cue"))
    return rows.select("o_orderkey", F.array_join(F.transform("kept", lambda s: s["structure"]), ",").alias("structures"), F.size("kept").cast("long").alias("overrides"), "renderable", "cue.source", "cue.used_for_geometry")
