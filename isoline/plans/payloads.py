"""Queries of nested payloads, direction marks and mesh texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import payloads as A
from isoline.operators import sequence as Q
from isoline.plans.geometry import POINTS
from isoline.plans.registry import query, rounded
from isoline.plans.sequence import SAMPLES
from isoline.sources import meshes as M
from isoline.sources.tables import dealt, points, read, samples

#: SQL of a payload of each event, with a leaf for each rule.
PAYLOAD = """'{"record":{"raw_image_sent":'||CASE WHEN event_id%4=0 THEN 'true' ELSE 'false' END||',"notes":"'||CASE WHEN event_id%5=0 THEN 'u'||user_id||'@example.com' ELSE event_type END||'","secondary_cues":{"used_for_geometry":'||CASE WHEN event_id%6=0 THEN 'true' ELSE 'false' END
||',"items":[{"used_for_agent_prompt":'||CASE WHEN event_id%7=0 THEN 'true' ELSE 'null' END||'},'||event_id||']}},"auth":[{"api_key":"'||CASE WHEN event_id%3=0 THEN '[redacted]' ELSE 'tk'||event_id END||'","api_key_present":true}],"Patient_Name":"'||CASE WHEN event_id%11=0 THEN 'x' ELSE ' ' END||'","frame":"'||CASE WHEN event_id%9=0 THEN 'data:image/png;base64,AA' ELSE 'none' END||'"}'"""


@query(f"""WITH p AS (SELECT event_id, {PAYLOAD} js FROM events), l AS (SELECT event_id, replace(replace(substr(fullkey,3),'[','.'),']','') path, j.type kind, json_extract_string(j.atom,'$') v FROM p, json_tree(p.js) j WHERE j.type NOT IN ('OBJECT','ARRAY')),
 c AS (SELECT event_id, path, unnest([CASE WHEN ends_with(path,'raw_image_sent') AND kind='BOOLEAN' AND v='true' THEN 'raw_media_flag_true' END, CASE WHEN contains(path,'secondary_cues') AND ends_with(path,'used_for_geometry') AND v='true' THEN 'secondary_cue_used_for_geometry' END,
 CASE WHEN contains(path,'secondary_cues') AND ends_with(path,'used_for_agent_prompt') AND v='true' THEN 'secondary_cue_sent_to_agent_prompt' END, CASE WHEN contains(path,'api_key') AND NOT ends_with(path,'_present') AND v<>'[redacted]' THEN 'secret_value_present' END,
 CASE WHEN contains(lower(path),'patient_name') AND trim(v)<>'' THEN 'pii_field_present' END, CASE WHEN kind='VARCHAR' AND contains(v,'@example.com') THEN 'pii_pattern_present' END, CASE WHEN contains(path,'frame') AND starts_with(v,'data:image/') THEN 'embedded_media_payload' END]) code FROM l)
 SELECT event_id, path, code FROM c WHERE code IS NOT NULL""")
def payload_audit(spark, d):
    """What the leaves of each event's nested payload violate, walked to any depth."""
    rows = dealt(read(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id").select("event_id", F.expr(PAYLOAD).alias("payload"))
    out = A.payload_violations(A.json_leaves(rows, "event_id", "payload"))
    return out.select("event_id", F.array_join("path", ".").alias("path"), "code")


#: SQL of an export of each event: cues, phone numbers, provider settings, raw media flags and media.
EXPORT = """'{"used":{"secondary_cues":[{"used_for_geometry":'||CASE WHEN event_id%6=0 THEN 'true' ELSE 'false' END||'}]},"seen_at":"'||CASE WHEN event_id%4=0 THEN 'call 138-0013-8000 now' ELSE 'x' END||'","note":"'||CASE WHEN event_id%5=0 THEN 'call 138-0013-8000 now' ELSE event_type END||'","provider":{"api_key":'||CASE event_id%3 WHEN 0 THEN '12345' WHEN 1 THEN '"***"' ELSE '"sk'||event_id||'"' END||',"tokens":['||CASE WHEN event_id%2=0 THEN '7' ELSE 'null,"***"' END||'],"api_key_present":5},"contains_raw_media":'||CASE event_id%7 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' WHEN 2 THEN '{"a":[1,false]}' WHEN 3 THEN 'null' ELSE 'false' END
||',"overlay":"'||CASE event_id%8 WHEN 0 THEN 'DATA:IMAGE/png;base64,AA' WHEN 1 THEN 'iVBORw0KGgo'||repeat('A',249) WHEN 2 THEN 'iVBORw0KGgo'||repeat('A',250) ELSE 'x' END||'","photo":'||CASE WHEN event_id%9=0 THEN '"data:image/png;base64,AA"' ELSE 'null' END||',"listed":["data:video/mp4;base64,AA"]}'"""


def _export_leaves(spark, d):
    rows = dealt(read(spark, d, "events").select("event_id", "event_type"), "event_id").select("event_id", F.expr(EXPORT).alias("payload"))
    return A.json_leaves(rows, "event_id", "payload")


@query("""WITH c AS (SELECT event_id, unnest([CASE WHEN event_id%6=0 THEN {'p':'used.secondary_cues.0.used_for_geometry','c':'secondary_cue_used_for_geometry_true'} END, CASE WHEN event_id%5=0 THEN {'p':'note','c':'pii_pattern_present'} END, CASE WHEN event_id%3=2 THEN {'p':'provider.api_key','c':'secret_value_present'} END, CASE WHEN event_id%7=0 THEN {'p':'contains_raw_media','c':'raw_media_flag_true'} END, CASE WHEN event_id%8<2 THEN {'p':'overlay','c':'embedded_media_payload'} END, CASE WHEN event_id%9=0 THEN {'p':'photo','c':'embedded_media_payload'} END]) v FROM events)
 SELECT event_id, v.p path, v.c code FROM c WHERE v IS NOT NULL""")
def export_preflight(spark, d):
    """What the leaves of each event's export violate."""
    return A.export_violations(_export_leaves(spark, d)).select("event_id", F.array_join("path", ".").alias("path"), "code")


@query("""SELECT event_id, 'provider.api_key' path FROM events WHERE event_id%3<>1 UNION ALL SELECT event_id, 'provider.tokens.0' FROM events WHERE event_id%2=0""")
def secret_leaks(spark, d):
    """Texts and numbers of each event's provider settings that leak."""
    return A.secret_leaks(_export_leaves(spark, d)).select("event_id", F.array_join("path", ".").alias("path"))


@query("""SELECT event_id, 'contains_raw_media' path FROM events WHERE event_id%7<3 UNION ALL SELECT event_id, 'photo' FROM events WHERE event_id%9=0""")
def raw_media_paths(spark, d):
    """Where each event's export holds raw media or says so."""
    return A.raw_media_paths(_export_leaves(spark, d), "event_id").select("event_id", F.array_join("path", ".").alias("path"))


@query(f"WITH {POINTS} SELECT id, CASE WHEN x<0 OR (abs(x)<1e-6 AND y<0) THEN -x ELSE x END dx, CASE WHEN x<0 OR (abs(x)<1e-6 AND y<0) THEN -y ELSE y END dy FROM (SELECT id, CASE WHEN id%5=0 THEN 0e0 ELSE round(x,4) END x, round(y,4)+0 y FROM p)")
def axial_directions(spark, d):
    """Each direction as an axis: turned around where it points left, or straight down."""
    rows = points(spark, d).select("id", F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.round("x", 4)).alias("x"), F.round("y", 4).alias("y"))
    return rounded(rows.select("id", *(c.alias(n) for c, n in zip(Q.axial(F.col("x"), F.col("y")), ("dx", "dy"), strict=True))))


@query(f"""WITH {SAMPLES}, p AS (SELECT user_id, seq, value x, event_id%13 y, count(*) OVER (PARTITION BY user_id) n FROM e), a AS (SELECT p.*, least(5,n-1) k FROM p),
 b AS (SELECT user_id, max(x) FILTER (WHERE seq=0) x0, max(y) FILTER (WHERE seq=0) y0, max(x) FILTER (WHERE seq=k) xk, max(y) FILTER (WHERE seq=k) yk, max(x) FILTER (WHERE seq=n-1) x1, max(y) FILTER (WHERE seq=n-1) y1, max(x) FILTER (WHERE seq=n-1-k) xm, max(y) FILTER (WHERE seq=n-1-k) ym FROM a GROUP BY 1),
 v AS (SELECT user_id, 'first' side, x0-xk dx, y0-yk dy FROM b UNION ALL SELECT user_id, 'last', x1-xm, y1-ym FROM b), s AS (SELECT *, sqrt(dx*dx+dy*dy) m FROM v)
 SELECT user_id, side, round(CASE WHEN m<1e-9 THEN 1 ELSE dx/m END,4)+0 tx, round(CASE WHEN m<1e-9 THEN 0 ELSE dy/m END,4)+0 ty FROM s""")
def outward_tangents(spark, d):
    """Unit directions out of both ends of each user's line, from the point five further in."""
    rows = samples(spark, d).select("user_id", "seq", F.col("value").alias("x"), (F.col("event_id") % 13).cast("double").alias("y"))
    return rounded(Q.outward_tangents(rows, "user_id"))


@query(f"""WITH {SAMPLES}, p AS (SELECT user_id, seq, value x, event_id%13 y FROM e), q AS (SELECT *, lead(x) OVER w-x dx, lead(y) OVER w-y dy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)), m AS (SELECT *, sqrt(dx*dx+dy*dy) m FROM q WHERE seq%8=0 AND dx IS NOT NULL)
 SELECT user_id, seq, round(x+dy/m*5,4)+0 ax, round(y-dx/m*5,4)+0 ay, round(x-dy/m*5,4)+0 bx, round(y+dx/m*5,4)+0 "by" FROM m WHERE m>=1e-6""")
def direction_ticks(spark, d):
    """A tick across every eighth segment of each user's line."""
    rows = samples(spark, d).select("user_id", "seq", F.col("value").alias("x"), (F.col("event_id") % 13).cast("double").alias("y"))
    return rounded(Q.ticks(rows, "user_id", 8, 5.0))


@query("""WITH f AS (SELECT vec_id%40 mesh, round(embedding[1]::DOUBLE,6) x, count(*) OVER (PARTITION BY vec_id%40) n FROM embeddings)
 SELECT mesh, count(*) vertices, CAST(CASE WHEN count(*)>=3 THEN count(*)-2 ELSE 0 END AS BIGINT) triangles, round(sum(x),4)+0 sum_x FROM f GROUP BY 1""")
def ply_text(spark, d):
    """Meshes written as PLY texts by Spark, one polygon over all vertices, and read from them."""
    v = F.col("vec_id")
    num = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 6).cast("string")
    rows = read(spark, d, "embeddings").select((v % 40).alias("mesh"), F.struct("vec_id", F.concat_ws(" ", F.lit("9"), num(0), num(1), num(2)).alias("line")).alias("r"))
    texts = rows.groupBy("mesh").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]).alias("vs"))
    n = F.size("vs")
    head = F.concat(F.lit("ply\nformat ascii 1.0\ncomment made\nelement vertex "), n, F.lit("\nproperty uchar quality\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"))
    texts = texts.select("mesh", F.concat(head, F.array_join("vs", "\n"), F.lit("\n"), F.concat_ws(" ", n, F.array_join(F.sequence(F.lit(0), n - 1), " "))).alias("text"))
    vs = M.ply_vertices(texts, "mesh", "text")
    tris = M.ply_triangles(texts, "mesh", "text").groupBy("mesh").agg(F.count("*").alias("triangles"))
    out = vs.groupBy("mesh").agg(F.count("*").alias("vertices"), F.sum("x").alias("sum_x")).join(tris, "mesh", "left")
    return rounded(out.select("mesh", "vertices", F.coalesce("triangles", F.lit(0)).alias("triangles"), "sum_x"))
