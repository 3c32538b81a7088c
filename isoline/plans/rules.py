"""Queries of the rule, review and audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators import audit as A
from isoline.operators import review as V
from isoline.operators import rules as R
from isoline.plans.registry import query, rounded
from isoline.sources.tables import points, read

NAMES = ["lower_eyelid", "lip_vermilion_margin_left", "cheek", "nasal_tip", "chin", "inner_canthus_right"]
#: SQL and columns of candidates read from line items.
CANDIDATES = f"""c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag='A' THEN 'fusiform' ELSE 'linear' END type, l_discount*8 direction_confidence, l_tax*10 region_confidence,
 ({NAMES!r})[l_suppkey%6+1] region, ({NAMES!r})[l_partkey%6+1] nearest, l_quantity margin_mm, greatest(l_linenumber-5,0)::DOUBLE diameter_deficit, l_partkey%9 pts, l_partkey%17=0 crosses, l_discount area_ratio, l_quantity/2 shift, 18e0 diameter,
 l_suppkey%19=0 ocrosses, l_suppkey%23<>0 tapers, CASE WHEN l_partkey%29=0 THEN 1 ELSE 0 END outside, greatest(l_linenumber-6,0)::DOUBLE axis_deficit, l_quantity+5 candidate_mm, l_tax*400 deviation, CASE WHEN l_linestatus='O' THEN 'noted' ELSE '' END reason FROM lineitem)"""


def _candidates(spark, d):
    c = F.col
    name = lambda i: F.get(F.array(*map(F.lit, NAMES)), i.cast("int"))
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_returnflag") == "A", "fusiform").otherwise("linear").alias("type"), (c("l_discount") * 8).alias("direction_confidence"), (c("l_tax") * 10).alias("region_confidence"),
        name(c("l_suppkey") % 6).alias("region"), F.array(name(c("l_partkey") % 6)).alias("landmarks"), name(c("l_partkey") % 6).alias("nearest_margin"), c("l_quantity").alias("margin_mm"), F.greatest(c("l_linenumber") - 5, F.lit(0)).cast("double").alias("diameter_deficit"),
        F.lit(True).alias("boundary_used"), (c("l_partkey") % 9).alias("boundary_points"), (c("l_partkey") % 17 == 0).alias("boundary_crosses"), c("l_discount").alias("area_ratio"), (c("l_quantity") / 2).alias("center_shift"), F.lit(18.0).alias("diameter"),
        (c("l_suppkey") % 19 == 0).alias("outline_crosses"), (c("l_suppkey") % 23 != 0).alias("outline_tapers"), F.when(c("l_partkey") % 29 == 0, 1).otherwise(0).alias("outside_points"), F.greatest(c("l_linenumber") - 6, F.lit(0)).cast("double").alias("axis_deficit"),
        (c("l_quantity") + 5).alias("candidate_mm"), (c("l_tax") * 400).alias("deviation"), F.when(c("l_linestatus") == "O", "noted").otherwise("").alias("override_reason"))


def _threshold_sql(n: str, fall: bool = True) -> str:
    """The distances once more, so that the SQL doesn't share the operator's table."""
    whole = f"WHEN {n}='default' THEN 18 WHEN {n} IN ('lower_eyelid','lower_eyelid_margin') THEN 16 WHEN {n} IN ('lip_vermilion','lip_vermilion_margin','oral_commissure','inner_canthus') THEN 14 WHEN {n} IN ('nasal_ala','nasal_ala_margin') THEN 12 WHEN {n}='nasal_tip' THEN 10"
    part = f"WHEN contains({n},'lower_eyelid') THEN 16 WHEN contains({n},'lip_vermilion') OR contains({n},'oral_commissure') THEN 14 WHEN contains({n},'nasal_ala') THEN 12 WHEN contains({n},'nasal_tip') THEN 10 WHEN contains({n},'inner_canthus') THEN 14"
    return f"CASE {whole} {part} ELSE 18 END" if fall else f"CASE {whole} {part} END"


CODES = f"""w AS (SELECT *, {_threshold_sql("nearest")} thr FROM c), k AS (SELECT *, [CASE WHEN direction_confidence<0.35 THEN 'low_rstl_confidence:medium' END, CASE WHEN region_confidence<0.45 THEN 'low_region_confidence:medium' END,
 CASE WHEN region IN ('lower_eyelid','lip_vermilion','nasal_ala','nasal_tip','oral_commissure') THEN 'sensitive_region_'||region||':high' END, CASE WHEN margin_mm<=thr THEN 'near_sensitive_free_margin:high' END, CASE WHEN type='linear' AND diameter_deficit>1e-6 THEN 'linear_diameter_coverage_deficit:high' END,
 CASE WHEN type='fusiform' AND pts>0 AND pts<6 THEN 'cutaneous_boundary_too_few_points:medium' END, CASE WHEN type='fusiform' AND crosses THEN 'cutaneous_boundary_self_intersection:high' END, CASE WHEN type='fusiform' AND area_ratio<0.08 THEN 'cutaneous_boundary_degenerate_area:high' END,
 CASE WHEN type='fusiform' AND shift>diameter THEN 'cutaneous_boundary_center_shift:high' END, CASE WHEN type='fusiform' AND ocrosses THEN 'fusiform_outline_self_intersection:high' END, CASE WHEN type='fusiform' AND NOT tapers THEN 'fusiform_outline_not_smoothly_tapered:high' END,
 CASE WHEN type='fusiform' AND outside>0 THEN 'fusiform_boundary_outside_envelope:high' END, CASE WHEN type='fusiform' AND axis_deficit>1e-6 THEN 'fusiform_axis_coverage_deficit:high' END, CASE WHEN candidate_mm<=thr THEN 'candidate_near_sensitive_free_margin:high' END,
 CASE WHEN abs(deviation)>15 THEN 'rstl_deviation_override:'||CASE WHEN reason<>'' THEN 'medium' ELSE 'high' END END] l FROM w), g AS (SELECT *, array_to_string(l,',') codes FROM k),
 s AS (SELECT *, (length(codes)-length(replace(codes,':high','')))//5 high, (length(codes)-length(replace(codes,':medium','')))//7 medium FROM g)"""


@query(f"WITH {CANDIDATES}, {CODES} SELECT l_orderkey, l_linenumber, l_partkey, codes, high, medium, high=0 passed FROM s")
def guardrail_warnings(spark, d):
    rows = _candidates(spark, d).withColumn("w", R.warnings())
    codes = F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["code"], x["severity"])), ",")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", codes.alias("codes"), R.severity_count("w", "high").alias("high"), R.severity_count("w", "medium").alias("medium"), (R.severity_count("w", "high") == 0).alias("passed"))


@query(f"""WITH {CANDIDATES}, {CODES}, o AS (SELECT s.*, o_orderstatus='P' rejected FROM s JOIN orders ON o_orderkey=l_orderkey),
 q AS (SELECT *, high*100+medium*25+deviation+(diameter_deficit+axis_deficit)*10+(l_partkey%4)*2+greatest(0,thr-margin_mm)*5+CASE WHEN rejected THEN 1000 ELSE 0 END score FROM o)
 SELECT l_orderkey, l_linenumber, l_partkey, round(score,3) score, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(score,9), l_linenumber*100000000+l_partkey) "rank" FROM q""")
def rank_candidates(spark, d):
    """Each order's candidates ranked; one shuffle by order serves the ranks."""
    rows = _candidates(spark, d).withColumn("w", R.warnings())
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", *(R.severity_count("w", s).alias(s) for s in ("high", "medium", "low")), "deviation", "diameter_deficit", "axis_deficit", (F.col("l_partkey") % 4).cast("double").alias("tip_error"), "margin_mm", R.threshold_near(F.col("nearest_margin"), F.lit("unknown")).alias("margin_threshold"))
    rows = rows.join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "P").alias("rejected")), "l_orderkey")
    rows = rows.withColumn("at", F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey"))
    return R.ranked(rows, ["l_orderkey"], "at").select("l_orderkey", "l_linenumber", "l_partkey", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_partkey, o "offset", round(cos(p_size/8e0)*cos(radians(o))-sin(p_size/8e0)*sin(radians(o)),4)+0 vx, round(cos(p_size/8e0)*sin(radians(o))+sin(p_size/8e0)*cos(radians(o)),4)+0 vy,
 round(least(greatest((p_retailprice-900)/1100e0-abs(o)/180,0),1),4)+0 confidence FROM (SELECT *, unnest([-10e0,0e0,10e0]) o FROM part)""")
def direction_variants(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.cos(F.col("p_size") / 8).alias("ax"), F.sin(F.col("p_size") / 8).alias("ay"), ((F.col("p_retailprice") - 900) / 1100.0).alias("confidence"))
    return rounded(R.variants(rows).select("p_partkey", "offset", "vx", "vy", "confidence"))


@query(f"""WITH n AS (SELECT p_partkey, ({NAMES!r})[p_partkey%6+1] a, ({NAMES!r})[p_size%6+1] b FROM part)
 SELECT p_partkey, coalesce(greatest({_threshold_sql("a", False)}, {_threshold_sql("b", False)}),18)::DOUBLE threshold_mm,
 coalesce({", ".join("CASE " + " ".join(f"WHEN contains({x},'{k}') THEN '{k}'" for k in R.PROTECTED) + " END" for x in ("a", "b", "'cheek'"))}) protected FROM n""")
def threshold_lookup(spark, d):
    name = lambda c: F.get(F.array(*map(F.lit, NAMES)), (F.col(c) % 6).cast("int"))
    names = F.array(name("p_partkey"), name("p_size"))
    return read(spark, d, "part").select("p_partkey", R.threshold_of(names, F.lit("unknown")).alias("threshold_mm"), R.protective_rule(names, F.lit("cheek")).alias("protected"))


@query("""WITH p AS (SELECT p_partkey, least(greatest(3*(p_size/4e0+2),12),80)/2 hl, (p_size/4e0+2)/2 hw, least(greatest(20+p_size%40,8),75)::DOUBLE tip FROM part),
 s AS (SELECT *, least(hl/hw*tan(radians(tip/2)),2.95) slope, hl/hw*tan(radians(tip/2))>2.95 limited FROM p), o AS (SELECT *, unnest(range(17)) i FROM s),
 u AS (SELECT *, CASE WHEN i<=8 THEN i/8e0 ELSE 2*(1-i/16e0) END u FROM o), y AS (SELECT *, ((slope-2)*u*u*u+(3-2*slope)*u*u+slope*u)*hw y, (i/16e0-0.5)*2*hl x FROM u)
 SELECT p_partkey, round(degrees(atan(slope/(hl/hw)))*2,4) tip_reached, limited, round(max(y),4) half_width, round(sum(y)*hl/8,4)+0 area FROM y GROUP BY p_partkey, slope, hl, hw, limited""")
def hermite_outline(spark, d):
    w = F.col("p_size") / 4 + 2
    rows = read(spark, d, "part").select("p_partkey", (E.clamp(w * 3, 12.0, 80.0) / 2).alias("half_l"), (w / 2).alias("half_w"), (20 + F.col("p_size") % 40).cast("double").alias("tip_angle"))
    rows = R.fusiform(rows, 16)
    area = F.aggregate("upper", F.lit(0.0), lambda s, p: s + p["y"]) * F.col("half_l") / 8
    return rounded(rows.select("p_partkey", "tip_reached", "limited", F.array_max(F.col("upper.y")).alias("half_width"), area.alias("area")))


@query("""WITH v AS (SELECT vec_id, unnest(range(7)) i, embedding e FROM embeddings), p AS (SELECT vec_id, i, e[2*i+1]::DOUBLE x, e[2*i+2]::DOUBLE y FROM v),
 q AS (SELECT a.vec_id, a.i, a.x ax, a.y ay, b.x bx, b.y yb FROM p a JOIN p b ON a.vec_id=b.vec_id AND b.i=(a.i+1)%7), r AS (SELECT vec_id, abs(sum(ax*yb-ay*bx))/2 area FROM q GROUP BY 1),
 t AS (SELECT s.vec_id, bool_or(((s.bx-s.ax)*(t.ay-s.ay)-(s.yb-s.ay)*(t.ax-s.ax))*((s.bx-s.ax)*(t.yb-s.ay)-(s.yb-s.ay)*(t.bx-s.ax))<-1e-9 AND ((t.bx-t.ax)*(s.ay-t.ay)-(t.yb-t.ay)*(s.ax-t.ax))*((t.bx-t.ax)*(s.yb-t.ay)-(t.yb-t.ay)*(s.bx-t.ax))<-1e-9) x FROM q s JOIN q t ON s.vec_id=t.vec_id AND t.i>=s.i+2 AND NOT (s.i=0 AND t.i=6) GROUP BY 1)
 SELECT vec_id, round(area,4) area, x crosses FROM r JOIN t USING(vec_id)""")
def polygon_checks(spark, d):
    ring = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    rows = read(spark, d, "embeddings").select("vec_id", ring.alias("p"))
    return rounded(rows.select("vec_id", R.shoelace(F.col("p")).alias("area"), R.crosses(F.col("p")).alias("crosses")))


@query("SELECT p_partkey, round(least(greatest(p_size*1.25e0,8),35),4) length, round(greatest(0,p_size-least(greatest(p_size*1.25e0,8),35)),4) deficit, p_size*1.25e0<8 OR p_size*1.25e0>35 clamped FROM part")
def linear_candidates(spark, d):
    return rounded(read(spark, d, "part").select("p_partkey", R.linear_length(F.col("p_size").cast("double")).alias("c")).select("p_partkey", "c.*"))


@query("""WITH s AS (SELECT s_suppkey i, s_nationkey/25e0 c, (s_suppkey*7)%60 sp, s_suppkey%19 tri, s_acctbal x, (s_suppkey*37)%101 y, (s_suppkey*53)%103 z FROM supplier), n AS (SELECT count(*) n FROM s),
 m AS (SELECT arg_min(i,(x,i)) x0, arg_max(i,(x,-i)) x1, arg_min(i,(y,i)) y0, arg_max(i,(y,-i)) y1, arg_min(i,(z,i)) z0, arg_max(i,(z,-i)) z1 FROM s),
 f AS (SELECT s.*, n, list_sort(list_concat(CASE WHEN c<0.1 THEN ['low_confidence'] ELSE [] END, CASE WHEN sp>55 THEN ['high_angular_spread'] ELSE [] END, CASE WHEN i=x0 THEN ['spatial_min_x'] ELSE [] END, CASE WHEN i=x1 THEN ['spatial_max_x'] ELSE [] END, CASE WHEN i=y0 THEN ['spatial_min_y'] ELSE [] END, CASE WHEN i=y1 THEN ['spatial_max_y'] ELSE [] END, CASE WHEN i=z0 THEN ['spatial_min_z'] ELSE [] END, CASE WHEN i=z1 THEN ['spatial_max_z'] ELSE [] END)) r FROM s, n, m),
 t AS (SELECT *, i%greatest(1,n//24)=0 st, count(*) FILTER (WHERE len(r)>0) OVER () fl, coalesce(sum(CASE WHEN len(r)=0 AND i%greatest(1,n//24)=0 THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) nw FROM f),
 u AS (SELECT *, list_sort(CASE WHEN st AND (i=0 OR nw+fl<24) THEN list_append(r,'uniform_coverage') ELSE r END) rr FROM t)
 SELECT i AS "index", round(c,4) confidence, array_to_string(rr,',') reasons FROM u WHERE len(rr)>0 ORDER BY c, sp DESC, tri, i LIMIT 24""")
def review_selection(spark, d):
    """A review list of at most 24 suppliers: a top-k report."""
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select(k.alias("index"), (F.col("s_nationkey") / 25).alias("confidence"), ((k * 7) % 60).alias("spread"), F.struct((k % 19).alias("t"), k.alias("i")).alias("tri"), F.col("s_acctbal").alias("x"), ((k * 37) % 101).alias("y"), ((k * 53) % 103).alias("z"))
    out = V.selected(rows, 24, 0.1, 55)
    return rounded(out.select("index", "confidence", F.array_join("reasons", ",").alias("reasons")))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal, CASE WHEN c_custkey%3=0 THEN NULL ELSE c_custkey*10 END k, c_custkey*10+1 f, (['accept','needs-correction','reject','','Approved'])[c_custkey%5+1] dec FROM customer),
 i AS (SELECT o_orderkey, o_orderkey k, o_orderkey f FROM orders), j AS (SELECT o_orderkey, coalesce(a.dec,b.dec) dec, coalesce(a.c_acctbal,b.c_acctbal) bal FROM i LEFT JOIN (SELECT * FROM r WHERE k IS NOT NULL) a ON i.k=a.k LEFT JOIN (SELECT * FROM r WHERE k IS NULL) b ON i.f=b.f)
 SELECT o_orderkey, CASE WHEN s='pending' AND bal>0 THEN 'accepted' WHEN s='pending' AND bal<=0 THEN 'rejected' ELSE s END decision FROM (SELECT *, CASE replace(lower(trim(coalesce(dec,''))),'-','_') WHEN '' THEN 'pending' WHEN 'accept' THEN 'accepted' WHEN 'approved' THEN 'accepted' WHEN 'needs_correction' THEN 'corrected' WHEN 'reject' THEN 'rejected' END s FROM j)""")
def review_overlay(spark, d):
    """Orders with the decision of the review row of their key, or of their fallback key."""
    k = F.col("c_custkey")
    words = F.get(F.array(*map(F.lit, ("accept", "needs-correction", "reject", "", "Approved"))), (k % 5).cast("int"))
    rows = read(spark, d, "customer").select(F.when(k % 3 != 0, k * 10).alias("k"), (k * 10 + 1).alias("f"), words.alias("word"), F.col("c_acctbal").alias("bal"))
    items = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("f"))
    out = V.overlaid(items, rows, "k", "f", ["word", "bal"])
    return out.select("o_orderkey", V.checked_decision(F.col("word"), F.col("bal") > 0, F.lit(False)).alias("decision"))


@query("""SELECT doc_id, arg_min(src,(p,src)) picked FROM (SELECT doc_id, 'manual' src, 0 p FROM labels WHERE quality=1 UNION ALL SELECT doc_id, 'weak', 1 FROM labels UNION ALL SELECT doc_id, 'default', 2 FROM documents WHERE n_chars>100) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1""")
def priority_match(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    tagged = lambda df, src, p: df.select("doc_id", F.lit(src).alias("picked"), F.lit(p).alias("p"))
    rows = tagged(labels.filter("quality = 1"), "manual", 0).unionByName(tagged(labels, "weak", 1)).unionByName(tagged(docs.filter("n_chars > 100"), "default", 2))
    return V.first_by_priority(rows.join(docs.select("doc_id"), "doc_id", "left_semi"), ["doc_id"], "p", "picked").select("doc_id", "picked")


@query("""WITH n AS (SELECT c_custkey+100 c_custkey, c_mktsegment, c_acctbal+1 c_acctbal FROM customer WHERE c_custkey%4=0), u AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n)
 SELECT c_custkey, c_mktsegment, round(c_acctbal,4) c_acctbal FROM u WHERE c_mktsegment='MACHINERY'""")
def upsert_latest(spark, d):
    old = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.filter("c_custkey % 4 = 0").withColumns({"c_custkey": F.col("c_custkey") + 100, "c_acctbal": F.col("c_acctbal") + 1})
    return rounded(V.upserted(old, new, "c_custkey").filter("c_mktsegment = 'MACHINERY'"))


def _audit_sql(table: str, text: str) -> str:
    email = A.EMAIL.replace("(?i)", "")
    return f"SELECT '{table}' source, unnest([CASE WHEN regexp_matches({text},'{email}','i') THEN 'email' END, CASE WHEN regexp_matches({text},'{A.PHONE}') THEN 'phone' END, CASE WHEN contains({text},'data:image/') OR contains({text},'data:video/') OR contains({text},'data:application/dicom') THEN 'embedded_media' END]) code FROM {table}"


@query("SELECT source, code, count(*) n FROM (" + " UNION ALL ".join(_audit_sql(t, c) for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))) + ") WHERE code IS NOT NULL GROUP BY ALL")
def privacy_audit(spark, d):
    rows = None
    for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        part = A.audit_texts(read(spark, d, t), t, c)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source", "code").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT event_id, unnest(['k','auth.'||event_type||'_token','auth.token_present','contact.email']) path, unnest([json_extract_string(props,'$.k'), CASE WHEN event_id%3=0 THEN '[redacted]' ELSE 'tk'||event_id END, 'true', CASE WHEN event_id%5=0 THEN 'u'||user_id||'@example.com' ELSE '' END]) v FROM events),
 c AS (SELECT event_id, path, unnest([CASE WHEN contains(path,'token') AND NOT ends_with(path,'_present') AND lower(v) NOT IN ('','[redacted]','redacted','***','null','none') THEN 'secret_value_present' END, CASE WHEN contains(path,'email') AND v<>'' THEN 'pii_field_present' END, CASE WHEN contains(v,'@example.com') THEN 'pii_pattern_present' END]) code FROM l)
 SELECT event_id, path, code FROM c WHERE code IS NOT NULL""")
def json_leaf_audit(spark, d):
    """Leaves of a payload built from each event, audited by key and value."""
    i = F.col("event_id")
    leaf = lambda p, v: F.struct(p.alias("path"), v.cast("string").alias("value"))
    leaves = F.array(
        leaf(F.lit("k"), F.get_json_object("props", "$.k")), leaf(F.concat(F.lit("auth."), F.col("event_type"), F.lit("_token")), F.when(i % 3 == 0, "[redacted]").otherwise(F.concat(F.lit("tk"), i))),
        leaf(F.lit("auth.token_present"), F.lit("true")), leaf(F.lit("contact.email"), F.when(i % 5 == 0, F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com"))).otherwise("")))
    rows = read(spark, d, "events").select("event_id", F.explode(leaves).alias("l")).select("event_id", "l.*")
    return A.audit_leaves(rows).select("event_id", "path", "code")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_concat(CASE WHEN l_quantity BETWEEN 1 AND 49 THEN [] ELSE ['quantity_range'] END, CASE WHEN l_discount+l_tax<=0.15+1e-9 THEN [] ELSE ['rates_sum'] END, CASE WHEN l_shipdate>=TIMESTAMP '1995-06-01' THEN [] ELSE ['ship_date'] END, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber)>1 THEN ['duplicate'] ELSE [] END)) rule FROM lineitem""")
def contract_violations(spark, d):
    rules = {"quantity_range": F.col("l_quantity").between(1, 49), "rates_sum": F.col("l_discount") + F.col("l_tax") <= 0.15 + 1e-9, "ship_date": F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp_ntz")}
    return A.violations(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], rules, ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT o_orderkey, list_concat(CASE WHEN o_orderstatus='P' THEN ['review_rejected'] ELSE [] END, CASE WHEN o_orderpriority='1-URGENT' THEN ['overlay_instability'] ELSE [] END, CASE WHEN o_custkey%7=0 THEN ['direction_error'] ELSE [] END, CASE WHEN o_custkey%5=0 THEN ['incision_rule_violation'] ELSE [] END, CASE WHEN o_custkey%10=0 THEN ['incision_rule_violation'] ELSE [] END) m FROM orders)
 SELECT o_orderkey, array_to_string(list_sort(list_distinct(m)),',') modes FROM o""")
def failure_modes(spark, d):
    c = F.col("o_custkey")
    codes = F.array_compact(F.array(F.when(c % 7 == 0, F.lit("low_rstl_confidence")), F.when(c % 5 == 0, F.lit("axis_coverage_deficit")), F.when(c % 10 == 0, F.lit("diameter_coverage_deficit")), F.lit("other")))
    modes = V.failure_modes(F.lit(None).cast("array<string>"), F.col("o_orderstatus") == "P", {"overlay_instability": F.col("o_orderpriority") != "1-URGENT"}, codes)
    return read(spark, d, "orders").select("o_orderkey", F.array_join(modes, ",").alias("modes"))


@query()
def edit_fingerprints(spark, d):
    """The 31-multiplier hash of each part's edit, to base 36."""
    return read(spark, d, "part").select("p_partkey", E.fingerprint31(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string"))).alias("fingerprint"))


@query("""WITH p AS (SELECT vec_id id, label, embedding[1]::DOUBLE*100 x, embedding[2]::DOUBLE*100 y FROM embeddings) SELECT label, count(*) n, count(*) FILTER (WHERE abs(x)>25 OR abs(y)>25) out_of_frame, round(max(x)-min(x),3) width, round(max(y)-min(y),3) height, round((max(x)-min(x))*(max(y)-min(y))/2500,4) fraction,
 concat_ws(',', CASE WHEN count(*)<40 THEN 'insufficient_mapped_overlay_points' END, CASE WHEN sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2))<4 THEN 'overlay_bbox_too_small' END, CASE WHEN (max(x)-min(x))*(max(y)-min(y))/2500>0.95 THEN 'overlay_bbox_too_large_for_frame' END, CASE WHEN count(*) FILTER (WHERE abs(x)>25 OR abs(y)>25)>0 THEN 'out_of_frame_projection' END) reasons FROM p GROUP BY 1""")
def registration_qa(spark, d):
    """Overlay registration per group: extent, share of the frame, points outside, and reasons in order."""
    x, y = F.col("x") * 100, F.col("y") * 100
    g = points(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if((F.abs(x) > 25) | (F.abs(y) > 25)).alias("out_of_frame"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height"))
    fraction = F.col("width") * F.col("height") / 2500
    reasons = F.concat_ws(",", F.when(F.col("n") < 40, "insufficient_mapped_overlay_points"), F.when(F.hypot("width", "height") < 4, "overlay_bbox_too_small"), F.when(fraction > 0.95, "overlay_bbox_too_large_for_frame"), F.when(F.col("out_of_frame") > 0, "out_of_frame_projection"))
    return g.select("label", "n", "out_of_frame", F.round("width", 3).alias("width"), F.round("height", 3).alias("height"), F.round(fraction, 4).alias("fraction"), reasons.alias("reasons"))
