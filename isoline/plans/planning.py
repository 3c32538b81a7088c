"""Queries of the planning operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.operators import planning as P
from isoline.operators import sequence as Q
from isoline.plans.registry import query, rounded
from isoline.plans.sequence import SAMPLES
from isoline.sources.tables import points, read, samples


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey%5=0 THEN 'missing_tumor_author' END, CASE WHEN p_brand='Brand#2' THEN 'non_mm_tumor_units' END, CASE WHEN k='subcutaneous' AND p_size%3=0 THEN 'missing_subcutaneous_depth' END,
 CASE WHEN k='cutaneous' AND p_size%4=0 THEN 'missing_cutaneous_margin' END, CASE WHEN k='cutaneous' AND m='freehand' AND p_partkey%9<6 THEN 'sparse_cutaneous_boundary_input' END, CASE WHEN k='cutaneous' AND m<>'center_diameter' AND p_partkey%9<3 THEN 'missing_cutaneous_boundary' END) codes, p_brand<>'Brand#2' passed
 FROM (SELECT *, CASE WHEN p_type='SMALL' THEN 'subcutaneous' ELSE 'cutaneous' END k, CASE WHEN p_partkey%2=0 THEN 'freehand' ELSE 'center_diameter' END m FROM part)""")
def input_quality(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "SMALL", "subcutaneous").otherwise("cutaneous").alias("kind"), F.when(k % 5 != 0, "a").alias("author"), F.when(F.col("p_brand") == "Brand#2", "cm").otherwise("mm").alias("units"), F.when(s % 3 != 0, s).alias("depth"), (s % 4).alias("margin"), F.when(k % 2 == 0, "freehand").otherwise("center_diameter").alias("boundary_mode"), (k % 9).alias("boundary_points"))
    rows = rows.withColumn("w", P.input_warnings())
    return rows.select("p_partkey", F.array_join(F.col("w.code"), ",").alias("codes"), (~F.exists("w", lambda w: w["severity"] == "high")).alias("passed"))


@query("""WITH v AS (SELECT vec_id, unnest(range(7)) i, embedding e FROM embeddings), p AS (SELECT vec_id, i, e[2*i+1]::DOUBLE x, e[2*i+2]::DOUBLE y FROM v), m AS (SELECT vec_id, avg(x) mx, avg(y) my FROM p GROUP BY 1),
 s AS (SELECT p.vec_id, 2*max(abs(x-mx)) along, 2*max(abs(y-my)) across, any_value(sqrt(mx*mx+my*my)) shift FROM p JOIN m USING(vec_id) GROUP BY 1), a AS (SELECT p.vec_id, abs(sum(p.x*q.y-p.y*q.x))/2 area FROM p JOIN p q ON p.vec_id=q.vec_id AND q.i=(p.i+1)%7 GROUP BY 1)
 SELECT vec_id, round(along,4) along, round(across,4) across, round(area/(pi()*0.04),4) area_ratio, round(shift,4) center_shift FROM s JOIN a USING(vec_id)""")
def boundary_profile(spark, d):
    ring = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    rows = read(spark, d, "embeddings").select("vec_id", P.boundary_profile(ring, F.lit(0.4), F.lit(0.0), F.lit(0.0)).alias("b"))
    return rounded(rows.select("vec_id", "b.along", "b.across", "b.area_ratio", "b.center_shift"))


@query("""SELECT o_orderkey, o_orderkey%4<>0 OR o_custkey%3=0 active FROM orders""")
def edit_activity(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("double")
    return read(spark, d, "orders").select("o_orderkey", P.edit_is_active(F.when(k % 4 != 0, 5.0), F.lit(0.0), F.lit(1.0), none, none, F.when(c % 3 == 0, "why")).alias("active"))


@query("""SELECT o_orderkey, r AS ready, CASE WHEN r THEN 'approved_candidate_ready_for_research_overlay' WHEN t THEN 'pending_clinician_confirmation_or_missing_required_review_context' ELSE 'agent_trace_gate_failed' END reason
 FROM (SELECT o_orderkey, o_custkey%5>0 t, o_orderstatus='F' AND o_custkey%5>0 AND o_orderpriority<>'5-LOW' AND (o_orderkey%2=0 OR o_orderkey%3=0) r FROM orders)""")
def approval_gate(spark, d):
    k = F.col("o_orderkey")
    got = P.approval(F.when(F.col("o_orderstatus") == "F", "approved_for_discussion").otherwise("pending"), F.when(F.col("o_orderpriority") != "5-LOW", "r"), F.when(k % 3 == 0, "n"), k % 2, F.col("o_custkey") % 5 > 0)
    return read(spark, d, "orders").select("o_orderkey", got.alias("a")).select("o_orderkey", "a.ready", "a.reason")


@query("""WITH g(step, acts) AS (VALUES ('sense', ['view']), ('act', ['click','purchase']), ('check', ['error','signup'])), s AS (SELECT user_id, list(DISTINCT event_type) seen FROM events GROUP BY 1)
 SELECT user_id, step, len(list_intersect(seen, acts)) done, CASE WHEN len(list_intersect(seen, acts))=len(acts) THEN 'complete' WHEN len(list_intersect(seen, acts))>0 THEN 'partial' ELSE 'missing' END status FROM s, g""")
def plan_audit(spark, d):
    """Each user's actions against the steps of a plan."""
    return P.plan_status(read(spark, d, "events"), "user_id", "event_type", {"sense": ["view"], "act": ["click", "purchase"], "check": ["error", "signup"]})


@query(f"WITH {SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) n FROM e), w AS (SELECT user_id, any_value(n) n FROM n GROUP BY 1), k AS (SELECT user_id, CAST(round_even(i*(n-1)/9e0,0) AS BIGINT) seq FROM (SELECT *, unnest(range(10)) i FROM w)) SELECT DISTINCT n.user_id, n.event_id FROM n LEFT JOIN k ON n.user_id=k.user_id AND n.seq=k.seq WHERE n.n<=10 OR k.seq IS NOT NULL")
def even_picks(spark, d):
    return P.even_picks(samples(spark, d), "user_id", 10).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 s FROM events) WHERE s%2=0")
def every_second(spark, d):
    return samples(spark, d).filter(F.col("seq") % 2 == 0).select("user_id", "event_id")


@query()
def validation_split(spark, d):
    return P.hash_split(read(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity/sum(l_quantity) OVER (PARTITION BY l_orderkey),4) share FROM lineitem")
def view_weights(spark, d):
    return rounded(P.view_weights(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share"))


@query("""WITH c AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 seq, count(*) OVER (PARTITION BY label) n, embedding[1]::DOUBLE x FROM embeddings WHERE label%3<>1) SELECT label, CASE WHEN label%2=0 THEN 'line'||label ELSE 'slicer_curve_1' END AS "name", CAST(seq AS BIGINT) seq, round(x,4)+0 x FROM c WHERE n>=2""")
def markup_curves(spark, d):
    """Curves written as markup documents by Spark and read back; those of another type are left out."""
    num = lambda i: F.get("embedding", F.lit(i)).cast("double")
    pts = read(spark, d, "embeddings").select("label", F.struct("vec_id", F.struct(F.array(num(0), num(1), num(2)).alias("position")).alias("p")).alias("s"))
    docs = pts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"]).alias("controlPoints"))
    mark = F.struct(F.when(F.col("label") % 3 == 1, "Fiducial").when(F.col("label") % 3 == 2, "Curve").alias("type"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("line"), "label")).alias("name"), "controlPoints")
    docs = docs.select("label", F.to_json(F.struct(F.lit("LPS").alias("coordinateSystem"), F.array(mark).alias("markups"))).alias("payload"))
    return rounded(P.curves(docs, "label", "payload").select("label", "name", F.col("seq").cast("long").alias("seq"), "x"))


@query()
def ridge_fit(spark, d):
    """Each label's ridge fit of a target coordinate to a point's."""
    out = P.ridge(points(spark, d), "label", ["x", "y", "z"], "qx", 1e-3)
    return rounded(out.select("label", *(F.col("coefficients")[i].alias(f"c{i}") for i in range(4)), "rmse"), 6)


@query()
def stabilized_one_euro(spark, d):
    """A slower filter of two coordinates' mean and the usual one of what is left, added up."""
    rows = samples(spark, d).withColumns({"mean": (F.col("value") + F.col("event_id") % 13) / 2}).withColumn("local", F.col("value") - F.col("mean"))
    whole = Q.one_euro(rows, "user_id", "mean", "t", "event_id", 1.25, 0.012).select("user_id", "event_id", F.col("smooth").alias("mean"))
    local = Q.one_euro(rows, "user_id", "local", "t", "event_id").select("user_id", "event_id", F.col("smooth").alias("local"))
    return rounded(whole.join(local, ["user_id", "event_id"]).select("user_id", "event_id", (F.col("mean") + F.col("local")).alias("smooth")))


@query()
def anchored_one_euro(spark, d):
    """The vectors of each label as frames of seven points, steadied about two of them."""
    e = lambda i: F.get("embedding", i).cast("double")
    rows = read(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") * 0.04).alias("t"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("point"))
    k = F.col("point") * 3
    rows = rows.select("label", "vec_id", "t", F.col("point").cast("long").alias("point"), e(k).alias("x"), e(k + 1).alias("y"), e(k + 2).alias("z"))
    return rounded(Q.anchored_one_euro(rows, "label", "point", [2, 5], ["x", "y", "z"], "t", "vec_id").select("label", "vec_id", "point", "axis", "smooth"))


@query("SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS first_order FROM orders WHERE o_custkey BETWEEN 10 AND 100000 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def unique_valid(spark, d):
    """Distinct valid keys with their first occurrence."""
    return read(spark, d, "orders").filter(F.col("o_custkey").between(10, 100000)).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))


@query("""WITH s AS (SELECT l_suppkey, list(DISTINCT l_partkey%50) p FROM lineitem GROUP BY 1) SELECT a.l_suppkey, len(list_intersect(a.p, b.p)) shared FROM s a JOIN s b ON b.l_suppkey=a.l_suppkey+1""")
def shared_ends(spark, d):
    """How many parts (by class) neighbouring suppliers share."""
    s = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("p"))
    t = s.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("p").alias("q"))
    return s.join(t, "l_suppkey").select("l_suppkey", F.size(F.array_intersect("p", "q")).cast("long").alias("shared"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) idx, role AS "action", length(text) size, turn FROM conversations""")
def execution_events(spark, d):
    """Conversations as numbered execution logs."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return read(spark, d, "conversations").select("conv_id", n.alias("idx"), F.col("role").alias("action"), F.length("text").cast("long").alias("size"), "turn")


