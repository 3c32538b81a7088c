"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import stats as S
from isoline.plans.registry import query, rounded
from isoline.sources.tables import read

@query("""SELECT l_returnflag, l_linestatus, count(l_extendedprice) n, round(avg(l_extendedprice),4) mean, round(median(l_extendedprice),4) median,
 round(quantile_disc(l_extendedprice,0.9),4) p90, round(min(l_extendedprice),4) least, round(max(l_extendedprice),4) most FROM lineitem GROUP BY ALL""")
def metric_summary(spark, d):
    return rounded(S.summary(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("""SELECT metric, count(value) n, round(avg(value),4) mean, round(median(value),4) median, round(quantile_disc(value,0.9),4) p90, round(min(value),4) least, round(max(value),4) most
 FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY metric""")
def metric_summary_unpivot(spark, d):
    return rounded(S.summaries(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("SELECT coalesce(o_orderpriority,'unknown') o_orderpriority, count(*) n FROM (SELECT nullif(o_orderpriority,'4-NOT SPECIFIED') o_orderpriority FROM orders) GROUP BY 1")
def category_counts(spark, d):
    return S.counts(read(spark, d, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')")), "o_orderpriority")


@query("""SELECT o_orderpriority, count(g) present, count(*) FILTER (WHERE g) passed, count(*) FILTER (WHERE NOT g) failed,
 round(CASE WHEN count(g)=0 THEN 0 ELSE count(*) FILTER (WHERE g)::DOUBLE/count(g) END,4) pass_rate
 FROM (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END g FROM orders) GROUP BY 1""")
def gate_pass_rates(spark, d):
    passed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return rounded(S.gate(read(spark, d, "orders"), ["o_orderpriority"], passed))


@query("""SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag='R') linear_n, round(avg(l_quantity) FILTER (WHERE l_returnflag='R'),4) linear_length,
 round(avg(l_discount) FILTER (WHERE l_returnflag='A'),4) fusiform_width, round(max(l_tax) FILTER (WHERE l_returnflag='A'),4) fusiform_error FROM lineitem GROUP BY 1""")
def filtered_metrics(spark, d):
    linear, fusiform = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    return rounded(read(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.count_if(linear).alias("linear_n"), F.avg(F.when(linear, F.col("l_quantity"))).alias("linear_length"),
        F.avg(F.when(fusiform, F.col("l_discount"))).alias("fusiform_width"), F.max(F.when(fusiform, F.col("l_tax"))).alias("fusiform_error")))


@query("""SELECT CASE WHEN grouping(event_type)=1 THEN 'all' ELSE event_type END event_type, count(value) n, round(avg(value),4) mean, round(sqrt(avg(value*value)),4) rms,
 round(quantile_disc(value,0.95),4) p95, round(max(value),4) most FROM events GROUP BY GROUPING SETS ((event_type),())""")
def overall_and_group_stats(spark, d):
    return rounded(S.overall_and_by(read(spark, d, "events"), "event_type", "value"))


@query("""WITH g AS (SELECT l_extendedprice e, unnest([CASE WHEN l_quantity<=25 THEN 'small' END, CASE WHEN l_quantity>=20 THEN 'large' END, 'any']) region FROM lineitem)
 SELECT region, count(e) n, round(avg(e),4) mean, round(median(e),4) median, round(quantile_cont(e,0.9),4) p90, round(quantile_cont(e,0.95),4) p95, round(max(e),4) most FROM g WHERE region IS NOT NULL GROUP BY 1""")
def interp_percentiles(spark, d):
    q = F.col("l_quantity")
    regions = F.array_compact(F.array(F.when(q <= 25, F.lit("small")), F.when(q >= 20, F.lit("large")), F.lit("any")))
    return rounded(S.interpolated(read(spark, d, "lineitem").select("l_extendedprice", F.explode(regions).alias("region")), ["region"], "l_extendedprice"))


@query("SELECT user_id, round(median(value),4) median, round(quantile_disc(value,0.5),4) lower_median FROM events GROUP BY 1")
def median_merge(spark, d):
    return rounded(S.medians(read(spark, d, "events"), ["user_id"], "value"))


@query("""SELECT lang, count(*) FILTER (WHERE p AND t) tp, count(*) FILTER (WHERE p AND NOT t) fp, count(*) FILTER (WHERE NOT p AND t) fn,
 round(count(*) FILTER (WHERE p AND t)/greatest(count(*) FILTER (WHERE p),1)::DOUBLE,4) "precision", round(count(*) FILTER (WHERE p AND t)/greatest(count(*) FILTER (WHERE t),1)::DOUBLE,4) recall,
 round(count(*) FILTER (WHERE p AND t)/greatest(count(*) FILTER (WHERE p OR t),1)::DOUBLE,4) iou
 FROM (SELECT lang, length(text)>=500 p, quality=1 t FROM documents JOIN labels USING(doc_id)) GROUP BY 1""")
def confusion_metrics(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", (F.length("text") >= 500).alias("p")).join(read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("t")), "doc_id")
    return rounded(S.confusion(rows, ["lang"], F.col("p"), F.col("t")))


@query("SELECT event_type, count(value) n, round(arg_max(value,(ts,event_id)),4) latest, round(min(value),4) least, round(max(value),4) most, round(avg(value),4) mean FROM events GROUP BY 1")
def metric_buckets(spark, d):
    return rounded(S.buckets(read(spark, d, "events"), "event_type", "value", ["ts", "event_id"]))


@query("""SELECT action, count(*) n FROM (SELECT unnest(['k' || (k//10), CASE WHEN k%2=0 THEN 'dim' ELSE 'normal' END]) action FROM (SELECT CAST(json_extract_string(props,'$.k') AS INT) k FROM events)) WHERE action<>'normal' GROUP BY 1""")
def explode_action_counts(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    actions = F.array(F.concat(F.lit("k"), F.floor(k / 10).cast("string")), F.when(k % 2 == 0, F.lit("dim")).otherwise(F.lit("normal")))
    return S.counts(read(spark, d, "events").select(F.explode(actions).alias("action")).filter("action <> 'normal'"), "action")


@query("SELECT counter, CAST(sum(n) AS BIGINT) n FROM (SELECT unnest([event_type, 'k' || (CAST(json_extract_string(props,'$.k') AS INT)//25)]) counter, unnest([1, CAST(json_extract_string(props,'$.k') AS INT)]) n FROM events) GROUP BY 1")
def diagnostics_merge(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return S.merged_counters(read(spark, d, "events"), F.create_map("event_type", F.lit(1).cast("long"), F.concat(F.lit("k"), F.floor(k / 25).cast("string")), k))


@query("""SELECT count(*) n, count(*) FILTER (WHERE c<0.35) low_n, round(count(*) FILTER (WHERE c<0.35)/count(*)::DOUBLE,4) low_fraction, round(min(c),4) least_confidence, round(avg(c),4) mean_confidence, round(max(s),4) most_spread
 FROM (SELECT (p_retailprice-900)/1100.0::DOUBLE c, p_size*1.8::DOUBLE s FROM part)""")
def prior_coverage(spark, d):
    rows = read(spark, d, "part").select(((F.col("p_retailprice") - 900) / 1100.0).alias("c"), (F.col("p_size") * 1.8).alias("s"))
    low = F.count_if(F.col("c") < 0.35)
    return rounded(rows.agg(F.count("*").alias("n"), low.alias("low_n"), (low / F.count("*")).alias("low_fraction"), F.min("c").alias("least_confidence"), F.avg("c").alias("mean_confidence"), F.max("s").alias("most_spread")))
