"""Queries of the ordered-sequence operators, over each user's events."""

from __future__ import annotations


from pyspark.sql import functions as F

from isoline.operators import sequence as Q
from isoline.operators import stats as S
from isoline.plans.registry import query, rounded
from isoline.sources.tables import read, samples

#: SQL of samples().
SAMPLES = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts)/1e6 t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 seq FROM events)"
MOVED = f"{SAMPLES}, m AS (SELECT *, sqrt(pow(value-lag(value) OVER w,2)+pow(k-lag(k) OVER w,2)) moved FROM (SELECT e.*, event_id%13 k FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY seq))"


def _moved(spark, d):
    return Q.displacement(samples(spark, d).withColumn("k", F.col("event_id") % 13), "user_id", ["value", "k"])


@query(f"""WITH RECURSIVE {SAMPLES}, r AS (SELECT user_id, event_id, seq, t, value raw, value x, 0e0 dx FROM e WHERE seq=0
 UNION ALL SELECT user_id, event_id, seq, t, raw, a*raw+(1-a)*px, dx FROM (SELECT *, 1/(1+1/(2*pi()*(1.5e0+0.05e0*abs(dx)))/dt) a FROM (SELECT *, ad*(raw-px)/dt+(1-ad)*pdx dx FROM (SELECT *, 1/(1+1/(2*pi()*1e0)/dt) ad FROM
 (SELECT e.user_id, e.event_id, e.seq, e.t, e.value raw, r.x px, r.dx pdx, CASE WHEN e.t-r.t<=0 THEN 1e-3 ELSE e.t-r.t END dt FROM r JOIN e ON e.user_id=r.user_id AND e.seq=r.seq+1)))))
 SELECT user_id, event_id, round(raw,4) raw, round(x,4) smooth FROM r""")
def one_euro(spark, d):
    return rounded(Q.one_euro(samples(spark, d), "user_id", "value", "t", "event_id"))


@query(f"""WITH RECURSIVE {SAMPLES}, r AS (SELECT user_id, event_id, seq, CASE WHEN event_type IN ('click','view') THEN 0.34e0 ELSE 0e0 END p FROM e WHERE seq=0
 UNION ALL SELECT e.user_id, e.event_id, e.seq, CASE WHEN e.event_type IN ('click','view') THEN least(1e0,r.p+0.34e0) ELSE greatest(0e0,r.p-0.16e0) END FROM r JOIN e ON e.user_id=r.user_id AND e.seq=r.seq+1)
 SELECT user_id, event_id, round(p,4) presence FROM r""")
def presence_fade(spark, d):
    rows = samples(spark, d).withColumn("hit", F.col("event_type").isin("click", "view"))
    return rounded(Q.presence(rows, "user_id", "hit", ["t", "event_id"], 0.34, 0.16))


@query(f"""WITH RECURSIVE {SAMPLES}, r AS (SELECT user_id, event_id, seq, 30e0*0.9e0+value*(1-0.9e0) v FROM e WHERE seq=0
 UNION ALL SELECT e.user_id, e.event_id, e.seq, r.v*0.9e0+e.value*(1-0.9e0) FROM r JOIN e ON e.user_id=r.user_id AND e.seq=r.seq+1) SELECT user_id, event_id, round(v+1e-9,4) ema FROM r""")
def ema(spark, d):
    # Sums of decimals end in exact halves; the nudge lets both engines round them alike.
    return rounded(Q.ema(samples(spark, d), "user_id", "value", ["t", "event_id"]).withColumn("ema", F.col("ema") + 1e-9))


@query(f"""WITH {MOVED} SELECT user_id, count(moved) n, round(avg(moved),4) mean, round(sqrt(avg(moved*moved)),4) rms, round(quantile_disc(moved,0.95),4) p95, round(max(moved),4) most,
 coalesce(count(moved)>0 AND sqrt(avg(moved*moved))<=90 AND quantile_disc(moved,0.95)<=180 AND max(moved)<=400, false) passed FROM m GROUP BY 1""")
def frame_jitter(spark, d):
    out = _moved(spark, d).groupBy("user_id").agg(*S.displacement("moved"))
    passed = (F.col("n") > 0) & (F.col("rms") <= 90) & (F.col("p95") <= 180) & (F.col("most") <= 400)
    return rounded(out.withColumn("passed", F.coalesce(passed, F.lit(False))))


@query(f"WITH {MOVED} SELECT user_id, event_id, round(sqrt(avg(moved*moved) OVER w),4) rms, round(max(moved) OVER w,4) most FROM m WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def rolling_stability(spark, d):
    return rounded(Q.rolling(_moved(spark, d), "user_id", "moved").select("user_id", "event_id", "rms", "most"))


@query(f"""WITH {SAMPLES}, v AS (SELECT user_id, seq, seq-row_number() OVER (PARTITION BY user_id ORDER BY seq) g FROM e WHERE event_type<>'error' AND value>5)
 SELECT user_id, min(seq) "first", max(seq) "last", count(*) n FROM v GROUP BY user_id, g HAVING count(*)>=2""")
def visible_runs(spark, d):
    out = Q.runs(samples(spark, d), "user_id", (F.col("event_type") != "error") & (F.col("value") > 5))
    return out.select("user_id", *(F.col(c).cast("long").alias(c) for c in ("first", "last", "n")))


ARC = f"""{SAMPLES}, q AS (SELECT *, coalesce(sqrt(pow(value-lag(value) OVER w,2)+pow(k-lag(k) OVER w,2)),0) st FROM (SELECT e.*, event_id%13 k FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY seq) s FROM q), a AS (SELECT *, CASE WHEN max(s) OVER (PARTITION BY user_id)>0 THEN s/max(s) OVER (PARTITION BY user_id) ELSE 0 END s01 FROM s)"""


def _line(spark, d):
    return samples(spark, d).withColumn("k", (F.col("event_id") % 13).cast("double"))


@query(f"WITH {ARC} SELECT user_id, event_id, round(s,4) s, round(s01,4) s01 FROM a")
def arc_length(spark, d):
    return rounded(Q.arc_length(_line(spark, d), "user_id", ["value", "k"]).select("user_id", "event_id", "s", "s01"))


@query(f"""WITH {ARC}, n AS (SELECT user_id, seq, value, k, s01, lead(value) OVER w nv, lead(k) OVER w nk, lead(s01) OVER w ns FROM a WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 g AS (SELECT *, unnest(range(CASE WHEN seq=0 THEN 0 ELSE floor(s01*15)::BIGINT+1 END, floor(ns*15)::BIGINT+1)) j FROM n WHERE ns>s01)
 SELECT user_id, j k, round(value+(j/15e0-s01)/(ns-s01)*(nv-value),4) "value", round(k+(j/15e0-s01)/(ns-s01)*(nk-k),4)+0 kk FROM g""")
def arc_resample(spark, d):
    out = Q.resampled(_line(spark, d).withColumnRenamed("k", "kk"), "user_id", ["value", "kk"], 16)
    return rounded(out)


@query(f"WITH {SAMPLES} SELECT user_id, event_id, round(coalesce(lead(value) OVER w,value)-coalesce(lag(value) OVER w,value),4)+0 t_value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)")
def tangents(spark, d):
    return rounded(Q.tangents(samples(spark, d), "user_id", ["value"]).select("user_id", "event_id", "t_value"))


@query(f"""WITH {SAMPLES}, w AS (SELECT a.user_id, a.event_id, a.seq, avg(b.value) mean FROM (SELECT e.*, count(*) OVER (PARTITION BY user_id) n, unnest([-2,-1,0,1,2]) o FROM e) a JOIN e b ON a.user_id=b.user_id AND b.seq=least(greatest(a.seq+a.o,0),a.n-1) GROUP BY ALL)
 SELECT user_id, event_id, round(mean,4) mean FROM w""")
def moving_average_edge(spark, d):
    return rounded(Q.moving_average(samples(spark, d), "user_id", "value").select("user_id", "event_id", "mean"))


@query("SELECT event_type, event_id, round(value,4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)<=120")
def last_n_buffer(spark, d):
    return rounded(Q.latest(read(spark, d, "events").select("event_type", "event_id", "ts", "value"), "event_type", 120, ["ts", "event_id"]).drop("ts"))


REQUIRED = ["view", "click", "purchase"]


@query(f"""WITH {SAMPLES}, f AS (SELECT user_id, min(seq) FILTER (WHERE event_type='view') a, min(seq) FILTER (WHERE event_type='click') b, min(seq) FILTER (WHERE event_type='purchase') c FROM e GROUP BY 1)
 SELECT user_id, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL complete, coalesce(a<=b AND b<=c, false) ordered, concat_ws(',', CASE WHEN a IS NULL THEN 'view' END, CASE WHEN b IS NULL THEN 'click' END, CASE WHEN c IS NULL THEN 'purchase' END) missing FROM f""")
def action_order_gate(spark, d):
    return Q.order_gate(samples(spark, d), "user_id", "event_type", "seq", REQUIRED)


@query(f"""WITH {SAMPLES}, p AS (SELECT user_id, seq, value p1, coalesce(lag(value) OVER w, value) p0, coalesce(lead(value) OVER w, value) p2, coalesce(lead(value,2) OVER w, lead(value) OVER w, value) p3, lead(seq) OVER w IS NOT NULL more FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 t AS (SELECT *, greatest(sqrt(abs(p1-p0)),1e-4) t1, greatest(sqrt(abs(p2-p1)),1e-4) g2, greatest(sqrt(abs(p3-p2)),1e-4) g3 FROM p), u AS (SELECT *, t1+g2 t2, t1+g2+g3 t3, unnest(CASE WHEN more THEN [0,1,2,3] ELSE [0] END) j FROM t),
 x AS (SELECT *, t1+(t2-t1)*j/4 tt FROM u), a AS (SELECT *, p0*(t1-tt)/t1+p1*tt/t1 a1, p1*(t2-tt)/(t2-t1)+p2*(tt-t1)/(t2-t1) a2, p2*(t3-tt)/(t3-t2)+p3*(tt-t2)/(t3-t2) a3 FROM x)
 SELECT user_id, seq, CAST(j AS BIGINT) j, round(CASE WHEN more THEN (a1*(t2-tt)/t2+a2*tt/t2)*(t2-tt)/(t2-t1)+(a2*(t3-tt)/(t3-t1)+a3*(tt-t1)/(t3-t1))*(tt-t1)/(t2-t1) ELSE p1 END,6)+0 "value" FROM a""")
def curve_densify(spark, d):
    out = Q.catmull_rom(samples(spark, d).select("user_id", "seq", "value"), "user_id", ["value"], 4)
    return rounded(out.withColumn("seq", F.col("seq").cast("long")), 6)


