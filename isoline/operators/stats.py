"""Aggregations: number summaries, counts, gates, percentiles, confusion, metric buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.functions.exprs import ratio
from isoline.operators.geometry import checkpointed

#: The largest double.
LARGEST = 1.7976931348623157e308
#: Rows of ranges that order_statistics() broadcasts at most.
RANGES = 100_000


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {c})")


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Column], aggregates: list[Column], most: int = 1_000_000, buckets: int = 1024, times: str | None = None) -> DataFrame:
    """Each group's aggregates of value's numbers, their count n, and as further columns its exact order statistics.

    places names them and tells each one's place (from 0) from n. The count, least
    and greatest of a group come first; while a wanted place lies among more than
    most different numbers, a histogram of the numbers between the range's ends is
    summed on the map side, and the range shrinks to the bucket of the place. Every
    other pass makes the buckets of a range over many magnitudes by logarithms. What
    is left is sorted, so no task holds more than most numbers or buckets of a
    group. The driver sees one count a pass. Nulls take no part, a group of
    nothing else has n 0 and nulls; infinities and NaN have buckets of their own,
    NaN the last. Groups may be null. A row counts times times, if that is given:
    as w_ it is there for aggregates, and places go by it.
    """
    v, same = F.col("v_"), lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    rows = df.select(*by, F.col(value).cast("double").alias("v_"), *([F.col(times).cast("long").alias("w_")] if times else []))
    weight = ["w_"] if times else []
    n = F.coalesce(F.sum(F.when(v.isNotNull(), F.col("w_"))), F.lit(0)) if times else F.count("v_")
    groups = rows.groupBy(*by).agg(n.alias("n"), *([F.count("v_").alias("rows_")] if times else []), F.min("v_").alias("lo_"), F.max("v_").alias("hi_"), *aggregates)
    groups = checkpointed(groups)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("place_"), at.cast("long").alias("left_")) for name, at in places.items())))
    wanted = groups.filter("n > 0").select(*by, each.alias("e_"), "lo_", "hi_", F.col("rows_" if times else "n").alias("size_")).select(*by, "e_.*", "lo_", "hi_", "size_")
    ends = [*by, "lo_", "hi_"]
    #: A table of ranges is broadcast only once its rows are counted.
    small = groups.count() * len(places) <= RANGES
    sent = F.broadcast if small else lambda df: df

    def between(ranges: DataFrame) -> DataFrame:
        r = ranges.filter("lo_ < hi_").select(*ends).distinct().alias("r")
        own = rows.filter(v.isNotNull()).alias("own")
        met = own.join(sent(r), reduce(lambda x, y: x & y, (F.col(f"own.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by), (v >= F.col("r.lo_")) & (v <= F.col("r.hi_"))))
        return met.select(*(F.col(f"own.{c}").alias(c) for c in by), "lo_", "hi_", "v_", *weight)

    def narrowed(ranges: DataFrame, by_size: bool) -> DataFrame:
        low, high = (F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(F.lit(e)) for c, e in (("lo_", -LARGEST), ("hi_", LARGEST)))
        part = (v / 2 - low / 2) / (high / 2 - low / 2)
        if by_size:  # of Java's logarithm, greater numbers never have a smaller one
            size = lambda c: F.signum(c) * F.coalesce(F.ln(F.abs(c)) + 746, F.lit(0.0))
            part = F.when(size(high) - size(low) > 24, (size(v) - size(low)) / (size(high) - size(low))).otherwise(part)
        bucket = F.when(F.isnan(v), buckets + 1).when(v == float("inf"), buckets).when(v == float("-inf"), -1).otherwise(F.least(F.floor(part * buckets), F.lit(buckets - 1)))
        counted = between(ranges).groupBy(*ends, bucket.alias("bucket_")).agg(F.sum("w_" if times else F.lit(1)).alias("n_"), F.count("*").alias("rows_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
        before = F.sum("n_").over(W.partitionBy(*ends).orderBy("bucket_")) - F.col("n_")
        counted = counted.withColumn("before_", before)
        ranges = sent(ranges)
        at = counted.alias("c").join(ranges.alias("w"), reduce(lambda x, y: x & y, (F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ends), F.lit(True)), "right")
        at = at.filter(F.col("c.n_").isNull() | (F.col("w.left_") >= F.col("c.before_")) & (F.col("w.left_") < F.col("c.before_") + F.col("c.n_")))
        pick = lambda new, old: F.when(F.col("c.n_").isNull(), F.col(old)).otherwise(F.col(new))
        return at.select(*(F.col(f"w.{c}").alias(c) for c in by), "place_", pick("least_", "w.lo_").alias("lo_"), pick("most_", "w.hi_").alias("hi_"), pick("c.rows_", "size_").alias("size_"), (F.col("left_") - F.coalesce("before_", F.lit(0))).alias("left_"))

    by_size = False
    while (wanted.filter("lo_ < hi_").agg(F.max("size_")).first()[0] or 0) > most:
        wanted, by_size = checkpointed(narrowed(wanted, by_size)), not by_size
    sorted_ = W.partitionBy(*ends).orderBy("v_")
    place = F.row_number().over(sorted_) - 1
    if times:  # the first of a row's places
        place = F.sum("w_").over(sorted_.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("w_")
    spots = wanted.filter("lo_ < hi_").groupBy(*ends).agg(F.collect_set("left_").alias("lefts_"))
    own = between(wanted).withColumn("k_", place.cast("long")).alias("o")
    here = F.filter("lefts_", lambda at: (at >= F.col("k_")) & (at < F.col("k_") + F.col("w_"))) if times else F.filter("lefts_", lambda at: at == F.col("k_"))
    met = F.exists("lefts_", lambda at: (at >= F.col("k_")) & (at < F.col("k_") + F.col("w_"))) if times else F.array_contains("lefts_", F.col("k_"))
    found = own.join(sent(spots).alias("s"), reduce(lambda x, y: x & y, (F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ends), met))
    found = found.select(*(F.col(f"o.{c}").alias(c) for c in ends), F.explode(here).alias("k_"), "v_").alias("f")
    w = wanted.alias("w")
    known = w.join(found, reduce(lambda x, y: x & y, (F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ends), F.col("left_") == F.col("k_")), "left")
    known = known.select(*(F.col(f"w.{c}").alias(c) for c in by), "place_", F.coalesce("v_", "w.lo_").alias("v_"))
    wide = known.groupBy(*by).agg(*(F.max(F.when(F.col("place_") == name, v)).alias(name) for name in places))
    names = [c for c in groups.columns if c not in (*by, "lo_", "hi_", "rows_")]
    out = groups.join(wide, same(groups, wide), "left")
    return out.select(*(groups[c] for c in (*by, *names)), *(wide[c] for c in places))


def _between(p: float, name: str) -> tuple[dict[str, Column], Column]:
    """The two places that a linearly interpolated percentile lies between, and its value from theirs."""
    at = (F.col("n") - 1) * p
    low = F.col(f"{name}_low")
    return {f"{name}_low": F.floor(at), f"{name}_high": F.ceil(at)}, low + (F.col(f"{name}_high") - low) * (at - F.floor(at))


def _rank(p: float) -> Column:
    """The place of the nearest-rank percentile."""
    return F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0))


def summary(df: DataFrame, by: list[str], value: str, times: str | None = None) -> DataFrame:
    """count, mean, median, nearest-rank p90, min and max of value's non-null numbers, each counting times times if that is given; by order_statistics()."""
    places, median = _between(0.5, "median")
    mean = F.sum(F.col("v_") * F.col("w_")) / F.sum(F.when(F.col("v_").isNotNull(), F.col("w_"))) if times else F.avg("v_")
    got = order_statistics(df, by, value, places | {"p90": _rank(0.9)}, [mean.alias("mean"), F.min("v_").alias("least"), F.max("v_").alias("most")], times=times)
    return got.select(*by, "n", "mean", median.alias("median"), "p90", "least", "most")


def summaries(df: DataFrame, metrics: list[str]) -> DataFrame:
    """summary() of many columns in one pass over df: one row per metric."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("m.*")
    return summary(long, ["metric"], "value")


def counts(df: DataFrame, key: str, unknown: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(unknown)).alias(key)).agg(F.count("*").alias("n"))


def gate(df: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """Present, passed and failed rows of a gate that may be null, and the share that passed (0 where none is present)."""
    yes, no = F.count_if(passed), F.count_if(~passed)
    return df.groupBy(*by).agg(F.count(passed).alias("present"), yes.alias("passed"), no.alias("failed"), ratio(yes, yes + no).alias("pass_rate"))


def displacement(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), nearest_rank(value, 0.95).alias("p95"), F.max(v).alias("most")]


def overall_and_by(df: DataFrame, key: str, value: str, overall: str = "all") -> DataFrame:
    """Displacement statistics of each group and of all rows, each row counting for both; by order_statistics()."""
    rows = df.select(F.explode(F.array(F.struct(F.col(key).alias("k"), F.lit(0).alias("g")), F.struct(F.lit(None).cast(dict(df.dtypes)[key]).alias("k"), F.lit(1).alias("g")))).alias("e"), F.col(value).alias("v")).select("e.*", "v")
    got = order_statistics(rows, ["k", "g"], "v", {"p95": _rank(0.95)}, [F.avg("v_").alias("mean"), F.sqrt(F.avg(F.col("v_") * F.col("v_"))).alias("rms"), F.max("v_").alias("most")])
    return got.select(F.when(F.col("g") == 1, F.lit(overall)).otherwise(F.col("k")).alias(key), "n", "mean", "rms", "p95", "most")


def interpolated(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, p90, p95 (linearly interpolated) and max; by order_statistics()."""
    parts = {name: _between(p, name) for name, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))}
    got = order_statistics(df, by, value, {k: c for places, _ in parts.values() for k, c in places.items()}, [F.avg("v_").alias("mean"), F.max("v_").alias("most")])
    return got.select(*by, "n", "mean", *(c.alias(name) for name, (_, c) in parts.items()), "most")


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The interpolated median, and the lower one."""
    return df.groupBy(*by).agg(F.median(value).alias("median"), nearest_rank(value, 0.5).alias("lower_median"))


def confusion(df: DataFrame, by: list[str], predicted: Column, truth: Column) -> DataFrame:
    """True and false positives, false negatives; precision, recall and intersection over union with denominators of at least 1."""
    tp, fp, fn = F.count_if(predicted & truth), F.count_if(predicted & ~truth), F.count_if(~predicted & truth)
    over = lambda n: tp / F.greatest(n, F.lit(1))
    return df.groupBy(*by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), over(tp + fp).alias("precision"), over(tp + fn).alias("recall"), over(tp + fp + fn).alias("iou"))


def buckets(df: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """count, latest (by order), min, max and mean of a metric by name."""
    return df.groupBy(name).agg(F.count(value).alias("n"), F.max_by(value, F.struct(*order)).alias("latest"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def merged_counters(df: DataFrame, counters: Column) -> DataFrame:
    """Sums by key of map columns."""
    return df.select(F.explode(counters).alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("n"))
