"""Review operators: selection for review, overlays of decisions, upserts, priority matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What reviewers write, and the decision it stands for.
DECISIONS = {"": "pending", "pending": "pending", "accept": "accepted", "accepted": "accepted", "approve": "accepted", "approved": "accepted", "needs_correction": "corrected", "correction": "corrected", "corrected": "corrected", "revised": "corrected", "reject": "rejected", "rejected": "rejected", "not_usable": "rejected"}
#: Failure modes that warning codes stand for.
FAILURE_MODES = {"low_rstl_confidence": "direction_error", "low_region_confidence": "region_misclassification", "candidate_near_sensitive_free_margin": "sensitive_structure_warning", "center_near_sensitive_free_margin": "sensitive_structure_warning", "sensitive_region": "sensitive_structure_warning", "diameter_coverage_deficit": "incision_rule_violation", "axis_coverage_deficit": "incision_rule_violation", "fusiform_outline_self_intersection": "incision_rule_violation", "fusiform_outline_not_smoothly_tapered": "incision_rule_violation", "fusiform_boundary_outside_envelope": "incision_rule_violation", "few_boundary_points": "tumor_boundary_input_quality", "boundary_self_intersection": "tumor_boundary_input_quality", "boundary_area_degenerate": "tumor_boundary_input_quality", "boundary_center_shift": "tumor_boundary_input_quality"}


def decision(raw: Column, accepted: Column, corrected: Column) -> Column:
    """The decision of a review; null for a word that isn't known, which checked_decision() takes for an error."""
    word = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("-"), F.lit("_"))
    said = F.element_at(F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv)), word)
    return (
        F.when((said == "pending") & accepted, "accepted")
        .when((said == "pending") & ~accepted & corrected, "corrected")
        .when((said == "pending") & ~accepted, "rejected")
        .when((said == "accepted") & ~accepted & corrected, "corrected")
        .otherwise(said)
    )


def checked_decision(raw: Column, accepted: Column, corrected: Column) -> Column:
    """decision(), but a word that isn't known stops the query and is named."""
    said = decision(raw, accepted, corrected)
    return F.when(said.isNull(), F.raise_error(F.concat(F.lit("unknown review decision: "), raw))).otherwise(said)


def failure_modes(explicit: Column, rejected: Column, gates: dict[str, Column], codes: Column) -> Column:
    """Sorted distinct failure modes: those given, a rejection, gates that are false, and what warning codes stand for."""
    table = F.create_map(*(F.lit(x) for kv in FAILURE_MODES.items() for x in kv))
    own = F.array(F.when(rejected, F.lit("review_rejected")), *(F.when(~gate, F.lit(mode)) for mode, gate in gates.items()))
    mapped = F.transform(codes, lambda c: F.element_at(table, c))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce(explicit, F.array().cast("array<string>")), own, mapped))))


def selected(samples: DataFrame, most: int, low_confidence: float, high_spread: float) -> DataFrame:
    """The samples to review (index, confidence, spread, tri, x..z) with their reasons: thresholds, extremes of each axis, and an even stride that stops once most are chosen; the worst first.

    index must count from 0. Extremes are single rows found by aggregation; the
    stride's stop is a running count over the strided rows alone.
    """
    agg = samples.agg(F.count("*").alias("n"), *(f(F.struct(*s))["i"].alias(name) for a in ("x", "y", "z") for name, f, s in ((f"spatial_min_{a}", F.min, (F.col(a), F.col("index").alias("i"))), (f"spatial_max_{a}", F.max, (F.col(a), (-F.col("index")).alias("i"))))))
    agg = agg.select("n", *(F.abs(c).alias(c) for c in agg.columns if c != "n"))
    rows = samples.crossJoin(F.broadcast(agg))  # a single row
    named = lambda when, reason: F.when(when, F.lit(reason))
    spatial = [named(F.col("index") == F.col(f"spatial_{m}_{a}"), f"spatial_{m}_{a}") for a in ("x", "y", "z") for m in ("min", "max")]
    rows = rows.withColumn("reasons", F.array_compact(F.array(named(F.col("confidence") < low_confidence, "low_confidence"), named(F.col("spread") > high_spread, "high_angular_spread"), *spatial)))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / max(most, 1)))
    chosen = F.size("reasons") > 0
    rows = rows.withColumn("strided", F.col("index") % stride == 0)
    flagged = rows.agg(F.count_if(chosen).alias("flagged"))
    steps = rows.filter("strided").select("index", (~chosen).cast("int").alias("new"))
    steps = steps.withColumn("news", F.sum("new").over(W.orderBy("index").rowsBetween(W.unboundedPreceding, -1)))
    steps = steps.crossJoin(F.broadcast(flagged))
    # A step is taken unless an earlier one had already brought the count to most; the first always is.
    steps = steps.filter((F.col("index") == 0) | (F.coalesce("news", F.lit(0)) + F.col("flagged") < most)).select("index", F.lit(True).alias("covered"))
    rows = rows.join(steps, "index", "left")
    rows = rows.withColumn("reasons", F.array_sort(F.concat("reasons", F.when(F.col("covered"), F.array(F.lit("uniform_coverage"))).otherwise(F.array().cast("array<string>")))))
    return rows.filter(F.size("reasons") > 0).orderBy("confidence", F.desc("spread"), "tri").limit(most).select("index", "confidence", "spread", "tri", "reasons")


def overlaid(items: DataFrame, rows: DataFrame, key: str, fallback: str, values: list[str]) -> DataFrame:
    """items with the values of the rows of equal key, else of equal fallback key."""
    first = rows.filter(F.col(key).isNotNull()).select(key, *(F.col(v).alias(f"a_{v}") for v in values))
    second = rows.filter(F.col(key).isNull()).select(fallback, *(F.col(v).alias(f"b_{v}") for v in values))
    out = items.join(first, key, "left").join(second, fallback, "left")
    return out.select(*items.columns, *(F.coalesce(f"a_{v}", f"b_{v}").alias(v) for v in values))


def unmatched(items: DataFrame, rows: DataFrame, key: str, fallback: str) -> DataFrame:
    """Rows that no item has, by key or, without one, by fallback."""
    have, lack = rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull())
    return have.join(items, key, "left_anti").unionByName(lack.join(items, fallback, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_by_priority(df: DataFrame, key: list[str], priority: str, tie: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(priority, tie)
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
