"""Inputs of candidates, review gates, plans as event logs, evenly spaced picks and ridge fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.operators.rules import crosses, shoelace

MARKUPS = "struct<coordinateSystem:string,markups:array<struct<type:string,name:string,region:string,controlPoints:array<struct<position:array<double>>>>>>"


def input_warnings() -> Column:
    """Warnings of a lesion row (kind, author, units, depth, margin, boundary_mode, boundary_points), in order."""
    c = F.col
    cutaneous = c("kind") == "cutaneous"
    rules = (
        (F.coalesce("author", F.lit("")) == "", "missing_tumor_author", "medium"), (F.coalesce("units", F.lit("mm")) != "mm", "non_mm_tumor_units", "high"), ((c("kind") == "subcutaneous") & c("depth").isNull(), "missing_subcutaneous_depth", "medium"),
        (cutaneous & (c("margin") <= 0), "missing_cutaneous_margin", "medium"), (cutaneous & (c("boundary_mode") == "freehand") & (c("boundary_points") < 6), "sparse_cutaneous_boundary_input", "medium"),
        (cutaneous & (c("boundary_mode") != "center_diameter") & (c("boundary_points") < 3), "missing_cutaneous_boundary", "medium"),
    )
    return F.array_compact(F.array(*(F.when(w, F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for w, code, s in rules)))


def boundary_profile(ring: Column, diameter: Column, cx: Column, cy: Column) -> Column:
    """Of a boundary (array of (x, y)): its size along both axes about its mean, area, area over that of the diameter's disk, distance of its mean from the centre, and whether it crosses itself."""
    n = F.size(ring)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    mx, my = mean("x"), mean("y")
    most = lambda k, m: F.array_max(F.transform(ring, lambda p: F.abs(p[k] - m)))
    area = shoelace(ring)
    disk = F.greatest(math.pi * (diameter / 2) ** 2, F.lit(1e-9))
    return F.struct((2 * most("x", mx)).alias("along"), (2 * most("y", my)).alias("across"), area.alias("area"), (area / disk).alias("area_ratio"), F.hypot(mx - cx, my - cy).alias("center_shift"), crosses(ring).alias("crosses"))


def edit_is_active(angle: Column, length: Column, width: Column, along: Column, across: Column, reason: Column) -> Column:
    """Whether an edit changes anything; nulls and zero scales count as none."""
    zero, one = lambda c: F.coalesce(c, F.lit(0.0)), lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
    return (zero(angle) != 0) | (one(length) != 1) | (one(width) != 1) | (zero(along) != 0) | (zero(across) != 0) | (F.coalesce(reason, F.lit("")) != "")


def approval(status: Column, reviewer: Column, notes: Column, high: Column, trace_passed: Column) -> Column:
    """ready, and why: approval needs a reviewer, notes where there are high warnings, and a passed trace."""
    asked = status == "approved_for_discussion"
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    ready = asked & trace_passed & has(reviewer) & ((high == 0) | has(notes))
    why = F.when(ready, "approved_candidate_ready_for_research_overlay").when(trace_passed, "pending_clinician_confirmation_or_missing_required_review_context").otherwise("agent_trace_gate_failed")
    return F.struct(ready.alias("ready"), why.alias("reason"))


def plan_status(log: DataFrame, key: str, action: str, groups: dict[str, list[str]]) -> DataFrame:
    """For each key and step of a plan: how many of the step's actions it has, and complete, partial or missing."""
    steps = F.explode(F.create_map(*(x for s, acts in groups.items() for x in (F.lit(s), F.array(*map(F.lit, acts))))))
    seen = log.groupBy(key).agg(F.collect_set(action).alias("seen"))
    rows = seen.select(key, "seen", steps.alias("step", "actions"))
    got = F.size(F.array_intersect("seen", "actions"))
    return rows.select(key, "step", got.cast("long").alias("done"), F.when(got == F.size("actions"), "complete").when(got > 0, "partial").otherwise("missing").alias("status"))


def even_picks(df: DataFrame, key: str, n: int, order: str = "seq") -> DataFrame:
    """At most n rows of each key, evenly spaced by place (halves to even), its first and last among them."""
    size = F.count("*").over(W.partitionBy(key))
    place = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    df = df.withColumns({"size_": size, "place_": place})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("size_") - 1) / (n - 1)))
    return df.filter((F.col("size_") <= n) | F.array_contains(wanted, F.col("place_").cast("double"))).drop("size_", "place_")


def hash_split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """df with split: validation for about share of the keys, else train; a key's side never changes with the data."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return df.withColumn("split", F.when(u < share, "validation").otherwise("train"))


def view_weights(df: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Weights not under zero, as shares of their group; groups whose weights are all zero are an error."""
    w = F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(0.0))
    total = F.sum(w).over(W.partitionBy(*by))
    return df.withColumn("share", F.when(total > 0, w / total).otherwise(F.raise_error(F.lit("all view weights are zero"))))


def curves(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Control points of curve markups in JSON texts: (key, name, region, seq, x, y, z); other types, points without three numbers and curves of fewer than two points go."""
    doc = F.from_json(payload, MARKUPS)
    rows = df.select(key, F.posexplode(F.filter(doc["markups"], lambda m: F.lower(F.coalesce(F.nullif(m["type"], F.lit("")), F.lit("curve"))) == "curve")).alias("i", "m"))
    pts = F.filter(F.col("m.controlPoints.position"), lambda p: (F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    name = F.coalesce(F.nullif("m.name", F.lit("")), F.concat(F.lit("slicer_curve_"), F.col("i") + 1))
    rows = rows.select(key, name.alias("name"), F.coalesce(F.nullif("m.region", F.lit("")), F.lit("slicer")).alias("region"), pts.alias("p")).filter(F.size("p") >= 2)
    return rows.select(key, "name", "region", F.posexplode("p").alias("seq", "p")).select(key, "name", "region", "seq", *(F.col("p")[i].alias(n) for i, n in enumerate("xyz")))


def ridge(df: DataFrame, by: str, inputs: list[str], target: str, strength: float) -> DataFrame:
    """Each group's ridge coefficients (intercept, not shrunk, first) and error: normal equations are summed in the JVM and solved a row at a time."""
    cols = [F.lit(1.0), *map(F.col, inputs)]
    k = len(cols)
    sums = [F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j] + [F.sum(a * F.col(target)).alias(f"b{i}") for i, a in enumerate(cols)] + [F.sum(F.col(target) ** 2).alias("yy")]

    def solved(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                rhs = np.array([r[f"b{i}"] for i in range(k)])
                w = np.linalg.solve(a + strength * np.diag([0.0] + [1.0] * (k - 1)), rhs)
                out.append((r[by], w.tolist(), float(np.sqrt(max(0.0, (r["yy"] - 2 * w @ rhs + w @ a @ w) / a[0, 0])))))
            yield pd.DataFrame(out, columns=[by, "coefficients", "rmse"])

    return df.groupBy(by).agg(*sums).mapInPandas(solved, f"{by} {dict(df.dtypes)[by]}, coefficients array<double>, rmse double")
