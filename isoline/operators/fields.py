"""Direction fields, masks, shape models and their fits, landmark sets, registries and plans of steps."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.operators.geometry import XYZ, checkpointed, similarity

#: Known mesh topologies, by id: version and whether it comes along.
TOPOLOGIES = {"mediapipe-468": ("mediapipe-canonical-468-v1", True), "flame-2023": ("flame-2023-v1", False)}

# Landmarks of a face mesh by part.
PARTS = {
    "left_eye": (33, 133, 160, 159, 158, 157, 173, 246, 7, 163, 144, 145, 153, 154, 155),
    "right_eye": (263, 362, 387, 386, 385, 384, 398, 466, 249, 390, 373, 374, 380, 381, 382),
    "left_brow": (70, 63, 105, 66, 107, 55, 65, 52, 53, 46),
    "right_brow": (336, 296, 334, 293, 300, 285, 295, 282, 283, 276),
    "nose": (1, 2, 4, 5, 6, 19, 94, 98, 168, 195, 197, 236, 327, 456),
    "outer_mouth": (61, 146, 91, 181, 84, 17, 314, 405, 321, 375, 291),
    "inner_mouth": (78, 95, 88, 178, 87, 14, 317, 402, 318, 324, 308),
    "stable_cheek": (50, 101, 118, 119, 120, 187, 205, 206, 207, 280, 330, 347, 348, 349, 411, 425, 426, 427),
    "central_forehead": (8, 9, 10, 151, 108, 109, 337, 338),
}
_POSE = ("left_eye", "right_eye", "left_brow", "right_brow", "outer_mouth", "inner_mouth", "central_forehead")
_FINE = ("left_eye", "right_eye", "left_brow", "right_brow", "nose", "outer_mouth", "inner_mouth")
#: Named sets of landmarks, by their parts.
SUBSETS = {"fine_only": _FINE, "central_face": _FINE, "pose_stable": _POSE, "pose_plus_nose": (*_POSE, "nose"), "pose_plus_cheek": (*_POSE, "stable_cheek"), "stable_face": (*_POSE, "nose", "stable_cheek")}

#: The steps of a plan, each with groups of actions of which one must be seen, and further actions that count as its own.
STEPS = {
    "inspect_tumor_input": ((("summarize_tumor_input_quality",),), ()),
    "localize_anatomy": ((("classify_region",),), ()),
    "query_direction": ((("query_rstl_direction",),), ()),
    "inspect_sensitive_structures": ((("inspect_sensitive_structures",),), ()),
    "generate_primary_candidate": ((("linear_subcutaneous_incision", "fusiform_cutaneous_incision"),), ()),
    "check_guardrails": ((("evaluate_guardrails",),), ()),
    "preview_candidates": ((("preview_incision_on_face",),), ()),
    "compare_direction_variants": ((("propose_direction_variants",), ("compare_candidates",)), ("linear_subcutaneous_incision", "fusiform_cutaneous_incision", "inspect_sensitive_structures", "evaluate_guardrails", "preview_incision_on_face", "retry_tool_failure", "recover_tool_failure")),
}
COMPARED = "compare_direction_variants"


def blended_axis(terms: list[tuple[Column, Column]]) -> Column:
    """The undirected angle (radians, -pi/2 to pi/2) of several weighted ones: angles are doubled, so that opposite directions agree, summed as vectors and halved."""
    total = lambda f: sum((w * f(2 * a) for a, w in terms[1:]), terms[0][1] * f(2 * terms[0][0]))
    return F.atan2(total(F.sin), total(F.cos)) / 2


def bell(v: Column, centre: float, width: float) -> Column:
    """exp of minus the square of v's distance from centre in widths."""
    return F.exp(-(((v - centre) / width) ** 2))


def around(x: Column, y: Column, centre: tuple[float, float], sigma: float, weight: float, radial: bool = False) -> tuple[Column, Column]:
    """The term of a field that circles a place, or points away from it, with Gaussian weight."""
    dx, dy = x - centre[0], y - centre[1]
    return F.atan2(dy, dx) + (0.0 if radial else math.pi / 2), weight * F.exp(-(dx * dx + dy * dy) / (2 * sigma**2))


def field_terms(x: Column, y: Column, table: tuple[tuple, ...]) -> list[tuple[Column, Column]]:
    """The terms (angle, weight) of a field from a table of rows: ("band", weight, degrees, axis, centre, width) holds a direction along a band across an axis ("x" or "y"), ("circle" or "rays", weight, x, y, width) turns about a place or points away from it."""
    out = []
    for kind, weight, *rest in table:
        if kind == "band":
            degrees, axis, centre, width = rest
            out.append((F.lit(math.radians(degrees)), weight * bell(x if axis == "x" else y, centre, width)))
        elif kind in ("circle", "rays"):
            out.append(around(x, y, (rest[0], rest[1]), rest[2], weight, radial=kind == "rays"))
        else:
            raise ValueError(f"unknown kind of a field's term: {kind}")
    return out


def in_mask(x: Column, y: Column, outer: tuple[float, float, float, float], holes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a point is in an ellipse (x, y and both radii; its edge included) and in none of the elliptic holes (their edges excluded)."""
    at = lambda e: ((x - e[0]) / e[2]) ** 2 + ((y - e[1]) / e[3]) ** 2
    return reduce(lambda a, h: a & (at(h) >= 1), holes, at(outer) <= 1)


def shaped(template: DataFrame, basis: DataFrame, coefficients: DataFrame, by: list[str]) -> DataFrame:
    """Vertices (by, v, x..z) of each group's shape: the template (v, x..z) plus its coefficients (by, k, c; k from 0) times the basis (v, k, x..z). The template takes part as component -1, so that all terms meet in one join and are summed by vertex once; groups without coefficients have no shape."""
    parts = basis.select("v", F.col("k").cast("long").alias("k"), *XYZ).unionByName(template.select("v", F.lit(-1).cast("long").alias("k"), *XYZ))
    whole = coefficients.select(*by).distinct().select(*by, F.lit(-1).cast("long").alias("k"), F.lit(1.0).alias("c"))
    weights = coefficients.select(*by, F.col("k").cast("long").alias("k"), F.col("c").cast("double").alias("c")).unionByName(whole)
    return parts.join(weights, "k").groupBy(*by, "v").agg(*(F.sum(F.col("c") * F.col(n)).alias(n) for n in XYZ))


def hinged(p: list[Column], pivot: tuple[float, float, float], angle: Column, weight: Column) -> list[Column]:
    """A point turned about the x axis through pivot by an angle (radians), as far as its weight says: at 1 wholly, at 0 not."""
    y, z = p[1] - pivot[1], p[2] - pivot[2]
    turned = [p[0], pivot[1] + F.cos(angle) * y - F.sin(angle) * z, pivot[2] + F.sin(angle) * y + F.cos(angle) * z]
    return [a + weight * (b - a) for a, b in zip(p, turned, strict=True)]


def posed(shape: DataFrame, joints: DataFrame, pose: DataFrame, skin: DataFrame, parents: tuple[int, ...], by: list[str]) -> DataFrame:
    """Vertices (by, v, x..z) of each group's shape (by, v, x..z) in its pose.

    Joints lie at weighted sums of vertices (joints: j, v, w) and hang in a tree:
    parents names each one's parent, which comes before it, -1 for a root. pose (by,
    j, rx, ry, rz) turns a joint about its place by a vector's length in radians; a
    joint without a row stays as it is. A vertex follows its joints' rigid motions
    by the weights of skin (v, j, w), which should add up to one; vertices without
    weights are left out. Motions are composed in one row a group, of which there
    are as many as subjects; vertices meet them in one join and one sum.
    """
    if any(not -1 <= p < i for i, p in enumerate(parents)):
        raise ValueError("posed: a joint comes before its parent")
    places = shape.join(joints.select("v", "j", "w"), "v").groupBy(*by).pivot("j", list(range(len(parents)))).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in XYZ))
    turns = pose.groupBy(*by).pivot("j", list(range(len(parents)))).agg(*(F.max(f"r{n}").alias(f"r{n}") for n in XYZ))
    rows = places.join(turns, by, "left")
    c = F.col

    def turned(j: int) -> list[list[Column]]:
        """The rotation about the vector (rx, ry, rz): cosine, cross product and outer product."""
        r = [F.coalesce(c(f"{j}_r{n}"), F.lit(0.0)) for n in XYZ]
        size = F.sqrt(r[0] ** 2 + r[1] ** 2 + r[2] ** 2)
        a = [F.when(size > 0, v / size).otherwise(0.0) for v in r]
        cross = ((F.lit(0.0), -a[2], a[1]), (a[2], F.lit(0.0), -a[0]), (-a[1], a[0], F.lit(0.0)))
        return [[(F.cos(size) if i == k else F.lit(0.0)) + F.sin(size) * cross[i][k] + (1 - F.cos(size)) * a[i] * a[k] for k in range(3)] for i in range(3)]

    for j, parent in enumerate(parents):  # a row's motions, each as nine numbers of a turn and three of a shift
        own, at = turned(j), [c(f"{j}_{n}") for n in XYZ]
        rows = rows.withColumns({f"m{j}_{i}{k}": own[i][k] for i in range(3) for k in range(3)})
        shift = [at[i] - sum(c(f"m{j}_{i}{k}") * at[k] for k in range(3)) for i in range(3)]
        rows = rows.withColumns({f"s{j}_{i}": shift[i] for i in range(3)})
        if parent >= 0:
            rows = rows.withColumns({f"g{j}_{i}{k}": sum(c(f"g{parent}_{i}{h}") * c(f"m{j}_{h}{k}") for h in range(3)) for i in range(3) for k in range(3)} | {f"h{j}_{i}": sum((c(f"g{parent}_{i}{h}") * c(f"s{j}_{h}") for h in range(3)), c(f"h{parent}_{i}")) for i in range(3)})
        else:
            rows = rows.withColumns({f"g{j}_{i}{k}": c(f"m{j}_{i}{k}") for i in range(3) for k in range(3)} | {f"h{j}_{i}": c(f"s{j}_{i}") for i in range(3)})
    motions = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(j).alias("j"), *(c(f"g{j}_{i}{k}").alias(f"g{i}{k}") for i in range(3) for k in range(3)), *(c(f"h{j}_{i}").alias(f"h{i}") for i in range(3))) for j in range(len(parents))))).alias("m")).select(*by, "m.*")
    met = shape.join(skin.select("v", "j", "w"), "v").join(motions, [*by, "j"])
    return met.groupBy(*by, "v").agg(*(F.sum(c("w") * (c(f"g{i}0") * c("x") + c(f"g{i}1") * c("y") + c(f"g{i}2") * c("z") + c(f"h{i}"))).alias(n) for i, n in enumerate(XYZ)))


def shape_fitted(landmarks: DataFrame, by: str, k: int, strength: float = 1e-4, rounds: int = 4) -> DataFrame:
    """Each group's k shape coefficients that bring a model's landmarks (x0..z0, and of k numbers each the arrays bx, by_ and bz of their basis) to observed ones (x..z), as (by, beta, rmse, n).

    Rounds alternate between aligning the observed points to the model (a
    similarity from sums) and a ridge step for the coefficients, whose normal
    equations are summed in the JVM; Python sees one row a group. Groups of fewer
    than four landmarks have no fit, and landmarks with a null take no part.
    """
    rows = checkpointed(landmarks.select(by, *XYZ, "x0", "y0", "z0", "bx", "by_", "bz").dropna())
    basis = dict(zip(XYZ, ("bx", "by_", "bz"), strict=True))
    beta = rows.groupBy(by).agg(F.count("*").alias("n")).filter("n >= 4").select(by, "n", F.array_repeat(F.lit(0.0), k).alias("beta"))
    kind = dict(rows.dtypes)[by]

    def solved(batches):
        for b in batches:
            out = []
            for _, r in b.iterrows():
                a, g = np.zeros((k, k)), np.array([r[f"g{i}"] for i in range(k)])
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = r[f"a{i}_{j}"]
                w = np.linalg.solve(a + strength * np.eye(k), g)
                out.append((r[by], int(r["n"]), w.tolist(), float(np.sqrt(max(0.0, r["rr"] - 2 * w @ g + w @ a @ w) / (3 * r["n"])))))
            yield pd.DataFrame(out, columns=[by, "n", "beta", "rmse"]).astype({by: object})

    for _ in range(max(1, rounds)):
        model = rows.join(beta, by)
        at = lambda n: F.col(f"{n}0") + F.aggregate(F.zip_with(basis[n], "beta", lambda b, c: b * c), F.lit(0.0), lambda s, v: s + v)
        fit = similarity(model.select(by, *XYZ, *(at(n).alias(f"q{n}") for n in XYZ)), by)
        aligned = rows.join(fit, by)
        rest = {n: F.col("scale") * sum((F.col(f"r{i}{j}") * F.col(m) for j, m in enumerate(XYZ[1:], 1)), F.col(f"r{i}0") * F.col("x")) + F.col(f"t{i}") - F.col(f"{n}0") for i, n in enumerate(XYZ)}
        aligned = aligned.select(by, *basis.values(), *(c.alias(f"d{n}") for n, c in rest.items()))
        over = lambda f: F.sum(sum((f(n) for n in XYZ[1:]), f("x")))
        sums = [over(lambda n, i=i, j=j: F.col(basis[n])[i] * F.col(basis[n])[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
        sums += [over(lambda n, i=i: F.col(basis[n])[i] * F.col(f"d{n}")).alias(f"g{i}") for i in range(k)]
        normal = aligned.groupBy(by).agg(F.count("*").alias("n"), over(lambda n: F.col(f"d{n}") ** 2).alias("rr"), *sums).filter("n >= 4")
        beta = checkpointed(normal.mapInPandas(solved, f"{by} {kind}, n long, beta array<double>, rmse double"))
    return beta.select(by, "beta", "rmse", "n")


def landmark_subset(name: str, n: int) -> list[int]:
    """Landmarks of a named set below n, each once, in the order of its parts; all for ``all`` and ``weighted_all``."""
    if name in ("all", "weighted_all"):
        return list(range(n))
    if name not in SUBSETS:
        raise ValueError(f"unknown landmark set: {name}")
    found = dict.fromkeys(i for part in SUBSETS[name] for i in PARTS[part] if i < n)
    return sorted(found) if name == "fine_only" else list(found)


def topology(name: Column) -> Column:
    """(version, bundled) of a topology's id; null for one that isn't known."""
    out = F.lit(None).cast("struct<version:string,bundled:boolean>")
    for known, (version, bundled) in TOPOLOGIES.items():
        out = F.when(name == known, F.struct(F.lit(version).alias("version"), F.lit(bundled).alias("bundled"))).otherwise(out)
    return out


def clamped_whole(value: Column, low: float, high: float, fallback: float) -> Column:
    """A number as a form's control takes it: the nearest whole one within its bounds, halves up, and the fallback for what is no finite number."""
    v = value.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(finite, F.least(F.greatest(F.floor(v + 0.5).cast("double"), F.lit(float(low))), F.lit(float(high)))).otherwise(float(fallback))


def diagnostics_json(counters: Column, events: Column) -> Column:
    """A diagnostics export: counters (a map) by name, and events (an array of structs) as they came, as JSON."""
    by_name = F.map_from_entries(F.array_sort(F.map_entries(counters)))
    return F.to_json(F.struct(by_name.alias("counters"), events.alias("events")))


def planned(log: DataFrame, context: DataFrame, key: str, order: str) -> DataFrame:
    """For each key of context (candidates, comparison_ready, retried, recovered) and step of the plan its status, how many of its actions the log (key, order, action) has, the first one's place, and the issues.

    A step fails where one of its groups of actions is missing; the comparison
    also says whether there were retries or recoveries, and fails without
    candidates or a comparison. One row of counts for a key and action reaches the
    steps, however long the log.
    """
    place = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    seen = log.withColumn("place", place).groupBy(key, "action").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    seen = seen.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("action", F.struct("n", "first")))).alias("seen"))
    rows = context.join(seen, key, "left").withColumn("seen", F.coalesce("seen", F.create_map().cast("map<string,struct<n:bigint,first:int>>")))
    c = F.col

    def step(name: str) -> Column:
        groups, further = STEPS[name]
        has = lambda a: F.map_contains_key("seen", F.lit(a))
        lacks = [~reduce(lambda x, y: x | y, map(has, g)) for g in groups]
        issues = [F.when(lack, F.lit("missing any of: " + ", ".join(g))) for lack, g in zip(lacks, groups, strict=True)]
        failed = reduce(lambda x, y: x | y, lacks)
        status = F.when(failed, "failed").otherwise("completed")
        if name == COMPARED:
            how = F.when(c("recovered") > 0, "_with_recovery").when(c("retried") > 0, "_after_retry").otherwise("")
            status = F.when(~c("comparison_ready") | (c("candidates") <= 0), "failed").otherwise(F.concat(status, how))
            issues += [F.when(c("recovered") > 0, F.lit("variants skipped after retry")).when(c("retried") > 0, F.lit("variants retried")), F.when(~c("comparison_ready"), F.lit("comparison missing")), F.when(c("candidates") <= 0, F.lit("no candidates"))]
        own = sorted({a for g in groups for a in g} | set(further))
        found = F.array_compact(F.array(*(F.try_element_at("seen", F.lit(a)) for a in own)))
        count = F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return F.struct(F.lit(name).alias("step"), status.alias("status"), count.alias("observed"), F.array_min(F.transform(found, lambda x: x["first"])).cast("long").alias("first"), F.array_compact(F.array(*issues)).alias("issues"))

    return rows.select(key, F.inline(F.array(*map(step, STEPS))))


def rolling_until(df: DataFrame, key: str, reset: str, value: str, rows: int = 8, order: str = "seq") -> DataFrame:
    """Root mean square and greatest of the last rows values, starting anew wherever reset differs from the row before."""
    w = W.partitionBy(key).orderBy(order)
    changed = (~F.col(reset).eqNullSafe(F.lag(reset).over(w))).cast("int")
    df = df.withColumn("changed_", changed).withColumn("run_", F.sum("changed_").over(w))
    last = W.partitionBy(key, "run_").orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumns({"rms": F.sqrt(F.avg(F.col(value) ** 2).over(last)), "most": F.max(value).over(last)}).drop("changed_", "run_")
