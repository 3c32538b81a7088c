"""Reviews applied to direction priors, contracts of atlases and overlays, and roll-ups of review records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators.geometry import checkpointed
from isoline.operators.review import decision
from isoline.operators.stats import summary

# Words for yes and no in a reviewer's table.
YES = ("true", "1", "yes", "y", "accepted", "accept")
NO = ("false", "0", "no", "n", "rejected", "reject", "corrected", "correction")

#: The places that a section of a review record may be at, in order, and the schema that it must name.
SECTIONS = {
    "stability": (("incision_overlay_stability", "overlay_stability", "incision_overlay.stability"), ("incision-overlay-stability/v0.1",)),
    "registration": (("incision_overlay_registration", "overlay_registration", "incision_overlay.registration"), ("incision-overlay-registration/v0.1",)),
    "replay": (("incision_overlay_replay_qa", "overlay_replay_qa", "incision_overlay.replay_qa"), ("incision-overlay-replay-qa/v0.1",)),
    "runtime": (("incision_overlay_runtime", "overlay_runtime", "incision_overlay.runtime", "diagnostics.sections.incision_overlay_runtime"), ("incision-overlay-runtime-diagnostics/v0.1",)),
    "view_3d": (("incision_overlay_3d_view", "overlay_3d_view", "incision_overlay.view_3d", "incision_overlay.view3d", "diagnostics.sections.incision_overlay_3d_view"), ("incision-overlay-3d-view-diagnostics/v0.1", "incision-overlay-3d-view/v0.1")),
    "local_region": (("incision_overlay_local_region_quality", "overlay_local_region_quality"), ("rstl-local-region-quality-gate/v0.1",)),
    "smoothing": (("incision_overlay_landmark_smoothing", "overlay_landmark_smoothing"), ("landmark-motion-stabilized-smoothing/v0.1",)),
}
#: Of sections that a record doesn't have itself, the key under which its runtime section has them.
IN_RUNTIME = {"local_region": "local_region_quality", "smoothing": "landmark_smoothing"}
#: The fields by which a section passes or fails.
PASSED = {"stability": "passed", "registration": "passed", "replay": "passed", "local_region": "passed", "smoothing": "enabled", "view_3d": "rendered"}
#: Numbers that are rolled up, by name: the part of the record and the path in it.
METRICS = {
    "direction_confidence": ("candidate", "direction_confidence"),
    "rstl_deviation_deg": ("candidate", "metrics.rstl_deviation_deg"),
    "sensitive_free_margin_min_distance_mm": ("candidate", "metrics.sensitive_free_margin_min_distance_mm"),
    "boundary_area_ratio_to_diameter_disk": ("candidate", "metrics.boundary_area_ratio_to_diameter_disk"),
    "diameter_coverage_deficit_mm": ("linear", "metrics.diameter_coverage_deficit_mm"),
    "length_to_width_ratio": ("fusiform", "metrics.length_to_width_ratio"),
    "tip_angle_error_deg": ("fusiform", "metrics.tip_angle_error_deg"),
    "axis_coverage_deficit_mm": ("fusiform", "metrics.axis_coverage_deficit_mm"),
    "outline_area_mm2": ("fusiform", "metrics.outline_area_mm2"),
    "outline_symmetry_max_error_mm": ("fusiform", "metrics.outline_symmetry_max_error_mm"),
    "boundary_envelope_min_margin_mm": ("fusiform", "metrics.boundary_envelope_min_margin_mm"),
    "boundary_envelope_outside_count": ("fusiform", "metrics.boundary_envelope_outside_count"),
    "jitter_rms_px": ("stability", "overall.rms_px"),
    "jitter_p95_px": ("stability", "overall.p95_px"),
    "jitter_max_px": ("stability", "overall.max_px"),
    "tracked_point_count": ("stability", "tracked_point_count"),
    "sample_count": ("stability", "sample_count"),
    "mapped_point_count": ("registration", "mapped_point_count"),
    "registration_candidate_point_count": ("registration", "candidate_point_count"),
    "invalid_ref_count": ("registration", "invalid_ref_count"),
    "missing_landmark_count": ("registration", "missing_landmark_count"),
    "degenerate_triangle_count": ("registration", "degenerate_triangle_count"),
    "out_of_frame_count": ("registration", "out_of_frame_count"),
    "out_of_frame_fraction": ("registration", "out_of_frame_fraction"),
    "bbox_diagonal_px": ("registration", "bbox_px.diagonal_px"),
    "bbox_frame_fraction": ("registration", "bbox_px.frame_fraction"),
    "frame_count": ("replay", "frame_count"),
    "registration_failed_count": ("replay", "registration_summary.failed_count"),
    "registration_pass_rate": ("replay", "registration_summary.pass_rate"),
    "view_candidate_point_count": ("viewer", "candidate_point_count"),
    "view_boundary_point_count": ("viewer", "boundary_point_count"),
    "active_region_count": ("local_region", "active_region_count"),
    "smooth_level": ("smoothing", "smooth_level"),
    "local_min_cutoff": ("smoothing", "local.min_cutoff"),
    "local_beta": ("smoothing", "local.beta"),
    "local_dcutoff": ("smoothing", "local.dcutoff"),
    "global_min_cutoff": ("smoothing", "global.min_cutoff"),
    "global_beta": ("smoothing", "global.beta"),
    "global_dcutoff": ("smoothing", "global.dcutoff"),
    "global_anchor_count": ("smoothing", "global.anchor_count"),
    "lesion_iou": ("cues", "lesion.iou"),
    "lesion_precision": ("cues", "lesion.precision"),
    "lesion_recall": ("cues", "lesion.recall"),
    "wrinkle_precision": ("cues", "wrinkle.precision"),
    "wrinkle_recall": ("cues", "wrinkle.recall"),
}
#: Numbers of the regions, one for each that isn't normal.
REGION_METRICS = ("motion_norm", "expression_value")


def blank_as_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def flag(text: Column) -> Column:
    """A yes or no of a table: (value, ok); a blank is null and ok, an unknown word null and not."""
    word = F.lower(blank_as_null(text))
    value = F.when(word.isin(*YES), True).when(word.isin(*NO), False)
    return F.struct(value.alias("value"), (word.isNull() | value.isNotNull()).alias("ok"))


def number(text: Column) -> Column:
    """A finite number of a table: (value, ok); a blank is null and ok."""
    value = E.numeric(blank_as_null(text))
    return F.struct(value.alias("value"), (blank_as_null(text).isNull() | value.isNotNull()).alias("ok"))


def vector(text: Column) -> Column:
    """A vector of a table, a JSON array or numbers between commas or semicolons: (value, ok); a blank is null and ok. Numbers in quotes count."""
    given = blank_as_null(text)
    listed = F.filter(F.split(F.replace(given, F.lit(";"), F.lit(",")), ","), lambda s: F.trim(s) != "")
    json = F.try_parse_json(given)
    parts = F.when(json.isNull(), listed).when(F.startswith(F.schema_of_variant(json), F.lit("ARRAY")), F.from_json(given, "array<string>"))
    value = F.transform(parts, lambda s: s.try_cast("double"))
    good = F.coalesce(F.forall(value, lambda v: v.isNotNull()), F.lit(False))
    return F.struct(F.when(good, value).alias("value"), (given.isNull() | good).alias("ok"))


def unit_vector(v: Column) -> Column:
    """A vector of three numbers at length 1, rounded to six digits; null for others, and for one without a direction."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    good = (F.size(v) == 3) & (size > 1e-12) & (size < float("inf"))
    return F.when(good, F.transform(v, lambda x: F.round(x / size, 6)))


def angle_of(v: Column) -> Column:
    """Degrees of a vector in its plane, rounded to three digits."""
    return F.round(F.degrees(F.atan2(F.get(v, F.lit(1)), F.get(v, F.lit(0)))), 3)


def vector_at(degrees: Column, old: Column) -> Column:
    """The unit vector at an angle that keeps the old vector's z before it is brought to length 1."""
    z = F.coalesce(F.get(old, F.lit(2)), F.lit(0.0))
    return unit_vector(F.array(F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), z))


def said(items: DataFrame) -> DataFrame:
    """Review items (word, accepted, angle, correction) with their decision; null for a word that isn't known."""
    corrected = F.col("correction").isNotNull() | F.col("angle").isNotNull()
    return items.withColumn("decision", decision(F.col("word"), F.col("accepted"), corrected))


def review_violations(items: DataFrame, samples: DataFrame) -> DataFrame:
    """What is wrong with review items (review_id, index, tri, word, accepted, reviewer, reviewed_at, angle, correction) for samples (index, tri): (review_id, code), several for one item if need be.

    Codes: unknown_decision, reviewer_required and reviewed_at_required (of
    decisions other than pending), correction_missing and correction_invalid (of
    corrected ones), duplicate_index, index_out_of_range (no such sample) and
    tri_mismatch (where the item names a triangle).
    """
    known = samples.select("index", F.col("tri").alias("sample_tri"))
    twice = items.groupBy("index").agg(F.count("*").alias("n")).filter("n > 1").select("index", F.lit(True).alias("twice"))
    rows = said(items).join(known, "index", "left").join(twice, "index", "left")
    done = F.col("decision") != "pending"
    fixed = F.col("decision") == "corrected"
    neither = F.col("correction").isNull() & F.col("angle").isNull()
    rules = {
        "unknown_decision": F.col("decision").isNull(),
        "reviewer_required": done & blank_as_null(F.col("reviewer")).isNull(),
        "reviewed_at_required": done & blank_as_null(F.col("reviewed_at")).isNull(),
        "correction_missing": fixed & neither,
        "correction_invalid": fixed & F.col("correction").isNotNull() & unit_vector(F.col("correction")).isNull(),
        "duplicate_index": F.col("twice"),
        "index_out_of_range": F.col("sample_tri").isNull(),
        "tri_mismatch": F.col("tri") != F.col("sample_tri"),
    }
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules.items())))
    return rows.select("review_id", F.explode(codes).alias("code"))


def reviewed(samples: DataFrame, items: DataFrame) -> DataFrame:
    """Samples (index, tri, vector) with their review: decision (null without one), the vector as corrected, its angle, the one before, applied and excluded. Items must be without review_violations(): one for a sample at most."""
    rows = samples.join(said(items).select("index", "decision", "angle", "correction"), "index", "left")
    fixed = F.coalesce(F.col("decision") == "corrected", F.lit(False))
    new = F.coalesce(unit_vector(F.col("correction")), F.when(F.col("correction").isNull(), vector_at(F.col("angle"), F.col("vector"))))
    rows = rows.withColumns({"before": F.when(fixed, F.col("vector")), "vector": F.when(fixed, new).otherwise(F.col("vector"))})
    return rows.select(
        *samples.columns, "decision", "before", angle_of(F.col("vector")).alias("angle"),
        F.coalesce(F.col("decision").isin("accepted", "corrected"), F.lit(False)).alias("applied"), F.coalesce(F.col("decision") == "rejected", F.lit(False)).alias("excluded"),
    )


ATLAS = "system string, version string, topologyId string, topologyVersion string, provenance string, validated boolean, lines array<struct<name:string,region:string,points:array<array<double>>>>"


def atlas_json(header: dict[str, Column], lines: Column) -> Column:
    """An atlas as JSON: its header, and lines (name, region, points of (tri, u, v)) with whole triangles and weights of six digits."""
    point = lambda p: F.array(F.round(p["tri"]).cast("double"), F.round(p["u"], 6), F.round(p["v"], 6))
    line = lambda s: F.struct(s["name"].alias("name"), s["region"].alias("region"), F.transform(s["points"], point).alias("points"))
    return F.to_json(F.struct(*(c.alias(n) for n, c in header.items()), F.transform(lines, line).alias("lines")))


def atlas_read(text: Column) -> Column:
    """An atlas from JSON, with defaults for what it doesn't name: version 0.1, no provenance, not validated, lines without a region."""
    a = F.from_json(text, ATLAS)
    lines = F.transform(a["lines"], lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["region"], F.lit("")).alias("region"), F.transform(s["points"], lambda p: F.struct(p[0].alias("tri"), p[1].alias("u"), p[2].alias("v"))).alias("points")))
    return F.struct(a["system"].alias("system"), F.coalesce(a["version"], F.lit("0.1")).alias("version"), a["topologyId"].alias("topologyId"), a["topologyVersion"].alias("topologyVersion"), F.coalesce(a["provenance"], F.lit("")).alias("provenance"), F.coalesce(a["validated"], F.lit(False)).alias("validated"), lines.alias("lines"))


def atlas_issues(atlas: Column, triangles: int, expected: dict[str, str]) -> Column:
    """Issues of an atlas, as (code, line; null for the atlas itself): header fields other than expected, no lines, and of lines fewer than two points, triangles beyond the mesh, weights outside of 0 to 1 by over a thousandth."""
    own = [F.when(~atlas[field].eqNullSafe(F.lit(value)), F.struct(F.lit(f"{field}_mismatch").alias("code"), F.lit(None).cast("string").alias("line"))) for field, value in expected.items()]
    own.append(F.when(F.coalesce(F.size(atlas["lines"]), F.lit(0)) < 1, F.struct(F.lit("no_lines").alias("code"), F.lit(None).cast("string").alias("line"))))

    def of_line(s: Column) -> Column:
        outside = lambda p: reduce(lambda a, w: a | (w < -1e-3) | (w > 1 + 1e-3), (p["u"], p["v"], 1 - p["u"] - p["v"]), F.lit(False))
        rules = {
            "few_points": F.coalesce(F.size(s["points"]), F.lit(0)) < 2,
            "triangle_out_of_range": F.exists(s["points"], lambda p: (p["tri"] < 0) | (p["tri"] >= triangles)),
            "weights_out_of_range": F.exists(s["points"], outside),
        }
        return F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(code).alias("code"), s["name"].alias("line"))) for code, broken in rules.items())))

    return F.concat(F.array_compact(F.array(*own)), F.coalesce(F.flatten(F.transform(atlas["lines"], of_line)), F.array().cast("array<struct<code:string,line:string>>")))


def valid_ref(tri: Column, u: Column, v: Column, w: Column, distance: Column) -> Column:
    """Whether a surface reference stands: a whole triangle from 0, finite weights (w may be null) of at least 0 that sum to 1, both to a ten-thousandth, and a finite distance if any."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    w = F.coalesce(w, 1 - u - v)
    ok = finite(tri) & (tri == F.floor(tri)) & (tri >= 0) & finite(u) & finite(v) & finite(w) & (F.abs(u + v + w - 1) <= 1e-4) & (F.least(u, v, w) >= -1e-4)
    return F.coalesce(ok & (distance.isNull() | finite(distance)), F.lit(False))


def _bound(value: Column, use) -> Column:
    """What use makes of a value that it names more than once: computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def profile_spans(profile: Column) -> Column:
    """The stretches between neighbouring points of a profile (array of (x, y) by x), as (ax, bx, ay, by) with half widths for y."""
    count = F.greatest(F.size(profile) - 1, F.lit(0))
    span = lambda a, b: F.struct(a["x"].alias("ax"), b["x"].alias("bx"), F.abs(a["y"]).alias("ay"), F.abs(b["y"]).alias("by"))
    return F.zip_with(F.slice(profile, F.lit(1), count), F.slice(profile, F.lit(2), count), span)


def half_width_at(x: Column, profile: Column, spans: Column) -> Column:
    """The half width at x of a profile (array of (x, y) by x) with its profile_spans(), between its points on the straight line; beyond its ends minus the distance to them."""
    first, last = F.get(profile, F.lit(0)), F.try_element_at(profile, F.lit(-1))

    def between(s: Column) -> Column:
        width = s["bx"] - s["ax"]
        return s["ay"] + (s["by"] - s["ay"]) * F.when(F.abs(width) > 1e-12, (x - s["ax"]) / width).otherwise(0.0)

    on = F.slice(F.filter(spans, lambda s: x.between(s["ax"], s["bx"])), 1, 1)
    return F.when(x < first["x"], x - first["x"]).when(x > last["x"], last["x"] - x).otherwise(F.coalesce(F.get(F.transform(on, between), F.lit(0)), F.lit(0.0)))


def outline_quality(upper: Column, lower: Column, boundary: Column) -> Column:
    """Quality of an outline's sides, arrays of (x, y) along its axis: whether half widths grow to the middle and shrink from it, the largest difference from symmetry, and the least margin of boundary points within it and how many lie outside (null and 0 for fewer than three)."""
    mid = F.floor(F.size(upper) / 2)
    steps = F.transform(profile_spans(upper), lambda s: s["by"] - s["ay"])
    monotone = F.forall(F.transform(steps, lambda s, i: F.when(i < mid, s >= -1e-7).otherwise(s <= 1e-7)), lambda ok: ok)
    apart = F.array_max(F.zip_with(upper, lower, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] + b["y"])))
    margins = F.when(F.size(boundary) >= 3, _bound(profile_spans(upper), lambda spans: F.transform(boundary, lambda p: half_width_at(p["x"], upper, spans) - F.abs(p["y"]))))
    outside = lambda m: F.coalesce(F.size(F.filter(m, lambda x: x < -1e-6)), F.lit(0))
    return _bound(margins, lambda m: F.struct(monotone.alias("monotone"), F.coalesce(apart, F.lit(0.0)).alias("symmetry_error"), F.array_min(m).alias("least_margin"), outside(m).alias("outside")))


def _shape(paths, leaf: str) -> str:
    """The type of a struct that has fields of the type leaf at some dotted paths."""
    inner: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        inner.setdefault(head, []).append(rest)
    return f"struct<{','.join(f'{h}:{_shape(rests, leaf) if all(rests) else leaf}' for h, rests in inner.items())}>"


def fields_at(v: Column, paths, leaf: str = "variant") -> Column:
    """A VARIANT object as a struct of what it has at some dotted paths, null where it has nothing of that type; null if it is no object. All are found in one walk over its fields: try_variant_get leaves a path that isn't there by an exception, which costs far more than one that is."""
    return F.try_variant_get(v, "$", _shape(paths, leaf))


def sections(records: DataFrame, record: str) -> DataFrame:
    """records with a VARIANT column for each section of their JSON record: of the places that it may be at the first that isn't empty, if that is an object of the section's schema; else null."""
    v, keyed = F.col("v"), "map<string,boolean>"
    outer = {p: p.rpartition(".")[0] for places, _ in SECTIONS.values() for p in places}
    keys_of = {o: f"keys_{o.replace('.', '_')}" for o in outer.values()}
    # Only the keys of these maps are used: a place is looked up where they have it, as a lookup in vain is dear.
    held = lambda p: F.when(F.array_contains(keys_of[outer[p]], p.rpartition(".")[2]), F.try_variant_get(v, f"$.{p}", "variant"))
    is_object = lambda v: fields_at(v, ["schema_version"], "string").isNotNull()
    named = lambda v: fields_at(v, ["schema_version"], "string")["schema_version"]
    # What has a schema's name isn't empty; only other values are written out to see.
    filled = lambda v: fields_at(v, ["schema_version"])["schema_version"].isNotNull() | ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "false", "0", "{}", "[]", '""')
    first = lambda places: F.get(F.filter(F.array(*map(held, places)), lambda x: x.isNotNull() & filled(x)), F.lit(0))
    gated = lambda s: F.when(named(F.col(s)).isin(*SECTIONS[s][1]), F.col(s))

    out = records.withColumn("v", F.try_parse_json(record))
    out = out.withColumns({"own_": F.try_variant_get(v, "$", keyed), "inner_": fields_at(v, [o for o in keys_of if o], keyed)})
    out = out.withColumns({name: F.map_keys(f"inner_.{o}" if o else "own_") for o, name in keys_of.items()})
    out = out.withColumns({s: first(places) for s, (places, _) in SECTIONS.items()} | {s: F.try_variant_get(v, f"$.{p}", "variant") for s, p in (("candidate", "candidate"), ("cues", "secondary_cues"))})
    out = out.drop("v", "own_", "inner_", *keys_of.values())
    out = out.withColumns({s: gated(s) for s in SECTIONS if s not in IN_RUNTIME})
    inner = {"viewer_": fields_at(F.col("view_3d"), ["viewer"])["viewer"], "runtime_": fields_at(F.col("runtime"), IN_RUNTIME.values())}
    out = out.withColumns(inner | {"type_": fields_at(F.col("candidate"), ["type"], "string")["type"], "shown_": boolean_at(F.col("cues"), "present")})
    or_else = lambda v, other: F.when(is_object(v), v).otherwise(other)
    out = out.withColumns({s: or_else(F.col(s), F.col(f"runtime_.{key}")) for s, key in IN_RUNTIME.items()} | {"viewer": or_else(F.col("viewer_"), F.col("view_3d"))})
    of_type = {t: F.when(F.col("type_") == t, F.col("candidate")) for t in ("linear", "fusiform")}
    return out.withColumns({s: gated(s) for s in IN_RUNTIME} | of_type | {"cues": F.when(F.col("shown_"), F.col("cues"))}).drop("viewer_", "runtime_", "type_", "shown_")


def boolean_at(v: Column, field: str) -> Column:
    """A boolean that a VARIANT object has as a field; a text or number is none."""
    found = fields_at(v, [field])[field]
    return F.when(F.schema_of_variant(found) == "BOOLEAN", found.try_cast("boolean"))


def rolled_up(parts: DataFrame) -> DataFrame:
    """Number summaries of all metrics of sections() rows, one row a metric that any record has. The records' paths are read once; equal numbers of a metric are counted before they are shuffled, and their counts written to the shared folder, as summary() reads them more than once."""
    # Numbers and texts that are numbers are taken as texts; a boolean is none.
    of_part = {s: [p for part, p in METRICS.values() if part == s] for s, _ in METRICS.values()}
    region = fields_at(F.col("local_region"), ["regions"], f"array<{_shape(['action', *REGION_METRICS], 'string')}>")["regions"]
    walked = parts.select(*(fields_at(F.col(s), paths, "string").alias(s) for s, paths in of_part.items()), F.coalesce(region, F.array()).alias("regions"))
    regions = F.filter("regions", lambda r: F.coalesce(r["action"], F.lit("unknown")) != "normal")
    of_regions = lambda m: F.transform(regions, lambda r: E.numeric(r[m]))
    found = walked.select(*(E.numeric(F.col(f"{s}.{p}")).alias(m) for m, (s, p) in METRICS.items()), *(of_regions(m).alias(m) for m in REGION_METRICS))
    pair = lambda name, v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("metric"), v.alias("value")))
    own = F.array(*(pair(m, F.col(m)) for m in METRICS))
    each = map(lambda m: F.transform(m, lambda v: pair(f"region_{m}", v)), REGION_METRICS)
    long = found.select(F.explode(F.array_compact(F.concat(own, *each))).alias("m")).select("m.*")
    counted = long.groupBy("metric", "value").agg(F.count("*").alias("times"))
    return summary(checkpointed(counted), ["metric"], "value", "times")


def section_gates(parts: DataFrame) -> DataFrame:
    """For each gated section how many records have it, pass and fail it (neither where its field is no boolean). Records alike in all sections are counted first, and only their counts are told apart by section."""
    ok = lambda s, f: boolean_at(F.col("viewer" if s == "view_3d" else s), f).alias(f"{s}_ok")
    alike = parts.select(*(F.col(s).isNotNull().alias(s) for s in PASSED), *(ok(s, f) for s, f in PASSED.items()))
    counted = alike.groupBy(*alike.columns).agg(F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("here"), F.col(f"{s}_ok").alias("ok")) for s in PASSED))
    long = counted.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    return long.groupBy("section").agg(count(F.col("here")).alias("present"), count(F.col("here") & F.col("ok")).alias("passed"), count(F.col("here") & ~F.col("ok")).alias("failed"))


def acceptance(entries: DataFrame, by: list[str]) -> DataFrame:
    """Seven checks of evidence entries (kind: photo, video or camera; registration, stability, replay and playable as booleans; runtime_errors and leaks as counts; resources as a boolean, null for none), the failed ones in order, and whether none is. Null counts as not ready, and as no error."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    steady = yes("registration") & yes("stability")
    none = lambda c: F.coalesce(F.max(c), F.lit(0)) <= 0
    checks = {
        "photo_overlay_ready": F.bool_or((F.col("kind") == "photo") & yes("registration")),
        "video_overlay_stable": F.bool_or((F.col("kind") == "video") & (yes("replay") | steady)),
        "video_export_playable": F.bool_or((F.col("kind") == "video") & yes("playable")),
        "camera_overlay_stable": F.bool_or((F.col("kind") == "camera") & steady),
        "runtime_error_free": none("runtime_errors"),
        "resources_available": F.bool_or("resources"),
        "sanitized_evidence_only": none("leaks"),
    }
    out = entries.groupBy(*by).agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()), F.count("*").alias("entries"))
    failures = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in checks)))
    return out.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def runtime_errors(counters: Column, events: Column) -> Column:
    """How many errors a diagnostics' counters (a map) and events (names) report."""
    names = ("runtime.error", "runtime.unhandledrejection")
    counted = sum((F.greatest(F.coalesce(F.try_element_at(counters, F.lit(n)), F.lit(0)), F.lit(0)) for n in names), F.lit(0))
    return counted + F.coalesce(F.size(F.filter(events, lambda e: e.isin(*names))), F.lit(0))


def first_of_each(items: Column, field: str) -> Column:
    """Structs of an array without those whose field an earlier one has."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), lambda y: y[field].eqNullSafe(x[field])))


def renderable(points: Column, centre: Column) -> Column:
    """Whether a candidate can be drawn: two points at least, and a centre of three coordinates."""
    return F.coalesce((F.size(points) >= 2) & (F.size(centre) >= 3), F.lit(False))


def review_only_cue(source: Column, label: Column) -> Column:
    """A secondary cue as it may be kept: with defaults for its source and label, to be confirmed by hand, and used neither for geometry nor in prompts, whatever it says itself."""
    return F.struct(
        F.coalesce(source, F.lit("synthetic")).alias("source"), F.coalesce(label, F.lit("low_confidence_cv_cue_requires_manual_confirmation")).alias("confidence_label"),
        F.lit(True).alias("manual_confirmation_required"), F.lit(False).alias("used_for_geometry"), F.lit(False).alias("used_for_agent_prompt"),
    )
