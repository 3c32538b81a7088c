"""Points and lines taken to a surface: references, smoothing, and overlays compiled from reviewed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoline.functions import exprs as E
from isoline.operators.contracts import valid_ref
from isoline.operators.geometry import XYZ, checkpointed, cols, similarity
from isoline.operators.surface import CORNERS, closest

# Names that an overlay's readers look for, and the state of a record that nobody has reviewed.
OVERLAY_SCHEMA = "incision-overlay/v0.1"
UNREVIEWED = "pending_clinician_confirmation"
REF = "struct<tri:double,u:double,v:double,w:double,distance:double>"
OVERLAY = f"schema_version string, tumor struct<center_ref:{REF}>, candidate struct<polyline_refs:array<{REF}>>, review_gate struct<live_overlay_ready:boolean>, audit struct<raw_image_sent:boolean,review_required:boolean,live_overlay_ready:boolean>"


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def anchored(points: DataFrame, triangles: DataFrame, by: list[str]) -> DataFrame:
    """Surface references of points (id, x..z): (by, id, tri, u, v, w, distance, x, y, z), the triangle (tri, x0..z2) of their by columns that is nearest, ties to the smaller tri, the weights of its corners at the place nearest the point, and that place. Points without coordinates or a mesh have none; points are read twice."""
    near = closest(points, triangles, by)
    at = [[F.col(f"{n}{j}") for n in XYZ] for j in CORNERS]
    rows = points.select(*by, "id", *XYZ).join(near, [*by, "id"]).join(triangles.select(*by, "tri", *(c for p in at for c in p)), [*by, "tri"])
    rows = rows.withColumn("at", E.weights_on_triangle(cols(), *at))
    place = [sum((F.col(f"at.{w}") * c[i] for w, c in zip("uvw", at, strict=True)), F.lit(0.0)) for i in range(3)]
    return rows.select(*by, "id", "tri", "at.u", "at.v", "at.w", "distance", *(c.alias(n) for c, n in zip(place, XYZ, strict=True)))


def smoothed(lines: DataFrame, triangles: DataFrame, by: list[str], rounds: int = 2, most: int | None = None) -> DataFrame:
    """Lines (by, line, seq, x..z) on a surface with their corners cut, as (by, line, seq, x..z) with seq from 0.

    In each round every segment hands on the points a quarter from its ends, taken
    back to the nearest place of the surface, and the line keeps its ends; a point
    at the place of the one before it goes. Lines of fewer than four points, with
    a point without coordinates, or of no mesh stay as they are, and with most so do
    those of more points than that; above half of it they have one round. A line's
    order needs one task's sort; points meet the surface by grid cells. The mesh is
    written once, as each round reads it.
    """
    triangles = checkpointed(triangles)
    line = W.partitionBy(*by, "line")
    order = line.orderBy("seq")
    rows = lines.join(triangles.select(*by).distinct().withColumn("meshed", F.lit(True)), by, "left")
    sound = F.min(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))).over(line)
    n = F.count("*").over(line)
    turns = F.when(~sound | F.col("meshed").isNull() | (n < 4), 0)
    if most is not None:
        turns = turns.when(n > most, 0).when(n > most / 2, min(1, rounds))
    current = rows.select(*by, "line", (F.row_number().over(order) - 1).alias("seq"), *XYZ, turns.otherwise(rounds).alias("turns"))
    for i in range(rounds):
        current = checkpointed(current)
        moving = current.filter(F.col("turns") > i).withColumns({f"n{n}": F.lead(n).over(order) for n in XYZ})
        cuts = F.array(*(F.struct((F.col("seq") * 2 + k).alias("seq"), *((F.col(n) * (1 - t) + F.col(f"n{n}") * t).alias(n) for n in XYZ)) for k, t in ((1, 0.25), (2, 0.75))))
        cut = moving.filter("nx is not null").select(*by, "line", "turns", F.explode(cuts).alias("c"))
        cut = checkpointed(cut.select(*by, F.struct("line", "c.seq", "turns").alias("id"), *(f"c.{n}" for n in XYZ)))
        new = anchored(cut, triangles, by).select(*by, "id.line", "id.seq", *XYZ, "id.turns")
        ends = moving.filter("seq = 0 or nx is null").select(*by, "line", F.when(F.col("seq") > 0, F.col("seq") * 2 + 1).otherwise(0).alias("seq"), *XYZ, "turns")
        step = E.distance(cols(), [F.lag(n).over(order) for n in XYZ])
        kept = ends.unionByName(new).withColumn("step", step).filter("step is null or step > 1e-9")
        kept = kept.select(*by, "line", (F.row_number().over(order) - 1).alias("seq"), *XYZ, "turns")
        current = kept.unionByName(current.filter(F.col("turns") <= i))
    return current.drop("turns")


def of_severity(warnings: Column, severity: str) -> Column:
    """Codes of the warnings (severity, code) of one severity."""
    return F.transform(F.filter(warnings, lambda w: (w["severity"] == severity) & (w["code"] != "")), lambda w: w["code"])


def compiled(records: DataFrame, triangles: DataFrame, by: list[str]) -> DataFrame:
    """Overlays of the records that may be shown, as (by, record_id, overlay): a struct with its points as references to the surface.

    records: record_id, title, candidate_type, tumor_kind, centre (array of x, y, z),
    boundary and polyline (arrays of such), diameter_mm, margin_mm, length_mm,
    width_mm, status, reviewer, notes, passed, high_codes, medium_codes, warnings
    (array of severity, code), approval_ready, live_overlay_ready; any may be null.
    Without lists of codes those of the warnings count. A record that isn't ready,
    lacks a centre, or whose centre or polyline of two points or more has no sound
    references has no overlay; boundary points without coordinates are left out.
    Records that are ready, and the mesh, are written once, as each is read again.
    """
    triangles = checkpointed(triangles)
    ready = checkpointed(records.filter("live_overlay_ready and centre is not null and polyline is not null"))
    empty = F.array().cast("array<array<double>>")
    tagged = lambda kind, points: F.transform(points, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), *(F.get(p, F.lit(k)).cast("double").alias(n) for k, n in enumerate(XYZ))))
    asked = F.explode(F.concat(tagged("centre", F.array("centre")), tagged("boundary", F.coalesce("boundary", empty)), tagged("line", F.col("polyline"))))
    points = ready.select(*by, "record_id", asked.alias("p")).select(*by, F.struct("record_id", "p.kind", "p.at").alias("id"), "p.x", "p.y", "p.z").filter(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    refs = anchored(points, triangles, by).select(*by, "id.*", F.struct(F.col("tri").cast("double").alias("tri"), "u", "v", "w", "distance").alias("ref"))
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "ref")))), lambda r: r["ref"])
    refs = refs.groupBy(*by, "record_id").agg(F.get(listed("centre"), F.lit(0)).alias("centre_ref"), listed("boundary").alias("boundary_refs"), listed("line").alias("line_refs"))
    rows = ready.join(refs, [*by, "record_id"]).filter(F.size("line_refs") == F.size("polyline"))
    status, on = F.coalesce("status", F.lit(UNREVIEWED)), F.lit(True)
    codes = {s: F.coalesce(F.col(f"{s}_codes"), of_severity(F.col("warnings"), s), F.array().cast("array<string>")) for s in ("high", "medium")}
    passed = F.coalesce("passed", F.lit(False))
    overlay = F.struct(
        F.lit(OVERLAY_SCHEMA).alias("schema_version"), F.col("title").alias("label"), "candidate_type", "tumor_kind",
        F.struct(F.col("centre_ref").alias("center_ref"), "boundary_refs", "diameter_mm", "margin_mm").alias("tumor"),
        F.struct(F.col("line_refs").alias("polyline_refs"), "length_mm", "width_mm", passed.alias("guardrails_passed"), codes["high"].alias("high_guardrail_codes")).alias("candidate"),
        F.struct(status.alias("status"), F.coalesce("reviewer", F.lit("")).alias("reviewer"), (F.coalesce("notes", F.lit("")) != "").alias("notes_present")).alias("review"),
        F.struct(passed.alias("passed"), codes["high"].alias("high_codes"), codes["medium"].alias("medium_codes")).alias("guardrail_summary"),
        F.struct(F.coalesce("approval_ready", F.lit(False)).alias("approval_ready"), on.alias("live_overlay_ready")).alias("review_gate"),
        F.struct(F.lit(False).alias("raw_image_sent"), on.alias("review_required"), status.alias("review_status"), F.coalesce("approval_ready", F.lit(False)).alias("approval_ready"), on.alias("live_overlay_ready")).alias("audit"),
    )
    return rows.select(*by, "record_id", overlay.alias("overlay")).filter(valid_overlay(F.col("overlay")))


def valid_overlay(overlay: Column) -> Column:
    """Whether an overlay (a struct with at least OVERLAY's fields) stands: its schema, a sound centre, two or more references that are all sound, no raw image sent, review required, and ready to be shown wherever it says."""
    sound = lambda r: valid_ref(r["tri"], r["u"], r["v"], r["w"], r["distance"])
    line, audit = overlay["candidate"]["polyline_refs"], overlay["audit"]
    ok = (overlay["schema_version"] == OVERLAY_SCHEMA) & sound(overlay["tumor"]["center_ref"]) & (F.size(line) >= 2) & F.forall(line, sound) & (audit["raw_image_sent"] == False) & audit["review_required"]  # noqa: E712
    gate = overlay["review_gate"]
    ok = ok & (gate.isNull() | F.coalesce(gate["live_overlay_ready"], F.lit(False))) & F.coalesce(audit["live_overlay_ready"], F.lit(True))
    return F.coalesce(ok, F.lit(False))


def overlay_of(text: Column) -> Column:
    """An overlay's JSON text as a struct of OVERLAY's fields, for valid_overlay(); null if it is none."""
    return F.from_json(text, OVERLAY)


def carried(lines: DataFrame, pairs: DataFrame, triangles: DataFrame, by: str, least: int = 3) -> DataFrame:
    """Lines (by, line, seq, x..z) of one topology carried to another's surface, as anchored() rows with line and seq: moved by the similarity that takes the landmark pairs (by, x..z to qx..qz) of their by column nearest, then to the nearest place of the triangles. Groups of fewer pairs than least carry nothing."""
    fit = similarity(pairs, by)
    enough = pairs.groupBy(by).agg(F.count("*").alias("pairs")).filter(F.col("pairs") >= least).select(by)
    turned = [F.col("scale") * sum((F.col(f"r{i}{j}") * c for j, c in enumerate(cols())), F.lit(0.0)) + F.col(f"t{i}") for i in range(3)]
    moved = lines.join(fit.join(enough, by, "left_semi"), by).select(by, F.struct("line", "seq").alias("id"), *(c.alias(n) for c, n in zip(turned, XYZ, strict=True)))
    return anchored(checkpointed(moved), triangles, [by]).select(by, "id.*", "tri", "u", "v", "w", "distance", *XYZ)


def margin_distances(p: list[Column], anchors: dict[str, tuple[float, float]], segments: dict[str, tuple[tuple[float, float], tuple[float, float]]], face_mm: float = 180.0) -> Column:
    """(name, mm) of how far a normalised point lies from each anchor and each segment of a face that is face_mm high, anchors first."""
    lits = lambda q: [F.lit(float(v)) for v in q]
    near = [(n, E.distance(p, lits(a))) for n, a in anchors.items()] + [(n, E.closest_on_segment(p, lits(a), lits(b))) for n, (a, b) in segments.items()]
    return F.array(*(F.struct(F.lit(n).alias("name"), (d * face_mm).alias("mm")) for n, d in near))


def units_per_mm(points: DataFrame, by: list[str], face_mm: float = 180.0) -> DataFrame:
    """(by, units_per_mm) of each mesh: its height along y over face_mm, 1 for a mesh without height."""
    height = F.max("y") - F.min("y")
    return points.groupBy(*by).agg(F.when(height > 1e-9, height / face_mm).otherwise(1.0).alias("units_per_mm"))
