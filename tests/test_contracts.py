"""Reviews, atlas contracts and roll-ups on hand-made records."""

import json

import pytest
from pyspark.sql import functions as F

from isoline.operators import contracts as C

ITEMS = "review_id string, index long, tri long, word string, accepted boolean, reviewer string, reviewed_at string, angle double, correction array<double>"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, i, [1.0, 0.0, 0.5]) for i in range(6)], "index long, tri long, vector array<double>")


def test_reviews_and_their_violations(spark, samples):
    items = spark.createDataFrame(
        [
            ("a", 0, 0, "Approve", None, "r", "d", None, None),
            ("b", 1, None, "needs-correction", None, "r", "d", 90.0, None),
            ("c", 2, 2, "", False, "r", "d", None, [0.0, 3.0, 4.0]),
            ("d", 3, 3, "reject", None, "r", "d", None, None),
            ("e", 4, 4, None, None, None, None, None, None),
        ],
        ITEMS,
    )
    assert C.review_violations(items, samples).isEmpty()
    got = {r["index"]: r for r in C.reviewed(samples, items).collect()}
    assert [got[i].decision for i in range(6)] == ["accepted", "corrected", "corrected", "rejected", "pending", None]
    assert got[1].vector == [0.0, 0.894427, 0.447214] and got[1].angle == 90.0 and got[1].before == [1.0, 0.0, 0.5]
    assert got[2].vector == [0.0, 0.6, 0.8]
    assert [got[i].applied for i in range(6)] == [True, True, True, False, False, False] and [i for i in got if got[i].excluded] == [3]
    bad = spark.createDataFrame(
        [
            ("f", 0, 9, "accept", None, " ", "d", None, None),
            ("g", 1, 1, "huh", None, "r", "d", None, None),
            ("h", 1, 1, "corrected", None, "r", None, None, None),
            ("i", 77, None, "revised", None, "r", "d", None, [0.0, 0.0, 0.0]),
            ("j", None, None, "reject", None, "r", "d", None, None),
        ],
        ITEMS,
    )
    codes = {(r.review_id, r.code) for r in C.review_violations(bad, samples).collect()}
    assert codes == {("f", "reviewer_required"), ("f", "tri_mismatch"), ("g", "unknown_decision"), ("g", "duplicate_index"), ("h", "duplicate_index"), ("h", "reviewed_at_required"), ("h", "correction_missing"), ("i", "index_out_of_range"), ("i", "correction_invalid"), ("j", "index_out_of_range")}
    assert C.review_violations(bad.limit(0), samples).isEmpty() and C.reviewed(samples, bad.limit(0)).count() == 6


def test_atlas_comes_back_as_written_and_is_checked(spark):
    text = json.dumps({"system": "s", "topologyId": "m", "topologyVersion": "1", "lines": [{"name": "short", "points": [[0, 0.5, 0.5]]}, {"name": "far", "region": "r", "points": [[9, 0.2, 0.2], [10, 0.2, 0.2]]}, {"name": "off", "points": [[0, 0.9, 0.9], [1, 0, 0]]}, {"name": "empty", "points": []}]})
    df = spark.createDataFrame([(text,), ('{"system":"s","lines":[]}',), ("no json",), (None,)], "t string").select("t", C.atlas_read(F.col("t")).alias("a"))
    expected = {"version": "0.1", "topologyId": "m"}
    issues = {r.t: [(i.code, i.line) for i in r.i] for r in df.select("t", C.atlas_issues(F.col("a"), 10, expected).alias("i")).collect()}
    assert issues[text] == [("few_points", "short"), ("triangle_out_of_range", "far"), ("weights_out_of_range", "off"), ("few_points", "empty")]
    assert issues['{"system":"s","lines":[]}'] == issues["no json"] == issues[None] == [("topologyId_mismatch", None), ("no_lines", None)]
    a = df.filter(F.col("t") == text)
    again = a.select(C.atlas_read(C.atlas_json({n: F.col(f"a.{n}") for n in ("system", "topologyId", "topologyVersion")}, F.col("a.lines"))).alias("b"), "a").first()
    assert again.a == again.b and again.a.version == "0.1" and again.a.lines[0].region == ""


def test_section_aliases_and_schemas(spark):
    s = lambda v, **k: {"schema_version": v, **k}
    records = [
        {"incision_overlay_stability": None, "overlay_stability": s("incision-overlay-stability/v0.1", passed=False, overall={"rms_px": "2.5"})},
        {"incision_overlay_stability": s("other"), "overlay_stability": s("incision-overlay-stability/v0.1", passed=True)},  # the first that's there decides
        {"incision_overlay": {"view3d": s("incision-overlay-3d-view-diagnostics/v0.1", viewer={"rendered": True, "candidate_point_count": 4})}, "incision_overlay_local_region_quality": "text", "overlay_runtime": s("incision-overlay-runtime-diagnostics/v0.1", local_region_quality=s("rstl-local-region-quality-gate/v0.1", passed=True, regions=[{"action": "dim", "motion_norm": 1}, {"motion_norm": 3}, {"action": "normal", "motion_norm": 100}, 7]))},
        {"candidate": {"type": "linear", "metrics": {"diameter_coverage_deficit_mm": True, "rstl_deviation_deg": "nan"}}, "secondary_cues": {"present": "true", "lesion": {"iou": 1}}},
        [],
        7,
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,)], "r string")
    parts = C.sections(df, "r")
    gates = {r.section: (r.present, r.passed, r.failed) for r in C.section_gates(parts).collect()}
    assert gates == {"stability": (1, 0, 1), "registration": (0, 0, 0), "replay": (0, 0, 0), "local_region": (1, 1, 0), "smoothing": (0, 0, 0), "view_3d": (1, 1, 0)}
    metrics = {r.metric: (r.n, r.mean) for r in C.rolled_up(parts).collect()}
    assert metrics == {"jitter_rms_px": (1, 2.5), "view_candidate_point_count": (1, 4.0), "region_motion_norm": (2, 2.0)}
    assert C.rolled_up(C.sections(df.limit(0), "r")).isEmpty()


def test_counted_numbers_have_the_summary_of_the_single_ones(spark):
    from isoline.operators.stats import order_statistics, summary

    rows = [("a", float(i * i % 23), i % 4) for i in range(60)] + [("a", None, 3), ("b", 5.0, 2), ("c", None, 9)]
    counted = spark.createDataFrame(rows, "g string, v double, w long").filter("w > 0")
    single = counted.select("g", "v", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int"))))
    text = lambda df: sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    assert text(summary(counted, ["g"], "v", "w")) == text(summary(single, ["g"], "v"))
    places = {f"p{i}": F.least(F.lit(i * 9), F.col("n") - 1) for i in range(11)}
    narrow = lambda df, times: order_statistics(df, ["g"], "v", places, [], most=4, buckets=3, times=times)
    assert text(narrow(counted, "w")) == text(narrow(single, None))


def test_numbers_of_a_record_are_counted_before_they_are_shuffled(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "checkpointed", lambda df: seen.append(df) or df)
    record = lambda i: json.dumps({"candidate": {"direction_confidence": i % 3}, "incision_overlay_stability": {}, "overlay_stability": {"schema_version": "incision-overlay-stability/v0.1", "overall": {"rms_px": "2.5"}}})
    got = C.rolled_up(C.sections(spark.createDataFrame([(record(i),) for i in range(300)], "r string"), "r"))
    assert {r.metric: (r.n, r.mean, r.p90) for r in got.collect()} == {"direction_confidence": (300, 1.0, 2.0), "jitter_rms_px": (300, 2.5, 2.5)}
    assert seen[0].count() == 4


def test_outlines_are_dealt_over_tasks_and_measured_at_their_ends(spark):
    import os

    from isoline.plans import QUERIES

    assert QUERIES["outline_quality"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).rdd.getNumPartitions() > 1
    side = lambda *ys: [(float(i), float(y)) for i, y in enumerate(ys)]
    rows = [(side(0, 2, 0), side(0, -2, 0), [(0.5, 0.5), (-1.0, 0.0), (3.0, 1.0)]), (side(1), side(), [(0.0, 0.0)] * 3), (side(), side(), [(0.0, 0.0)] * 2), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u array<struct<x:double,y:double>>, l array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r.i: tuple(r.q) for r in df.select("i", C.outline_quality(F.col("u"), F.col("l"), F.col("b")).alias("q")).collect()}
    assert got == {0: (True, 0.0, -2.0, 2), 1: (True, 0.0, 0.0, 0), 2: (True, 0.0, None, 0), 3: (None, 0.0, None, 0)}


def test_each_place_of_a_record_is_read_once(spark):
    plan = C.section_gates(C.sections(spark.createDataFrame([("{}",)], "r string"), "r"))._jdf.queryExecution().optimizedPlan().toString()
    for place in C.SECTIONS["stability"][0] + C.SECTIONS["view_3d"][0]:
        assert plan.count(f", $.{place}, ") == 1


def test_places_that_a_record_lacks_are_not_looked_up_and_like_records_are_counted_first(spark):
    import re

    s = lambda v, **k: {"schema_version": v, **k}
    stability = s("incision-overlay-stability/v0.1", passed=True)
    records = [{"overlay_stability": stability}] * 3 + [{"overlay_stability": {}, "incision_overlay": {"stability": stability}}, {"incision_overlay": [stability], "diagnostics": "text"}, {"overlay_stability": "false", "incision_overlay": {"stability": stability}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "r string")
    gates = C.section_gates(C.sections(df, "r"))
    assert {tuple(r) for r in gates.collect()} == {("stability", 4, 4, 0), *((other, 0, 0, 0) for other in C.PASSED if other != "stability")}
    plan = gates._jdf.queryExecution().optimizedPlan().toString()
    for place in C.SECTIONS["stability"][0] + C.SECTIONS["view_3d"][0]:
        assert re.search(rf"array_contains\(keys_\w*#\d+, {place.split('.')[-1]}\) THEN try_variant_get\(v#\d+, \$\.{place}, ", plan)
    assert plan.index("Generate explode") < plan.rindex("Aggregate [")
