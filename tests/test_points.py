"""Operators on points: joins by distance, suppression, numbering, reasons, decisions, counts."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from motecraft.config import Config, Thresholds
from motecraft.operators import report, review, spatial
from motecraft.plans.images import settle

POINTS = "image_id string, id int, seq long, x double, y double, rank double"


def points(spark, n=200, seed=1, reach=120):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, i, rng.uniform(-reach, reach), rng.uniform(-reach, reach), float(rng.randint(0, 20))) for i in range(n)]
    return rows, spark.createDataFrame(rows, POINTS)


def brute_greedy(rows, distance):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[2])):
        if all(k[0] != r[0] or math.hypot(k[3] - r[3], k[4] - r[4]) >= distance for k in kept):
            kept.append(r)
    return {r[2] for r in kept}


def test_three_forms_of_suppression_agree(spark):
    rows, df = points(spark)
    want = brute_greedy(rows, 11)
    for got in (spatial.suppress_fold(df, 11), spatial.suppress(df, 11), spatial.suppress_rounds(df, 11, settle=settle)):
        assert {r["seq"] for r in got.collect()} == want


def test_suppression_is_strict_and_ties_go_by_sequence(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 5.0), ("a", 2, 2, 11.0, 0.0, 5.0), ("a", 3, 3, 5.0, 0.0, 5.0), ("b", 4, 4, 0.0, 0.0, 1.0)], POINTS)
    for got in (spatial.suppress_fold(df, 11), spatial.suppress(df, 11), spatial.suppress_rounds(df, 11, settle=settle)):
        assert {r["seq"] for r in got.collect()} == {1, 2, 4}
    assert spatial.suppress(df.where("false"), 11).count() == 0 == spatial.suppress_rounds(df.where("false"), 11, settle=settle).count()


def test_joins_by_distance_match_brute_force(spark):
    rows, df = points(spark)
    others, odf = points(spark, 60, seed=2)
    d = lambda r, o: math.hypot(r[3] - o[3], r[4] - o[4]) if r[0] == o[0] else math.inf
    least = {r[1]: min(d(r, o) for o in others) for r in rows}
    assert {r["id"] for r in spatial.near(df, odf, 9).collect()} == {i for i, v in least.items() if v <= 9}
    assert {r["id"] for r in spatial.far(df, odf, 13).collect()} == {i for i, v in least.items() if v >= 13}
    got = {r["id"]: r["distance"] for r in spatial.nearest(df, odf, 30).collect()}
    assert all((got[i] is None) if v > 30 else got[i] == pytest.approx(v) for i, v in least.items())


def test_distance_joins_are_equi_joins(spark):
    _, df = points(spark, 10)
    for joined in (spatial.near(df, df, 9), spatial.far(df, df, 9)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_reading_order_rounds_half_to_even_and_ids_continue(spark):
    df = spark.createDataFrame([("a", 0, 1, 9.0, 17.5, 0.0), ("a", 0, 2, 5.0, 52.5, 0.0), ("a", 0, 3, 1.0, 18.0, 0.0), ("a", 0, 4, 2.0, 0.0, 0.0)], POINTS)
    ids = {r["seq"]: r["id"] for r in spatial.numbered(df).collect()}
    assert ids == {4: 1, 1: 2, 3: 3, 2: 4}
    more = spatial.numbered(df, after=spark.createDataFrame([("a", 7)], "image_id string, id int"))
    assert sorted(r["id"] for r in more.collect()) == [8, 9, 10, 11]


def decided(spark, rows, decide=review.decide):
    schema = "id int, status string, score double, origin string, human_decision string, confirmed boolean, suggestion boolean, removed boolean, baseline_status string"
    return {r["id"]: r for r in decide(spark.createDataFrame(rows, schema)).collect()}


def test_decision_table_rows_in_order(spark):
    t = Thresholds()
    plain = (None, None, None, None, None, None)
    got = decided(
        spark,
        [
            (1, "accepted", 0.0, "manual", None, None, None, None, None), (2, "review", 0.0, "automatic", "keep", None, None, None, None), (3, "review", 0.0, None, None, True, None, None, None),
            (4, "review", 0.99, None, None, None, True, True, None), (5, "review", 0.5, None, None, None, None, True, None), (6, "accepted", t.priority - 1e-9, *plain), (7, "accepted", t.priority, *plain),
            (8, "review", t.reject - 1e-9, *plain), (9, "review", t.reject, *plain), (10, "review", t.accept, *plain), (11, None, 0.5, *plain), (12, "review", 0.5, None, None, None, None, None, "accepted"),
        ],
    )
    assert all(got[i]["model_score"] is None and got[i]["model_decision"] is None for i in (1, 2, 3))
    assert got[4]["model_score"] == 0.99 and got[4]["model_decision"] is None and got[4]["removed"] and got[5]["removed"]
    assert [got[i]["model_decision"] for i in range(6, 13)] == ["review_original_green", "preserve_original_green", "reject", "review", "accept", "review", "preserve_original_green"]
    assert [got[i]["status"] for i in range(6, 13)] == ["review", "accepted", "review", "review", "accepted", "review", "accepted"]
    assert [got[i]["removed"] for i in range(6, 13)] == [False, False, True, False, False, False, False]
    assert got[8]["model_rejected"] and got[8]["origin"] == "automatic" and got[8]["baseline_status"] == "review"
    assert got[6]["reason"] == review.PRIORITY_TEXT


def test_bad_scores_fail_even_for_people(spark):
    for bad in (math.nan, -0.1, 1.1, None):
        for decide in (review.decide, review.decide_plain):
            with pytest.raises(PySparkException):
                decided(spark, [(1, "accepted", bad, "manual", None, None, None, None, None)], decide)


def test_plain_table_ignores_provenance(spark):
    got = decided(spark, [(1, "review", 0.0, "manual", "keep", True, None, None, None), (2, "odd", 0.0, *(None,) * 6)], review.decide_plain)
    assert got[1]["model_rejected"] and got[1]["status"] == "review" and got[2]["status"] == "odd"


def test_priority_defaults_to_reject():
    assert Thresholds(priority=None).priority_below == Thresholds().reject


def test_counts_and_totals(spark):
    rows = [("a", 1, "review", False, None, None, "automatic"), ("a", 2, "review", True, None, True, "automatic"), ("a", 3, "accepted", None, None, None, "manual"), ("b", 1, "review", True, True, None, "automatic")]
    df = spark.createDataFrame(rows, "image_id string, id int, status string, removed boolean, model_rejected boolean, suggestion boolean, origin string")
    measures = ["baseline_count", "count", "review_count", "model_rejected_count", "dim_proposal_count"]
    got = {r["image_id"]: tuple(r[m] for m in measures) for r in report.with_total(report.summarise(df), "image_id", measures).collect()}
    assert got == {"a": (1, 2, 1, 0, 1), "b": (1, 0, 0, 1, 0), "TOTAL": (2, 2, 1, 1, 1)}


def test_human_edits(spark):
    df = spark.createDataFrame([("a", 1, "review"), ("a", 2, "accepted"), ("a", 3, "review")], "image_id string, id int, status string")
    edits = spark.createDataFrame([("a", 1, "keep"), ("a", 2, "delete")], "image_id string, id int, human_decision string")
    added = spark.createDataFrame([("a", 4)], "image_id string, id int")
    got = {r["id"]: r for r in review.corrected(df, edits, added).collect()}
    assert got[1]["status"] == "accepted" and got[1]["confirmed"] and got[2]["removed"] and got[3]["human_decision"] is None and got[4]["origin"] == "manual"
    assert report.summarise(review.corrected(df, edits, added)).first()["count"] == 3


def test_reasons_are_listed_in_order(spark):
    row = dict(agrees=False, chroma=1.0, ring=1.0, edge=1.0, width=20, height=10, area=501, x=1.0, y=50.0, image_width=100, image_height=100, red_distance=17.9)
    fine = dict(agrees=True, chroma=20.0, ring=20.0, edge=12.0, width=33, height=20, area=500, x=18.5, y=50.0, image_width=100, image_height=100, red_distance=18.0)
    df = spark.createDataFrame([row, fine, fine | {"red_distance": None}])
    got = [r["c"] for r in df.select(review.reason_codes().alias("c")).collect()]
    assert sorted(got, key=len) == [[], [], list(review.REASON_TEXT)]
    text = df.select(review.reason_text(review.reason_codes()).alias("t")).first()["t"]
    assert text == review.SEPARATOR.join(review.REASON_TEXT.values())


def test_spreadsheet_names_and_job_states(spark):
    names = ["=1", "  @x", "+", "-a", "plain", "a=b", ""]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(report.csv_safe(F.col("n")).alias("n")).collect()]
    assert got == ["'=1", "'  @x", "'+", "'-a", "plain", "a=b", ""]
    items = [("q", "queued"), ("r", "completed"), ("r", "queued"), ("c", "completed"), ("c", "failed"), ("f", "failed")]
    got = {r["job_id"]: r["state"] for r in report.job_states(spark.createDataFrame(items, "job_id string, status string")).collect()}
    assert got == {"q": "queued", "r": "running", "c": "completed", "f": "failed"}


def test_parameters_are_checked():
    assert Config.from_json('{"tile_size": 64}', 2.0) == Config(tile_size=64, scale=2.0)
    for bad in ('{"tile_size": 63}', '{"scale": 0}', '{"unknown": 1}', '{"nms_distance": 0}', '{"threshold_step": 0}', '{"tile_padding": 47}'):
        with pytest.raises(ValueError):
            Config.from_json(bad)
