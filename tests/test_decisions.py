"""Texts and provenance of decisions, the scale of features, and what a manifest says of failed images."""

import json
from pathlib import Path

import numpy as np
import pytest

from motecraft.config import Config
from motecraft.operators import detect, features, report, review
from motecraft.plans import images
from motecraft.sources import sinks

POINTS = "image_id string, id int, x double, y double, status string, origin string, suggestion boolean, removed boolean, human_decision string, confirmed boolean, reason string, score double"


def rows(spark, decide):
    made = [
        ("a", 1, 0.0, 0.0, "accepted", None, None, None, None, None, "old", 0.01),
        ("a", 2, 0.0, 0.0, "accepted", "other", None, None, None, None, "old", 0.99),
        ("a", 3, 0.0, 0.0, "review", None, None, None, None, None, "old", 0.01),
        ("a", 4, 0.0, 0.0, "review", None, None, None, None, None, None, 0.99),
        ("a", 5, 0.0, 0.0, "review", None, None, None, None, None, "old", 0.5),
        ("a", 6, 0.0, 0.0, "review", "manual", None, None, None, None, "old", 0.01),
        ("a", 7, 0.0, 0.0, "review", None, True, True, None, None, "old", 0.5),
    ]
    t = review.Thresholds(0.2, 0.8, 0.3)
    return {r["id"]: r for r in decide(spark.createDataFrame(made, POINTS), t).collect()}


def test_reasons_and_origins(spark):
    r = rows(spark, review.decide)
    assert [r[i]["reason"] for i in range(1, 8)] == [
        "模型与原检测不一致，需要复核；old", "old", "模型自动排除（可恢复）：疑似干扰中心；old", "模型通过；", "模型仍不确定；old", "old", "old",
    ]
    assert [r[i]["origin"] for i in range(1, 8)] == ["automatic"] * 5 + ["manual", None]
    plain = rows(spark, review.decide_plain)
    assert plain[3]["reason"] == "模型自动排除（可恢复）：疑似光晕/亮缝；old" and plain[4]["reason"] == "模型通过；" and plain[2]["reason"] == "old"
    assert {p["origin"] for p in plain.values()} == {"automatic"}


def test_features_of_a_scaled_image_are_those_of_the_smaller_one(spark):
    rng = np.random.default_rng(3)
    small = rng.integers(0, 255, (40, 50, 3)).astype(np.uint8)
    large = np.repeat(np.repeat(small, 2, axis=0), 2, axis=1)
    point = lambda x, y: spark.createDataFrame([("i", 1, x, y)], "image_id string, id int, x double, y double")
    a = features.extract(images.image_rows(spark, [("i", large)]), point(44.0, 30.0), scale=2.0).first()["values"]
    b = features.extract(images.image_rows(spark, [("i", small)]), point(22.0, 15.0)).first()["values"]
    assert np.allclose(a, b, atol=1e-3)
    with pytest.raises(ValueError):
        features.extract(images.formula_images(spark), point(1.0, 1.0), scale=0.0)


def test_a_batch_with_a_failed_image(spark, tmp_path):
    good = images.image_rows(spark, [("good", images.formula_image(dim=True))])
    bad = images.image_rows(spark, [("bad", images.formula_image())]).selectExpr("image_id", "name", "width * 7 AS width", "height", "n_channels", "data", "sha256", "n_bytes", "error")
    both = good.selectExpr("image_id", "name", "width", "height", "n_channels", "data", "'aa' AS sha256", "n_bytes", "error").union(bad)
    scorer = lambda i, p: p.selectExpr("*", "0.9D AS score")
    made = images.count_images(both, Config(min_ring=200), scorer=scorer, trained_on=spark.createDataFrame([("aa",)], "sha256 string"))
    assert [tuple(r) for r in made["errors"].collect()] == [("bad", detect.UNREADABLE)]
    assert made["summary"].first()["used_in_model_training"] is True
    proposed = made["points"].where("suggestion").collect()
    assert proposed and all(p["model_decision"] == "dim_proposal" and p["reason"].startswith("暗颗粒补漏建议（尚未计入）；") and p["removed"] for p in proposed)
    sinks.write_bundle(made, str(tmp_path / "out"), model=True)
    lines = [json.loads(x) for f in (tmp_path / "out" / "manifest").glob("*.txt") for x in Path(f).read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["name"]) == [{"name": "bad", "error": detect.UNREADABLE}, {"name": "good", "sha256": "aa"}]


def test_totals_stay_apart_from_null_names(spark):
    found = report.with_total(spark.createDataFrame([(None, 1), ("a", 2)], "name string, n long"), "name", ["n"]).collect()
    assert sorted((r["name"] or "", r["n"]) for r in found) == [("", 1), ("TOTAL", 3), ("a", 2)]
