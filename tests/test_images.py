"""Kernels, detection, features, sources and sinks on generated images."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from motecraft.config import Config
from motecraft.functions import pixels, values
from motecraft.operators import detect, features, review, scoring
from motecraft.plans import images as plan
from motecraft.sources import images, sinks
from motecraft.streaming import jobs


def scene(h, w, cores=(), red=(), dim=()):
    """Light ground with dark squares that have bright cores, and red rings."""
    y, x = np.mgrid[0:h, 0:w]
    image = np.full((h, w, 3), 245, np.uint8)
    for cx, cy in (*cores, *dim):
        away = np.maximum(abs(x - cx), abs(y - cy))
        image[away <= 11] = (70, 75, 65)
        image[away <= 7] = (60, 150, 140) if (cx, cy) in dim else (160, 220, 195)
    for cx, cy, r in red:
        away = np.hypot(x - cx, y - cy)
        image[(away <= r) & (away >= r - 4)] = (40, 40, 230)
    return image


def brute_components(mask, diagonal):
    seen, out = np.zeros(mask.shape, bool), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            p = stack.pop()
            own.append(p)
            for a, b in steps:
                q = (p[0] + a, p[1] + b)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not seen[q]:
                    seen[q] = True
                    stack.append(q)
        out.append(np.array(own))
    return out


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_match_flood_fill(diagonal):
    rng = np.random.default_rng(0)
    for density in (0.05, 0.4, 0.6, 0.95):
        mask = rng.random((37, 53)) < density
        got, want = pixels.regions(mask, diagonal), brute_components(mask, diagonal)
        assert len(got.area) == len(want)
        for k, own in enumerate(want):
            assert got.area[k] == len(own)
            assert (got.y0[k], got.x0[k]) == tuple(own.min(axis=0)) and (got.height[k], got.width[k]) == tuple(np.ptp(own, axis=0) + 1)
            assert (got.cy[k], got.cx[k]) == pytest.approx(tuple(own.mean(axis=0)))
            if len(own) > 2:
                low, high = np.linalg.eigvalsh(np.cov(own.T))
                assert got.eigen[k] == pytest.approx(max(low, 0) / max(high, 1e-6), abs=1e-6)
            assert (got.crop(k, 2).sum()) == len(own)
        assert (got.mask(np.ones(len(want), bool), mask.shape) == mask).all()
    assert len(pixels.regions(np.zeros((3, 3), bool)).area) == 0 and len(pixels.regions(np.ones((1, 1), bool)).area) == 1


def test_kernels_against_their_definitions():
    rng = np.random.default_rng(1)
    plane = rng.random((30, 41)).astype(np.float32)
    assert pixels.blur(np.full((20, 20), 7.0), 1.5) == pytest.approx(7.0, abs=1e-4)
    taps = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    window = np.outer(taps, taps) / taps.sum() ** 2
    assert pixels.blur(plane, 1.5)[15, 20] == pytest.approx((plane[9:22, 14:27] * window).sum(), abs=1e-5)
    assert pixels.area_resize(plane, 15, 41) == pytest.approx(plane.reshape(15, 2, 41).mean(axis=1))
    assert pixels.area_resize(plane, 30, 41) == pytest.approx(plane)
    assert pixels.sample(plane, np.array([3.25]), np.array([4.5]))[0] == pytest.approx(0.75 * plane[3, 4:6].mean() + 0.25 * plane[4, 4:6].mean())
    assert pixels.sample(plane, np.array([-5.0]), np.array([99.0]))[0] == plane[0, 40]
    assert pixels.sample(plane, np.array([-2.0]), np.array([42.0]), mirror=True)[0] == pytest.approx(plane[2, 38])
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert pixels.filled(ring).sum() == 25 and pixels.filled(~ring)[4, 4]
    assert pixels.grow(np.pad([[True]], 2)).sum() == 5 and pixels.shrink(pixels.grow(ring)).sum() >= ring.sum()
    assert pixels.wide_grow(np.pad([[True]], 5), 3).sum() == 49
    hill = np.zeros((50, 50))
    hill[10, 10], hill[10, 15], hill[40, 40], hill[0, 49] = 10, 9, 20, 12
    y, x = pixels.peaks(hill, np.ones((50, 50), bool), 10, 8)
    assert list(zip(y.tolist(), x.tolist(), strict=True)) == [(40, 40), (0, 49), (10, 10)]
    gx, gy = pixels.gradients(np.tile(np.arange(10.0), (10, 1)))
    assert (gx[:, 1:-1] == 8).all() and (gy == 0).all()


def found(spark, image, cfg=Config()):
    return plan.detect(plan.image_rows(spark, [("i", image)]), cfg).orderBy("id").collect()


def test_distances_equal_all_pairs():
    rng = np.random.default_rng(5)
    for shape, share in (((1, 1), 0.5), ((1, 40), 0.1), ((40, 1), 0.1), ((23, 31), 0.01), ((31, 23), 0.3), ((16, 16), 1.0), ((9, 9), 0.0)):
        mask = rng.random(shape) < share
        y, x = np.mgrid[: shape[0], : shape[1]]
        at = np.argwhere(mask)
        want = np.min([np.hypot(y - a, x - b) for a, b in at], axis=0) if len(at) else np.full(shape, np.inf)
        np.testing.assert_allclose(pixels.distance(mask), want, rtol=0, atol=1e-9)


def test_cores_are_found_once_also_across_tiles(spark):
    small = Config(tile_size=64, tile_padding=64)
    cores = [(64, 50), (128, 128), (40, 100), (150, 30)]
    got = found(spark, scene(180, 190, cores), small)
    assert sorted((round(p["x"]), round(p["y"])) for p in got) == sorted(cores)
    assert [p["id"] for p in got] == [1, 2, 3, 4] and got == found(spark, scene(180, 190, cores), small)


def test_border_red_and_blank(spark):
    got = found(spark, scene(160, 160, [(9, 80), (80, 80)], red=[(80, 80, 30)]))
    codes = {round(p["x"]): p["reason_codes"] for p in got}
    assert "BORDER" in codes[9] and 80 not in codes
    assert found(spark, scene(100, 120)) == []
    speck = scene(60, 60)
    speck[10, 10:14], speck[40, 10:15] = (40, 40, 230), (40, 40, 230)
    rows = detect.exclusions(plan.image_rows(spark, [("i", speck)])).collect()
    assert len(rows) == 1 and rows[0]["y"] == 40 and rows[0]["x"] == 12


def test_scale_gives_points_in_full_pixels(spark):
    image = np.repeat(np.repeat(scene(120, 120, [(60, 60)]), 2, axis=0), 2, axis=1)
    got = found(spark, image, Config(scale=2.0))
    assert len(got) == 1 and abs(got[0]["x"] - 120) < 2 and abs(got[0]["y"] - 120) < 2


def test_suppression_per_tile_is_not_one_for_all(spark):
    schema = "image_id string, tile_id int, seq long, x double, y double, rank double"
    df = spark.createDataFrame([("i", 0, 0, 5.0, 0.0, 1.0), ("i", 0, 1, 12.0, 0.0, 2.0), ("i", 1, 2, 12.0, 0.0, 2.0), ("i", 1, 3, 20.0, 0.0, 3.0)], schema)
    from motecraft.operators import spatial

    two = spatial.suppress(spatial.suppress(df, 11, ("image_id", "tile_id")).where("x < 10 and tile_id = 0 or x >= 10 and tile_id = 1"), 11)
    assert {r["seq"] for r in two.collect()} == {3} != {r["seq"] for r in spatial.suppress(df, 11).collect()}


def test_recovery_stays_away_from_points(spark):
    made = detect.candidates(plan.image_rows(spark, [("i", scene(160, 200, dim=[(45, 80), (130, 80)]))]))
    none = detect.points_of(made).where("false")
    both = detect.propose(made, none).collect()
    assert [round(p["x"]) for p in both] == [45, 130] and all(p["removed"] and p["suggestion"] for p in both)
    one = detect.propose(made, spark.createDataFrame([("i", 6, 50.0, 80.0)], "image_id string, id int, x double, y double")).collect()
    assert [(round(p["x"]), p["id"]) for p in one] == [(130, 7)]


def test_features_have_their_names_and_shape(spark):
    names = features.names()
    assert len(names) == len(set(names)) == 478 and names[0] == "green_r0_3_q10" and names[174] == "v4_green_grid_0_0" and names[-1] == "v4_chroma_center_offset"
    rows = plan.image_rows(spark, [("i", scene(90, 90, [(45, 45)]))])
    at = spark.createDataFrame([("i", 1, 45.0, 45.0), ("i", 2, 0.0, 0.0)], "image_id string, id int, x double, y double")
    got = {r["id"]: dict(zip(names, r["values"], strict=True)) for r in features.extract(rows, at).collect()}
    assert all(np.isfinite(list(v.values())).all() for v in got.values())
    one = got[1]
    assert one["green_r0_3_q50"] == pytest.approx(220, abs=1) and one["chroma_r0_3_q50"] == pytest.approx(35, abs=1)
    assert one["green_center_offset_7"] == pytest.approx(0, abs=1e-3) and one["green_dark_coverage_60"] == 1
    assert sum(one[f"v4_hog_0_0_{b}"] ** 2 for b in range(8)) == pytest.approx(1, abs=1e-3)
    with pytest.raises(Exception, match="outside"):
        features.extract(rows, at.withColumn("x", F.lit(90.0))).collect()


def test_whole_batch_with_a_scorer_and_a_bad_image(spark):
    rows = plan.image_rows(spark, [("a", scene(160, 160, [(45, 80), (105, 80)])), ("b", scene(100, 100))])
    rows = rows.union(rows.where("image_id = 'b'").withColumns({"image_id": F.lit("bad"), "name": F.lit("bad"), "data": F.lit(bytearray(b"x"))}))
    result = plan.count_images(rows, scorer=scoring.by_function(lambda m: np.full(len(m), 0.01), features.names()))
    summary = {r["image_id"]: r for r in result["summary"].collect()}
    assert set(summary) == {"a", "b"} and [r["image_id"] for r in result["errors"].collect()] == ["bad"]
    assert summary["a"]["baseline_count"] == 2 and summary["b"]["count"] == 0
    points = result["points"].collect()
    assert len({(p["image_id"], p["id"]) for p in points}) == len(points)
    assert all(p["removed"] for p in points if p["model_rejected"] or p["suggestion"]) and all(0 <= p["x"] < 160 for p in points)
    with pytest.raises(ValueError):
        scoring.by_function(lambda m: m, ["other"])


def test_model_files_are_checked(tmp_path):
    (tmp_path / "m").write_bytes(b"model")
    good = {"artifact_sha256": hashlib.sha256(b"model").hexdigest(), "feature_version": features.VERSION, "feature_names": features.names(), "thresholds": {"reject_below": 0.1, "accept_at_least": 0.9}}
    data, thresholds = scoring.checked_artifact(str(tmp_path / "m"), good)
    assert data == b"model" and thresholds.priority_below == 0.1
    for bad in ({"artifact_sha256": "0"}, {"feature_version": "x"}, {"feature_names": []}):
        with pytest.raises(ValueError):
            scoring.checked_artifact(str(tmp_path / "m"), good | bad)


def test_forest_scorer(spark):
    rows = plan.image_rows(spark, [("a", scene(160, 160, [(45, 80), (105, 80)]))])
    at = spark.createDataFrame([("a", i, 20.0 + 5 * i, 80.0) for i in range(20)], "image_id string, id int, x double, y double")
    labelled = features.extract(rows, at).withColumn("label", (F.abs(F.col("id") % 12 - 5) < 2).cast("int"))
    scores = scoring.forest(labelled, trees=5)(rows, at).collect()
    assert len(scores) == 20 and all(0 <= r["score"] <= 1 for r in scores)


def folder(tmp_path):
    for name, image in (("One.png", scene(40, 50)), ("two.PNG", scene(30, 30)), ("grey.png", scene(20, 20)[:, :, 0])):
        (tmp_path / name).write_bytes(sinks.png(image))
    (tmp_path / "fake.png").write_bytes(b"no image")
    (tmp_path / "cut.png").write_bytes(sinks.png(scene(9, 9))[:40])
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_scan_check_and_decode(spark, tmp_path):
    where = folder(tmp_path)
    files = images.scan(spark, where)
    assert {r["name"] for r in files.collect()} == {"One.png", "two.PNG", "grey.png", "fake.png", "cut.png"}
    rows = {r["name"]: r for r in images.decoded(spark, where, images.checked(files)).collect()}
    assert rows["One.png"]["error"] is None and bytes(rows["One.png"]["data"]) == scene(40, 50).tobytes()
    assert (rows["grey.png"]["n_channels"], rows["two.PNG"]["width"]) == (1, 30)
    assert "format" in rows["fake.png"]["error"] and "decoded" in rows["cut.png"]["error"]
    assert detect.bgr(rows["grey.png"]["data"], 20, 20, 1).shape == (20, 20, 3)
    limits = images.within_limits(images.checked(files)).first()
    assert limits["accepted"] and not images.within_limits(images.checked(files), max_files=2).first()["accepted"]
    assert images.conflicts(files).count() == 0
    assert [tuple(r) for r in images.conflicts(files.where("false")).collect()] == [("empty", None)]
    assert [r["name"] for r in images.plain_scan(spark, where).collect()] == ["cut.png", "fake.png", "grey.png", "One.png", "two.PNG"]
    assert [r["problem"] for r in images.conflicts(files.union(files.where("name = 'One.png'"))).collect()] == ["same stem", "listed twice"]
    exported = images.export_names(files, "0123456789abcdef").collect()
    assert len({r["export_name"] for r in exported}) == 5 and all(r["export_name"].startswith("0123456789ab_image_0") for r in exported)


def test_lists_keep_order_and_refuse_paths(spark, tmp_path):
    (tmp_path / "list.txt").write_bytes("﻿ b.png \r\n\n a.png\n".encode())
    assert [r["name"] for r in images.listed(spark, str(tmp_path / "list.txt")).orderBy("place").collect()] == ["b.png", "a.png"]
    for bad in ("/a.png", "../a.png", "x/../a.png", "C:\\a.png"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="not a name"):
            images.listed(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(Exception, match="no such image"):
        images.selected(images.scan(spark, folder(tmp_path)), spark.createDataFrame([(0, "none.png")], "place int, name string")).collect()


def test_sinks(spark, tmp_path):
    rows = plan.image_rows(spark, [("a", scene(160, 160, [(45, 80)])), ("=b", scene(100, 100, red=[(50, 50, 20)]))])
    result = plan.count_images(rows)
    sinks.write_bundle(result, str(tmp_path / "out"), images=rows)
    for kind in ("annotated", "red_masks"):
        drawn = {f.name: f.read_bytes() for f in (tmp_path / "out" / kind).iterdir()}
        assert set(drawn) == {"a.png", "=b.png"} and all(v.startswith(b"\x89PNG") for v in drawn.values())
    payload = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/payload")).collect()]
    assert {(r["image_id"], r["width"], r["height"], r["src"]) for r in payload} == {("a", 160, 160, "images/a"), ("=b", 100, 100, "images/%3Db")}
    table = sinks.count_table(result["summary"]).collect()
    assert [r["name"] for r in table] == ["'=b", "a", "TOTAL"] and table[2]["count"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/counts")).count() == 3
    document = json.loads(spark.read.text(str(tmp_path / "out/detections")).first()["value"])
    assert document["config"]["tile_size"] == 640 and len(document["images"]) == 2
    assert spark.createDataFrame([('{"a":"</b>"}',)], "j string").select(sinks.html_payload(F.col("j"))).first()[0] == '{"a":"\\u003c/b>"}'
    pictures = sinks.annotations(rows, result["points"], result["exclusions"]).collect()
    assert all(bytes(r["png"]).startswith(b"\x89PNG") for r in pictures) and len(pictures) == 2
    assert sinks.red_masks(rows).count() == 2


def test_drop_folder_as_jobs(spark, tmp_path):
    (tmp_path / "in/job1").mkdir(parents=True)
    (tmp_path / "in/job2").mkdir()
    folder(tmp_path / "in/job1")
    (tmp_path / "in/job2/x.png").write_bytes(b"bad")

    def handle(files, number):
        return files.select("path", F.when(F.col("name") == "two.PNG", "secret /tmp/path").alias("error"))

    for _ in range(2):
        jobs.process(jobs.uploads(spark, str(tmp_path / "in")), handle, str(tmp_path / "items"), str(tmp_path / "cp")).awaitTermination()
    items = jobs.job_items(spark, str(tmp_path / "items"))
    states = {r["job_id"]: (r["state"], r["failed"], r["total"]) for r in jobs.job_states(items).collect()}
    assert states == {"job1": ("completed", 3, 6), "job2": ("failed", 1, 1)}
    assert not any("secret" in (r["error"] or "") for r in items.collect())
    assert jobs.admitted(jobs.job_states(items)) and not jobs.admitted(spark.createDataFrame([("queued",)] * 3, "state string"))
    assert jobs.snapshot(items.withColumn("_x", F.lit(1))).columns == items.columns
    with pytest.raises(ValueError):
        jobs.one_model(spark.createDataFrame([("a",), ("b",)], "model_sha256 string"))


def test_statuses_are_consistent(spark):
    got = found(spark, scene(160, 160, [(45, 80), (105, 80)]))
    assert all((p["status"] == "review") == bool(p["reason_codes"]) and p["reason"].count(review.SEPARATOR) == max(0, len(p["reason_codes"]) - 1) for p in got)


def test_names_without_case(spark):
    same = ["Straße.png", "STRASSE.png", "STRAẞE.png", "ΟΔΟΣ.png", "οδος.png", "οδοσ.png", "ﬁle.png", "FILE.png", "Ä.png", "ä.png", "мир.png", "МИР.png", "a.png"]
    rows = spark.createDataFrame([(n, f"/x/{n}", "png") for n in same], "name string, path string, suffix string")
    assert {r["name"]: r["folded"] for r in rows.select("name", values.casefold(F.col("name")).alias("folded")).collect()} == {n: n.casefold() for n in same}
    assert images.conflicts(rows).where("problem = 'same stem'").count() == 5
    twice = spark.createDataFrame([("a.png", "file:/x/a.png", "png"), ("a.png", "file:///x/./a.png", "png")], rows.schema)
    assert {r["problem"] for r in images.conflicts(twice.select("name", "path", "suffix")).collect()} == {"same stem", "listed twice"}
