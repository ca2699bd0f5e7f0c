"""Logs of human edits with undos."""

import random

import pytest

from motecraft.operators import review


def plain(rows):
    stacks = {}
    for image, point, _, action in sorted(rows, key=lambda r: r[2]):
        if action is None:
            continue
        own = stacks.setdefault((image, point), [])
        if action != "undo":
            own.append(action)
        elif own:
            own.pop()
    return {k: v[-1] if v else None for k, v in stacks.items()}


def decisions(df):
    return {(r["image_id"], r["id"]): r["human_decision"] for r in df.collect()}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_stacks_in_any_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([1, 1, 2, 3]), seq, rng.choice(["keep", "delete", "undo", "undo", None])) for seq in rng.sample(range(-200, 2000), 600)]
    log = spark.createDataFrame(rows, "image_id string, id int, seq long, action string").repartition(5)
    assert decisions(review.standing_edits(log, chunk)) == plain(rows)


def test_undo_of_nothing_and_unknown_actions(spark):
    schema = "image_id string, id int, seq long, action string"
    assert decisions(review.standing_edits(spark.createDataFrame([("a", 1, 1, "undo"), ("a", 1, 2, "undo"), ("a", 1, 3, "keep")], schema))) == {("a", 1): "keep"}
    with pytest.raises(Exception, match="unknown action: erase"):
        review.standing_edits(spark.createDataFrame([("a", 1, 1, "erase")], schema)).collect()
    assert review.standing_edits(spark.createDataFrame([], schema)).collect() == []


def test_repeated_edits_and_points_do_not_fan_out(spark):
    points = spark.createDataFrame([("a", 1, "review"), ("a", 2, "accepted")], "image_id string, id int, status string")
    edits = spark.createDataFrame([("a", 1, "delete", 5), ("a", 1, "keep", 2), ("a", 2, "delete", 1), ("a", 2, "keep", 9)], "image_id string, id int, human_decision string, seq int")
    assert sorted((r["id"], r["human_decision"], r["removed"]) for r in review.corrected(points, edits).collect()) == [(1, "delete", True), (2, "keep", False)]
    assert sorted((r["id"], r["human_decision"]) for r in review.corrected(points, edits.drop("seq")).collect()) == [(1, "keep"), (2, "keep")]
