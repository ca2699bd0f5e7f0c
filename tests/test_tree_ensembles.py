"""Ensembles as tables of nodes, their files, and rounding."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motecraft.config import Thresholds
from motecraft.functions.numbers import rounded
from motecraft.operators import features, scoring, trees

LEAF = (None, None, None, None)


def nodes(rows):
    return pd.DataFrame(rows, columns=trees.COLUMNS)


def grown(rng, n_trees, n_features, depth):
    rows = []
    for tree in range(n_trees):
        waiting, made = [(0, 0)], 1
        while waiting:
            node, level = waiting.pop()
            if level < depth and rng.random() < 0.8:
                rows.append((tree, node, rng.randrange(n_features), rng.uniform(-1, 1), made, made + 1, None))
                waiting += [(made, level + 1), (made + 1, level + 1)]
                made += 2
            else:
                rows.append((tree, node, *LEAF, rng.random()))
    return nodes(rows)


def plain(table, x):
    by = {(r.tree, r.node): r for r in table.itertuples()}
    out = []
    for tree in sorted(set(table["tree"])):
        at = by[tree, 0]
        while at.feature == at.feature and at.feature is not None:
            at = by[tree, at.left if x[int(at.feature)] <= at.threshold else at.right]
        out.append(at.value)
    return sum(out) / len(out)


def test_walk_equals_node_by_node():
    rng = random.Random(2)
    table = grown(rng, 12, 5, 6).sample(frac=1, random_state=1)
    x = np.random.default_rng(3).uniform(-1, 1, (300, 5))
    x[0, :] = np.nan
    assert np.allclose(trees.Ensemble(table).scores(x, rows=64), [plain(table, r) for r in x])
    assert trees.Ensemble(table).scores(np.zeros((0, 5))).shape == (0,)
    with pytest.raises(ValueError, match="more features"):
        trees.Ensemble(nodes([(0, 0, 4, 0.5, 1, 2, None), (0, 1, *LEAF, 0.0), (0, 2, *LEAF, 1.0)])).scores(np.zeros((1, 4)))


@pytest.mark.parametrize(
    ("rows", "says"),
    [
        ([], "not a table"),
        ([(0, 0, 0, 0.5, 1, 2, None), (0, 1, *LEAF, 0.0)], "missing"),
        ([(0, 0, 0, 0.5, 1, 0, None), (0, 1, *LEAF, 0.0)], "before its parent"),
        ([(0, 0, *LEAF, 0.5), (0, 0, *LEAF, 0.5)], "twice"),
        ([(0, 1, *LEAF, 0.5)], "first node"),
        ([(0, 0, *LEAF, None)], "not a number"),
    ],
)
def test_bad_tables_are_refused(rows, says):
    with pytest.raises(ValueError, match=says):
        trees.Ensemble(nodes(rows))


def test_models_in_folders(tmp_path):
    own, limits = [(0, 0, 1, 0.5, 1, 2, None), (0, 1, *LEAF, 0.1), (0, 2, *LEAF, 0.9)], Thresholds(0.1, 0.9, 0.3)
    trees.save(nodes(own), str(tmp_path / "a"), ["p", "q"], "v1", limits)
    model, thresholds, metadata = trees.load(str(tmp_path / "a"), ["p", "q"], "v1")
    assert model.scores(np.array([[0, 0.5], [0, 0.6]])).tolist() == [0.1, 0.9] and thresholds == limits and metadata["model_version"] == "nodes-1.0"
    assert trees.load(str(tmp_path / "a"), ["p", "q"], "v1")[0] is model
    for names, version in ((["q", "p"], "v1"), (["p", "q"], "v2")):
        with pytest.raises(ValueError, match="other features"):
            trees.load(str(tmp_path / "a"), names, version)
    described = json.loads((tmp_path / "a" / "model.json").read_text())
    (tmp_path / "a" / "model.json").write_text(json.dumps(described | {"model_version": "other-2"}))
    with pytest.raises(ValueError, match="no reader"):
        trees.load(str(tmp_path / "a"), ["p", "q"], "v1")
    (tmp_path / "a" / "model.json").write_text(json.dumps(described | {"artifact_sha256": "0"}))
    with pytest.raises(ValueError, match="not the one described"):
        trees.load(str(tmp_path / "a"), ["p", "q"], "v1")
    for name in "bcd":
        trees.save(nodes(own), str(tmp_path / name), ["p"], "v1", limits)
        trees.load(str(tmp_path / name), ["p"], "v1")
    assert trees._loaded.cache_info().currsize == 2


def test_scorer_of_a_folder(tmp_path):
    trees.save(nodes([(0, 0, *LEAF, 0.25)]), str(tmp_path), features.names(), features.VERSION, Thresholds())
    scorer, thresholds = scoring.ensemble(str(tmp_path))
    assert callable(scorer) and thresholds == Thresholds(thresholds.reject, thresholds.accept, thresholds.priority_below)


def test_walk_keeps_columns_and_takes_nulls(spark):
    model = trees.Ensemble(nodes([(0, 0, 1, 0.5, 1, 2, None), (0, 1, *LEAF, 0.1), (0, 2, *LEAF, 0.9)]))
    rows = spark.createDataFrame([(1, 0.0, 0.4), (2, 0.0, 0.6), (3, None, None)], "k int, a double, b double")
    assert sorted(map(tuple, trees.walk(rows, ["a", "b"], model).select("k", "score").collect())) == [(1, 0.1), (2, 0.9), (3, 0.9)]
    assert trees.walk(rows.where("k > 9"), ["a", "b"], model).collect() == []


def test_rounding_equals_pythons(spark):
    rng = random.Random(9)
    numbers = [2.675, 0.125, 0.375, -0.125, -2.675, 1.005, 0.0, -0.0, 1e15 + 0.3, 1e300, 5e-324, 0.5, 1.5, 2.5, -0.5, 1234567.8905, 0.045, 1.0049999999999999]
    numbers += [rng.uniform(-3000, 3000) for _ in range(3000)] + [k / 8 for k in range(-200, 200)] + [k / 100 + 0.005 for k in range(2000)] + [round(rng.uniform(0, 500), 3) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    for digits in (0, 2, 3, 6):
        got = [r[0] for r in df.select(rounded(F.col("v"), digits)).collect()]
        assert got == [float(round(v, digits)) for v in numbers]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(rounded(F.col("v"), 2).cast("string")).collect()
    assert [r[0] for r in odd] == [None, "NaN", "Infinity"]
