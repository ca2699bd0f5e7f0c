"""Extremely randomised trees against a plain version that draws the same cuts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motecraft.operators import extra_trees, trees


def plain(matrix, label, count, seed, min_leaf, share):
    """Rows of both classes of each node, and each inner node's cut, by recursion over row sets in the order of nodes."""
    total = np.array([(label == 0).sum(), (label == 1).sum()])
    weight = len(label) / (2.0 * np.maximum(total, 1))
    out = {}
    for t in range(count):
        sets, k = [np.arange(len(label))], 0
        while k < len(sets):
            here = sets[k]
            n = np.array([(label[here] == 0).sum(), (label[here] == 1).sum()])
            out[t, k] = (None, None, *n.tolist())
            if n.sum() >= 2 * min_leaf and n.min() > 0:
                order, where = extra_trees.draws(seed, t, k, matrix.shape[1])
                tried = []
                for f in order:
                    column = matrix[here, f]
                    known = column[~np.isnan(column)]
                    if len(known) and known.min() < known.max() and len(tried) < max(1, int(share * matrix.shape[1])):
                        at = known.min() + where[f] * (known.max() - known.min())
                        tried.append((f, at if at < known.max() else known.min()))
                best = (-1.0, None)
                for f, at in tried:
                    sides = [here[matrix[here, f] <= at], here[~(matrix[here, f] <= at)]]
                    if min(map(len, sides)) >= min_leaf:
                        mass = [np.array([(label[s] == c).sum() * weight[c] for c in (0, 1)]) for s in sides]
                        pure = sum((m**2).sum() / m.sum() for m in mass)
                        best = max(best, (pure, (f, at, sides)), key=lambda b: b[0])
                if best[1]:
                    f, at, sides = best[1]
                    out[t, k] = (int(f), float(at), *n.tolist())
                    sets += sides
            k += 1
    return out


def got(nodes):
    return {(r.tree, r.node): (None if pd.isna(r.feature) else int(r.feature), None if pd.isna(r.threshold) else r.threshold, r.negatives, r.positives) for r in nodes.itertuples()}


def test_grown_on_events_as_the_plain_version(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 600")
    rows = events.select(F.array(F.col("value"), F.col("user_id").cast("double"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 11), F.lit(1.0)).alias("values"), (F.col("user_id") % 5 < 2).cast("int").alias("label"))
    local = rows.toPandas()
    matrix = np.array([[np.nan if v is None else v for v in r] for r in local["values"]], float)
    nodes = extra_trees.grow(rows.repartition(5), trees=4, seed=9)
    assert got(nodes) == plain(matrix, local["label"].to_numpy(), 4, 9, 3, 0.5)
    leaves = nodes[nodes["feature"].isna()]
    assert (leaves["negatives"] + leaves["positives"] >= 3).all() and (leaves.groupby("tree")[["negatives", "positives"]].sum().sum(axis=1) == len(local)).all()
    model = trees.Ensemble(nodes[trees.COLUMNS])
    reached = np.bincount(model.leaves(matrix).ravel(), minlength=len(nodes))
    assert (reached[nodes["feature"].isna()] == (leaves["negatives"] + leaves["positives"])).all()


def test_portions_do_not_change_trees(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [([float(v) for v in rng.integers(0, 6, 4)], int(rng.random() < 0.4)) for _ in range(200)]
    rows = spark.createDataFrame(data, "values array<double>, label int")
    whole = extra_trees.grow(rows, trees=3, seed=1, max_features=1.0)
    monkeypatch.setattr(extra_trees, "CELLS", 9)
    pd.testing.assert_frame_equal(extra_trees.grow(rows.repartition(3), trees=3, seed=1, max_features=1.0), whole)


def test_odd_rows(spark):
    schema = "values array<double>, label int, slot long"
    one = extra_trees.grow(spark.createDataFrame([([1.0, None], 1, 1)] * 9, schema), trees=2)
    assert one["value"].tolist() == [1.0, 1.0] and len(one) == 2
    mixed = spark.createDataFrame([([1.0, float("inf")], i % 2, 0) for i in range(20)] + [([1.0, -5.0], 1, 0), (None, 1, 0), ([2.0, 2.0], None, 0)], schema)
    assert extra_trees.grow(mixed, trees=1)[["negatives", "positives"]].iloc[0].tolist() == [10, 11]
    for bad in (spark.createDataFrame([], schema), spark.createDataFrame([([1.0], 0, 0), ([1.0, 2.0], 1, 0)], schema)):
        with pytest.raises(ValueError):
            extra_trees.grow(bad, trees=1)
