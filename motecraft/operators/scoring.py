"""Scores of points: given, computed by a function over features, or by a model fitted with Spark ML.

No trained model is part of this library. A scorer takes images and points and returns the points with `score`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motecraft.config import Thresholds
from motecraft.operators import extra_trees, features, trees


class Scorer(Protocol):
    def __call__(self, images: DataFrame, points: DataFrame) -> DataFrame: ...


def given(scores: DataFrame) -> Scorer:
    """Scores from a table (image_id, id, score)."""
    return lambda images, points: points.join(scores.select("image_id", "id", "score"), ["image_id", "id"], "left")


def by_function(f: Callable[[np.ndarray], np.ndarray], feature_names: list[str] | None = None, scale: float = 1.0) -> Scorer:
    """Probabilities of a function of the feature matrix, for instance a loaded classifier's; one call a batch.

    `feature_names`, if given, must equal the library's names in order.
    """
    if feature_names is not None and list(feature_names) != features.names():
        raise ValueError("the model was made for other features")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["image_id", "id"]].assign(score=np.asarray(f(np.vstack(batch["values"].to_numpy())), float))

    def scorer(images: DataFrame, points: DataFrame) -> DataFrame:
        made = features.extract(images, points.select("image_id", "id", "x", "y"), scale).mapInPandas(run, "image_id string, id int, score double")
        return points.join(made, ["image_id", "id"], "left")

    return scorer


def ensemble(folder: str, scale: float = 1.0) -> tuple[Scorer, Thresholds]:
    """The scorer of a model of trees in a folder, and its own thresholds."""
    model, thresholds, _ = trees.load(folder, features.names(), features.VERSION)
    return by_function(model.scores, features.names(), scale), thresholds


def fitted(labelled: DataFrame, folder: str, thresholds: Thresholds, count: int = 240, seed: int = 0, scale: float = 1.0, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> Scorer:
    """Extremely randomised trees grown on `values` and `label` of labelled points, saved in `folder`, as a scorer.

    Leaves hold three points or more, half the features are tried at each cut, and both classes weigh alike.
    """
    nodes = extra_trees.grow(labelled, trees=count, seed=seed, min_leaf=3, max_features=0.5, settle=settle)
    trees.save(nodes, folder, features.names(), features.VERSION, thresholds)
    return ensemble(folder, scale)[0]


def checked_artifact(path: str, metadata: dict, feature_version: str = features.VERSION) -> tuple[bytes, Thresholds]:
    """A model file's bytes and thresholds, after its hash, features and feature version are found as in `metadata`.

    Keys: `artifact_sha256`, `feature_names`, `feature_version`, `thresholds` (reject_below, accept_at_least and, if it
    differs from the first, review_priority_below). `feature_version` is what the caller takes these features to be. The
    bytes are for a loader of the caller's.
    """
    data = Path(path).read_bytes()
    if hashlib.sha256(data).hexdigest() != metadata["artifact_sha256"]:
        raise ValueError("the model file is not the one described")
    if metadata["feature_version"] != feature_version or list(metadata["feature_names"]) != features.names():
        raise ValueError("the model was made for other features")
    t = metadata["thresholds"]
    return data, Thresholds(t["reject_below"], t["accept_at_least"], t.get("review_priority_below"))


def forest(labelled: DataFrame, trees: int = 240, seed: int = 1, scale: float = 1.0) -> Scorer:
    """A random forest fitted on `values` and `label` of labelled points.

    Its cuts are searched, not drawn; `fitted` grows extremely randomised trees.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = lambda df: df.withColumn("features", array_to_vector(F.col("values").cast("array<double>")))
    model = RandomForestClassifier(labelCol="label", numTrees=trees, minInstancesPerNode=3, featureSubsetStrategy="0.5", seed=seed).fit(vector(labelled))

    def scorer(images: DataFrame, points: DataFrame) -> DataFrame:
        made = model.transform(vector(features.extract(images, points.select("image_id", "id", "x", "y"), scale)))
        return points.join(made.select("image_id", "id", vector_to_array("probability")[1].alias("score")), ["image_id", "id"], "left")

    return scorer
