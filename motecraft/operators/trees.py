"""Ensembles of decision trees as tables of nodes: portable, checked, and walked for whole batches.

A node has a `feature` to compare and a `threshold`: values up to it, and NaN never, go `left`, others `right`. A node
without a feature is a leaf with a `value`. Each tree begins at node 0. A score is the mean of the leaves that the trees
lead to. A model is a folder: `nodes.parquet`, and `model.json` that describes it.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from motecraft.config import Thresholds

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double"
COLUMNS = [c.split()[0] for c in NODES.split(", ")]
#: Nodes a model may have: it is sent to every executor.
MOST_NODES = 5_000_000


class Ensemble:
    """The nodes of all trees in arrays, children as places in them."""

    def __init__(self, nodes: pd.DataFrame):
        missing = set(COLUMNS) - set(nodes.columns)
        if missing or not len(nodes) or len(nodes) > MOST_NODES:
            raise ValueError(f"not a table of nodes: {sorted(missing) or len(nodes)}")
        nodes = nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        key = nodes["tree"].to_numpy(np.int64) << 32 | nodes["node"].to_numpy(np.int64)
        if (np.diff(key) <= 0).any():
            raise ValueError("a node is there twice")
        self.feature = nodes["feature"].astype(float).fillna(-1).to_numpy(np.int64)
        self.inner = self.feature >= 0
        self.threshold, self.value = nodes["threshold"].to_numpy(float), nodes["value"].to_numpy(float)
        self.children = np.zeros((len(nodes), 2), np.int64)
        for side, name in enumerate(("left", "right")):
            wanted = (key >> 32 << 32) | nodes[name].astype(float).fillna(0).to_numpy(np.int64)
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            if (self.inner & ((key[place] != wanted) | (wanted <= key))).any():
                raise ValueError("a child is missing, or stands before its parent")
            self.children[:, side] = place
        self.roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
        if len(self.roots) != nodes["tree"].nunique():
            raise ValueError("a tree has no first node")
        if not np.isfinite(self.threshold[self.inner]).all() or not np.isfinite(self.value[~self.inner]).all():
            raise ValueError("a threshold or a leaf's value is not a number")

    def leaves(self, matrix: np.ndarray) -> np.ndarray:
        """The place of the leaf that each row (first axis) reaches in each tree; all trees go down together."""
        at = np.tile(self.roots, (len(matrix), 1))
        row = np.arange(len(matrix))[:, None]
        while (going := self.inner[at]).any():
            left = matrix[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(going, self.children[at, np.where(left, 0, 1)], at)
        return at

    def scores(self, matrix: np.ndarray, rows: int = 4096) -> np.ndarray:
        if self.inner.any() and matrix.shape[1] <= self.feature.max():
            raise ValueError("the model was made for more features")
        parts = [self.value[self.leaves(matrix[i : i + rows])].mean(axis=1) for i in range(0, len(matrix), rows)]
        return np.concatenate(parts) if parts else np.zeros(0)


def walk(rows: DataFrame, features: list[str], ensemble: Ensemble, score: str = "score") -> DataFrame:
    """`rows` with the ensemble's score of their `features`; null features count as NaN."""
    sent = rows.sparkSession.sparkContext.broadcast(ensemble)
    scorer = F.pandas_udf(lambda *columns: pd.Series(sent.value.scores(np.column_stack([c.to_numpy(float) for c in columns]))), DoubleType())
    return rows.withColumn(score, scorer(*[F.col(f"`{c}`").cast("double") for c in features]))


def _read_nodes(folder: Path, metadata: dict) -> Ensemble:
    data = (folder / "nodes.parquet").read_bytes()
    if hashlib.sha256(data).hexdigest() != metadata["artifact_sha256"]:
        raise ValueError("the model file is not the one described")
    return Ensemble(pd.read_parquet(folder / "nodes.parquet"))


#: Readers of models by the beginning of their version.
READERS: dict[str, Callable[[Path, dict], Ensemble]] = {"nodes-1": _read_nodes}


def save(nodes: pd.DataFrame, folder: str, feature_names: list[str], feature_version: str, thresholds: Thresholds, version: str = "nodes-1.0") -> None:
    """Write a model that `load` reads; its nodes are checked first."""
    Ensemble(nodes)
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    nodes[COLUMNS].to_parquet(path / "nodes.parquet", index=False)
    given = {"reject_below": thresholds.reject, "accept_at_least": thresholds.accept, "review_priority_below": thresholds.priority_below}
    metadata = {"model_version": version, "feature_version": feature_version, "feature_names": list(feature_names), "thresholds": given, "artifact_sha256": hashlib.sha256((path / "nodes.parquet").read_bytes()).hexdigest()}
    (path / "model.json").write_text(json.dumps(metadata, indent=1), "utf-8")


@functools.lru_cache(maxsize=2)
def _loaded(folder: str, stamps: tuple[int, ...]) -> tuple[Ensemble, dict]:
    path = Path(folder)
    metadata = json.loads((path / "model.json").read_text("utf-8"))
    version = str(metadata.get("model_version", ""))
    reader = next((read for start, read in READERS.items() if version.startswith(start)), None)
    if reader is None:
        raise ValueError(f"no reader for models of version {version!r}")
    return reader(path, metadata), metadata


def load(folder: str, feature_names: list[str], feature_version: str) -> tuple[Ensemble, Thresholds, dict]:
    """A model, its thresholds and what describes it, if it was made for these features. The last two models stay in memory until their files change."""
    path = Path(folder).resolve()
    model, metadata = _loaded(str(path), tuple((path / f).stat().st_mtime_ns for f in ("model.json", "nodes.parquet")))
    if metadata["feature_version"] != feature_version or list(metadata["feature_names"]) != list(feature_names):
        raise ValueError("the model was made for other features")
    t = metadata["thresholds"]
    return model, Thresholds(t["reject_below"], t["accept_at_least"], t.get("review_priority_below")), metadata
