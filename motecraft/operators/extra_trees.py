"""Extremely randomised trees, grown level by level: random cuts, chosen by counts that Spark aggregates.

Each open node draws an order of the features and a place between each one's extremes in the node. The first features
in that order that vary, `max_features` of all at most, offer the cut at that place; the one that separates the weighted
classes best (Gini; the earliest of equals) splits the node, if both sides have `min_leaf` rows or more. Draws depend on
seed, tree and node only, so results don't depend on how rows are spread.

A level takes two aggregations over the rows: the extremes of the open nodes, then the classes left of each cut. Tasks
keep one array a node and merge their batches before the shuffle. Nodes are taken in portions of at most `CELLS` values,
which bounds what tasks hold, what is broadcast, and what returns to the driver, however many rows there are.

Defined cases: null and NaN features go right, and infinite ones count as +-1e300; rows without a label or features are
not used; without any row the call is an error; with one class, or nothing to cut, each tree is one leaf; repeated rows
count each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import COLUMNS, MOST_NODES, Ensemble

#: Values of nodes times features that are worked on at once.
CELLS = 2_000_000
_FAR = 1e300


def draws(seed: int, tree: int, node: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a node tries `n` features, and where between its extremes each one would be cut."""
    rng = np.random.default_rng([seed, tree, node])
    return rng.permutation(n), rng.random(n)


def cuts(low: np.ndarray, high: np.ndarray, seed: int, tree: int, node: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features a node tries and their thresholds, from its extremes."""
    order, share = draws(seed, tree, node, len(low))
    order = order[(low < high)[order]][:most]
    at = low[order] + share[order] * (high[order] - low[order])
    return order, np.where(at < high[order], at, low[order])


def best(left: np.ndarray, total: np.ndarray, weight: np.ndarray, min_leaf: int) -> int | None:
    """The cut that separates best, by the rows of both classes (second axis) left of each cut; None if none may be made."""
    right = total - left
    fits = (left.sum(axis=1) >= min_leaf) & (right.sum(axis=1) >= min_leaf)
    if not fits.any():
        return None
    pure = sum(((side * weight) ** 2).sum(axis=1) / np.maximum((side * weight).sum(axis=1), 1e-300) for side in (left, right))
    return int(np.argmax(np.where(fits, pure, -np.inf)))


class _Tree:
    """Nodes of one tree while it grows."""

    def __init__(self, total: np.ndarray):
        self.feature, self.threshold, self.left, self.total = [-1], [0.0], [0], [total]

    def split(self, node: int, feature: int, threshold: float, left: np.ndarray) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, first
        for total in (left, self.total[node] - left):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(0)
            self.total.append(total)
        return first, first + 1


def _table(grown: list[_Tree], weight: np.ndarray) -> pd.DataFrame:
    parts = []
    for t, tree in enumerate(grown):
        feature, left, total = np.array(tree.feature), np.array(tree.left), np.array(tree.total).reshape(-1, 2)
        inner, mass = feature >= 0, total * weight
        parts.append(
            pd.DataFrame(
                {
                    "tree": t, "node": np.arange(len(feature)), "feature": pd.array(np.where(inner, feature, 0), "Int64"), "threshold": np.where(inner, tree.threshold, np.nan),
                    "left": pd.array(left, "Int64"), "right": pd.array(left + 1, "Int64"), "value": np.where(inner, np.nan, mass[:, 1] / mass.sum(axis=1)), "negatives": total[:, 0], "positives": total[:, 1],
                }
            ).assign(**{c: (lambda d, c=c: d[c].mask(~inner)) for c in ("feature", "left", "right")})
        )
    return pd.concat(parts, ignore_index=True)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.clip(np.array([np.asarray(v, float) for v in values]).reshape(len(values), -1), -_FAR, _FAR)


def _in_nodes(matrix: np.ndarray, model: Ensemble, slots: np.ndarray, only: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree: rows that are in open nodes, ordered by them, where each node begins, and the open nodes."""
    at = slots[model.leaves(matrix)]
    for tree in only:
        order = np.argsort(at[:, tree], kind="stable")
        slot = at[order, tree]
        order, slot = order[slot >= 0], slot[slot >= 0]
        if len(slot):
            begin = np.flatnonzero(np.diff(slot, prepend=-1))
            yield order, begin, slot[begin]


def _extremes(rows: DataFrame, sent, wide: int, n: int) -> pd.DataFrame:
    """The least and greatest value of every feature in each open node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, slots, only, _, _ = sent.value
        low, high, met = np.full((n, wide), np.inf), np.full((n, wide), -np.inf), np.zeros(n, bool)
        for batch in batches:
            matrix = _matrix(batch["values"])
            for order, begin, slot in _in_nodes(matrix, model, slots, only):
                low[slot] = np.fmin(low[slot], np.fmin.reduceat(matrix[order], begin, axis=0))
                high[slot] = np.fmax(high[slot], np.fmax.reduceat(matrix[order], begin, axis=0))
                met[slot] = True
        if len(some := np.flatnonzero(met)):
            yield pd.DataFrame({"slot": some, "low": list(low[some]), "high": list(high[some])})

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": [key[0]], "low": [np.min(np.stack(part["low"].to_list()), axis=0)], "high": [np.max(np.stack(part["high"].to_list()), axis=0)]})

    schema = "slot long, low array<double>, high array<double>"
    return rows.select("values").mapInPandas(run, schema).groupBy("slot").applyInPandas(merge, schema).toPandas()  # at most n rows


def _left(rows: DataFrame, sent, n: int) -> pd.DataFrame:
    """The rows of both classes left of each cut of each open node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, slots, only, feature, threshold = sent.value
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            matrix, label = _matrix(batch["values"]), batch["label"].to_numpy(np.int64)
            for order, begin, slot in _in_nodes(matrix, model, slots, only):
                for here, s in zip(np.split(order, begin[1:]), slot.tolist(), strict=True):
                    under = matrix[here][:, feature[s]] <= threshold[s]
                    positives = under[label[here] == 1].sum(axis=0)
                    found[s] = found.get(s, 0) + np.stack((under.sum(axis=0) - positives, positives))
        if found:
            yield pd.DataFrame({"slot": list(found), "negatives": [v[0].tolist() for v in found.values()], "positives": [v[1].tolist() for v in found.values()]})

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": [key[0]], **{c: [np.sum(np.stack(part[c].to_list()), axis=0).tolist()] for c in ("negatives", "positives")}})

    schema = "slot long, negatives array<long>, positives array<long>"
    return rows.mapInPandas(run, schema).groupBy("slot").applyInPandas(merge, schema).toPandas()  # at most n rows


def grow(rows: DataFrame, values: str = "values", label: str = "label", trees: int = 240, seed: int = 0, min_leaf: int = 3, max_features: float = 0.5, settle: Callable[[DataFrame], DataFrame] = lambda df: df) -> pd.DataFrame:
    """The nodes (`trees.COLUMNS` and the rows of both classes, `negatives` and `positives`) of an ensemble that tells label 1.

    Classes weigh alike in total. `settle` stores what every pass reads.
    """
    used = rows.select(F.col(values).cast("array<double>").alias("values"), (F.col(label).cast("int") == 1).cast("int").alias("label")).dropna()
    used = settle(used)
    first = used.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"), F.min(F.size("values")).alias("least"), F.max(F.size("values")).alias("most")).first()
    if not first["n0"] + first["n1"] or first["least"] != first["most"] or not first["most"]:
        raise ValueError("no rows, or rows of different features, to grow trees from")
    total, wide = np.array([first["n0"], first["n1"]]), first["most"]
    weight = total.sum() / (2.0 * np.maximum(total, 1))
    most = max(1, int(max_features * wide))
    grown = [_Tree(total) for _ in range(trees)]
    may = lambda t, k: grown[t].total[k].sum() >= 2 * min_leaf and grown[t].total[k].min() > 0
    level = [(t, 0) for t in range(trees) if may(t, 0)]
    while level:
        after = []
        table = _table(grown, weight)
        model = Ensemble(table[COLUMNS])  # as many nodes as a model may have, or an error
        starts = np.searchsorted(table["tree"], np.arange(trees))
        portion = max(1, CELLS // wide)
        for i in range(0, len(level), portion):
            nodes = level[i : i + portion]
            after += _split(used, nodes, grown, model, starts, weight, wide, most, seed, min_leaf)
        if sum(len(t.feature) for t in grown) > MOST_NODES:
            raise ValueError("the trees have more nodes than a model may have")
        level = [(t, k) for t, k in after if may(t, k)]
    return _table(grown, weight)


def _split(rows: DataFrame, nodes: list[tuple[int, int]], grown: list[_Tree], model: Ensemble, starts: np.ndarray, weight: np.ndarray, wide: int, most: int, seed: int, min_leaf: int) -> list[tuple[int, int]]:
    """Split what can be split of a portion of open nodes; the new nodes are returned."""
    context = rows.sparkSession.sparkContext
    slots = np.full(len(model.feature), -1)
    slots[[starts[t] + k for t, k in nodes]] = np.arange(len(nodes))
    only = np.unique([t for t, _ in nodes])
    sent = context.broadcast((model, slots, only, None, None))
    feature, threshold = [np.zeros(0, int)] * len(nodes), [np.zeros(0)] * len(nodes)
    for row in _extremes(rows, sent, wide, len(nodes)).itertuples():
        feature[row.slot], threshold[row.slot] = cuts(np.asarray(row.low), np.asarray(row.high), seed, *nodes[row.slot], most)
    sent.destroy()
    sent = context.broadcast((model, slots, only, feature, threshold))
    left = {row.slot: np.stack((row.negatives, row.positives), axis=1) for row in _left(rows, sent, len(nodes)).itertuples()}
    sent.destroy()
    made = []
    for s, (t, k) in enumerate(nodes):
        pick = best(left[s], grown[t].total[k], weight, min_leaf) if len(feature[s]) else None
        if pick is not None:
            made += [(t, child) for child in grown[t].split(k, int(feature[s][pick]), float(threshold[s][pick]), left[s][pick])]
    return made
