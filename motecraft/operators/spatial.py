"""Joins and suppression by distance between points, as equi-joins on bins.

A grid of bins as wide as the radius puts all points within the radius of a probe into its own bin or the eight around
it. The build side is written out once for each of its nine bins, so that the probe keeps one row and the join is an
equi-join with a residual test, which Spark can shuffle, sort, and split when one bin is crowded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    return F.floor(x / width), F.floor(y / width)


def squared_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def _build(points: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """The build side: `b_*` columns, one row for each bin from which a point can be seen."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    bx, by = bins(F.col("x"), F.col("y"), width)
    seen = points.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("x").alias("b_x"), F.col("y").alias("b_y"), bx.alias("bin_x"), by.alias("bin_y"), F.explode(around).alias("step"))
    return seen.select(*[f"b_{k}" for k in keys], "b_x", "b_y", (F.col("bin_x") + F.col("step.i")).alias("b_bin_x"), (F.col("bin_y") + F.col("step.j")).alias("b_bin_y"))


def _condition(keys: Sequence[str], width: float, within: Column) -> Column:
    px, py = bins(F.col("x"), F.col("y"), width)
    met = (px == F.col("b_bin_x")) & (py == F.col("b_bin_y")) & within
    for k in keys:
        met = met & (F.col(k) == F.col(f"b_{k}"))
    return met


def _within(radius: float, strict: bool) -> Column:
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
    return d2 < radius * radius if strict else d2 <= radius * radius


def near(points: DataFrame, others: DataFrame, radius: float, keys: Sequence[str] = ("image_id",), strict: bool = False) -> DataFrame:
    """Rows of `points` that have one of `others` within the radius (semi-join)."""
    return points.join(_build(others, keys, radius), _condition(keys, radius, _within(radius, strict)), "left_semi")


def far(points: DataFrame, others: DataFrame, radius: float, keys: Sequence[str] = ("image_id",), strict: bool = True) -> DataFrame:
    """Rows of `points` that have none of `others` within the radius (anti-join)."""
    return points.join(_build(others, keys, radius), _condition(keys, radius, _within(radius, strict)), "left_anti")


def nearest(points: DataFrame, others: DataFrame, radius: float, keys: Sequence[str] = ("image_id",), row: str = "id") -> DataFrame:
    """`keys`, `row` and `distance` to the nearest of `others` within the radius; null where there is none."""
    joined = points.join(_build(others, keys, radius), _condition(keys, radius, _within(radius, False)), "left")
    d2 = squared_distance(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
    return joined.groupBy(*keys, row).agg(F.sqrt(F.min(d2)).alias("distance"))


def suppress_fold(points: DataFrame, distance: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Greedy suppression as one fold per group, for small groups: rank descending, then `seq`; strictly nearer falls."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("order"), "seq", "x", "y")))
    groups = points.groupBy(*keys).agg(order.alias("rows"))
    kind = "array<struct<order:double,seq:bigint,x:double,y:double>>"

    def step(kept: Column, row: Column) -> Column:
        hit = F.exists(kept, lambda k: squared_distance(k["x"], k["y"], row["x"], row["y"]) < distance * distance)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(row)))

    kept = groups.select(*keys, F.explode(F.aggregate(F.col("rows").cast(kind), F.array().cast(kind), step)).alias("row"))
    return kept.select(*keys, F.col("row.seq").alias("seq"))


def _pairs_within(x: np.ndarray, y: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs strictly nearer than `distance`, each once: strips as wide as that, sorted by y."""
    strip = np.floor(x / distance)
    found = [np.empty((2, 0), int)]
    for s in np.unique(strip):
        own = np.flatnonzero(strip == s)
        for others in (own, np.flatnonzero(strip == s + 1)):
            others = others[np.argsort(y[others], kind="stable")]
            first, end = np.searchsorted(y[others], y[own] - distance), np.searchsorted(y[others], y[own] + distance, "right")
            n = end - first
            a = np.repeat(own, n)
            b = others[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)]
            near = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 < distance**2
            found.append(np.stack([a, b])[:, near & ((strip[a] != strip[b]) | (a < b))])
    a, b = np.concatenate(found, axis=1)
    return a, b


def greedy(x: np.ndarray, y: np.ndarray, rank: np.ndarray, seq: np.ndarray, distance: float) -> np.ndarray:
    """Positions kept, in the order of keeping: in rounds, what outranks all its open neighbours stays and closes them."""
    place = np.empty(len(x), int)
    place[np.lexsort((seq, -rank))] = np.arange(len(x))
    a, b = _pairs_within(x, y, distance)
    better, worse = np.where(place[a] < place[b], (a, b), (b, a))
    is_open, kept = np.ones(len(x), bool), np.zeros(len(x), bool)
    while is_open.any():
        live = is_open[better] & is_open[worse]
        better, worse = better[live], worse[live]
        top = is_open.copy()
        top[worse] = False
        kept |= top
        is_open &= ~top
        is_open[worse[top[better]]] = False
    return np.flatnonzero(kept)[np.argsort(place[kept])]


def suppress(points: DataFrame, distance: float, keys: Sequence[str] = ("image_id",), out: str = "kept_order") -> DataFrame:
    """Greedy suppression for large groups; all columns and `out`, the order of keeping within the group."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields if f.name != out)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = greedy(*(group[c].to_numpy() for c in ("x", "y", "rank", "seq")), distance)
        return group.iloc[at].assign(**{out: np.arange(len(at))})

    return points.drop(out).groupBy(*keys).applyInPandas(run, f"{schema}, {out} long")


def suppress_rounds(points: DataFrame, distance: float, keys: Sequence[str] = ("image_id",), settle=lambda df: df.checkpoint()) -> DataFrame:
    """The same rows without any group in one task: keep what outranks all around it, drop its neighbours, repeat.

    For point sets where one group is too large for a task. `settle` cuts the lineage between rounds.
    """
    columns = [*keys, "seq", "x", "y", "rank"]
    open_ = settle(points.select(*columns))
    kept = None
    while not open_.isEmpty():
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        bx, by = bins(F.col("x"), F.col("y"), distance)
        wide = open_.select(*[F.col(c).alias(f"b_{c}") for c in columns], bx.alias("bx"), by.alias("by"), F.explode(around).alias("step"))
        wide = wide.withColumn("b_bin_x", F.col("bx") + F.col("step.i")).withColumn("b_bin_y", F.col("by") + F.col("step.j"))
        stronger = (F.col("b_rank") > F.col("rank")) | ((F.col("b_rank") == F.col("rank")) & (F.col("b_seq") < F.col("seq")))
        top = settle(open_.join(wide, _condition(keys, distance, _within(distance, True) & stronger), "left_anti"))
        kept = top if kept is None else kept.unionByName(top)
        open_ = settle(far(open_.join(top.select(*keys, "seq"), [*keys, "seq"], "left_anti"), top, distance, keys))
    return points.where("false").select(*keys, "seq") if kept is None else kept.select(*keys, "seq")


def reading_order(keys: Sequence[str] = ("image_id",), band: float = 35.0, tie: str = "seq") -> Window:
    """Rows of the page by bands of y (half-even), then x; ties in the order of `tie`."""
    return Window.partitionBy(*keys).orderBy(F.bround(F.col("y") / band), "x", tie)


def numbered(points: DataFrame, keys: Sequence[str] = ("image_id",), after: DataFrame | None = None, tie: str = "seq", out: str = "id") -> DataFrame:
    """Numbers 1.. in reading order; with `after`, continued from its largest id in the same group."""
    ranked = points.withColumn(out, F.row_number().over(reading_order(keys, tie=tie)))
    if after is None:
        return ranked
    last = after.groupBy(*keys).agg(F.max(out).alias("last_id"))
    return ranked.join(last, list(keys), "left").withColumn(out, (F.col(out) + F.coalesce("last_id", F.lit(0))).cast("int")).drop("last_id")
