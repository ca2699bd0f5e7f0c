"""The tree of bright regions of a grey plane, and the regions in it that are stable.

At each level the pixels at least that bright fall into regions (corners connect). Going down, regions grow and merge: a
node is a region at the level where it last changed, its parent the region that it becomes part of.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes from the brightest level down: the darkest level of each, its parent (-1: none), its area and one of its pixels."""

    level: np.ndarray
    parent: np.ndarray
    area: np.ndarray
    pixel: np.ndarray

    def at_level(self, level: int) -> np.ndarray:
        """The nodes that are the regions of pixels of `level` and brighter."""
        below = np.where(self.parent >= 0, self.level[self.parent], -1)
        return np.flatnonzero((self.level >= level) & (below < level))


def _edges(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of pixels that touch by a side or a corner."""
    number = np.arange(shape[0] * shape[1], dtype=np.int64).reshape(shape)
    pairs = [(number[:, :-1], number[:, 1:]), (number[:-1], number[1:]), (number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])]
    return np.concatenate([a.ravel() for a, _ in pairs]), np.concatenate([b.ravel() for _, b in pairs])


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by value, and where each value of a byte begins among them."""
    return np.argsort(values, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(values, minlength=256))))


def component_tree(plane: np.ndarray) -> Tree:
    """Union-find over the pixels of a plane of bytes, a level at a time from the brightest.

    Of each level only the touching pairs whose darker pixel is of that level are united, all at once, so the work over
    all levels is that of the pairs.
    """
    value = np.ascontiguousarray(plane, np.uint8).ravel()
    a, b = _edges(plane.shape)
    edge_order, edge_starts = _by_value(np.minimum(value[a], value[b]))
    pixel_order, pixel_starts = _by_value(value)
    root, area, node = np.arange(len(value)), np.ones(len(value), np.int64), np.full(len(value), -1, np.int64)
    levels, areas, pixels, links, made = [], [], [], [], 0

    def find(x: np.ndarray) -> np.ndarray:
        top = root[x]
        while ((above := root[top]) != top).any():
            root[x] = top = above  # written at once, so that the steps along a chain double
        return top

    for level in range(255, -1, -1):
        own = pixel_order[pixel_starts[level] : pixel_starts[level + 1]]
        if not len(own):
            continue
        pairs = edge_order[edge_starts[level] : edge_starts[level + 1]]
        left, right = find(a[pairs]), find(b[pairs])
        before = np.unique(np.concatenate((own, left, right)))
        while (apart := left != right).any():
            left, right = left[apart], right[apart]  # what is one region stays one
            np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
            left, right = np.split(find(np.concatenate((left, right))), 2)
        after = find(before)
        tops, place = np.unique(after, return_inverse=True)
        total = np.bincount(place, area[before]).astype(np.int64)
        number = made + np.arange(len(tops))
        inner = node[before] >= 0
        links.append((node[before][inner], number[place][inner]))
        area[tops], node[tops] = total, number
        levels.append(np.full(len(tops), level))
        areas.append(total)
        first = np.zeros(len(tops), np.int64)
        first[place[::-1]] = before[::-1]
        pixels.append(first)
        made += len(tops)
    parent = np.full(made, -1, np.int64)
    for child, above in links:
        parent[child] = above
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Tree(joined(levels), parent, joined(areas), joined(pixels))


def variation(tree: Tree, delta: int) -> np.ndarray:
    """How much of each region's area is gained and lost within `delta` levels down and up, the latter along the largest part."""
    n = len(tree.level)
    every = np.arange(n)
    order = np.lexsort((every, tree.area))
    largest = np.full(n, -1, np.int64)
    child = order[tree.parent[order] >= 0]
    largest[tree.parent[child]] = child  # the last one stays, which is the largest
    outer, inner = every.copy(), every.copy()
    for _ in range(delta):
        up, down = tree.parent[outer], largest[inner]
        outer = np.where((up >= 0) & (tree.level[up] >= tree.level - delta), up, outer)
        inner = np.where((down >= 0) & (tree.level[down] <= tree.level + delta), down, inner)
    return (tree.area[outer] - tree.area[inner]) / tree.area


def stable(tree: Tree, delta: int, least: int, most: int, largest_variation: float, diversity: float) -> np.ndarray:
    """Nodes whose variation is a minimum along the tree and small, each differing enough from the stable one around it."""
    change = variation(tree, delta)
    child = np.flatnonzero(tree.parent >= 0)
    lowest = np.full(len(change), np.inf)
    np.minimum.at(lowest, tree.parent[child], change[child])
    above = np.where(tree.parent >= 0, change[tree.parent], np.inf)
    fit = (change <= largest_variation) & (change <= lowest) & ((change == 0) | (change < above)) & (tree.area >= least) & (tree.area <= most)
    kept: set[int] = set()
    for i in np.flatnonzero(fit)[::-1].tolist():  # from the darkest, so that those around come first
        outer = tree.parent[i]
        while outer >= 0 and outer not in kept:
            outer = tree.parent[outer]
        if outer < 0 or tree.area[outer] - tree.area[i] >= diversity * tree.area[outer]:
            kept.add(i)
    return np.array(sorted(kept), np.int64)
