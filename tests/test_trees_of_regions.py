"""The tree of regions against flooding at every level, and what makes regions stable."""

import numpy as np
import pytest

from motecraft.functions import component_tree, pixels
from motecraft.plans import catalog, images


@pytest.mark.parametrize(("shape", "top"), [((9, 13), 6), ((40, 31), 40), ((1, 7), 3), ((25, 25), 256), ((1, 1), 2)])
def test_tree_equals_flooding_at_all_levels(shape, top):
    plane = np.random.default_rng(top).integers(0, top, shape).astype(np.uint8)
    tree = component_tree.component_tree(plane)
    assert (tree.parent < 0).sum() == 1 and (tree.level[tree.parent[tree.parent >= 0]] < tree.level[tree.parent >= 0]).all()
    for level in range(256):
        nodes, found = tree.at_level(level), pixels.regions(plane >= level)
        assert sorted(tree.area[nodes].tolist()) == sorted(found.area.tolist())
        if len(nodes):
            assert np.array_equal(found.area[found.label_at(tree.pixel[nodes] // shape[1], tree.pixel[nodes] % shape[1])], tree.area[nodes])


def test_empty_plane():
    assert len(component_tree.component_tree(np.zeros((0, 4), np.uint8)).level) == 0


def test_a_bright_square_is_stable_once_and_nested_ones_must_differ():
    plane = np.full((60, 60), 20, np.uint8)
    plane[20:40, 20:40] = 200
    tree = component_tree.component_tree(plane)
    assert tree.area[component_tree.stable(tree, 3, 20, 800, 0.45, 0.2)].tolist() == [400]
    plane[24:36, 24:36] = 240  # 144 of 400 pixels: differs enough
    tree = component_tree.component_tree(plane)
    assert sorted(tree.area[component_tree.stable(tree, 3, 20, 800, 0.45, 0.2)].tolist()) == [144, 400]
    plane[21:39, 21:39] = 240  # 324 of 400 pixels: less than a fifth is between them
    tree = component_tree.component_tree(plane)
    assert tree.area[component_tree.stable(tree, 3, 20, 800, 0.45, 0.2)].tolist() == [400]


def test_stable_regions_are_minima_that_differ():
    """By walking the tree node by node: variation from the definition, least along the tree, nested ones a fifth apart."""
    plane = pixels.blur(np.random.default_rng(4).integers(0, 255, (50, 50)).astype(np.float32), 1.5).astype(np.uint8)
    tree = component_tree.component_tree(plane)
    level, parent, area = tree.level.tolist(), tree.parent.tolist(), tree.area.tolist()
    children = {i: [k for k, p in enumerate(parent) if p == i] for i in range(len(level))}

    def change(i):
        outer = inner = i
        while parent[outer] >= 0 and level[parent[outer]] >= level[i] - 3:
            outer = parent[outer]
        while (own := [k for k in children[inner]]) and level[big := max(own, key=lambda k: (area[k], k))] <= level[i] + 3:
            inner = big
        return (area[outer] - area[inner]) / area[i]

    every = [change(i) for i in range(len(level))]
    assert np.allclose(every, component_tree.variation(tree, 3))
    fit = {i for i, v in enumerate(every) if v <= 0.45 and 10 <= area[i] <= 800 and all(v <= every[k] for k in children[i]) and (v == 0 or parent[i] < 0 or v < every[parent[i]])}
    kept = component_tree.stable(tree, 3, 10, 800, 0.45, 0.2).tolist()
    assert kept and set(kept) <= fit
    for i in fit:
        around = parent[i]
        while around >= 0 and around not in kept:
            around = parent[around]
        assert (i in kept) == (around < 0 or area[around] - area[i] >= 0.2 * area[around])


def test_regions_of_pictures_of_the_tables(spark, sf):
    pictures = catalog.grey_pictures(spark, sf).limit(20)
    got = {(r["image_id"], r["level"]) for r in images.region_tree(pictures).collect()}
    assert got == {(p["image_id"], v) for p in pictures.collect() for v in p["data"]}
