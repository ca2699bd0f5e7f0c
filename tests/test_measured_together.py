"""Regions that are measured together have the measures they have alone."""

import numpy as np
import pytest

from motecraft.config import Config
from motecraft.functions import component_tree, pixels
from motecraft.operators import detect
from motecraft.plans.images import formula_image


@pytest.mark.parametrize("image", [formula_image(True), formula_image(dim=True)])
def test_measures_do_not_depend_on_what_is_measured_together(image, monkeypatch):
    cfg, halo = Config(threshold_step=30), Config().tile_padding
    sm, chroma, red = (pixels.mirrored(p, halo) for p in detect.planes(image, cfg))
    found = []
    for together in (1, 7, 512):
        monkeypatch.setattr(detect, "_TOGETHER", together)
        found.append(repr(detect.tile_candidates(sm, chroma, red, cfg, (159 + halo, 159 + halo), halo)))
    assert len(found[0]) > 1000 and len(set(found)) == 1


def test_regions_on_red_or_dark_are_not_measured(monkeypatch):
    cfg, measured = Config(), []
    plane = np.full((60, 60), 30.0, np.float32)
    plane[10:20, 10:20] = plane[10:20, 35:45] = 200
    red = np.zeros((60, 60), bool)
    red[:, 30:] = True
    monkeypatch.setattr(detect, "rims", lambda p, y, x, radii, make=detect.rims: (measured.extend(x), make(p, y, x, radii))[1])
    r, none = pixels.regions(plane > 100), (np.zeros(0, int), np.zeros(0, int))
    rows = detect._measured(r, np.arange(2), plane, plane, plane, red, pixels.distance(red), none, (59, 59), cfg)
    assert [row["x"] for row in rows] == [14.5] and set(measured) == {14.5} and np.isnan(rows[0]["peak_distance"])


def test_a_wide_even_ground_takes_few_steps(monkeypatch):
    """Chains of pixels of one level are shortened while they are followed."""
    steps, same = [], np.array([[7] * 400] * 3, np.uint8)
    monkeypatch.setattr(np, "minimum", type("Minimum", (), {"__call__": staticmethod(np.minimum), "at": staticmethod(lambda *a, at=np.minimum.at: (steps.append(len(a[1])), at(*a))[1])})())
    tree = component_tree.component_tree(same)
    assert tree.area.tolist() == [1200] and sum(steps) < 3 * steps[0] and all(a > b for a, b in zip(steps, steps[1:], strict=False))
