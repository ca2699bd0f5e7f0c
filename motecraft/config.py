"""Parameters of detection and review, with their checks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Fixed default values, for images of about 2448 x 2048 pixels; lengths in pixels, levels 0 to 255."""

    min_area: int = 30
    max_area: int = 800
    min_side: int = 7
    max_side: int = 43
    max_aspect: float = 2.0
    min_extent: float = 0.5
    min_eigen_ratio: float = 0.22
    min_edge: float = 5.0
    min_ring: float = 6.0
    min_green: float = 65.0
    min_chroma: float = -10.0
    nms_distance: float = 11.0
    red_margin: float = 35.0
    red_min_value: float = 130.0
    red_min_area: int = 5
    red_dilation: int = 3
    tile_size: int = 640
    tile_padding: int = 64
    smooth_sigma: float = 1.5
    threshold_step: int = 8
    agreement_distance: float = 9.0
    review_chroma: float = 20.0
    review_ring: float = 20.0
    review_edge: float = 12.0
    review_aspect: float = 1.65
    scale: float = 1.0

    def __post_init__(self) -> None:
        if self.tile_size < 64 or self.tile_padding < 48 or self.threshold_step < 1 or not self.nms_distance > 0:
            raise ValueError("tile_size must be 64 or more, tile_padding 48 or more, threshold_step 1 or more, nms_distance above 0")
        if not (self.scale > 0 and math.isfinite(self.scale)):
            raise ValueError("scale must be positive and finite")

    @classmethod
    def from_json(cls, text: str, scale: float | None = None) -> Config:
        """Overrides as a JSON object; unknown names are an error. `scale` overrides the object's."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        made = cls(**given)
        return made if scale is None else replace(made, scale=scale)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


@dataclass(frozen=True)
class Thresholds:
    """Fixed score thresholds of the decision tables; `priority` defaults to `reject`."""

    reject: float = 0.03235212971268178
    accept: float = 0.9420962146734764
    priority: float | None = 0.25990247557330387

    @property
    def priority_below(self) -> float:
        return self.reject if self.priority is None else self.priority
