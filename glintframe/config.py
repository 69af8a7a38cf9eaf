"""Detector settings, the named profiles, and what follows from them before any row is read."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    # The thresholds of the general and red flash definitions, and of the analysis model.
    swing: float = 0.10
    dark: float = 0.80
    area_fraction: float = 0.25
    flash_limit: float = 3.0
    red_delta: float = 0.2
    red_saturation: float = 0.8
    red_flare: float = 0.0035
    extended: bool = True
    extended_area_ratio: float = 1.0
    extended_hold: float = 1.0
    extended_window: float = 5.0
    extended_coverage: float = 0.8
    warnings: bool = True
    warn_swing: float = 0.08
    warn_area_fraction: float = 0.20
    warn_flash_limit: float = 2.0
    patterns: bool = True
    pattern_pairs: int = 5
    pattern_swing: float = 0.10
    pattern_area: float = 0.25
    pattern_seconds: float = 0.5
    pattern_hold: float = 0.5
    pattern_regularity: float = 2.5
    screen_w: int = 1024
    screen_h: int = 768
    window_w: int = 341
    window_h: int = 256
    scale: float = 0.25
    noise: float = 0.02
    red_noise: float = 0.04
    pool: float = 0.125
    max_gap: float = 5.0
    section_pad: float = 1.5
    section_merge_gap: float = 3.0
    section_min: float = 2.0
    section_max: float = 45.0

    @property
    def k_fail(self) -> int:
        """Flashes within a second that fail."""
        return max(1, math.floor(self.flash_limit) + 1)

    @property
    def k_extended(self) -> int:
        return max(1, math.ceil(self.flash_limit))

    @property
    def k_warn(self) -> int:
        return max(1, math.floor(self.warn_flash_limit) + 1)

    @property
    def warns(self) -> bool:
        return self.warnings and self.k_warn <= self.k_fail and self.warn_swing <= self.swing

    @property
    def context_seconds(self) -> float:
        """Seconds beside a section that its verdict can depend on."""
        return 6.5 if self.extended else 4.5

    @property
    def safe_rate(self) -> float:
        """Pictures a second that can't flash too often: transitions allowed a second, with a margin, to two decimals."""
        pairs = self.k_fail - 1
        if self.extended:
            pairs = min(pairs, self.k_extended - 1)
        return math.floor(2 * pairs / 1.05 * 100) / 100

    def signature(self) -> str:
        """Twelve hex digits that change with any setting a verdict depends on."""
        kept = {k: v for k, v in asdict(self).items() if not k.startswith(("section_", "warn"))}
        return hashlib.sha1(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:12]

    def analysis_size(self, width: int, height: int) -> tuple[int, int]:
        """Frame size of the analysis: fitted into the scaled screen, even, at least 2."""
        fit = min(self.screen_w / width, self.screen_h / height) * self.scale
        return tuple(max(2, round(v * fit / 2) * 2) for v in (width, height))

    def geometry(self, width: int, height: int) -> Geometry:
        ww = min(width, max(2, round(self.window_w * self.scale)))
        wh = min(height, max(2, round(self.window_h * self.scale)))
        xs = sorted({*range(0, width - ww + 1, max(1, ww // 8)), width - ww})
        ys = sorted({*range(0, height - wh + 1, max(1, wh // 8)), height - wh})
        return Geometry(width, height, ww, wh, xs, ys, max(1, round(self.area_fraction * ww * wh)), max(1, round(self.warn_area_fraction * ww * wh)))


@dataclass(frozen=True)
class Geometry:
    """Sliding windows over one frame size, row by row; the last ones lie flush with the edges."""

    width: int
    height: int
    ww: int
    wh: int
    xs: list
    ys: list
    area: int
    warn_area: int

    def box(self, cell: int) -> tuple[int, int, int, int]:
        x, y = self.xs[cell % len(self.xs)], self.ys[cell // len(self.xs)]
        return x, y, x + self.ww, y + self.wh

    def cells(self) -> list[tuple[int, int, int, int, int]]:
        return [(i, *self.box(i)) for i in range(len(self.xs) * len(self.ys))]


PROFILES = {
    "wcag_ext": Config(),
    "wcag": Config(extended=False, patterns=False),
    "strict": Config(swing=0.08, area_fraction=0.20, flash_limit=2.0, extended=False, warnings=False),
}


def profile_name(config: Config) -> str:
    return next((name for name, c in PROFILES.items() if c == config), "custom")


def with_settings(profile: str, **settings) -> Config:
    return replace(PROFILES[profile], **settings)
