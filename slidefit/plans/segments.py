"""Windows: an interval of offsets [a, b], either side infinite, with weights gamma^(j - delta)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FORWARD, BACKWARD = ("fw", "forward"), ("bw", "backward")


@dataclass(frozen=True)
class Segment:
    """Forward windows grow towards the anchor (gamma = g/(g-1)), backward ones decay from it (gamma = (g-1)/g).

    g counts the samples that weigh in effectively and must exceed 1; gamma may be given instead. Infinite sides are
    allowed where the weights vanish.
    """

    a: float
    b: float
    direction: str
    g: float | None = None
    delta: int = 0
    gamma: float | None = field(default=None)
    label: str | None = None

    def __post_init__(self):
        if self.direction not in FORWARD + BACKWARD:
            raise ValueError(f"direction must be fw or bw, found {self.direction!r}")
        object.__setattr__(self, "direction", "fw" if self.direction in FORWARD else "bw")
        for v in (self.a, self.b):
            if np.isfinite(v) and v != int(v):
                raise TypeError("boundaries are whole numbers or infinite")
        if not self.a < self.b:
            raise ValueError(f"a < b isn't fulfilled: {self.a}, {self.b}")
        if (self.g is None) == (self.gamma is None):
            raise ValueError("give g or gamma")
        if self.gamma is None:
            if not self.g > 1:
                raise ValueError("g must exceed 1")
            object.__setattr__(self, "gamma", self.g / (self.g - 1) if self.direction == "fw" else (self.g - 1) / self.g)
        else:
            object.__setattr__(self, "g", float("inf") if self.gamma == 1 else max(1 / abs(1 - self.gamma), self.gamma / abs(1 - self.gamma)))
        if self.a == -np.inf and not self.gamma > 1 or self.b == np.inf and not self.gamma < 1:
            raise ValueError("weights don't vanish towards the infinite side")

    def weight(self, j) -> np.ndarray:
        return np.power(float(self.gamma), np.asarray(j, float) - self.delta)

    def ab_range(self, thd: float = 1e-6) -> tuple[int, int]:
        """Finite boundaries: an infinite side ends where the weight, relative to 1, falls under thd."""
        a, b = self.a, self.b
        if a == -np.inf:
            a = min(int(np.floor(np.log(thd) / np.log(self.gamma))) + self.delta, b - 1)
        if b == np.inf:
            b = max(int(np.ceil(np.log(thd) / np.log(self.gamma))) + self.delta, a + 1)
        return int(a), int(b)

    def window(self, thd: float = 1e-6) -> tuple[range, np.ndarray]:
        """Offsets and their weights."""
        a, b = self.ab_range(thd)
        return range(a, b + 1), self.weight(np.arange(a, b + 1))

    def __str__(self) -> str:
        return f"Segment(a={self.a}, b={self.b}, direction={self.direction}, g={self.g:g}, delta={self.delta}, label={self.label})"
