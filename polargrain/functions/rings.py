"""Ring borders of the grid in closed form.

Rings are ``step`` wide up to the transition and then grow by ``ratio`` from one to the next, so
the border before ring k is a linear term plus a geometric sum; the last border is the outer rim.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Rings:
    inner: float
    outer: float
    step: float
    even: int  # rings of equal width
    grown: int  # rings that grow
    ratio: float

    @classmethod
    def fitted(cls, inner: float, outer: float, step: float, transition: float, ratio: float) -> Rings:
        """As many growing rings as come closest to the rim, and one at least if there is room for any."""
        even = round((transition - inner) / step)
        room = outer - inner - even * step
        if room <= 0 or ratio <= 1:
            return cls(inner, outer, step, even, 0, ratio)
        return cls(inner, outer, step, even, max(1, round(math.log1p(room * (ratio - 1) / step) / math.log(ratio))), ratio)

    def __len__(self) -> int:
        return self.even + self.grown

    def border(self, k: int) -> float:
        """Inner border of ring ``k``; that of one ring too many is the rim."""
        if k == len(self):
            return self.outer
        bent = max(0, k - self.even)
        geometric = math.expm1(bent * math.log(self.ratio)) / (self.ratio - 1) if bent else 0.0
        return self.inner + self.step * (min(k, self.even) + geometric)

    def borders(self) -> list[float]:
        return [self.border(k) for k in range(len(self) + 1)]
