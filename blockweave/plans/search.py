"""A step length along a direction, for fits whose points may be vectors or tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Trial points of one search; a search that uses them all returns the best step it saw.
TRIALS = 25


def wolfe_step(at: Callable[[float], tuple], value: float, descent: float, step: float, trials: int = TRIALS) -> tuple | None:
    """A step with enough decrease and enough flattening, by bracketing and bisection.

    ``at(step)`` is (value, slope along the direction, anything else); the result for the step found is returned,
    None if no trial point was lower. ``descent`` is the slope along the direction at the start.
    """
    low, high = 0.0, np.inf
    best = None
    for _ in range(trials):
        result = at(step)
        if not np.isfinite(result[0]) or result[0] > value + 1e-4 * step * descent:
            high = step
        else:
            best = result
            if result[1] >= 0.9 * descent:
                return best
            low = step
        step = 2.0 * step if np.isinf(high) else (low + high) / 2.0
    return best
