"""Minimising a smooth function of a bounded number of parameters, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MEMORY = 8


def minimize(
    loss_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]],
    theta: np.ndarray,
    iterations: int,
    tolerance: float = 1e-7,
) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    loss, slope = loss_and_slope(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        step, scales = -slope, []
        for moved, bent in reversed(past):
            scales.append((moved @ step) / (moved @ bent))
            step = step - scales[-1] * bent
        if past:
            moved, bent = past[-1]
            step = step * ((moved @ bent) / (bent @ bent))
        for (moved, bent), scale in zip(past, reversed(scales), strict=True):
            step = step + (scale - (bent @ step) / (moved @ bent)) * moved
        size = 1.0
        while size > 1e-8:
            new = theta + size * step
            new_loss, new_slope = loss_and_slope(new)
            if new_loss <= loss + 1e-4 * size * (slope @ step):
                break
            size /= 2
        else:
            break
        if (new - theta) @ (new_slope - slope) > 1e-12:
            past = [*past[1 - MEMORY :], (new - theta, new_slope - slope)]
        gained = loss - new_loss
        theta, loss, slope = new, new_loss, new_slope
        if gained < tolerance:
            break
    return theta
