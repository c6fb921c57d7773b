"""The interpolating cubic spline: a fixed linear map for given knots."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=256)
def knot_weights(knots: tuple[float, ...], points: tuple[float, ...]) -> np.ndarray:
    """(points, knots): the spline's value at a point is the weighted sum of the values at ``knots``.

    ``knots`` ascend, at any distances. The third derivative is continuous at the first and last
    inner knots (not-a-knot ends), so polynomials of degree 3 come out as they are; three knots
    give the parabola, two the line, one its value. Points outside the knots have weights NaN.
    """
    x, at = np.array(knots), np.array(points)
    n = len(x)
    if n < 4:
        made = np.stack([np.prod([(at - x[j]) / (x[i] - x[j]) for j in range(n) if j != i] or [np.ones(len(at))], axis=0) for i in range(n)], axis=1) if n else np.zeros((len(at), 0))
    else:
        step = np.diff(x)
        bend, right = np.zeros((n, n)), np.zeros((n, n))
        for i in range(1, n - 1):
            a, b = step[i - 1], step[i]
            bend[i, i - 1 : i + 2] = a, 2 * (a + b), b
            right[i, i - 1 : i + 2] = 6 / a, -6 / a - 6 / b, 6 / b
        bend[0, :3] = step[1], -step[0] - step[1], step[0]
        bend[-1, -3:] = step[-1], -step[-2] - step[-1], step[-2]
        second = np.linalg.solve(bend, right)
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        h = step[i][:, None]
        t = (at - x[i])[:, None] / h
        unit = np.eye(n)
        made = (1 - t) * unit[i] + t * unit[i + 1] + h**2 / 6 * (((1 - t) ** 3 - (1 - t)) * second[i] + (t**3 - t) * second[i + 1])
    if n:
        made[(at < x[0]) | (at > x[-1])] = np.nan
    return made


def grid(knots: int = 12, points: int = 300) -> np.ndarray:
    return np.linspace(1, knots, points)


def weights(knots: int = 12, points: int = 300) -> np.ndarray:
    """The map for knots 1 to ``knots`` and points evenly spaced over them."""
    return knot_weights(tuple(map(float, range(1, knots + 1))), tuple(grid(knots, points).tolist()))


def curve(x: Sequence[float], y: Sequence[float], points: tuple[float, ...]) -> list[float | None]:
    """The spline through (x, y), x ascending, at ``points``; None outside of x."""
    if not len(x):
        return [None] * len(points)
    made = knot_weights(tuple(x), points) @ np.array(y, dtype=float)
    return [None if np.isnan(v) else float(v) for v in made]


def curve_through(points: tuple[float, ...]) -> Callable[..., Column]:
    """A function of two columns of arrays, x ascending and y: the spline's values at ``points`` as an array."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([curve(a, b, points) for a, b in zip(x, y, strict=True)])

    return run
