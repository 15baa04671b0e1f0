"""FIT-1: the steel technology mix as an exact constrained least-squares fit.

Per row: shares ``x`` of (BF-BOF, NG DRI-EAF, Scrap EAF) minimising ``|A x - b|^2`` with
``sum x = 1``, ``0 <= x1 <= 1``, ``0 <= x2 <= 0.05``, ``0.6 <= x3 <= 1``, where ``b`` holds the
observed intensities of coal, gas and electricity.

Eliminating ``x1 = 1 - x2 - x3`` leaves a convex quadratic ``y'Hy + 2g'y`` in ``y = (x2, x3)`` over
a quadrilateral. ``H`` is constant and only ``g`` depends on the row, so the optimum is the
unconstrained minimum when that is feasible and otherwise the best of the four edge minima. The
fit is three projections of column arithmetic: each intermediate is computed once per row, the
expressions stay small enough for generated code, and no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Energy intensity per technology. Rows coal, gas, electricity.
TECHNOLOGIES = ("BF-BOF", "NG DRI-EAF", "Scrap EAF")
CARRIERS = ("COAL", "GAS", "ELEC")
INTENSITIES = np.array([[15.3, 0.0, 0.6], [1.1, 12.9, 1.7], [1.0, 3.6, 2.3]])

# Share bounds of the second and third technology.
X2_MAX = 0.05
X3_MIN = 0.6

#: Corners of the feasible (x2, x3) region, in order around it.
VERTICES = np.array([[0.0, X3_MIN], [X2_MAX, X3_MIN], [X2_MAX, 1.0 - X2_MAX], [0.0, 1.0]])


def _linear(weights: Sequence[float], columns: Sequence[Column], constant: float = 0.0) -> Column:
    terms = [c * F.lit(float(w)) for w, c in zip(weights, columns)]
    return sum(terms[1:], terms[0]) + F.lit(float(constant))


def constrained_mix(df: DataFrame, observed: Sequence[str], name: str = "fit") -> DataFrame:
    """Add the fitted shares as a struct ``(x1, x2, x3)``.

    ``observed`` names the coal, gas and electricity intensities; the struct is NULL where one of
    them is missing.
    """
    a1 = INTENSITIES[:, 0]
    m = INTENSITIES[:, 1:] - a1[:, None]
    h = m.T @ m
    b = [F.col(c) for c in observed]
    # g = M'(A1 - b), NULL as soon as one intensity is.
    gradient = {f"__g{j}": _linear(-m[:, j], b, m[:, j] @ a1) for j in range(2)}

    g = [F.col("__g0"), F.col("__g1")]
    free = -np.linalg.inv(h)
    steps = {"__y2": _linear(free[0], g), "__y3": _linear(free[1], g)}
    edges = list(zip(VERTICES, np.roll(VERTICES, -1, axis=0) - VERTICES))
    for i, (p, d) in enumerate(edges):
        # Along p + s d the objective falls fastest at s = -slope / curvature.
        steps[f"__slope{i}"] = _linear(d, g, d @ h @ p)

    def point(objective: Column, y2: Column, y3: Column) -> Column:
        return F.struct(
            objective.alias("objective"),
            (F.lit(1.0) - y2 - y3).alias("x1"), y2.alias("x2"), y3.alias("x3"),
        )

    candidates = []
    lengths = {}
    for i, (p, d) in enumerate(edges):
        slope, curvature = F.col(f"__slope{i}"), float(d @ h @ d)
        lengths[f"__s{i}"] = F.least(F.greatest(-slope / curvature, F.lit(0.0)), F.lit(1.0))
        s = F.col(f"__s{i}")
        objective = _linear(2 * p, g, p @ h @ p) + s * (slope * 2.0 + s * curvature)
        candidates.append(point(objective, s * float(d[0]) + float(p[0]), s * float(d[1]) + float(p[1])))

    y2, y3 = F.col("__y2"), F.col("__y3")
    feasible = (y2 >= 0.0) & (y2 <= X2_MAX) & (y3 >= X3_MIN) & (y2 + y3 <= 1.0)
    best = F.when(feasible, point(F.lit(0.0), y2, y3)).otherwise(F.array_min(F.array(*candidates)))
    # greatest and least skip NULLs, so rows with a missing intensity are masked here.
    fit = F.when(g[0].isNotNull() & g[1].isNotNull(), best)
    return (
        df.withColumns(gradient)
        .withColumns(steps)
        .withColumns(lengths)
        .withColumn(name, fit)
        .drop(*gradient, *steps, *lengths)
    )
