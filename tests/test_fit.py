"""The constrained fit against a dense grid over the feasible shares."""

import numpy as np

from scenfold.functions.fit import INTENSITIES, constrained_mix
from tests.frames import frame


def test_no_worse_than_a_dense_grid(spark):
    rng = np.random.default_rng(7)
    b = np.column_stack([rng.uniform(-2, 14, 400), rng.uniform(-1, 5, 400), rng.uniform(0, 4, 400)])
    df = frame(spark, "b1 double, b2 double, b3 double", *[tuple(map(float, r)) for r in b])
    rows = constrained_mix(df, ["b1", "b2", "b3"]).select("b1", "b2", "b3", "fit.*").collect()

    x2, x3 = np.meshgrid(np.linspace(0, 0.05, 101), np.linspace(0.6, 1, 401))
    keep = x2 + x3 <= 1
    grid = np.column_stack([1 - x2[keep] - x3[keep], x2[keep], x3[keep]])
    for row in rows:
        target = np.array([row["b1"], row["b2"], row["b3"]])
        x = np.array([row["x1"], row["x2"], row["x3"]])
        assert abs(x.sum() - 1) < 1e-12
        assert -1e-12 <= x[0] <= 1 and -1e-12 <= x[1] <= 0.05 + 1e-12 and 0.6 - 1e-12 <= x[2] <= 1 + 1e-12
        best = (((grid @ INTENSITIES.T) - target) ** 2).sum(axis=1).min()
        assert ((INTENSITIES @ x - target) ** 2).sum() <= best + 1e-9


def test_exact_mix_is_recovered_and_missing_is_null(spark):
    x = np.array([0.2, 0.03, 0.77])
    b = tuple(float(v) for v in INTENSITIES @ x)
    df = frame(spark, "b1 double, b2 double, b3 double", b, (1.0, None, 1.0))
    first, second = constrained_mix(df, ["b1", "b2", "b3"]).collect()
    np.testing.assert_allclose([first["fit"][k] for k in ("x1", "x2", "x3")], x, atol=1e-12)
    assert second["fit"] is None


def test_stays_in_generated_code(spark):
    df = frame(spark, "b1 double, b2 double, b3 double", (1.0, 1.0, 1.0))
    plan = constrained_mix(df.repartition(2), ["b1", "b2", "b3"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
