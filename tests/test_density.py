"""The kernel density against kernels summed over all rows."""

import math
import random

import numpy as np
import pytest

from riskgrain.operators.profile import density_curve


def plain_curve(values, points, cut):
    x = np.array(sorted(values))
    q1, q3 = np.quantile(x, [0.25, 0.75])
    spread = min(x.std(ddof=1), (q3 - q1) / 1.349) if q3 > q1 else x.std(ddof=1)
    h = 1.059 * spread / len(x) ** 0.2
    at = np.linspace(x[0] - cut * h, x[-1] + cut * h, points)
    return at, np.exp(-((at[:, None] - x) / h) ** 2 / 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


@pytest.mark.parametrize("shape", ["normal", "ties", "outlier", "no quartile distance"])
def test_density(spark, shape):
    rng = random.Random(4)
    values = {
        "normal": [rng.gauss(3, 2) for _ in range(500)], "ties": [float(rng.randrange(5)) for _ in range(400)],
        "outlier": [rng.random() for _ in range(200)] + [500.0], "no quartile distance": [1.0] * 90 + [2.0, 7.0],
    }[shape]
    table = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    for fine in (256, 8):
        found = sorted(map(tuple, density_curve(table, "v", 60, fine=fine).collect()))
        at, want, h = plain_curve(values, 60, 3.0)
        assert [f[0] for f in found] == list(range(60)) and np.allclose([f[1] for f in found], at)
        # the stated error of the cells: a share of a kernel's height
        height = 1 / (h * math.sqrt(2 * math.pi))
        assert np.abs(np.array([f[2] for f in found]) - want).max() <= height / (8 * fine ** 2) + 1e-9 * height


def test_no_density(spark):
    for rows in ([], [(1.0,)], [(2.0,)] * 5, [(None,)]):
        assert density_curve(spark.createDataFrame(rows, "v double"), "v").count() == 0
