"""The mixing fit reaches the targets, or the least-squares optimum where they cannot be met."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.llm import mixing

DOMAINS, TARGETS = ["high", "low", "toxic"], {"high": 0.85, "low": 0.10, "toxic": 0.05}


def fitted(spark, p):
    t = np.random.default_rng(2).integers(20, 2000, len(p)).astype(float)
    rows = [(float(n), *map(float, x)) for n, x in zip(t, p, strict=True)]
    features = spark.createDataFrame(rows, "_tokens double, _p0 double, _p1 double, _p2 double").repartition(4).persist()
    steps = mixing.fit_rates(features, DOMAINS, TARGETS)
    found = np.array(features.select("_tokens", "_p0", "_p1", "_p2", mixing._rate(steps, 3)).collect())
    return found[:, 0], found[:, 1:4], found[:, 4]


@pytest.mark.parametrize("shape", [(1, 1, 1), (0.3, 2.07, 0.63)])
def test_soft_posteriors_meet_the_targets(spark, shape):
    t, p, r = fitted(spark, np.random.default_rng(1).dirichlet(shape, 5000))
    assert (r >= 0).all() and (r == 0).any()
    assert np.allclose((t * r) @ p / t.sum(), [0.85, 0.10, 0.05], atol=1e-6)


def test_targets_out_of_reach_end_at_the_optimum(spark):
    p = 0.2 + 0.4 * np.random.default_rng(1).dirichlet((1, 1, 1), 3000)
    with pytest.warns(UserWarning, match="do not meet"):
        t, p, r = fitted(spark, p)
    gram = (p * t[:, None]).T @ p / t.sum()
    slope = p @ np.linalg.solve(gram, (t * r) @ p / t.sum() - [0.85, 0.10, 0.05])
    assert slope.min() >= -1e-3 and abs((t * r) @ slope) / t.sum() <= 1e-3
