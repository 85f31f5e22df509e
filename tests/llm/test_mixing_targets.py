"""Rates on skewed, soft and unattainable domains."""

import numpy as np
import pytest

from larkspur.llm.mixing import Fit, newton, rates_of, solve, sums_at


def soft(shares, blur, n=4000, seed=3):
    """Token counts as weights, and posteriors of domains with these shares that keep ``blur`` for the others."""
    rng = np.random.default_rng(seed)
    k = len(shares)
    domain = np.repeat(np.arange(k), np.maximum(1, np.round(np.array(shares) * n).astype(int)))
    p = np.full((len(domain), k), blur / (k - 1)) * rng.uniform(0.5, 1.5, (len(domain), k))
    p[np.arange(len(domain)), domain] = 1 - blur
    return rng.integers(50, 500, len(domain)), p / p.sum(1, keepdims=True)


@pytest.mark.parametrize("shares", [(0.61, 0.16, 0.15, 0.09), (0.9, 0.06, 0.03, 0.01), (0.7, 0.28, 0.018, 0.002), (0.97, 0.02, 0.008, 0.002)])
def test_skewed_domains_meet_their_targets(spark, shares):
    tokens, p = soft(shares, 0.02)
    held = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "n_tokens bigint, posteriors array<double>").repartition(3)
    gap, step = solve(held, np.full(4, 0.25))
    got = (rates_of(p, gap, step) * tokens / tokens.sum()) @ p
    assert np.abs(got - 0.25).max() < 2.5e-3 and np.allclose(got - 0.25, gap, atol=2e-6)


@pytest.mark.parametrize("blur", [0.02, 0.4, 0.7])
@pytest.mark.parametrize("targets", [(0.25,) * 4, (0.0, 0.0, 0.1, 0.9), (0.0, 0.0, 0.0, 1.0)])
def test_rates_are_optimal(blur, targets):
    tokens, p = soft((0.9, 0.06, 0.03, 0.01), blur)
    w, fit = tokens / tokens.sum(), Fit()
    gap = newton(lambda points: sums_at(w, p, points), np.array(targets), fit)
    rates = rates_of(p, gap, 1 / fit.solve_ridge)
    slope = p @ ((rates * w) @ p - targets) + fit.solve_ridge * (rates - 1)
    assert np.abs(np.where(rates > 0, slope, np.minimum(slope, 0))).max() <= fit.optimal


def test_a_gap_is_told_and_unfinished_rounds_fail(spark):
    held = spark.createDataFrame([(10, [0.6, 0.4])] * 5, "n_tokens bigint, posteriors array<double>")
    with pytest.warns(UserWarning, match="from its target"):
        gap, _ = solve(held, np.array([0.0, 1.0]))
    assert np.abs(gap).max() > 0.3
    with pytest.raises(RuntimeError, match="not optimal"):
        solve(held, np.array([0.0, 1.0]), Fit(solve_rounds=1))
