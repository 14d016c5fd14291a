"""Rates at the optimum, also where a domain is rare."""

import numpy as np
import pytest

from millrace.llm import mixing


@pytest.mark.parametrize("held", [(0.97, 0.028, 0.002), (0.99, 0.0095, 0.0005), (0.95, 0.04, 0.01), (0.2, 0.3, 0.5)])
def test_rates_are_optimal(spark, held):
    rng = np.random.default_rng(7)
    p = rng.dirichlet(np.ones(3), 3000) * 0.02 + 0.98 * np.eye(3)[rng.choice(3, 3000, p=held)]
    tokens = rng.integers(1, 2000, 3000)
    mix = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p, strict=True)], "tokens long, p_clean double, p_low double, p_toxic double")
    y = mixing.fit_rates(mix, mixing.TARGETS)
    rate = np.array([r["rate"] for r in mix.select(mixing._rate(y).alias("rate"), "tokens").collect()])
    # The optimum's conditions, from the rates alone: no gradient where a rate is positive, none below zero elsewhere.
    residual = (rate * tokens) @ p / tokens.sum() - np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    slope = p @ residual + mixing.RIDGE * (rate - 1)
    assert (rate >= 0).all() and np.abs(slope[rate > 0]).max() < 1e-7 and slope.min() > -1e-7


def test_unfinished_fit_is_an_error(spark, monkeypatch):
    mix = spark.createDataFrame([(10, 0.9, 0.05, 0.05), (10, 0.2, 0.7, 0.1)], "tokens long, p_clean double, p_low double, p_toxic double")
    monkeypatch.setattr(mixing, "MAX_STEPS", 0)
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(mix, mixing.TARGETS)
