import math

import numpy as np
import pytest

from tideline.functions.gamma import chi2_tail, gamma_quantile, gamma_tails, poisson_limits
from tideline.operators import rates


def poisson_cdf(k, mean):
    return sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k + 1))


@pytest.mark.parametrize("x", [1, 2, 10, 137])
def test_limits_cut_the_poisson_tails(x):
    lo, hi = poisson_limits([x])
    assert 1 - poisson_cdf(x - 1, lo[0]) == pytest.approx(0.025, abs=1e-10)
    assert poisson_cdf(x, hi[0]) == pytest.approx(0.025, abs=1e-10)


def test_limits_of_zero_and_fractions():
    lo, hi = poisson_limits([0.0, 2.6])
    assert lo[0] == 0 and hi[0] == pytest.approx(-math.log(0.025))
    assert gamma_tails(2.6, lo[1])[0] == pytest.approx(0.025) and gamma_tails(3.6, hi[1])[1] == pytest.approx(0.025)
    assert [float(v[1]) for v in poisson_limits([0.0, 2.6], floor_events=True)] == pytest.approx(
        [float(v[0]) for v in poisson_limits([2.0])]
    )


@pytest.mark.parametrize("a", [0.05, 0.7, 1.0, 33.3, 999.0, 1001.0, 4e5, 2e7])
@pytest.mark.parametrize("p", [0.001, 0.025, 0.5, 0.975])
def test_quantile_inverts(a, p):
    assert gamma_tails(a, gamma_quantile(p, np.array([a])))[0][0] == pytest.approx(p, rel=1e-8)


def test_density_is_continuous_across_the_series_switch():
    x = np.array([980.0, 1000.0, 1040.0])
    low, high = gamma_tails(1000.0, x)[0], gamma_tails(1000.0 + 1e-9, x)[0]
    assert np.allclose(low, high, rtol=1e-9)


def test_chi2_tail():
    x = np.array([0.1, 3.841458820694124, 50.0, 400.0])
    assert chi2_tail(x, 1) == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in x], rel=1e-10)
    assert chi2_tail(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-10)


def test_rate_limits_without_person_time(spark):
    df = spark.createDataFrame([(3.0, 100.0), (0.0, 0.0), (None, 5.0)], "w_events double, pt double")
    rows = rates.poisson_rate_ci(df).collect()
    assert rows[0]["rate"] == pytest.approx(0.03) and rows[0]["rate_lo"] < 0.03 < rows[0]["rate_hi"]
    assert rows[1]["rate"] is None and rows[1]["rate_hi"] is None
