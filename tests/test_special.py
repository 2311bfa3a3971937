"""Tails against the mathematics library of the JVM and closed forms."""

import numpy as np
import pytest

from cpgspark.functions import special as sp


def test_tails_against_jvm(spark):
    m = spark.sparkContext._jvm.org.apache.commons.math3
    for x in (0.1, 1.0, 5.0, 30.0):
        assert sp.chi2_sf(x) == pytest.approx(1 - m.distribution.ChiSquaredDistribution(1.0).cumulativeProbability(x), rel=1e-6, abs=1e-13)
        assert sp.chi2_sf(x, 4) == pytest.approx(1 - m.distribution.ChiSquaredDistribution(4.0).cumulativeProbability(x), rel=1e-6, abs=1e-12)
        assert sp.f_sf(x, 1, 50.0) == pytest.approx(1 - m.distribution.FDistribution(1.0, 50.0).cumulativeProbability(x), rel=1e-6, abs=1e-12)
        assert sp.t_sf2(x, 7.0) == pytest.approx(2 * m.distribution.TDistribution(7.0).cumulativeProbability(-x), rel=1e-6, abs=1e-12)
    for k, n, p in ((0, 10, 0.2), (3, 10, 0.2), (10, 10, 0.5)):
        assert sp.binom_sf(k, n, p) == pytest.approx(1 - m.distribution.BinomialDistribution(n, p).cumulativeProbability(k - 1), abs=1e-10)
    assert sp.log_gamma(np.array([0.5, 3.3, 100.0])) == pytest.approx([m.special.Gamma.logGamma(v) for v in (0.5, 3.3, 100.0)], rel=1e-12)


def test_quantiles_invert():
    p = np.array([1e-12, 0.01, 0.05, 0.5])
    assert sp.normal_sf(sp.normal_isf(p)) == pytest.approx(p, rel=1e-9)
    assert sp.t_sf2(sp.t_isf2(p[1:], 9.0), 9.0) == pytest.approx(p[1:], rel=1e-8)


def test_fisher():
    assert sp.fisher_two_sided([3], [1], [1], [3])[0] == pytest.approx(34 / 70)
    assert np.isnan(sp.fisher_two_sided([0], [0], [1], [3])[0])
    assert sp.fisher_two_sided([0], [4], [0], [3])[0] == 1.0


def test_noncentral_t_is_central_without_shift():
    assert sp.noncentral_t_sf(2.0, 10, 0.0) == pytest.approx(sp.t_sf2(2.0, 10.0) / 2, rel=1e-4)
