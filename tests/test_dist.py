"""Distribution functions against tabulated values."""

import math

import pytest

from insightspark.functions import dist as D


@pytest.mark.parametrize("got, want", [
    (D.norm_cdf(1.96), 0.9750021048517795), (D.norm_ppf(0.975), 1.959963984540054), (D.norm_ppf(0.8), 0.8416212335729143), (D.norm_sf2(1.96), 0.04999579029644087),
    (D.t_ppf(0.975, 10), 2.2281388519649385), (D.t_ppf(0.95, 5), 2.015048373333023), (D.t_sf2(2.2281388519649385, 10), 0.05), (D.t_sf2(1.0, 1), 0.5),
    (D.chi2_sf(3.841458820694124, 1), 0.05), (D.chi2_sf(18.307038053275146, 10), 0.05), (D.chi2_sf(2.0, 2), math.exp(-1)),
    (D.f_sf(4.964602743730711, 1, 10), 0.05), (D.f_sf(3.325834530413011, 5, 10), 0.05), (D.beta_inc(2, 3, 0.5), 0.6875),
])
def test_tabulated(got, want):
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_limits():
    assert D.norm_ppf(0) is None and D.norm_ppf(1) is None
    assert D.t_sf2(1.0, 0) is None
    assert D.f_sf(0, 2, 3) == 1.0
    assert D.chi2_sf(0, 3) == 1.0


def test_relations():
    for t, df in [(0.3, 3), (2.5, 7), (5.0, 30)]:
        assert D.f_sf(t * t, 1, df) == pytest.approx(D.t_sf2(t, df), rel=1e-10)
    assert D.t_sf2(1.7, 1e7) == pytest.approx(D.norm_sf2(1.7), rel=1e-5)
