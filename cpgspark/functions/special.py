"""Probability tails in NumPy, and the same as pandas UDFs.

Undefined inputs give NaN here and null in Spark.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = np.finfo(float).tiny
_erfc = np.frompyfunc(math.erfc, 1, 1)
_inverse = NormalDist().inv_cdf
_quantile = np.frompyfunc(lambda p: _inverse(p) if 0 < p < 1 else (-math.inf if p == 0 else math.inf if p == 1 else math.nan), 1, 1)


def log_gamma(x) -> np.ndarray:
    """For positive x: shifted to 8 or more, then Stirling's series."""
    x = np.asarray(x, float)
    small = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        small = np.where(low, small + np.log(np.where(low, z, 1)), small)
        z = np.where(low, z + 1, z)
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - small


def normal_sf(x) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(np.asarray(x, float) / math.sqrt(2)), float)


def normal_isf(p) -> np.ndarray:
    return -np.asarray(_quantile(np.asarray(p, float)), float)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    ok = (z > 0) & (z < 1) & (p > 0) & (q > 0)
    zz, pp, qq = np.where(ok, z, 0.5), np.where(ok, p, 1.0), np.where(ok, q, 1.0)
    front = np.exp(log_gamma(pp + qq) - log_gamma(pp) - log_gamma(qq) + pp * np.log(zz) + qq * np.log1p(-zz)) / pp
    tiny = 1e-300
    c = np.ones_like(zz)
    d = 1 - (pp + qq) * zz / (pp + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (qq - m) * zz / ((pp + 2 * m - 1) * (pp + 2 * m)), -(pp + m) * (pp + qq + m) * zz / ((pp + 2 * m) * (pp + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    inner = front * h
    edge = np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan)))
    return np.where(ok, np.where(swap, 1 - inner, inner), edge)


def gamma_q(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    zero = x <= 0
    xx = np.where(zero, 1.0, x)
    front = np.exp(-xx + a * np.log(xx) - log_gamma(a))
    term = 1 / a
    total = term.copy()
    for k in range(1, 600):
        term = term * xx / (a + k)
        total = total + term
    series = 1 - front * total
    tiny = 1e-300
    b = xx + 1 - a
    c = np.full(a.shape, 1 / tiny)
    d = 1 / np.where(b == 0, tiny, b)
    h = d.copy()
    for k in range(1, 600):
        num = -k * (k - a)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
    out = np.where(zero, 1.0, np.where(xx < a + 1, series, front * h))
    return np.where(np.isnan(x), np.nan, out)


def chi2_sf(x, df=1) -> np.ndarray:
    x = np.asarray(x, float)
    if np.isscalar(df) and df == 1:
        return np.asarray(_erfc(np.sqrt(np.maximum(x, 0) / 2)), float)
    return gamma_q(np.asarray(df, float) / 2, x / 2)


def f_sf(x, d1, d2) -> np.ndarray:
    x = np.maximum(np.asarray(x, float), 0)
    return beta_inc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * x))


def t_sf2(t, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_isf2(p, df) -> np.ndarray:
    """The t whose two-sided tail is p, by bisection."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.zeros(p.shape), np.full(p.shape, 1e10)
    for _ in range(200):
        mid = np.where(hi > 2 * lo + 1, np.sqrt((lo + 1e-3) * hi), (lo + hi) / 2)
        above = t_sf2(mid, df) > p
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(np.isnan(p) | np.isnan(df), np.nan, (lo + hi) / 2)


def binom_sf(k, n, p) -> np.ndarray:
    """P(X >= k)."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inside = (k > 0) & (k <= n)
    v = beta_inc(np.where(inside, k, 1.0), np.where(inside, n - k + 1, 1.0), p)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, v))


#: Cells of a block of tables: tables at once times the counts that the largest can have.
CELLS = 1 << 20


def fisher_two_sided(ma, ua, mb, ub) -> np.ndarray:
    """Sum of the probabilities of tables not likelier than the observed (equal ones within rounding); 1 on a degenerate margin, NaN without a row."""
    tables = np.stack([np.asarray(v, np.int64) for v in (ma, ua, mb, ub)])
    distinct, back = np.unique(tables, axis=1, return_inverse=True)
    a, b, c, d = distinct
    ra, rb, m, n = a + b, c + d, a + c, a + b + c + d
    out = np.where((ra == 0) | (rb == 0), np.nan, 1.0)
    open_ = np.flatnonzero((ra > 0) & (rb > 0) & (m > 0) & (m < n))
    lo, hi = np.maximum(0, m - rb), np.minimum(ra, m)
    open_ = open_[np.argsort((hi - lo)[open_], kind="stable")]  # blocks of tables of like widths
    most = int(n[open_].max()) if len(open_) else 0
    if most < 1 << 22:  # the logarithms of all factorials needed
        known = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most + 1)))))
        factorial = lambda v: known[v]
    else:
        factorial = lambda v: log_gamma(v + 1.0)
    at = 0
    while at < len(open_):
        end = at + 1
        while end < len(open_) and (end + 1 - at) * (hi - lo + 1)[open_[end]] <= CELLS:
            end += 1
        k = open_[at:end]
        x = lo[k, None] + np.arange(int((hi - lo)[k[-1]]) + 1)
        real = x <= hi[k, None]
        x = np.minimum(x, hi[k, None])
        top, right, col, all_ = ra[k, None], rb[k, None], m[k, None], n[k, None]
        log_p = factorial(top) - factorial(x) - factorial(top - x) + factorial(right) - factorial(col - x) - factorial(right - col + x) - factorial(all_) + factorial(col) + factorial(all_ - col)
        pmf = np.where(real, np.exp(log_p), 0)
        seen = np.take_along_axis(pmf, (a[k] - lo[k])[:, None], 1)
        out[k] = np.minimum(1.0, np.where(pmf <= seen * (1 + 1e-7) + 1e-15, pmf, 0).sum(axis=1))
        at = end
    return out[np.ravel(back)]


def noncentral_t_sf(t: float, df: float, shift: float) -> float:
    """P(T > t) by quadrature over the scale."""
    s = np.linspace(1e-6, 1 + 12 / math.sqrt(2 * df) if df > 1 else 8.0, 20001)
    log_f = math.log(2) + (df / 2) * math.log(df / 2) - float(log_gamma(df / 2)) + (df - 1) * np.log(s) - df * s * s / 2
    y = np.exp(log_f) * normal_sf(t * s - shift)
    return float(np.trapezoid(y, s))


def _udf(fn):
    """Series functions of one, two and three doubles."""

    def one(a: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float)))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float), b.to_numpy(float)))

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(fn(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)))

    return {1: one, 2: two, 3: three}


def _clean(fn, n: int):
    f = F.pandas_udf(_udf(fn)[n], DoubleType())
    return lambda *cols: F.nanvl(f(*cols), F.lit(None).cast("double"))


chi2_sf_col = _clean(chi2_sf, 1)
chi2k_sf_col = _clean(chi2_sf, 2)
normal_sf_col = _clean(normal_sf, 1)
normal_isf_col = _clean(normal_isf, 1)
t_sf2_col = _clean(t_sf2, 2)
t_isf2_col = _clean(t_isf2, 2)
f_sf_col = _clean(f_sf, 3)
binom_sf_col = _clean(binom_sf, 3)


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(a, b, c, d))


def fisher_col(*cols):
    return F.nanvl(F.pandas_udf(_fisher, DoubleType())(*cols), F.lit(None).cast("double"))
