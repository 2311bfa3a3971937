"""Windows over the position axis: smoothing, neighbours, imputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import normal_isf_col, normal_sf_col


def box_smooth(store: DataFrame, span_bp: int = 500) -> DataFrame:
    """Counts replaced by their means over the rows within span // 2 bases of the sample; coverage keeps being the sum."""
    h = span_bp // 2
    w = Window.partitionBy("sample", "chrom").orderBy("pos").rangeBetween(-h, h)
    out = store.withColumns({"_m": F.avg("N_meth").over(w), "_c": F.avg("coverage").over(w)})
    return out.withColumns({"N_meth": F.col("_m"), "coverage": F.col("_c"), "N_unmeth": F.col("_c") - F.col("_m")}).drop("_m", "_c")


def neighbour_scores(rows: DataFrame, bp: int = 200, z: str = "z", diff: str = "meth_diff") -> DataFrame:
    """Adds n_neighbours, the sum of the scores and the share of the focal sign within +-bp; rows without z don't count."""
    w = Window.partitionBy("chrom").orderBy("pos").rangeBetween(-bp, bp)
    up = F.when(F.col(z).isNotNull(), F.when(F.col(diff) >= 0, 1).otherwise(0))
    s = rows.withColumn("_up", up)
    s = s.withColumns({"n_neighbours": F.count(z).over(w), "z_sum": F.sum(z).over(w), "_ups": F.sum("_up").over(w)})
    share = F.when(F.col("_up") == 1, F.col("_ups")).otherwise(F.col("n_neighbours") - F.col("_ups")) / F.col("n_neighbours")
    return s.withColumn("sign_share", F.when(F.col(z).isNotNull(), share)).drop("_up", "_ups")


def combine_neighbours(rows: DataFrame, bp: int = 200, p: str = "pvalue", diff: str = "meth_diff", out: str = "pvalue_combined", min_share: float = 0.6, focal: float = 0.5) -> DataFrame:
    """Signed Stouffer over the neighbourhood; applied where enough neighbours share the focal sign and the focal p is below `focal`, and never above the raw p."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-300)), F.lit(1 - 1e-12))
    usable = F.col(p).isNotNull() & F.col(diff).isNotNull()
    s = rows.withColumn("_z", F.when(usable, F.when(F.col(diff) >= 0, 1.0).otherwise(-1.0) * normal_isf_col(clipped / 2)))
    s = neighbour_scores(s, bp, "_z", diff)
    both = 2 * normal_sf_col(F.abs("z_sum") / F.sqrt("n_neighbours"))
    apply = usable & (F.col("sign_share") >= min_share) & (F.col(p) < focal)
    return s.withColumn(out, F.when(apply, F.least(p, both)).otherwise(F.col(p))).drop("_z", "z_sum", "sign_share")


# ---- kernels over one sample's chromosome -----------------------------------


#: Elements of a block's matrix: sites at once times the sites of their windows.
CELLS = 1 << 21


def _blocks(lo: np.ndarray, hi: np.ndarray):
    """Consecutive ranges (i, j, s, e) of rows whose windows lie in [s, e), of at most CELLS cells but for single rows; lo and hi ascend."""
    i = 0
    while i < len(lo):
        j, step = i + 1, 1024
        while j < len(lo) and step:
            k = min(j + step, len(lo))
            if (k - i) * max(int(hi[k - 1]) - int(lo[i]), 1) <= CELLS:
                j = k
            else:
                step //= 2
        yield i, j, int(lo[i]), int(hi[j - 1])
        i = j


def gaussian_beta(pos: np.ndarray, beta: np.ndarray, cov: np.ndarray, bandwidth: float, at: np.ndarray | None = None) -> np.ndarray:
    """Coverage-weighted Gaussian mean of beta at `at` (ascending; the sites if None), cut off at four bandwidths."""
    at = (pos if at is None else at).astype(float)
    ok = np.isfinite(beta) & (cov > 0)
    x, b, c = pos[ok].astype(float), beta[ok], cov[ok].astype(float)
    lo, hi = np.searchsorted(x, at - 4 * bandwidth), np.searchsorted(x, at + 4 * bandwidth, side="right")
    out = np.full(len(at), np.nan)
    for i, j, s, e in _blocks(lo, hi):
        away = x[None, s:e] - at[i:j, None]
        w = np.where(np.abs(away) <= 4 * bandwidth, np.exp(-0.5 * (away / bandwidth) ** 2), 0) * c[None, s:e]
        total = w.sum(axis=1)
        out[i:j] = np.where(total > 0, (w @ b[s:e]) / np.where(total > 0, total, 1), np.nan)
    return out


def grid_gaussian(pos: np.ndarray, beta: np.ndarray, cov: np.ndarray, bandwidth: float, step: float) -> np.ndarray:
    """Smoothed on a regular grid and brought back to the sites by linear interpolation."""
    if len(pos) < 2:
        return beta.copy()
    grid = np.arange(pos[0], pos[-1] + step, step, dtype=float)
    g = gaussian_beta(pos, beta, cov, bandwidth, grid)
    ok = np.isfinite(g)
    return np.interp(pos, grid[ok], g[ok]) if ok.any() else np.full(len(pos), np.nan)


def local_polynomial(pos: np.ndarray, beta: np.ndarray, cov: np.ndarray, ns: int = 70, h_bp: float = 1000, degree: int = 2) -> np.ndarray:
    """Weighted local polynomial: the window has at least `ns` sites and half-width `h_bp`; tricube times coverage; cut to [0, 1]."""
    ok = np.isfinite(beta) & (cov > 0)
    x, b, c = pos[ok].astype(float), beta[ok], cov[ok].astype(float)
    out = np.full(len(pos), np.nan)
    n, need = len(x), min(ns, len(x))
    if n == 0:
        return out
    at = pos.astype(float)
    # the distance that holds `need` sites: among as many before and behind
    k = np.searchsorted(x, at)
    h = np.empty(len(at))
    for i in range(0, len(at), max(1, CELLS // (2 * need))):
        near = k[i : i + max(1, CELLS // (2 * need)), None] + np.arange(-need, need)
        away = np.where((near >= 0) & (near < n), np.abs(x[np.clip(near, 0, n - 1)] - at[i : i + len(near), None]), np.inf)
        h[i : i + len(near)] = np.partition(away, need - 1, axis=1)[:, need - 1]
    h = np.maximum(h_bp, h) * (1 + 1e-9)
    lo, hi = np.searchsorted(x, at - h), np.searchsorted(x, at + h, side="right")
    powers = np.arange(2 * degree + 1)
    for i, j, s, e in _blocks(np.minimum.accumulate(lo[::-1])[::-1], np.maximum.accumulate(hi)):
        u = (x[None, s:e] - at[i:j, None]) / h[i:j, None]
        w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0) * c[None, s:e]
        u = np.where(w > 0, u, 0)
        up = [w * u**q for q in powers]
        moments = np.stack([v.sum(axis=1) for v in up], axis=1)
        right = np.stack([v @ b[s:e] for v in up[: degree + 1]], axis=1)
        points = (w > 0).sum(axis=1)
        for d in range(degree + 1):
            own = np.flatnonzero(np.clip(points - 1, 0, degree) == d)
            if len(own):
                a = moments[own][:, powers[: d + 1, None] + powers[None, : d + 1]]
                coef = np.einsum("sij,sj->si", np.linalg.pinv(a, hermitian=True), right[own, : d + 1])
                out[i + own] = np.clip(coef[:, 0], 0, 1)
    return out


def knn_impute(pos: np.ndarray, beta: np.ndarray, k: int = 5, max_bp: float = 10_000) -> np.ndarray:
    """Missing betas from the k nearest sites with one, weighted by 1 / (distance + 1), none farther than max_bp."""
    have, gaps = np.flatnonzero(np.isfinite(beta)), np.flatnonzero(~np.isfinite(beta))
    out = beta.copy()
    if not len(have):
        return out
    x = pos[have].astype(float)
    for i in range(0, len(gaps), max(1, CELLS // (2 * k))):
        own = gaps[i : i + max(1, CELLS // (2 * k))]
        near = np.searchsorted(x, pos[own])[:, None] + np.arange(-k, k)
        there = (near >= 0) & (near < len(x))
        near = np.clip(near, 0, len(x) - 1)
        away = np.where(there, np.abs(x[near] - pos[own, None]), np.inf)
        first = np.argsort(away, axis=1, kind="stable")[:, :k]
        away, near = np.take_along_axis(away, first, 1), np.take_along_axis(near, first, 1)
        w = np.where(away <= max_bp, 1 / (away + 1), 0)
        total = w.sum(axis=1)
        out[own] = np.where(total > 0, (w * beta[have[near]]).sum(axis=1) / np.where(total > 0, total, 1), np.nan)
    return out


def _by_track(store: DataFrame, fn, schema: str) -> DataFrame:
    """fn on each sample's chromosome, rows by position."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values("pos", kind="stable"))

    return store.select("sample", "chrom", "pos", "N_meth", "coverage").groupBy("sample", "chrom").applyInPandas(run, schema)


def _beta(pdf: pd.DataFrame) -> np.ndarray:
    c = pdf["coverage"].to_numpy(float)
    return np.where(c > 0, pdf["N_meth"].to_numpy(float) / np.where(c > 0, c, 1), np.nan)


SMOOTHED = "sample string, chrom string, pos int, beta_raw double, beta_smooth double"


def smooth(store: DataFrame, method: str = "gaussian", bandwidth: float = 1000, step: float | None = None, ns: int = 70, h_bp: float = 1000, degree: int = 2, min_sites: int = 3) -> DataFrame:
    """Smoothed betas by sample and chromosome; fewer than `min_sites` sites stay as they are."""
    if method not in ("gaussian", "bsmooth"):
        raise ValueError("method is gaussian or bsmooth")

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, cov, raw = pdf["pos"].to_numpy(), pdf["coverage"].to_numpy(float), _beta(pdf)
        if len(pos) < min_sites:
            s = raw
        elif method == "bsmooth":
            s = local_polynomial(pos, raw, cov, ns, h_bp, degree)
        else:
            s = grid_gaussian(pos, raw, cov, bandwidth, step or bandwidth / 10)
        return pdf[["sample", "chrom", "pos"]].assign(beta_raw=raw, beta_smooth=s)

    return _by_track(store, track, SMOOTHED)


def impute(store: DataFrame, sites: DataFrame, samples: list[str], k: int = 5, max_bp: float = 10_000) -> DataFrame:
    """Every sample at every site: beta, observed or from its neighbours, and whether it was imputed."""
    from ..sources.store import aligned

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = _beta(pdf)
        full = knn_impute(pdf["pos"].to_numpy(), raw, k, max_bp)
        return pdf[["sample", "chrom", "pos"]].assign(beta=full, imputed=~np.isfinite(raw) & np.isfinite(full))

    return _by_track(aligned(store, sites, samples), track, "sample string, chrom string, pos int, beta double, imputed boolean")
