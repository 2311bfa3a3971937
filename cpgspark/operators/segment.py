"""Hidden Markov segmentation of one track at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fdr import adjust_by_chrom
from .regions import stouffer_columns, stouffer_p
from .smooth import _beta, _by_track, gaussian_beta


def transition(n: int, self_loop: float = 0.99, given: np.ndarray | None = None) -> np.ndarray:
    """Row-normalised transitions: sticky, or a matrix of one's own."""
    if given is not None:
        t = np.asarray(given, float)
        return t / t.sum(axis=1, keepdims=True)
    if n == 1:
        return np.ones((1, 1))
    t = np.full((n, n), (1 - self_loop) / (n - 1))
    np.fill_diagonal(t, self_loop)
    return t


def log_emission(x: np.ndarray, means: np.ndarray, kind: str = "bernoulli", sd: float = 0.1) -> np.ndarray:
    """Log likelihood of each observation in each state; the same in all for missing ones."""
    x, m = np.asarray(x, float)[:, None], np.asarray(means, float)[None, :]
    if kind == "bernoulli":
        m = np.clip(m, 1e-6, 1 - 1e-6)
        e = x * np.log(m) + (1 - x) * np.log(1 - m)
    elif kind == "gaussian":
        e = -0.5 * ((x - m) / sd) ** 2 - np.log(sd)
    else:
        raise ValueError("emission is bernoulli or gaussian")
    return np.where(np.isfinite(x), e, 0.0)


def viterbi(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest path from a uniform start."""
    n, k = emission.shape
    if n == 0:
        return np.zeros(0, int)
    logt = np.log(np.maximum(trans, 1e-300))
    best = emission[0] - np.log(k)
    back = np.zeros((n, k), np.int32)
    for i in range(1, n):
        s = best[:, None] + logt
        back[i] = s.argmax(axis=0)
        best = s.max(axis=0) + emission[i]
    path = np.empty(n, int)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def posteriors(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """State probabilities by forward and backward sums, scaled at each step."""
    n, k = emission.shape
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    f, b = np.empty((n, k)), np.ones((n, k))
    f[0] = e[0] / e[0].sum()
    for i in range(1, n):
        f[i] = (f[i - 1] @ trans) * e[i]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = trans @ (e[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = f * b
    return p / p.sum(axis=1, keepdims=True)


def segment(x: np.ndarray, means: list[float], self_loop: float = 0.99, emission: str = "bernoulli", sd: float = 0.1, trans: np.ndarray | None = None) -> np.ndarray:
    return viterbi(log_emission(x, np.array(means), emission, sd), transition(len(means), self_loop, trans))


def state_runs(path: np.ndarray, state: int) -> list[tuple[int, int]]:
    """Half-open index ranges in which the path is in a state."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (path == state).astype(np.int8), [0]))))
    return [*zip(edge[::2].tolist(), edge[1::2].tolist())]


def runs_of_state(rows: DataFrame, state: int, keys: list[str] = ["sample", "chrom"]) -> DataFrame:
    """The same over a table with a `state` column: start, end (last position + 1), n."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("pos")
    r = rows.withColumn("_id", F.row_number().over(w) - F.sum(F.when(F.col("state") == state, 1).otherwise(0)).over(w)).filter(F.col("state") == state)
    return r.groupBy(*keys, "_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n")).drop("_id")


def states(store: DataFrame, means: list[float], self_loop: float = 0.99, emission: str = "bernoulli", sd: float = 0.1, min_sites: int = 5) -> DataFrame:
    """The state of every site of each sample's chromosome."""

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_sites:
            return pdf[["sample", "chrom", "pos"]].iloc[:0].assign(state=pd.Series(dtype="int32"), beta=pd.Series(dtype=float))
        b = _beta(pdf)
        return pdf[["sample", "chrom", "pos"]].assign(state=segment(b, means, self_loop, emission, sd), beta=b)

    return _by_track(store, track, "sample string, chrom string, pos int, state int, beta double")


SEGMENTS = "sample string, chrom string, start int, end int, n_cpgs int, mean_beta double"


def _segments(pdf: pd.DataFrame, runs: list[tuple[int, int]], values: list[float]) -> pd.DataFrame:
    pos = pdf["pos"].to_numpy()
    first = pdf[["sample", "chrom"]].iloc[0] if len(pdf) else {"sample": None, "chrom": None}
    rows = [(first["sample"], first["chrom"], int(pos[a]), int(pos[b - 1]) + 1, b - a, v) for (a, b), v in zip(runs, values)]
    out = pd.DataFrame(rows, columns=["sample", "chrom", "start", "end", "n_cpgs", "mean_beta"])
    return out.astype({"sample": object, "chrom": object, "start": "int32", "end": "int32", "n_cpgs": "int32", "mean_beta": float})


def pmd(store: DataFrame, bandwidth_bp: float = 10_000, threshold: float = 0.55, min_bp: int = 100_000, self_loop: float = 0.999, min_sites: int = 10) -> DataFrame:
    """Partially methylated domains: the low state of the smoothed track, at least min_bp long; beta weighted by coverage."""

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_sites:
            return _segments(pdf, [], [])
        c = pdf["coverage"].to_numpy(float)
        b, pos = _beta(pdf), pdf["pos"].to_numpy()
        s = gaussian_beta(pos, b, c, bandwidth_bp)
        path = segment(s, [threshold / 2, min(threshold + 0.25, 0.95)], self_loop)
        runs = [(i, j) for i, j in state_runs(path, 0) if pos[j - 1] + 1 - pos[i] >= min_bp]
        return _segments(pdf, runs, [float(np.nansum(np.where(np.isfinite(b[i:j]), b[i:j], 0) * c[i:j]) / max(c[i:j].sum(), 1e-300)) for i, j in runs])

    return _by_track(store, track, SEGMENTS)


def hmr(store: DataFrame, threshold: float = 0.3, max_density: float = 0.02, min_cpgs: int = 4, self_loop: float = 0.85) -> DataFrame:
    """Hypomethylated runs of at least min_cpgs sites with a mean beta below the threshold; kind is LMR where sites are sparse, else HMR."""

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 5:
            return _segments(pdf, [], []).assign(kind=pd.Series(dtype=object))
        b, pos = _beta(pdf), pdf["pos"].to_numpy()
        path = segment(b, [threshold / 2, min(threshold + 0.4, 0.95)], self_loop)
        runs = [(i, j) for i, j in state_runs(path, 0) if j - i >= min_cpgs and np.isfinite(b[i:j]).any() and np.nanmean(b[i:j]) < threshold]
        out = _segments(pdf, runs, [float(np.nanmean(b[i:j])) for i, j in runs])
        return out.assign(kind=pd.Series(["LMR" if (j - i) / (pos[j - 1] + 1 - pos[i]) <= max_density else "HMR" for i, j in runs], dtype=object))

    return _by_track(store, track, SEGMENTS + ", kind string")


def segment_regions(sites: DataFrame, self_loop: float = 0.95, min_cpgs: int = 5, min_abs_diff: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Regions as runs of the lower or higher of three states of the difference; Stouffer p, BH by chromosome."""

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        return pdf.assign(state=segment(pdf["meth_diff"].to_numpy(float), [-0.2, 0.0, 0.2], self_loop, "gaussian", 0.1))

    cols = sites.select("chrom", F.col("pos").cast("int").alias("pos"), F.col("pvalue").cast("double").alias("pvalue"), F.col("meth_diff").cast("double").alias("meth_diff"))
    s = cols.groupBy("chrom").applyInPandas(track, "chrom string, pos int, pvalue double, meth_diff double, state int")
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("pos")
    r = s.withColumn("_p", F.lag("state").over(w)).withColumn("_id", F.sum(F.when(F.col("_p").isNull() | (F.col("_p") != F.col("state")), 1).otherwise(0)).over(w)).filter("state <> 1")
    r = r.withColumn("_z", stouffer_columns())
    g = r.groupBy("chrom", "_id", "state").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n_cpgs"), F.avg("meth_diff").alias("mean_diff"), F.sum("_z").alias("_zs"), F.count("_z").alias("_zn"))
    g = g.filter((F.col("n_cpgs") >= min_cpgs) & (F.abs("mean_diff") >= min_abs_diff)).withColumn("pvalue", stouffer_p(F.col("_zs"), F.col("_zn"))).drop("_id", "_zs", "_zn")
    return adjust_by_chrom(g).filter(F.col("qvalue") < alpha).withColumn("dmr_type", F.when(F.col("state") == 0, "hypo").otherwise("hyper")).drop("state")


