"""Quality control, power, clocks and cell composition."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bare_chrom, beta
from ..functions.special import noncentral_t_sf, t_isf2

THRESHOLDS = (1, 5, 10, 20, 30)


def conversion_rate(chh_store: DataFrame) -> DataFrame:
    """1 - methylated share of CHH calls, by sample; null without coverage."""
    return chh_store.filter(F.col("context") == "CHH").groupBy("sample").agg(F.sum("N_meth").alias("m"), F.sum("coverage").alias("c")).select("sample", (1 - beta("m", "c")).alias("conversion_rate"))


def global_methylation(store: DataFrame) -> DataFrame:
    """Pooled beta by sample and context; outliers are over 3 robust deviations from the median of at least 3 samples."""
    g = store.groupBy("sample", "context").agg(F.sum("N_meth").alias("m"), F.sum("coverage").alias("c")).withColumn("beta", beta("m", "c")).drop("m", "c")
    w = Window.partitionBy("context")
    g = g.withColumns({"median_beta": F.median("beta").over(w), "n": F.count("beta").over(w)})
    g = g.withColumn("mad", F.median(F.abs(F.col("beta") - F.col("median_beta"))).over(w))
    z = F.when((F.col("n") >= 3) & (F.col("mad") > 0), F.abs(F.col("beta") - F.col("median_beta")) / (1.4826 * F.col("mad")))
    return g.withColumn("robust_z", z).withColumn("is_outlier", F.coalesce(F.col("robust_z") > 3, F.lit(False))).drop("n")


def coverage_uniformity(store: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS, low: float = 0.5) -> DataFrame:
    """By sample and chromosome, and for the genome: mean coverage, share of sites at each threshold; low where the mean is under half the genome's."""
    aggs = [F.count(F.lit(1)).alias("n_sites"), F.avg("coverage").alias("mean_coverage"), *(F.avg((F.col("coverage") >= t).cast("double")).alias(f"frac_{t}x") for t in thresholds)]
    g = store.groupingSets([[F.col("sample"), F.col("chrom")], [F.col("sample")]], "sample", "chrom").agg(*aggs, F.grouping("chrom").alias("_g"))
    g = g.withColumn("chrom", F.when(F.col("_g") == 1, "genome").otherwise(F.col("chrom")))
    whole = F.max(F.when(F.col("_g") == 1, F.col("mean_coverage"))).over(Window.partitionBy("sample"))
    return g.withColumn("low_coverage", F.col("mean_coverage") < low * whole).drop("_g")


def sex_check(store: DataFrame, min_coverage: int = 5, x_names: tuple[str, ...] = ("X",), single: float = 0.25) -> DataFrame:
    """Pooled beta of the X chromosome; samples are split at the middle of the widest gap, lower ones are male."""
    x = store.filter(bare_chrom("chrom").isin([n.upper() for n in x_names]) & (F.col("coverage") >= min_coverage))
    g = x.groupBy("sample").agg(F.sum("N_meth").alias("m"), F.sum("coverage").alias("c"), F.count(F.lit(1)).alias("n_sites")).withColumn("x_beta", beta("m", "c")).drop("m", "c")
    w = Window.orderBy("x_beta", "sample")  # one row per sample
    gaps = g.withColumn("_p", F.lag("x_beta").over(w))
    cut = gaps.agg(F.max_by((F.col("x_beta") + F.col("_p")) / 2, F.col("x_beta") - F.col("_p")).alias("_t"))
    out = g.crossJoin(F.broadcast(cut)).withColumn("threshold", F.coalesce("_t", F.lit(single))).drop("_t")
    return out.withColumn("inferred_sex", F.when(F.col("x_beta") < F.col("threshold"), "male").otherwise("female"))


def contamination(store: DataFrame, min_coverage: int = 10) -> DataFrame:
    """Share of well-covered sites whose beta is between 0.2 and 0.8."""
    s = store.filter(F.col("coverage") >= min_coverage).withColumn("b", beta())
    return s.groupBy("sample").agg(F.count("b").alias("n_sites"), F.avg(((F.col("b") > 0.2) & (F.col("b") < 0.8)).cast("double")).alias("intermediate_share"))


def sample_correlation(store: DataFrame, samples: list[str], method: str = "spearman", min_coverage: int = 10) -> DataFrame:
    """Correlation of betas of all pairs of samples over the sites that all have.

    A site's betas are one row, so pairs cost no join.  For Spearman, ranks with
    ties averaged come from counts of distinct betas.
    """
    ok = store.filter((F.col("coverage") >= min_coverage) & F.col("sample").isin(samples)).withColumn("b", beta())
    if method == "spearman":
        shared = ok.groupBy("chrom", "pos").agg(F.countDistinct("sample").alias("n")).filter(F.col("n") == len(samples)).select("chrom", "pos")
        ok = ok.join(shared, ["chrom", "pos"])
        counts = ok.groupBy("sample", "b").agg(F.count(F.lit(1)).alias("k"))
        w = Window.partitionBy("sample").orderBy("b")
        ranks = counts.select("sample", "b", (F.sum("k").over(w) - (F.col("k") - 1) / 2.0).alias("v"))
        ok = ok.join(ranks, ["sample", "b"])
    elif method == "pearson":
        ok = ok.withColumn("v", F.col("b"))
    else:
        raise ValueError("method is spearman or pearson")
    wide = ok.groupBy("chrom", "pos").agg(*(F.max(F.when(F.col("sample") == s, F.col("v"))).alias(f"v{i}") for i, s in enumerate(samples)), F.countDistinct("sample").alias("n")).filter(F.col("n") == len(samples))
    pairs = [(i, j) for i in range(len(samples)) for j in range(i, len(samples))]
    one = wide.agg(*(F.corr(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs), F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*(F.struct(F.lit(samples[i]).alias("sample_a"), F.lit(samples[j]).alias("sample_b"), F.col(f"c{i}_{j}").alias("corr")) for i, j in pairs)))
    return one.select(rows.alias("r"), F.col("n").alias("n_sites")).select("r.*", "n_sites")


def correlation_matrix(pairs: DataFrame, samples: list[str]) -> DataFrame:
    """Pairs of sample_correlation as a whole matrix: a row and a column for each sample, in the order given, with 1 on the diagonal."""
    both = pairs.select("sample_a", "sample_b", "corr").unionByName(pairs.select(F.col("sample_b").alias("sample_a"), F.col("sample_a").alias("sample_b"), "corr"))
    both = both.withColumn("corr", F.when(F.col("sample_a") == F.col("sample_b"), 1.0).otherwise(F.col("corr")))
    wide = both.groupBy(F.col("sample_a").alias("sample")).pivot("sample_b", samples).agg(F.max("corr"))
    return wide.orderBy(F.array_position(F.lit(samples), F.col("sample")))


def join_metrics(obs: DataFrame, *metrics: DataFrame) -> DataFrame:
    """Metrics by sample joined to the sample table; nothing of it is lost."""
    out = obs
    for m in metrics:
        out = out.join(m, out["sample_id"] == m["sample"], "left").drop(m["sample"])
    return out


def power(diff: float, coverage: float, n: int | None = None, target: float | None = None, alpha: float = 0.05, baseline: float = 0.5, replicate_sd: float = 0.05, dispersion: float = 1.0, n_tests: int | None = None, two_sided: bool = True) -> float:
    """Power of a t test with n samples per group, or the least n (from 2 to 10,000) that reaches a target power.

    A sample's variance is that of its reads at the baseline, times the
    dispersion, and that between samples; it is the same in both groups.
    """
    if (n is None) == (target is None):
        raise ValueError("give n or the target power")
    if coverage <= 0:
        raise ValueError("coverage must be positive")
    level = alpha / (n_tests or 1) * (1 if two_sided else 2)
    effect = abs(diff) / max(math.sqrt(dispersion * baseline * (1 - baseline) / coverage + replicate_sd**2), 1e-12)

    def at(k: int) -> float:
        if k < 2:
            return 0.0
        df, shift = 2 * k - 2, effect * math.sqrt(k / 2)
        t = float(t_isf2(level, df))
        below = 1 - noncentral_t_sf(-t, df, shift) if two_sided else 0.0
        return min(max(noncentral_t_sf(t, df, shift) + below, 0.0), 1.0)

    if n is not None:
        return at(n)
    # the power grows with n: bisection
    lo, hi = 2, 10_000
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if at(mid) >= target else (mid + 1, hi)
    return lo


# ---- clocks ----------------------------------------------------------------


def age_from_linear(x, adult_age: float = 20.0):
    """Age of a transformed linear predictor: exponential below the adult age, linear above."""
    return F.when(x < 0, (1 + adult_age) * F.exp(x) - 1).otherwise((1 + adult_age) * x + adult_age)


def age_clock(betas: DataFrame, coefficients: DataFrame, intercept: float = 0.0, transform: str | None = None, impute: bool = True) -> DataFrame:
    """sample, n_sites, n_imputed and age from betas (cpg_id, sample, beta) and coefficients (cpg_id, coefficient).

    A missing beta is the mean of the cohort at the site; a site that no sample has doesn't count.
    """
    b = betas.join(coefficients.select("cpg_id", "coefficient"), "cpg_id")
    mean = F.avg("beta").over(Window.partitionBy("cpg_id"))
    b = b.withColumn("used", F.coalesce("beta", mean) if impute else F.col("beta"))
    g = b.groupBy("sample").agg(F.count("used").alias("n_sites"), F.count(F.when(F.col("beta").isNull() & F.col("used").isNotNull(), True)).alias("n_imputed"), (F.coalesce(F.sum(F.col("used") * F.col("coefficient")), F.lit(0.0)) + intercept).alias("linear"))
    return g.withColumn("age", age_from_linear(F.col("linear")) if transform == "horvath" else F.col("linear"))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares by the active-set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ (b - a @ x)
    for _ in range(10 * n + 50):
        free = np.flatnonzero(~passive & (w > 1e-10))
        if not len(free):
            break
        passive[free[w[free].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                break
            bad = passive & (s <= 0)
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        w = a.T @ (b - a @ x)
    return x


def deconvolve(betas: DataFrame, reference: DataFrame, cell_types: list[str]) -> DataFrame:
    """sample, cell_type and share from betas (cpg_id, sample, beta) and a reference (cpg_id and a column per cell type)."""
    rows = betas.join(reference.select("cpg_id", *cell_types), "cpg_id").na.drop(subset=["beta", *cell_types])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = nnls(pdf[cell_types].to_numpy(float), pdf["beta"].to_numpy(float))
        total = x.sum()
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "cell_type": cell_types, "share": x / total if total > 0 else x})

    return rows.select("sample", "beta", *cell_types).groupBy("sample").applyInPandas(solve, "sample string, cell_type string, share double")
