"""The queries behind the usual plots and report tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import beta, chrom_order, is_canonical
from .annotate import tss
from .intervals import points_in


def site_matrix(store: DataFrame, samples: list[str], modulus: int = 1, seed: int = 42, complete: bool = True) -> DataFrame:
    """One row per site, one beta per sample; every modulus-th position, complete rows only."""
    rows = store.filter(F.col("sample").isin(samples) & (F.expr(f"pmod(pos, {modulus})") == seed % modulus)).withColumn("b", beta())
    wide = rows.groupBy("chrom", "pos").pivot("sample", samples).agg(F.avg("b"))
    return wide.na.drop(subset=samples) if complete else wide


def pca(matrix: DataFrame, samples: list[str], components: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates of the samples, shares of variance): from the Gram matrix of the centred rows, one aggregation of samples squared cells."""
    mean = sum((F.col(f"`{s}`") for s in samples[1:]), F.col(f"`{samples[0]}`")) / len(samples)
    c = matrix.select(*((F.col(f"`{s}`") - mean).alias(f"c{i}") for i, s in enumerate(samples)))
    n = len(samples)
    row = c.agg(*(F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n))).first()
    g = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(g)
    order = values.argsort()[::-1][:components]
    scale = np.sqrt(np.maximum(values[order], 0))
    return vectors[:, order] * scale, np.maximum(values[order], 0) / max(values.clip(0).sum(), 1e-300)


def scree(matrix: DataFrame, samples: list[str], components: int = 6) -> np.ndarray:
    return pca(matrix, samples, components)[1]


def tss_metaplot(store: DataFrame, genes: DataFrame, window_bp: int = 2000, n_bins: int = 100) -> DataFrame:
    """Mean beta by sample and strand-relative bin around the TSS."""
    g = tss(genes).select("chrom", "tss", "strand", (F.col("tss") - window_bp).alias("w_start"), (F.col("tss") + window_bp).alias("w_end")).filter("w_end > 0").withColumn("w_start", F.greatest("w_start", F.lit(0)))
    rows = points_in(store.drop("strand").withColumn("b", beta()).filter("b is not null"), g, start="w_start", end="w_end")
    rel = F.when(F.col("strand") == "-", F.col("tss") - F.col("pos")).otherwise(F.col("pos") - F.col("tss"))
    bin_ = F.least(F.lit(n_bins - 1), F.floor((rel + window_bp) * n_bins / (2 * window_bp))).cast("int")
    return rows.withColumn("bin", bin_).groupBy("sample", "bin").agg(F.avg("b").alias("mean_beta"), F.count(F.lit(1)).alias("n"))


def gene_body_metaplot(store: DataFrame, genes: DataFrame, flank: int = 2000, flank_bins: int = 30, body_bins: int = 40, min_bp: int = 500) -> DataFrame:
    """Mean beta by sample and bin over upstream flank, scaled body and downstream flank, read along the strand."""
    g = genes.filter(F.col("end") - F.col("start") >= min_bp).select("chrom", "strand", F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.greatest(F.lit(0), F.col("start") - flank).alias("w_start"), (F.col("end") + flank).alias("w_end"))
    rows = points_in(store.drop("strand").withColumn("b", beta()).filter("b is not null"), g, start="w_start", end="w_end")
    off = F.when(F.col("strand") == "-", F.col("g_end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("g_start"))
    size = F.col("g_end") - F.col("g_start")
    bin_ = F.when(off < 0, F.floor((off + flank) * flank_bins / flank)).when(off < size, flank_bins + F.floor(off * body_bins / size)).otherwise(flank_bins + body_bins + F.least(F.lit(flank_bins - 1), F.floor((off - size) * flank_bins / flank)))
    return rows.withColumn("bin", bin_.cast("int")).groupBy("sample", "bin").agg(F.avg("b").alias("mean_beta"), F.count(F.lit(1)).alias("n"))


def thinned(rows: DataFrame, keep_one_in: int, seed: int = 42, keys: tuple[str, ...] = ("sample", "chrom", "pos")) -> DataFrame:
    """A share of the rows that depends on their keys only."""
    return rows.filter(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(keep_one_in)) == 0)


def keep_significant(rows: DataFrame, keep_one_in: int, flag: str = "significant", seed: int = 42) -> DataFrame:
    return rows.filter(F.col(flag) | (F.pmod(F.xxhash64("chrom", "pos", F.lit(seed)), F.lit(keep_one_in)) == 0))


def coverage_distribution(store: DataFrame, width: int = 10) -> DataFrame:
    """Sites by sample and class of coverage."""
    return store.withColumn("coverage_bin", F.expr(f"coverage div {width} * {width}")).groupBy("sample", "coverage_bin").agg(F.count(F.lit(1)).alias("n"))


def volcano(sites: DataFrame, alpha: float = 0.05, min_abs_diff: float = 0.1, p: str = "pvalue", q: str = "qvalue") -> DataFrame:
    sig = F.coalesce((F.col(q) < alpha) & (F.abs("meth_diff") >= min_abs_diff), F.lit(False))
    return sites.withColumns({"neg_log10_p": -F.log10(F.greatest(F.col(p), F.lit(1e-300))), "significant": sig}).withColumns({"hyper": F.col("significant") & (F.col("meth_diff") > 0), "hypo": F.col("significant") & (F.col("meth_diff") < 0)})


def ma_plot(sites: DataFrame, alpha: float = 0.05, min_abs_diff: float = 0.1, **kw) -> DataFrame:
    return volcano(sites, alpha, min_abs_diff, **kw).withColumn("mean_beta", (F.col("beta_case") + F.col("beta_ctrl")) / 2)


def manhattan(sites: DataFrame, spacing: int = 10_000_000, canonical: bool = True, p: str = "pvalue") -> DataFrame:
    """Positions on one axis: chromosomes in natural order, `spacing` bases between them."""
    s = sites.filter(is_canonical("chrom")) if canonical else sites
    ends = s.groupBy("chrom").agg(F.max("pos").alias("_end")).withColumn("_o", chrom_order("chrom"))
    w = Window.orderBy("_o", "chrom")  # one row per chromosome
    off = ends.select("chrom", (F.sum(F.col("_end") + spacing).over(w) - F.col("_end") - spacing).alias("_off"))
    return s.join(F.broadcast(off), "chrom").withColumns({"x": F.col("pos") + F.col("_off"), "neg_log10_p": -F.log10(F.greatest(F.col(p), F.lit(1e-300)))}).drop("_off")


def pvalue_histogram(sites: DataFrame, bins: int = 30, p: str = "pvalue") -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return sites.filter(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def region_sizes(regions: DataFrame) -> DataFrame:
    return regions.select("chrom", "start", "end", "n_cpgs", (F.col("end") - F.col("start")).alias("width"))


def karyogram(sites: DataFrame, value: str = "meth_diff", bin_bp: int = 1_000_000) -> DataFrame:
    return sites.withColumn("bin", F.expr(f"pos div {bin_bp}")).groupBy("chrom", "bin").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def set_overlaps(sets: dict[str, DataFrame], keys: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Sizes of the exclusive combinations of 2 to 6 region sets."""
    if not 2 <= len(sets) <= 6:
        raise ValueError("2 to 6 sets")
    rows = None
    for i, s in enumerate(sets.values()):
        part = s.select(*keys).distinct().withColumn("_bit", F.lit(1 << i))
        rows = part if rows is None else rows.unionByName(part)
    names = [*sets]
    g = rows.groupBy(*keys).agg(F.sum("_bit").alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    label = F.concat_ws("&", *(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(n)) for i, n in enumerate(names)))
    return g.withColumn("combination", label)


def top_sites(sites: DataFrame, store: DataFrame, samples: list[str], n: int = 1000) -> DataFrame:
    """Betas of all samples at the n sites of largest absolute effect."""
    top = sites.select("chrom", "pos", "meth_diff").orderBy(F.abs("meth_diff").desc_nulls_last(), "chrom", "pos").limit(n)
    rows = store.filter(F.col("sample").isin(samples)).join(F.broadcast(top), ["chrom", "pos"]).withColumn("b", beta())  # n rows
    return rows.groupBy("chrom", "pos", "meth_diff").pivot("sample", samples).agg(F.avg("b"))


def region_matrix(store: DataFrame, regions: DataFrame, samples: list[str]) -> DataFrame:
    """Pooled beta of every sample in every region, the end included, by one range join."""
    r = regions.select("chrom", "start", "end").distinct().withColumn("end1", F.col("end") + 1)
    rows = points_in(store.filter(F.col("sample").isin(samples)), r, end="end1")
    return rows.groupBy("chrom", "start", "end", "sample").agg(F.sum("N_meth").alias("m"), F.sum("coverage").alias("c"), F.count(F.lit(1)).alias("n_sites")).withColumn("beta", beta("m", "c")).drop("m", "c")


def top_regions(regions: DataFrame, n: int = 10, by: str = "qvalue") -> DataFrame:
    return regions.orderBy(F.col(by).asc_nulls_last(), "chrom", "start").limit(n)


def region_violin(regions: DataFrame, split: str = "dmr_type") -> DataFrame:
    """Long rows of case and control betas of regions, split by a column."""
    both = F.explode(F.array(F.struct(F.lit("case").alias("group"), F.col("mean_beta_case").alias("beta")), F.struct(F.lit("control").alias("group"), F.col("mean_beta_control").alias("beta"))))
    return regions.select(F.col(split).alias("split"), both.alias("v")).select("split", "v.*")


def site_stats(sites: DataFrame, alpha: float = 0.05, min_abs_diff: float = 0.1, q: str = "qvalue") -> DataFrame:
    v = volcano(sites, alpha, min_abs_diff, p=q, q=q)
    return v.agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.col("significant").cast("int")).alias("n_sig"), F.sum(F.col("hyper").cast("int")).alias("n_hyper"), F.sum(F.col("hypo").cast("int")).alias("n_hypo"), F.avg(F.col("significant").cast("double")).alias("share_sig"), F.median(F.when(F.col("significant"), F.abs("meth_diff"))).alias("median_abs_diff"))


def region_stats(regions: DataFrame) -> DataFrame:
    return regions.agg(F.count(F.lit(1)).alias("n_regions"), F.sum((F.col("dmr_type") == "hyper").cast("int")).alias("n_hyper"), F.sum((F.col("dmr_type") == "hypo").cast("int")).alias("n_hypo"), F.median(F.col("end") - F.col("start")).alias("median_width"))


def qc_status(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Worst status of a sample: limits give by column the values from which it is ok and warn; lower ones fail."""
    score = F.greatest(F.lit(0), *(F.when(F.col(c) >= ok, 0).when(F.col(c) >= warn, 1).when(F.col(c).isNull(), 0).otherwise(2) for c, (ok, warn) in limits.items()))
    return metrics.withColumn("status", F.element_at(F.array(*map(F.lit, ("ok", "warn", "fail"))), score + 1))
