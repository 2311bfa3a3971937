"""Null regions: the site test and the region caller replayed on shuffled labels.

Permutations are a column, not a loop: one job tests every site under every
shuffle, and the caller sees (permutation, chromosome) as the chromosome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fdr import empirical_region_fdr, is_mirror, permutation, permuted_statistics
from .prep import region_qfilter, tiles
from .regions import call_tiles
from .site_tests import reference_p


def null_regions(store: DataFrame, case: list[str], control: list[str], call: Callable[[DataFrame], DataFrame], n_perm: int = 100, seed: int = 42, strata: dict[str, str] | None = None, reference: str = "adaptive") -> tuple[DataFrame, int]:
    """(regions with `perm`, permutations used); shuffles that are the labels or their mirror are left out."""
    use = [i for i in range(n_perm) if not is_mirror(permutation(i, case, control, seed, strata), case, control)]
    s = permuted_statistics(store, case, control, n_perm, seed, strata).filter(F.col("perm").isin(use))
    s = s.withColumn("pvalue", reference_p(F.col("lr"), F.col("phi"), F.col("df_phi"), reference))
    r = call(s.withColumn("chrom", F.concat_ws("|", "perm", "chrom")).drop("perm"))
    parts = F.split("chrom", r"\|", 2)
    return r.withColumns({"perm": parts[0].cast("int"), "chrom": parts[1]}), len(use)


def chain_fdr(store: DataFrame, case: list[str], control: list[str], observed: DataFrame, n_perm: int = 100, seed: int = 42, method: str = "max_t", strata: dict[str, str] | None = None, **chain) -> DataFrame:
    """Empirical p and q of chained regions (pvalue_combined) from replays with the same settings."""
    from .regions import chain_merge

    nulls, used = null_regions(store, case, control, lambda s: chain_merge(s, **chain), n_perm, seed, strata)
    return empirical_region_fdr(observed, nulls, used, method, "pvalue_combined")


def tile_fdr(store: DataFrame, case: list[str], control: list[str], observed: DataFrame, size: int = 1000, n_perm: int = 100, seed: int = 42, method: str = "max_t", strata: dict[str, str] | None = None, min_cpgs: int = 5, alpha: float = 0.05, min_abs_diff: float = 0.1, merge: bool = True, reference: str = "chi2", unite: str = "intersect", dispersion: str = "site", below: float | None = None) -> DataFrame:
    """The same for the regions of tile_regions (pvalue), merged or not: settings have to be those of the observed run.

    `below` is the q value that the observed regions were filtered by, if any.
    """
    nulls, used = null_tile_regions(store, case, control, size, n_perm, seed, strata, min_cpgs, alpha, min_abs_diff, merge, reference, unite, dispersion)
    return empirical_region_fdr(observed, region_qfilter(nulls, below, ("qvalue",)), used, method, "pvalue")


def null_tile_regions(store: DataFrame, case: list[str], control: list[str], size: int = 1000, n_perm: int = 100, seed: int = 42, strata: dict[str, str] | None = None, min_cpgs: int = 5, alpha: float = 0.05, min_abs_diff: float = 0.1, merge: bool = True, reference: str = "chi2", unite: str = "intersect", dispersion: str = "site") -> tuple[DataFrame, int]:
    """(regions with `perm`, permutations used): tile_regions replayed on shuffled labels, each permutation adjusted on its own."""
    use = [i for i in range(n_perm) if not is_mirror(permutation(i, case, control, seed, strata), case, control)]
    t = tiles(store.filter(F.col("sample").isin([*case, *control])), size)
    enough = t.groupBy("chrom", "tile").agg(F.max("n_cpgs").alias("n_cpgs")).filter(F.col("n_cpgs") >= min_cpgs)
    s = permuted_statistics(t.withColumnRenamed("tile", "pos"), case, control, n_perm, seed, strata, unite, dispersion).filter(F.col("perm").isin(use))
    s = s.join(enough.withColumnRenamed("tile", "pos"), ["chrom", "pos"]).withColumns({"start": F.col("pos"), "end": F.col("pos") + size, "pvalue": reference_p(F.col("lr"), F.col("phi"), F.col("df_phi"), reference)})
    return call_tiles(s.drop("pos"), alpha, min_abs_diff, merge, ("perm",)), len(use)
