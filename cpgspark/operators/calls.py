"""Regions from counts in one call: site test, region caller, filter, shuffled labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import permute, regions, segment
from .prep import region_qfilter
from .site_tests import dmc, resolve_chromosomes

METHODS = ("chain_merge", "sliding_window", "tile_based", "rule_segment")


def dmr(
    store: DataFrame,
    obs: DataFrame,
    method: str = "chain_merge",
    preset: str | None = None,
    alpha: float | None = None,
    min_abs_diff: float | None = None,
    merge_bp: int | None = None,
    min_cpgs: int | None = None,
    pct_sig: float | None = None,
    min_len: int | None = None,
    use_q: bool = False,
    window_bp: int = 500,
    min_sig: int = 3,
    tile_size: int = 1000,
    tile_min_cpgs: int = 5,
    merge_adjacent: bool = True,
    q_below: float | None = 0.05,
    empirical: bool = False,
    n_perm: int = 100,
    seed: int = 42,
    strata: dict[str, str] | None = None,
    fdr_method: str = "max_t",
    dispersion: str = "site",
    chromosomes: list[str] | None = None,
    canonical_only: bool = False,
    **site_options,
) -> DataFrame:
    """Regions of `obs` (sample_id, treatment 1 or 0), of those with a q value below `q_below` (all, if None).

    `site_options` are those of dmc.  With `empirical` (chains and tiles) the
    caller is replayed on shuffled labels with the same settings.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if preset is not None and method != "chain_merge":
        raise ValueError("presets are for chain_merge")
    if empirical and method not in ("chain_merge", "tile_based"):
        raise ValueError("shuffled labels are for chain_merge and tile_based")
    store = resolve_chromosomes(store, chromosomes, canonical_only)
    rows = obs.select("sample_id", "treatment").collect()  # one row per sample
    case, control = (sorted(r["sample_id"] for r in rows if r["treatment"] == t) for t in (1, 0))
    if method == "tile_based":
        how = {"size": tile_size, "min_cpgs": tile_min_cpgs, "alpha": 0.05 if alpha is None else alpha, "min_abs_diff": 0.1 if min_abs_diff is None else min_abs_diff, "merge": merge_adjacent, "dispersion": dispersion}
        found = region_qfilter(regions.tile_regions(store, case, control, **how), q_below, ("qvalue",))
        return permute.tile_fdr(store, case, control, found, n_perm=n_perm, seed=seed, method=fdr_method, strata=strata, below=q_below, **how) if empirical else found
    sites = dmc(store, obs, dispersion=dispersion, **site_options)
    if method == "chain_merge":
        chain = {"preset": preset, "alpha": alpha, "min_abs_diff": min_abs_diff, "merge_bp": merge_bp, "min_cpgs": regions.resolve_min_cpgs(min_cpgs, preset), "pct_sig": pct_sig, "min_len": min_len, "use_q": use_q}
        if empirical and use_q:
            raise ValueError("shuffled sites have no q value")
        found = region_qfilter(regions.chain_merge(sites, **chain), q_below, ("qvalue_combined",))
        if not empirical:
            return found
        nulls, used = permute.null_regions(store, case, control, lambda s: region_qfilter(regions.chain_merge(s, **chain), q_below, ("qvalue_combined",)), n_perm, seed, strata)
        return permute.empirical_region_fdr(found, nulls, used, fdr_method, "pvalue_combined")
    effect = 0.1 if min_abs_diff is None else min_abs_diff
    level = 0.05 if alpha is None else alpha
    cpgs = regions.resolve_min_cpgs(min_cpgs, None)
    if method == "sliding_window":
        return region_qfilter(regions.sliding_windows(sites, window_bp, cpgs, min_sig, level, effect), q_below, ("qvalue_combined",))
    return region_qfilter(segment.segment_regions(sites, min_cpgs=cpgs, min_abs_diff=effect, alpha=level), q_below, ("qvalue",))
