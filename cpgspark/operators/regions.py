"""Regions from site results: chains, windows, tiles, variance density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import binom_sf_col, normal_isf_col, normal_sf_col
from .aggregate import site_groups
from .fdr import adjust
from .intervals import islands, overlapping, points_in
from .prep import tiles

#: Fixed values of the chain presets.
PRESETS = {
    "strict": {"alpha": 1e-6, "min_abs_diff": 0.2, "merge_bp": 250, "min_cpgs": 5, "pct_sig": 0.5, "min_len": 100},
    "default": {"alpha": 1e-4, "min_abs_diff": 0.1, "merge_bp": 500, "min_cpgs": 3, "pct_sig": 0.5, "min_len": 50},
    "permissive": {"alpha": 1e-4, "min_abs_diff": 0.05, "merge_bp": 1000, "min_cpgs": 3, "pct_sig": 0.5, "min_len": 50},
}
#: Fixed values of a chain without a preset, and the sites that a region needs by default where users call it.
CHAIN = {"alpha": 0.05, "min_abs_diff": 0.1, "merge_bp": 500, "min_cpgs": 3, "pct_sig": 0.5, "min_len": 50}
LAYER_MIN_CPGS = 5


def chain_settings(preset: str | None = None, **given) -> dict:
    """The settings of a chain: what is given (not None) wins, then the preset, then the bare values."""
    if preset is not None and preset not in PRESETS:
        raise ValueError(f"preset is one of {sorted(PRESETS)}")
    return (PRESETS[preset] if preset else CHAIN) | {k: v for k, v in given.items() if v is not None}


def resolve_min_cpgs(min_cpgs: int | None, preset: str | None) -> int:
    """Sites that a region needs where users call it: given, of the preset, or 5."""
    return chain_settings(preset, min_cpgs=min_cpgs)["min_cpgs"] if preset or min_cpgs is not None else LAYER_MIN_CPGS


def direction(mean: Column | str, n_hyper: Column | str, n_hypo: Column | str) -> Column:
    """hyper or hypo by the mean's sign; mixed where neither direction has 60 % of the sites that have one; by the majority without a mean."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    mean, up, down = c(mean), c(n_hyper), c(n_hypo)
    split = (up + down == 0) | (F.greatest(up, down) / (up + down) < 0.6)
    return F.when(split, "mixed").when(F.when(mean.isNull() | F.isnan(mean), up > down).otherwise(mean > 0), "hyper").otherwise("hypo")


def stouffer_columns(p: str = "pvalue", diff: str = "meth_diff", signed: bool = True) -> Column:
    """The score of a row: null if it doesn't count, 0 for no effect."""
    ok = F.col(p).isNotNull() & (F.col(p) > 0) & (F.col(p) <= 1) & F.col(diff).isNotNull()
    z = normal_isf_col(F.least(F.greatest(F.col(p), F.lit(2.2250738585072014e-308)), F.lit(1 - 1e-15)) / 2)
    return F.when(ok, F.signum(diff) * z if signed else z)


def stouffer_p(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(1.0), 2 * normal_sf_col(F.abs(total) / F.sqrt(n))))


def _region_stats(sites: DataFrame, keys: list[str], start: Column, end: Column, combine: bool) -> DataFrame:
    """Statistics of the sites of each region; sites have _sig and, if `combine`, _z."""
    extra = [F.sum("_z").alias("_zs"), F.count("_z").alias("_zn")] if combine else []
    g = sites.groupBy(*keys).agg(
        start.alias("start"),
        end.alias("end"),
        F.count(F.lit(1)).alias("n_cpgs"),
        F.sum(F.col("_sig").cast("int")).alias("n_sig"),
        F.avg("meth_diff").alias("mean_diff"),
        F.sum(F.when(F.col("meth_diff") > 0, 1).otherwise(0)).alias("n_hyper"),
        F.sum(F.when(F.col("meth_diff") < 0, 1).otherwise(0)).alias("n_hypo"),
        F.min("pvalue").alias("min_pvalue"),
        *extra,
    )
    g = g.withColumn("dmr_type", direction("mean_diff", "n_hyper", "n_hypo"))
    if combine:
        g = g.withColumn("pvalue_combined", stouffer_p(F.col("_zs"), F.col("_zn"))).drop("_zs", "_zn")
    return g


def chain_merge(sites: DataFrame, preset: str | None = None, alpha: float | None = None, min_abs_diff: float | None = None, merge_bp: int | None = None, min_cpgs: int | None = None, pct_sig: float | None = None, min_len: int | None = None, use_q: bool = False, combine: bool = True) -> DataFrame:
    """Significant sites chained over gaps of up to merge_bp; a region has all sites from its first to its last significant one.

    Settings that aren't given are those of the preset, or of CHAIN without one.
    """
    d = chain_settings(preset, alpha=alpha, min_abs_diff=min_abs_diff, merge_bp=merge_bp, min_cpgs=min_cpgs, pct_sig=pct_sig, min_len=min_len)
    alpha, min_abs_diff, merge_bp, min_cpgs, pct_sig, min_len = (d[k] for k in ("alpha", "min_abs_diff", "merge_bp", "min_cpgs", "pct_sig", "min_len"))
    p = "qvalue" if use_q else "pvalue"
    s = sites.withColumn("_sig", F.coalesce((F.col(p) < alpha) & (F.abs("meth_diff") >= min_abs_diff), F.lit(False)))
    if combine:
        s = s.withColumn("_z", stouffer_columns())
    w = Window.partitionBy("chrom").orderBy("pos")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("chrom").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    sig_pos = F.when(F.col("_sig"), F.col("pos"))
    s = s.withColumn("_lastsig", F.last(sig_pos, ignorenulls=True).over(back))
    s = s.withColumn("_new", F.when(F.col("_sig") & (F.col("_lastsig").isNull() | (F.col("pos") - F.col("_lastsig") > merge_bp)), 1).otherwise(0))
    s = s.withColumn("_chain", F.sum("_new").over(w))
    # a site lies in a chain if the chain behind it and the one ahead are the same
    s = s.withColumn("_next", F.last(F.when(F.col("_sig"), F.col("_chain")), ignorenulls=True).over(ahead)).filter((F.col("_chain") > 0) & (F.col("_chain") == F.col("_next")))
    g = _region_stats(s, ["chrom", "_chain"], F.min("pos"), F.max("pos") + 1, combine).drop("_chain")
    g = g.filter((F.col("end") - F.col("start") >= min_len) & (F.col("n_cpgs") >= min_cpgs) & (F.col("n_sig") / F.col("n_cpgs") >= pct_sig))
    return adjust(g, "fdr_bh", "pvalue_combined", "qvalue_combined") if combine else g


def sliding_windows(sites: DataFrame, window_bp: int = 500, min_cpgs: int = 5, min_sig: int = 3, alpha: float = 0.05, min_abs_diff: float = 0.1, max_len: int = 10_000, combine: bool = True) -> DataFrame:
    """Windows from each site on that hold enough sites and significant sites, merged where they touch, with statistics of the merged span."""
    p = "qvalue" if "qvalue" in sites.columns else "pvalue"
    s = sites.withColumn("_sig", F.coalesce((F.col(p) < alpha) & (F.abs("meth_diff") >= min_abs_diff), F.lit(False)))
    w = Window.partitionBy("chrom").orderBy("pos").rangeBetween(0, window_bp - 1)
    c = s.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.sum(F.col("_sig").cast("int")).over(w)}).filter((F.col("_n") >= min_cpgs) & (F.col("_k") >= min_sig))
    runs = islands(c.select("chrom", "pos"), ["chrom"], "pos", F.col("pos") - F.col("_prev") > window_bp)
    spans = runs.groupBy("chrom", "island").agg(F.min("pos").alias("s"), (F.max("pos") + window_bp).alias("e")).filter(F.col("e") - F.col("s") <= max_len)
    inner = points_in(s.withColumn("_z", stouffer_columns()) if combine else s, spans, start="s", end="e")
    g = _region_stats(inner, ["chrom", "s", "e"], F.first("s"), F.first("e"), combine).drop("s", "e")
    g = g.filter((F.col("n_cpgs") >= min_cpgs) & (F.col("n_sig") >= min_sig))
    return adjust(g, "fdr_bh", "pvalue_combined", "qvalue_combined") if combine else g


def tile_statistics(store: DataFrame, case: list[str], control: list[str], size: int = 1000, min_cpgs: int = 5, unite: str = "intersect", dispersion: str = "site") -> DataFrame:
    """The likelihood-ratio statistic on counts of tiles; a tile needs min_cpgs sites in some sample."""
    from .site_tests import lr_statistic

    t = tiles(store.filter(F.col("sample").isin([*case, *control])), size)
    n = t.groupBy("chrom", "tile").agg(F.max("n_cpgs").alias("n_cpgs")).filter(F.col("n_cpgs") >= min_cpgs)
    g = site_groups(t.withColumnRenamed("tile", "pos"), case, control, unite)
    s = lr_statistic(g, dispersion).join(n.withColumnRenamed("tile", "pos"), ["chrom", "pos"])
    return s.withColumns({"start": F.col("pos"), "end": F.col("pos") + size}).drop("pos")


def tile_regions(store: DataFrame, case: list[str], control: list[str], size: int = 1000, min_cpgs: int = 5, alpha: float = 0.05, min_abs_diff: float = 0.1, merge: bool = True, reference: str = "chi2", **kw) -> DataFrame:
    from .site_tests import reference_p

    s = tile_statistics(store, case, control, size, min_cpgs, **kw)
    return call_tiles(s.withColumn("pvalue", reference_p(F.col("lr"), F.col("phi"), F.col("df_phi"), reference)), alpha, min_abs_diff, merge)


def call_tiles(tested: DataFrame, alpha: float = 0.05, min_abs_diff: float = 0.1, merge: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Regions of tested tiles (chrom, start, end, n_cpgs, meth_diff, pvalue), each group `by` on its own."""
    s = adjust(tested, by=by)
    hit = s.filter((F.col("qvalue") < alpha) & (F.abs("meth_diff") >= min_abs_diff)).withColumn("dmr_type", F.when(F.col("meth_diff") >= 0, "hyper").otherwise("hypo"))
    return merge_adjacent_tiles(hit, by=by) if merge else hit


def merge_adjacent_tiles(regions: DataFrame, combine: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Touching tiles of one direction become one: sites add up, effects are means of the tiles, p is an unsigned Stouffer."""
    w = Window.partitionBy(*by, "chrom").orderBy("start")
    s = regions.withColumns({"_pe": F.lag("end").over(w), "_pt": F.lag("dmr_type").over(w)})
    s = s.withColumn("_id", F.sum(F.when(F.col("_pe").isNull() | (F.col("start") > F.col("_pe")) | (F.col("dmr_type") != F.col("_pt")), 1).otherwise(0)).over(w))
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), F.first("dmr_type").alias("dmr_type"), F.sum("n_cpgs").alias("n_cpgs"), F.avg("meth_diff").alias("meth_diff"), F.count(F.lit(1)).alias("n_tiles")]
    if not combine:
        return s.groupBy(*by, "chrom", "_id").agg(*aggs).drop("_id")
    s = s.withColumn("_z", stouffer_columns(diff="meth_diff", signed=False))
    g = s.groupBy(*by, "chrom", "_id").agg(*aggs, F.sum("_z").alias("_zs"), F.count("_z").alias("_zn")).withColumn("pvalue", stouffer_p(F.col("_zs"), F.col("_zn")))
    return adjust(g.drop("_id", "_zs", "_zn"), by=by)


def variance_density(sites: DataFrame, size: int = 1000, min_cpgs: int = 5) -> DataFrame:
    """Tiles with their sites, variable sites and the genome's rate; direction by the sum of the signs of the variable sites."""
    rate = sites.agg((F.sum(F.col("is_dvc").cast("int")) / F.count(F.lit(1))).alias("rate"))
    g = sites.withColumn("start", F.expr(f"pos div {size} * {size}")).groupBy("chrom", "start").agg(F.count(F.lit(1)).alias("n_cpgs"), F.sum(F.col("is_dvc").cast("int")).alias("n_dvc"), F.sum(F.when(F.col("is_dvc"), F.signum("var_log_ratio"))).alias("sign_sum"))
    g = g.filter(F.col("n_cpgs") >= min_cpgs).crossJoin(F.broadcast(rate))  # one row
    return g.withColumns({"end": F.col("start") + size, "direction": F.when(F.col("sign_sum") > 0, "more_variable").when(F.col("sign_sum") < 0, "less_variable").otherwise("mixed")})


def variance_regions(sites: DataFrame, size: int = 1000, min_cpgs: int = 5, alpha: float = 0.05) -> DataFrame:
    d = variance_density(sites, size, min_cpgs)
    p = F.greatest(binom_sf_col(F.col("n_dvc").cast("double"), F.col("n_cpgs").cast("double"), "rate"), F.lit(2.2250738585072014e-308))
    return adjust(d.withColumn("pvalue", p)).filter((F.col("qvalue") < alpha) & (F.col("n_dvc") > 0))


def diagnose(reference: DataFrame, called: DataFrame, sites: DataFrame, alpha: float = 1e-5) -> DataFrame:
    """Each reference region (chrom, start, end) with why it was or wasn't called: overlap, no_sites, no_signal, weak_signal or structural.

    Touching counts as overlap, and region ends are inclusive for sites.
    """
    ref = reference.select("chrom", "start", "end").distinct()
    met = overlapping(ref.withColumn("end1", F.col("end") + 1), called.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), (F.col("end") + 1).alias("r_end")), ends=("start", "end1", "r_start", "r_end"))
    hit = met.select("chrom", "start", "end").distinct().withColumn("_hit", F.lit(True))
    inside = points_in(sites.select("chrom", "pos", "qvalue"), ref.withColumn("end1", F.col("end") + 1), end="end1")
    q = inside.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n_sites"), F.min("qvalue").alias("min_q"))
    out = ref.join(hit, ["chrom", "start", "end"], "left").join(q, ["chrom", "start", "end"], "left")
    bucket = F.when(F.col("_hit"), "overlap").when(F.col("n_sites").isNull(), "no_sites").when(F.col("min_q").isNull() | (F.col("min_q") >= 0.05), "no_signal").when(F.col("min_q") >= alpha, "weak_signal").otherwise("structural")
    return out.select("chrom", "start", "end", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), "min_q", bucket.alias("bucket"))
