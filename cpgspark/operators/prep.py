"""Filtering, normalising, merging and aggregating counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import is_canonical
from ..sources.store import with_counts
from .intervals import islands, points_in


def coverage_quantile(store: DataFrame, quantile: float = 0.999) -> DataFrame:
    """(sample, cutoff): the nearest-rank quantile of each sample's coverage over the genome, as a whole number.

    The rank is round(quantile * (n - 1)), halves up.  Coverages are counted
    first, so the window runs over distinct values.
    """
    counted = store.groupBy("sample", "coverage").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sample").orderBy("coverage")
    total = F.sum("n").over(Window.partitionBy("sample"))
    ranked = counted.withColumns({"upto": F.sum("n").over(w), "rank": F.floor(F.lit(quantile) * (total - 1) + 0.5)})
    return ranked.filter("upto > rank").groupBy("sample").agg(F.min("coverage").alias("cutoff"))


def drop_blacklisted(store: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Rows whose position is in no interval (chrom, start, end)."""
    return points_in(store, blacklist.select("chrom", "start", "end"), "left_anti")


def filter_sites(store: DataFrame, min_coverage: int = 10, max_quantile: float = 0.999, blacklist: DataFrame | None = None) -> DataFrame:
    cut = coverage_quantile(store, max_quantile)
    kept = store.join(F.broadcast(cut), "sample").filter((F.col("coverage") >= min_coverage) & (F.col("coverage") <= F.col("cutoff"))).select(store.columns)  # one row per sample
    return kept if blacklist is None else drop_blacklisted(kept, blacklist)


def filter_coverage(store: DataFrame, lo_count: int = 10, hi_perc: float = 99.9, blacklist: DataFrame | None = None) -> DataFrame:
    return filter_sites(store, lo_count, hi_perc / 100, blacklist)


def scale_factors(store: DataFrame, method: str = "median") -> DataFrame:
    """(sample, centre, factor); all centres are brought to their own median (or mean)."""
    centre = {"median": F.median, "mean": F.avg}[method]
    per = store.groupBy("sample").agg(centre("coverage").alias("centre"))
    target = per.agg(centre("centre").alias("target"))
    return per.crossJoin(F.broadcast(target)).select("sample", "centre", F.when(F.col("centre") > 0, F.col("target") / F.col("centre")).otherwise(1.0).alias("factor"))  # the target is one row


def normalize_coverage(store: DataFrame, method: str = "median") -> DataFrame:
    f = scale_factors(store, method)
    scaled = store.join(F.broadcast(f.select("sample", "factor")), "sample")
    return with_counts(scaled, F.round(F.col("N_meth") * F.col("factor")), F.round(F.col("N_unmeth") * F.col("factor"))).select(store.columns)


def filter_canonical(store: DataFrame) -> DataFrame:
    return store.filter(is_canonical("chrom"))


def dropped_contigs(store: DataFrame) -> DataFrame:
    """(chrom, n) of the rows that filter_canonical leaves out, for a log."""
    return store.filter(~is_canonical("chrom")).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def infer_strand(store: DataFrame, reference: DataFrame, block: int = 10_000) -> DataFrame:
    """Strand from the reference base: C is +, G is -, all else *.

    reference: (chrom, block, bases), blocks of `block` bases from 0 on.
    """
    at = store.withColumn("_block", F.expr(f"pos div {block}"))
    base = F.upper(F.substring("bases", F.expr(f"pos % {block} + 1"), F.lit(1)))
    joined = at.join(reference.select("chrom", F.col("block").alias("_block"), "bases"), ["chrom", "_block"], "left")
    return joined.withColumn("strand", F.when(base == "C", "+").when(base == "G", "-").otherwise("*")).select(store.columns)


def merge_strands(store: DataFrame) -> DataFrame:
    """Counts of the minus strand go to the position before, on the plus strand; without minus rows nothing changes."""
    moved = store.withColumns({"pos": F.when(F.col("strand") == "-", F.col("pos") - 1).otherwise(F.col("pos")).cast("int"), "_minus": (F.col("strand") == "-").cast("int")})
    g = moved.groupBy("sample", "chrom", "context", "pos").agg(F.sum("N_meth").alias("m"), F.sum("N_unmeth").alias("u"), F.min("strand").alias("only"), F.max("_minus").alias("minus"), F.max(F.col("strand") == "+").alias("plus"))
    out = g.withColumn("strand", F.when((F.col("minus") == 1) | F.col("plus"), "+").otherwise(F.col("only")))
    return with_counts(out, F.col("m"), F.col("u")).select(store.columns)


def merge_pairs_by_position(store: DataFrame) -> DataFrame:
    """Without strands: in each run of consecutive positions the 1st and 2nd, 3rd and 4th and so on are one site."""
    once = store.groupBy("sample", "chrom", "context", "pos").agg(F.sum("N_meth").alias("m"), F.sum("N_unmeth").alias("u"))
    w = Window.partitionBy("sample", "chrom", "context").orderBy("pos")
    run = once.withColumn("run", F.col("pos") - F.row_number().over(w))
    inner = Window.partitionBy("sample", "chrom", "context", "run").orderBy("pos")
    pair = run.withColumn("pair", F.expr("(row_number() over (partition by sample, chrom, context, run order by pos) - 1) div 2"))
    del inner
    g = pair.groupBy("sample", "chrom", "context", "run", "pair").agg(F.min("pos").alias("pos"), F.sum("m").alias("m"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("n"))
    out = g.withColumn("strand", F.when(F.col("n") == 2, "+").otherwise("*"))
    return with_counts(out, F.col("m"), F.col("u")).select(store.columns)


def aggregate_regions(store: DataFrame, regions: DataFrame, min_sites: int = 1) -> DataFrame:
    """Counts summed by sample and region (chrom, start, end, region_id), in the store's columns and the region's."""
    r = regions.select("chrom", "start", "end", "region_id")
    g = points_in(store, r).groupBy("sample", "chrom", "region_id", "start", "end").agg(F.sum("N_meth").alias("m"), F.sum("N_unmeth").alias("u"), F.count(F.lit(1)).alias("n_cpgs"), F.first("context").alias("context"))
    g = g.filter(F.col("n_cpgs") >= min_sites).withColumns({"pos": F.expr("int((start + end) div 2)"), "strand": F.lit("*")})
    return with_counts(g, F.col("m"), F.col("u")).select(*store.columns, "region_id", "start", "end", "n_cpgs")


def tiles(store: DataFrame, size: int = 1000) -> DataFrame:
    """Counts by sample and tile of `size` bases; strand of the first row that has one."""
    known = F.when(F.col("strand") != "*", F.col("strand"))
    g = store.withColumn("tile", F.expr(f"int(pos div {size} * {size})")).groupBy("sample", "chrom", "tile")
    return g.agg(F.sum("N_meth").alias("N_meth"), F.sum("coverage").alias("coverage"), F.count(F.lit(1)).alias("n_cpgs"), F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("pos"))), F.lit("*")).alias("strand"))


def pseudo_counts(store: DataFrame, smooth: DataFrame) -> DataFrame:
    """N_meth replaced by the smoothed beta times coverage, rounded half to even; rows without one keep theirs."""
    s = smooth.select("sample", "chrom", "pos", "beta_smooth")
    joined = store.join(s, ["sample", "chrom", "pos"], "left")
    m = F.coalesce(F.least(F.greatest(F.bround(F.col("beta_smooth") * F.col("coverage")), F.lit(0)), F.col("coverage")), F.col("N_meth"))
    joined = joined.withColumn("_m", m.cast("int"))
    return with_counts(joined, F.col("_m"), F.col("coverage") - F.col("_m")).select(store.columns)


def region_qfilter(regions: DataFrame, below: float | None, columns: tuple[str, ...] = ("combined_qvalue", "combined_pvalue")) -> DataFrame:
    """Regions whose first available column of these is below a threshold."""
    found = next((c for c in columns if c in regions.columns), None)
    return regions if below is None or found is None else regions.filter(F.col(found) < below)


def runs(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Runs of positions not more than `gap` apart: start, end (last + 1), n."""
    marked = islands(rows.select(*keys, "pos").distinct(), keys, "pos", F.col("pos") - F.col("_prev") > gap)
    return marked.groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")
