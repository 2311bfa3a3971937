"""Sites shared by samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _strand() -> Column:
    """Strand of the first sample in name order that has one; else *."""
    known = F.when(F.col("strand") != "*", F.col("strand"))
    return F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("sample"))), F.lit("*")).alias("strand")


def intersect_sites(store: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, strand) present in all samples; the strand isn't part of the key."""
    rows = store.filter(F.col("sample").isin(samples))
    return rows.groupBy("chrom", "pos").agg(F.countDistinct("sample").alias("n"), _strand()).filter(F.col("n") == len(samples)).drop("n")


def union_sites(store: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, strand) present in any sample; strand of the first sample in name order."""
    rows = store.filter(F.col("sample").isin(samples))
    return rows.groupBy("chrom", "pos").agg(F.min_by("strand", "sample").alias("strand"))


def intersect_stranded(store: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, strand) present in all samples, the strand being part of the key."""
    rows = store.filter(F.col("sample").isin(samples))
    return rows.groupBy("chrom", "pos", "strand").agg(F.countDistinct("sample").alias("n")).filter(F.col("n") == len(samples)).drop("n")


def sites_of(store: DataFrame, samples: list[str], unite: str = "union") -> DataFrame:
    if unite not in ("union", "intersect"):
        raise ValueError("unite is union or intersect")
    return (union_sites if unite == "union" else intersect_sites)(store, samples)


def site_index(store: DataFrame, samples: list[str], unite: str = "union") -> DataFrame:
    """Sites with their place (from 0) in the order of the chromosome's positions."""
    w = Window.partitionBy("chrom").orderBy("pos")
    return sites_of(store, samples, unite).withColumn("index", F.row_number().over(w) - 1)


def beta_at_clock_sites(store: DataFrame, coords: DataFrame, samples: list[str]) -> DataFrame:
    """(cpg_id, sample, beta) for every site of a manifest (cpg_id, chrom, pos) and every sample; null where there is no coverage."""
    grid = coords.select("cpg_id", "chrom", "pos").withColumn("sample", F.explode(F.array(*map(F.lit, samples))))
    found = store.groupBy("sample", "chrom", "pos").agg(F.sum("N_meth").alias("m"), F.sum("coverage").alias("c"))
    return grid.join(found, ["sample", "chrom", "pos"], "left").select("cpg_id", "sample", F.when(F.col("c") > 0, F.col("m") / F.col("c")).alias("beta"))
