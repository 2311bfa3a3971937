"""Summaries and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import beta


def sample_summary(store: DataFrame) -> DataFrame:
    """Per sample and chromosome: sites, mean and median coverage, pooled methylation."""
    g = store.groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("coverage").alias("mean_coverage"), F.median("coverage").alias("median_coverage"), F.sum("N_meth").alias("m"), F.sum("coverage").alias("c"))
    return g.withColumn("pooled_methylation", beta("m", "c")).drop("m", "c")


def group_sums(samples: list[str], name: str) -> list[Column]:
    """Sums of one group of samples that the tests need: counts, squares over coverage, and betas."""
    mine = F.col("sample").isin(samples)
    covered = mine & (F.col("coverage") > 0)
    n, m = F.col("coverage").cast("double"), F.col("N_meth").cast("double")
    b = m / n
    return [
        F.sum(F.when(covered, F.col("coverage")).otherwise(0)).alias(f"n_{name}"),
        F.sum(F.when(covered, F.col("N_meth")).otherwise(0)).alias(f"m_{name}"),
        F.coalesce(F.sum(F.when(covered, m * m / n)), F.lit(0.0)).alias(f"q_{name}"),
        F.count(F.when(covered, True)).alias(f"k_{name}"),
        F.avg(F.when(covered, b)).alias(f"mean_{name}"),
        F.var_samp(F.when(covered, b)).alias(f"var_{name}"),
    ]


def listed_rows(samples: list[str]) -> Column:
    """A site's covered rows as a list in the order of `samples`, of which i is the place; for listed_sums."""
    n, m = F.col("coverage").cast("double"), F.col("N_meth").cast("double")
    place = F.array_position(F.array(*map(F.lit, samples)), F.col("sample")).cast("int") - 1
    row = F.struct(place.alias("i"), n.alias("n"), m.alias("m"), (m * m / n).alias("q"))
    return F.sort_array(F.collect_list(F.when(F.col("coverage") > 0, row)))


def listed_sums(rows: str, name: str, counts: str = "long") -> list[Column]:
    """The sums of group_sums from a list of rows, without a grouping; n and m get the type `counts` (doubles are exact for all that stores hold)."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def of(field: str) -> Column:
        return F.aggregate(F.col(rows), F.lit(0.0), lambda a, x: a + F.coalesce(x[field], F.lit(0.0)))

    betas = F.filter(F.transform(F.col(rows), lambda x: x["m"] / x["n"]), lambda b: b.isNotNull())
    k = F.size(betas)
    mean = F.when(k > 0, total(betas) / k)
    var = F.when(k > 1, total(F.transform(betas, lambda b: (b - mean) * (b - mean))) / (k - 1))
    return [of("n").cast(counts).alias(f"n_{name}"), of("m").cast(counts).alias(f"m_{name}"), of("q").alias(f"q_{name}"), F.size(rows).cast("long").alias(f"k_{name}"), mean.alias(f"mean_{name}"), var.alias(f"var_{name}")]


def site_groups(store: DataFrame, case: list[str], control: list[str], unite: str = "union", min_case: int | None = None, min_control: int = 0, keys: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """One row per site with both groups' sums, in one shuffle.

    unite: intersect keeps sites that all samples have.  Sites with fewer
    covered samples than the minima are left out.
    """
    rows = store.filter(F.col("sample").isin([*case, *control]))
    g = rows.groupBy(*keys).agg(F.countDistinct("sample").alias("n_samples"), *group_sums(case, "case"), *group_sums(control, "ctrl")) if unite == "intersect" else rows.groupBy(*keys).agg(*group_sums(case, "case"), *group_sums(control, "ctrl"))
    if unite == "intersect":
        g = g.filter(F.col("n_samples") == len(case) + len(control)).drop("n_samples")
    if min_case:
        g = g.filter(F.col("k_case") >= min_case)
    if min_control:
        g = g.filter(F.col("k_ctrl") >= min_control)
    return g


def welford(store: DataFrame, samples: list[str]) -> DataFrame:
    """Mean, sum of squared deviations, number and variance of the mean of the betas at each site."""
    rows = store.filter(F.col("sample").isin(samples) & (F.col("coverage") > 0)).withColumn("b", beta())
    g = rows.groupBy("chrom", "pos").agg(F.avg("b").alias("mean"), F.count("b").alias("n"), F.var_samp("b").alias("v"))
    return g.select("chrom", "pos", "mean", F.coalesce(F.col("v") * (F.col("n") - 1), F.lit(0.0)).alias("m2"), "n", (F.col("v") / F.col("n")).alias("var_mean"))


def annotation_counts(rows: DataFrame, column: str = "feature_type", key: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Distinct regions of each class, most first."""
    r = rows.withColumn("feature", F.explode(column)) if rows.schema[column].dataType.typeName() == "array" else rows.withColumn("feature", F.col(column))
    return r.groupBy("feature").agg(F.countDistinct(*key).alias("n")).orderBy(F.desc("n"), "feature")


def coannotation(rows: DataFrame, column: str, key: tuple[str, ...]) -> DataFrame:
    """Pairs of classes and the number of regions that have both; the pair of a class with itself counts its regions."""
    r = rows.select(*key, F.explode(column).alias("a")).distinct()
    return r.join(r.withColumnRenamed("a", "b"), list(key)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def numeric_by_annotation(rows: DataFrame, value: str, column: str = "feature_type", include_all: bool = True) -> DataFrame:
    """Long rows (feature, value), with a copy of all under All."""
    r = rows.withColumn("feature", F.explode(column)) if rows.schema[column].dataType.typeName() == "array" else rows.withColumn("feature", F.col(column))
    out = r.select("feature", F.col(value).alias("value"))
    return out.unionByName(rows.select(F.lit("All").alias("feature"), F.col(value).alias("value"))) if include_all else out


def categorical_shares(rows: DataFrame, group: str, column: str = "feature_type", include_all: bool = True) -> DataFrame:
    """Counts of classes by group and in all, with their share of the group: grouping sets in one pass."""
    base = rows.groupingSets([[F.col(group), F.col(column)], [F.col(column)]] if include_all else [[F.col(group), F.col(column)]], F.col(group), F.col(column))
    g = base.agg(F.count(F.lit(1)).alias("n"), F.grouping(group).alias("_all"))
    g = g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias("grp"), F.col(column).alias("feature"), "n")
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))
