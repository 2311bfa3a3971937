"""The count store: schema, reading, writing and point, site and region queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import beta
from ..operators.intervals import points_in

SCHEMA = T.StructType([T.StructField(n, t()) for n, t in (("chrom", T.StringType), ("pos", T.IntegerType), ("strand", T.StringType), ("context", T.StringType), ("N_meth", T.IntegerType), ("N_unmeth", T.IntegerType), ("coverage", T.IntegerType), ("sample", T.StringType))])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store written with partitionBy("sample", "chrom"); the given schema keeps names like 1 strings."""
    return spark.read.schema(SCHEMA).parquet(path).select(*SCHEMA.fieldNames())


def write_store(rows: DataFrame, path: str) -> None:
    """One file per (sample, chrom), positions in order; only the partitions at hand are replaced."""
    out = rows.select(*SCHEMA.fieldNames()).repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "pos")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("sample", "chrom").parquet(path)


def with_counts(rows: DataFrame, meth: Column, unmeth: Column) -> DataFrame:
    """Rows with new counts; coverage is always their sum."""
    return rows.withColumns({"N_meth": meth.cast("int"), "N_unmeth": unmeth.cast("int")}).withColumn("coverage", F.col("N_meth") + F.col("N_unmeth"))


def query_region(store: DataFrame, chrom: str, start: int, end: int, samples: list[str] | None = None) -> DataFrame:
    """Rows of [start, end), with beta."""
    hit = (F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end)
    if samples is not None:
        hit = hit & F.col("sample").isin(samples)
    return store.filter(hit).withColumn("beta", beta())


def query_regions(store: DataFrame, regions: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Rows of every region (chrom, start, end, region_id); where regions overlap, once for each."""
    rows = store if samples is None else store.filter(F.col("sample").isin(samples))
    return points_in(rows, regions.select("chrom", "start", "end", "region_id")).drop("start", "end").withColumn("beta", beta())


def query_sites(store: DataFrame, sites: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Rows at given (chrom, pos)."""
    rows = store if samples is None else store.filter(F.col("sample").isin(samples))
    return rows.join(sites.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi").withColumn("beta", beta())


def region_beta(store: DataFrame, samples: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Pooled beta, sites and mean coverage of each sample (column sample) in [start, end], the end included."""
    rows = store.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))
    found = rows.groupBy("sample").agg(F.sum("N_meth").alias("m"), F.sum("coverage").alias("c"), F.count(F.lit(1)).alias("n_sites"), F.avg("coverage").alias("mean_coverage"))
    return samples.select("sample").join(found, "sample", "left").select("sample", beta("m", "c").alias("beta"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"), "mean_coverage")


def load_chromosome(store: DataFrame, chrom: str, samples: list[str], sites: DataFrame | None = None) -> DataFrame:
    rows = store.filter((F.col("chrom") == chrom) & F.col("sample").isin(samples))
    return rows if sites is None else rows.join(sites.select("chrom", "pos", "strand").distinct(), ["chrom", "pos", "strand"])


def aligned(store: DataFrame, sites: DataFrame, samples: list[str]) -> DataFrame:
    """Every sample at every site, 0 where it has no row; rows of the same place are summed first."""
    once = store.filter(F.col("sample").isin(samples)).groupBy("sample", "chrom", "pos").agg(F.sum("N_meth").alias("N_meth"), F.sum("coverage").alias("coverage"))
    grid = sites.select("chrom", "pos").distinct().withColumn("sample", F.explode(F.array(*map(F.lit, samples))))
    return grid.join(once, ["sample", "chrom", "pos"], "left").na.fill(0, ["N_meth", "coverage"])


def count_rows(store: DataFrame) -> int:
    return store.count()


# ---- driver tables as a store ----------------------------------------------


def lineitem_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic store of six samples and five chromosomes made of line items; s0 to s2 are treated."""
    q = F.col("l_quantity").cast("int")
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_returnflag", q.alias("q"))
    in_block = (F.col("l_returnflag") == "A") & (F.expr("l_suppkey % 6") < 3) & (F.expr("(l_partkey div 5) % 50") < 10)
    keyed = raw.select(
        F.concat(F.lit("s"), F.expr("l_suppkey % 6")).alias("sample"),
        F.concat(F.lit("chr"), F.expr("l_partkey % 5 + 1")).alias("chrom"),
        F.expr("int((l_partkey div 5) * 100 + (l_partkey % 7) * 13)").alias("pos"),
        "q",
        F.when((F.col("l_returnflag") == "R") | in_block, F.col("q")).otherwise(0).alias("m"),
    )
    g = keyed.groupBy("sample", "chrom", "pos").agg(F.sum("m").cast("int").alias("N_meth"), F.sum("q").cast("int").alias("coverage"))
    return g.select("chrom", "pos", F.lit("+").alias("strand"), F.lit("CpG").alias("context"), "N_meth", (F.col("coverage") - F.col("N_meth")).alias("N_unmeth"), "coverage", "sample")


TREATED, CONTROLS = ["s0", "s1", "s2"], ["s3", "s4", "s5"]
