"""Coverage files as a stream: additive sums per site are the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import COVERAGE


def stream_coverage(spark: SparkSession, folder: str, sample: str, offset: int = -1) -> DataFrame:
    """New six-column files of a folder as store rows of one sample."""
    rows = spark.readStream.schema(COVERAGE).option("sep", "\t").csv(folder)
    return rows.select("chrom", (F.col("start") + offset).cast("int").alias("pos"), "N_meth", "N_unmeth", (F.col("N_meth") + F.col("N_unmeth")).alias("coverage"), F.lit(sample).alias("sample"))


def running_sums(rows: DataFrame) -> DataFrame:
    """Counts by sample and site over all that has arrived."""
    n, m = F.col("coverage").cast("double"), F.col("N_meth").cast("double")
    return rows.groupBy("sample", "chrom", "pos").agg(F.sum("N_meth").alias("N_meth"), F.sum("coverage").alias("coverage"), F.sum(m * m / F.greatest(n, F.lit(1.0))).alias("q"))
