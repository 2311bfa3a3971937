"""Result tables by chromosome, with a manifest, and conversions that are done once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import convert_sample, qualified
from .store import read_store


def _put(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> dict | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads(spark.read.text(path).first()[0])


class ResultStore:
    """A table of results partitioned by chromosome; chromosomes can be replaced one by one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = _get(spark, f"{path}/manifest") or {}

    @classmethod
    def create(cls, rows: DataFrame, path: str, **notes) -> ResultStore:
        spark = rows.sparkSession
        out = rows.repartition("chrom").sortWithinPartitions("chrom", "pos" if "pos" in rows.columns else "start")
        out.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/rows")
        _put(spark, f"{path}/manifest", {"schema": json.loads(rows.schema.json()), "notes": notes})
        return cls(spark, path)

    def table(self) -> DataFrame:
        schema = T.StructType.fromJson(self.manifest["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").select(*schema.fieldNames())

    def chrom(self, name: str) -> DataFrame:
        """One chromosome, by its partition alone."""
        return self.table().filter(F.col("chrom") == name)

    def chroms(self) -> list[str]:
        return [r[0] for r in self.table().select("chrom").distinct().orderBy("chrom").collect()]  # one row per chromosome

    def update(self, rows: DataFrame) -> None:
        """Replaces the chromosomes that rows have; the others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(f"{self.path}/rows")


def ensure_converted(spark: SparkSession, obs: DataFrame, path: str, kind: str = "bismark", **options) -> DataFrame:
    """The store of a sample sheet; a sample is converted anew only if its file or the options differ from its manifest's."""
    for r in obs.select("sample_id", "path").orderBy("sample_id").collect():  # one per sample
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r["path"])
        state = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
        wanted = {"file": [qualified(spark, r["path"]), state.getLen(), state.getModificationTime()], "format": kind, "options": {k: str(v) for k, v in sorted(options.items())}}
        manifest = f"{path}-manifest/{r['sample_id']}"
        if _get(spark, manifest) != wanted:
            convert_sample(spark, r["path"], r["sample_id"], path, kind, **options)
            _put(spark, manifest, wanted)
    return read_store(spark, path).filter(F.col("sample").isin([r[0] for r in obs.select("sample_id").collect()]))
