"""Session helpers and the analysis object."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a folder that goes with the process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="cpgspark-")
        atexit.register(shutil.rmtree, _own[key], True)
    return f"file://{_own[key]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps don't recompute it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


atexit.register(_forget)


@dataclass
class Cohort:
    """Samples, store and result tables of one analysis.

    `obs` has one row per sample (sample_id, group, treatment 0/1, covariates);
    `store` the counts; `tables` the results by name.
    """

    spark: SparkSession
    obs: DataFrame
    store: DataFrame
    assembly: str = "unknown"
    context: str = "CpG"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)

    def samples(self, treatment: int | None = None) -> list[str]:
        rows = self.obs if treatment is None else self.obs.filter(F.col("treatment") == treatment)
        return [r[0] for r in rows.select("sample_id").orderBy("sample_id").collect()]  # one row per sample

    @property
    def treated(self) -> list[str]:
        return self.samples(1)

    @property
    def controls(self) -> list[str]:
        return self.samples(0)

    def save(self, path: str) -> None:
        """All tables as Parquet, notes as JSON text."""
        self.obs.write.mode("overwrite").parquet(f"{path}/obs")
        self.store.write.mode("overwrite").partitionBy("sample", "chrom").parquet(f"{path}/store")
        for name, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        meta = {"assembly": self.assembly, "context": self.context, "tables": sorted(self.tables), "notes": self.notes}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cohort:
        from .sources.store import read_store

        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}
        return cls(spark, spark.read.parquet(f"{path}/obs"), read_store(spark, f"{path}/store"), meta["assembly"], meta["context"], tables, meta["notes"])

    def significant(self, name: str, alpha: float = 0.05, min_abs_diff: float = 0.0) -> DataFrame:
        t = self.tables[name]
        q = next(c for c in ("qvalue_combined", "qvalue", "pvalue_combined", "pvalue") if c in t.columns)
        return t.filter((F.col(q) < alpha) & (F.abs("meth_diff") >= min_abs_diff))
