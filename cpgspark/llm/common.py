"""What the operators share: reading tables, tables in the shared folder, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="cpgspark-")
        atexit.register(shutil.rmtree, _own[key], True)
    return f"file://{_own[key]}"


def _delete(path: str) -> None:
    spark = _written.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


atexit.register(_forget)


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table written to the shared folder: lineage ends there, lost executors lose nothing.

    The table `instead_of`, made by this function, is deleted once its successor
    is written.  Shuffle files of the finished job go when the driver's JVM
    collects what refers to them; it is asked to, as it would else wait for half
    an hour and the disks fill with what no task will read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cpg_path = path
    if instead_of is not None:
        _delete(instead_of._cpg_path)
    else:
        spark.sparkContext._jvm.System.gc()
    return out


def spread_keys(spark: SparkSession, n: int, most: int = 4096) -> list[int]:
    """n whole numbers that hash partitioning puts into n different partitions, so that equal pieces of work share none; beyond `most`, just n numbers."""
    if n > most:
        return list(range(n))
    place = F.expr(f"pmod(hash(cast(id as int)), {n})")
    rows = spark.range(64 * n).select(F.col("id").cast("int").alias("k"), place.alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()  # n rows
    keys = {r["k"] for r in rows}
    rest = (k for k in range(64 * n, 65 * n) if k not in keys)
    return sorted(keys) + [next(rest) for _ in range(n - len(keys))]


def unused(columns, *names: str) -> list[str]:
    """These names, longer where the columns have them already (in any case)."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
