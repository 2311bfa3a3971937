"""Sharding by global byte-size prefix sums.

Rows are put in one global order by range partitioning.  Each partition counts
its rows and bytes in one streaming pass; the totals of the partitions (one row
each) give every partition its offset, and equal targets cut the global prefix
sum into contiguous shards of nearly equal bytes.

Groups (equal texts) stay together: they are neighbours in the order, and a cut
that would part one is moved to the group's nearer edge.  Only a group of more
than 1/`SPLIT` of a shard's target is parted, so that a shard never misses its
target by more than that (or one larger row).

No row is ever gathered: the driver sees one row per partition and one per cut,
and the shuffle moves the order key, the size and the checksum, never the text.

Defined cases: null texts have the size 1 and are a group of their own, apart
from empty texts by no more than chance; null ids come first among equal texts;
rows that are equal in all get neighbouring slots; an empty table gives an empty
table; other columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, unused


#: A group up to this part of a shard's target is never parted.
SPLIT = 20


def running_totals(df: DataFrame, size: str, order: list[str], before: str = "before", index: str = "index") -> tuple[DataFrame, int, int]:
    """Adds `before` (bytes of all rows in front) and `index` (rows in front) in the global order.

    Returns the rows with both columns, all rows and all bytes.  Ties in the
    whole order are rows with equal order columns; they follow one another.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, inner, row = unused(df.columns, "_part", "_bytes", "_rows")
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    sorted_rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(inner, T.LongType()), T.StructField(row, T.LongType())])
    at_size = df.columns.index(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        total = rows = 0
        for b in batches:
            sizes = b.column(at_size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            front = ends - sizes + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(sizes), number, np.int32)), pa.array(front), pa.array(np.arange(rows, rows + len(sizes)))], names=[*b.schema.names, part, inner, row])
            total += int(sizes.sum())
            rows += len(sizes)

    counted = materialize(sorted_rows.mapInArrow(count, out), "running")
    totals = counted.groupBy(F.col(part).alias("p")).agg(F.sum(f"`{size}`").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row per partition
    offsets, all_bytes, all_rows = [], 0, 0
    for r in totals:
        offsets.append((r["p"], all_bytes, all_rows))
        all_bytes, all_rows = all_bytes + r["b"], all_rows + r["n"]
    at = df.sparkSession.createDataFrame(offsets, f"{part} int, {before} long, {index} long")
    placed = counted.join(F.broadcast(at.withColumnsRenamed({before: f"{before}__", index: f"{index}__"})), part)
    placed = placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col(inner) + F.col(f"{before}__")).alias(before), (F.col(row) + F.col(f"{index}__")).alias(index))
    return placed, all_rows, all_bytes


def _cuts(placed: DataFrame, size: str, group: list[str], before: str, all_bytes: int, shards: int) -> list[int]:
    """Where shards 1, 2, ... begin, in bytes: at equal targets, moved to the nearer edge of a row, or of a group that isn't too large."""
    end = F.col(before) + F.col(f"`{size}`")
    targets = [all_bytes * k // shards for k in range(1, shards)]
    touched = F.lit(False)
    for target in targets:
        touched = touched | ((F.col(before) <= target) & (end >= target))
    names = [f"_g{i}" for i in range(len(group))]
    rows = placed.select(F.col(before).alias("_b"), end.alias("_e"), touched.alias("_t"), *(F.col(f"`{c}`").alias(g) for c, g in zip(group, names)))
    met = rows.filter("_t").collect()  # two rows per cut at most
    extent = {}
    if group and met:
        of = rows.filter("_t").select(*(F.col(g).alias(f"{g}_") for g in names)).distinct()
        same = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in names]
        extent = {tuple(r[g] for g in names): (r["first"], r["last"]) for r in rows.join(F.broadcast(of), same).groupBy(*names).agg(F.min("_b").alias("first"), F.max("_e").alias("last")).collect()}
    out = []
    for target in targets:
        first = last = target
        here = [r for r in met if r["_b"] <= target <= r["_e"]]
        if len(here) == 1:
            first, last = here[0]["_b"], here[0]["_e"]
        if group and here and len(keys := {tuple(r[g] for g in names) for r in here}) == 1:
            wide = extent[keys.pop()]
            if (wide[1] - wide[0]) * shards * SPLIT <= all_bytes:
                first, last = wide
        out.append(first if target - first <= last - target else last)
    return out


def shard_by_bytes(df: DataFrame, size: str, order: list[str], shards: int = 16, group: list[str] | None = None) -> DataFrame:
    """Adds `shard` and `slot` (gapless from 0 within the shard); columns of these names must not be there.

    A shard misses its target by less than one row's size, or with `group` (which
    must be the first columns of the order) by less than 1/`SPLIT` of the target
    or one row.  Sizes must be at least 1.
    """
    group = group or []
    if order[: len(group)] != group:
        raise ValueError("the group's columns come first in the order")
    before, index = unused(df.columns, "_before", "_index")
    placed, _, all_bytes = running_totals(df, size, order, before, index)
    if not all_bytes:
        return placed.withColumns({"shard": F.lit(0), "slot": F.col(index)}).drop(before, index)
    shard = F.lit(0)
    for cut in _cuts(placed, size, group, before, all_bytes, shards):
        shard = shard + (F.col(before) >= cut).cast("int")
    rows = placed.withColumn("shard", shard)
    first = rows.groupBy(F.col("shard").alias("_s")).agg(F.min(index).alias("_first")).collect()  # `shards` rows
    start = F.create_map(*(F.lit(x).cast(t) for r in first for x, t in ((r["_s"], "int"), (r["_first"], "long"))))
    return rows.withColumn("slot", F.col(index) - start[F.col("shard")]).drop(before, index)


def op9_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, law `bytes`: contiguous ranges in the order of the texts' digests, balanced by size, equal texts together."""
    from .common import table

    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = table(spark, sf_dir, "documents").select(
        F.md5(body).alias("key"),
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    out = shard_by_bytes(rows, "size", ["key", "doc_id", "text_crc32", "size"], group=["key"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is made byte by byte from its table, which SQL builds by the rule of the polynomial.
OP9_SQL = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS i))
), d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS key, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, key, size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, 2 * size - 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32 FROM d, tab
), p AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER w AS after, row_number() OVER w - 1 AS idx, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY key, doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
), e AS (
  SELECT *, min(before) OVER (PARTITION BY key) AS gb, max(after) OVER (PARTITION BY key) AS ga FROM p
), t AS (
  SELECT k, any_value(total) * k // 16 AS target FROM p, (SELECT unnest(range(1, 16)) AS k) GROUP BY k
), m AS (
  SELECT k, target, count(DISTINCT key) AS keys, count(*) AS touch, min(before) AS rb, max(after) AS ra, min(gb) AS gb, max(ga) AS ga, any_value(total) AS total FROM t JOIN e ON before <= target AND after >= target GROUP BY k, target
), u AS (
  SELECT k, target, CASE WHEN keys = 1 AND (ga - gb) * 16 * 20 <= total THEN gb WHEN touch = 1 THEN rb ELSE target END AS a, CASE WHEN keys = 1 AND (ga - gb) * 16 * 20 <= total THEN ga WHEN touch = 1 THEN ra ELSE target END AS b FROM m
), cut AS (SELECT CASE WHEN target - a <= b - target THEN a ELSE b END AS pos FROM u),
s AS (SELECT doc_id, size, text_crc32, idx, (SELECT count(*) FROM cut WHERE pos <= before) AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard, (idx - min(idx) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM s"""
