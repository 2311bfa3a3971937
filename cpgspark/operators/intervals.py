"""Interval joins, islands and nearest neighbours along a position axis.

An equality join on the chromosome with the range as a residual is quadratic in
a chromosome.  Here intervals are cut into bins, so that the join key is
(chrom, bin): every pair meets in exactly one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 10_000


def points_in(points: DataFrame, intervals: DataFrame, how: str = "inner", bin_size: int = BIN, chrom: str = "chrom", pos: str = "pos", start: str = "start", end: str = "end") -> DataFrame:
    """Points with every interval [start, end) that holds them; other columns must differ by name.

    how: inner, left, left_semi or left_anti.
    """
    cut = intervals.filter(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.expr(f"sequence(`{start}` div {bin_size}, (`{end}` - 1) div {bin_size})")))
    cut = cut.withColumnRenamed(chrom, "_chrom")
    at = points.withColumn("_pbin", F.expr(f"`{pos}` div {bin_size}"))
    on = (F.col(chrom) == F.col("_chrom")) & (F.col("_pbin") == F.col("_bin")) & (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))
    out = at.join(cut, on, how)
    return out.drop("_pbin", "_bin", "_chrom")


def overlapping(left: DataFrame, right: DataFrame, how: str = "inner", bin_size: int = BIN, ends: tuple[str, str, str, str] = ("start", "end", "r_start", "r_end"), chroms: tuple[str, str] = ("chrom", "r_chrom")) -> DataFrame:
    """Pairs of overlapping half-open intervals, each in the bin of the later start only."""
    ls, le, rs, re_ = ends
    cut = lambda t, s, e, b: t.withColumn(b, F.explode(F.expr(f"sequence(`{s}` div {bin_size}, greatest(`{e}` - 1, `{s}`) div {bin_size})")))
    a, b = cut(left, ls, le, "_lb"), cut(right, rs, re_, "_rb")
    on = (F.col(chroms[0]) == F.col(chroms[1])) & (F.col("_lb") == F.col("_rb")) & (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    if how == "inner":
        on = on & (F.col("_lb") == F.expr(f"greatest(`{ls}`, `{rs}`) div {bin_size}"))
    return a.join(b, on, how).drop("_lb", "_rb")


def islands(rows: DataFrame, keys: list[str], order: str, broken: Column, name: str = "island") -> DataFrame:
    """Adds a running island number per key: a new one where `broken` (an expression over _prev, the row before) holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_prev", F.lag(order).over(w)).withColumn(name, F.sum(F.when(F.col("_prev").isNull() | broken, 1).otherwise(0)).over(w)).drop("_prev")


def merge_intervals(intervals: DataFrame, keys: list[str] = ["chrom"], start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or touching intervals, with the number of them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = intervals.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_id", F.sum("_new").over(w))
    return parts.groupBy(*keys, "_id").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged")).drop("_id")


def nearest(points: DataFrame, marks: DataFrame, value: str, bin_size: int | None = None, chrom: str = "chrom", pos: str = "pos", mark: str = "mark") -> DataFrame:
    """Adds `value` of the nearest mark of the chromosome and its position; at equal distance that on the left.

    Marks are unique by chromosome and position.
    """
    p = points.withColumns({"_kind": F.lit(1), "_at": F.col(pos).cast("long"), "_m": F.lit(None).cast(f"struct<{mark}:bigint,{value}:{marks.schema[value].dataType.simpleString()}>")})
    m = marks.select(F.col(chrom), *(F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema.fields if f.name != chrom), F.lit(0).alias("_kind"), F.col(mark).cast("long").alias("_at"), F.struct(F.col(mark).cast("long").alias(mark), F.col(value)).alias("_m"))
    both = p.unionByName(m)
    back = Window.partitionBy(chrom).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(chrom).orderBy(F.col("_at").desc(), F.col("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_l": F.last("_m", ignorenulls=True).over(back), "_r": F.last("_m", ignorenulls=True).over(ahead)}).filter("_kind = 1")
    left, right = F.col("_at") - F.col(f"_l.{mark}"), F.col(f"_r.{mark}") - F.col("_at")
    best = F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull() | (left <= right), F.col("_l")).otherwise(F.col("_r"))
    return found.withColumn("_best", best).select(*points.columns, F.col(f"_best.{value}").alias(value), F.col(f"_best.{mark}").alias(mark))
