"""Tracks, tables and reports as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import chrom_order, value_of


def bedgraph(store: DataFrame, sample: str, value: str = "beta") -> DataFrame:
    """chrom, start, end, value in natural order; rows without a value are left out."""
    s = store.filter(F.col("sample") == sample).withColumn("value", value_of(value)).filter("value is not null")
    return s.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value").orderBy(chrom_order("chrom"), "chrom", "start")


def write_bedgraph(store: DataFrame, sample: str, path: str, value: str = "beta") -> None:
    rows = bedgraph(store, sample, value)
    six = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", "value"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    rows.select(F.concat_ws("\t", "chrom", "start", "end", six)).write.mode("overwrite").text(path)


def sites_bed(sites: DataFrame, alpha: float = 0.05, min_abs_diff: float = 0.0, q: str = "qvalue") -> DataFrame:
    """Six columns of the significant sites; numbers follow the order by chromosome and position."""
    s = sites.filter((F.col(q) < alpha) & (F.abs("meth_diff") >= min_abs_diff))
    rank = F.row_number().over(Window.orderBy("chrom", "pos"))  # significant sites only
    return s.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.concat(F.lit("dmc_"), rank).alias("name"), F.expr(f"int(1000 * (1 - {q}))").alias("score"), F.when(F.col("meth_diff") >= 0, "+").otherwise("-").alias("strand"))


def regions_bed(regions: DataFrame, q: str = "qvalue") -> DataFrame:
    rank = F.row_number().over(Window.orderBy("chrom", "start"))  # regions
    score = F.least(F.lit(1000), F.greatest(F.lit(0), (-100 * F.log10(F.greatest(F.col(q), F.lit(1e-300)))).cast("int")))
    return regions.select("chrom", "start", "end", F.concat(F.lit("dmr_"), rank).alias("name"), F.when(F.col(q).isNotNull(), score).otherwise(0).alias("score"), F.when(F.col("dmr_type") == "hyper", "+").when(F.col("dmr_type") == "hypo", "-").otherwise(".").alias("strand"))


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by `; `, structures and maps as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("; ", F.transform(c, lambda x: x.cast("string")))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    flat(df).write.mode("overwrite").csv(path, sep=sep, header=True)


def significant_table(sites: DataFrame, alpha: float = 0.05, full: bool = False) -> DataFrame:
    """All rows, or the significant ones by the first of the usual columns, sorted by it."""
    gate = next(c for c in ("qvalue_combined", "qvalue", "pvalue_combined", "pvalue") if c in sites.columns)
    return sites if full else sites.filter(F.col(gate) < alpha).orderBy(gate, "chrom", "pos")


def variance_table(sites: DataFrame, alpha: float = 0.05, full: bool = False) -> DataFrame:
    return sites if full else sites.filter(F.col("qvalue_variance") < alpha).orderBy("qvalue_variance", "chrom", "pos")


def per_sample_rows(store: DataFrame) -> DataFrame:
    """Tab-separated rows of per-sample call files: 1-based base, percentages of both bases."""
    s = store.filter("coverage > 0")
    return s.select("sample", F.concat("chrom", F.lit("."), F.col("pos") + 1).alias("chrBase"), "chrom", (F.col("pos") + 1).alias("base"), F.when(F.col("strand") == "-", "R").otherwise("F").alias("strand"), "coverage", (100.0 * F.col("N_meth") / F.col("coverage")).alias("freqC"), (100.0 * F.col("N_unmeth") / F.col("coverage")).alias("freqT"))


def write_per_sample(store: DataFrame, path: str) -> None:
    per_sample_rows(store).repartition("sample").sortWithinPartitions("sample", "chrom", "base").write.mode("overwrite").partitionBy("sample").csv(path, sep="\t", compression="gzip")


def report_json(metrics: DataFrame, section: str) -> str:
    """A report section of one row per sample as JSON."""
    data = {r["sample"]: {k: v for k, v in r.asDict().items() if k != "sample"} for r in metrics.collect()}
    return json.dumps({"id": section, "plot_type": "generalstats", "data": data}, sort_keys=True)


def matrix(store: DataFrame, samples: list[str], layer: str = "beta", unite: str = "union") -> DataFrame:
    """A row per site in order, a column per sample: the dense layer as a table."""
    from ..operators.align import site_index

    idx = site_index(store, samples, unite)
    rows = store.filter(F.col("sample").isin(samples)).withColumn("_v", value_of(layer))
    wide = rows.groupBy("chrom", "pos").pivot("sample", samples).agg(F.first("_v"))
    return idx.join(wide, ["chrom", "pos"])


def export_tables(tables: dict[str, DataFrame], out_dir: str, alpha: float = 0.05, full: bool = False, sep: str = "\t") -> None:
    for name, t in tables.items():
        rows = significant_table(t, alpha, full) if {"chrom", "pos"} <= {*t.columns} and not full and {"pvalue", "qvalue"} & {*t.columns} else t
        write_table(rows, f"{out_dir}/{name}", sep)
