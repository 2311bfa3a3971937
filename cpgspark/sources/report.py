"""An HTML report of an analysis, made of its tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, plotdata, qc

STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:2px 8px;text-align:right}"


def _cell(v: object) -> str:
    if v is None:
        return ""
    return html.escape(f"{v:.6g}" if isinstance(v, float) else "; ".join(map(str, v)) if isinstance(v, list) else str(v))


def table_html(df: DataFrame, most: int = 100) -> str:
    """The first `most` rows of a table, with a note if there are more."""
    rows = df.limit(most + 1).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows[:most])
    more = f"<p>the first {most} rows</p>" if len(rows) > most else ""
    return f"<table><tr>{head}</tr>{body}</table>{more}"


def sections(store: DataFrame, sites: DataFrame | None = None, regions: DataFrame | None = None, alpha: float = 0.05, top: int = 20) -> list[tuple[str, DataFrame]]:
    """The tables of a report: coverage, methylation, and of sites and regions the numbers and the best ones."""
    out = [("Samples", aggregate.sample_summary(store).orderBy("sample", "chrom")), ("Global methylation", qc.global_methylation(store).orderBy("sample")), ("Coverage", qc.coverage_uniformity(store).filter("chrom = 'genome'").orderBy("sample"))]
    if sites is not None:
        out += [("Sites", plotdata.site_stats(sites)), ("Best sites", sites.filter(F.col("qvalue") < alpha).orderBy("qvalue", "chrom", "pos").limit(top))]
    if regions is not None:
        q = next(c for c in ("qvalue_combined", "qvalue") if c in regions.columns)
        out += [("Regions", plotdata.region_stats(regions)), ("Best regions", plotdata.top_regions(regions, top, q))]
    return out


def report_html(title: str, parts: list[tuple[str, DataFrame]]) -> str:
    body = "".join(f"<h2>{html.escape(name)}</h2>{table_html(df)}" for name, df in parts)
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def write_report(title: str, parts: list[tuple[str, DataFrame]], path: str) -> None:
    """As a text file in the folder `path`, wherever Spark can write."""
    spark = parts[0][1].sparkSession
    spark.createDataFrame([(report_html(title, parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)
