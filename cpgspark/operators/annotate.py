"""Features of genes and islands at sites and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import nearest, overlapping

#: Fixed priorities of the features; intergenic is what has none.
PRIORITY = {"promoter": 0, "5UTR": 1, "3UTR": 2, "TTS": 3, "exon": 4, "intron": 5, "noncoding": 6, "intergenic": 7}


def tss(genes: DataFrame) -> DataFrame:
    """Genes (chrom, start, end, strand, gene_id, gene_type) with tss and tes."""
    plus = F.col("strand") != "-"
    return genes.withColumns({"tss": F.when(plus, F.col("start")).otherwise(F.col("end") - 1), "tes": F.when(plus, F.col("end") - 1).otherwise(F.col("start"))})


def _window(genes: DataFrame, at: str, up: int, down: int, name: str) -> DataFrame:
    plus = F.col("strand") != "-"
    lo = F.when(plus, F.col(at) - up).otherwise(F.col(at) - down + 1)
    hi = F.when(plus, F.col(at) + down).otherwise(F.col(at) + up + 1)
    return genes.select("chrom", F.greatest(F.lit(0), lo).alias("f_start"), hi.alias("f_end"), "gene_id", F.lit(name).alias("feature"))


def promoters(genes: DataFrame, up: int = 2000, down: int = 200) -> DataFrame:
    return _window(tss(genes), "tss", up, down, "promoter")


def tts(genes: DataFrame, up: int = 100, down: int = 1000) -> DataFrame:
    return _window(tss(genes), "tes", up, down, "TTS")


def introns(exons: DataFrame, genes: DataFrame) -> DataFrame:
    """Stretches of a gene before an exon that no earlier exon reaches; what follows the last exon isn't one."""
    w = Window.partitionBy("gene_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    g = genes.groupBy("gene_id").agg(F.min("start").alias("g_start"), F.max("end").alias("g_end"))
    e = exons.withColumn("_reach", F.max("end").over(w)).join(g, "gene_id")
    lo, hi = F.coalesce(F.greatest("_reach", "g_start"), "g_start"), F.least("start", "g_end")
    return e.select("chrom", lo.alias("f_start"), hi.alias("f_end"), "gene_id", F.lit("intron").alias("feature")).filter("f_start < f_end")


def noncoding(genes: DataFrame) -> DataFrame:
    return genes.filter(F.coalesce("gene_type", F.lit("")) != "protein_coding").select("chrom", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "gene_id", F.lit("noncoding").alias("feature"))


def utrs(rows: DataFrame, side: str) -> DataFrame:
    """One side (5 or 3) of UTR rows (chrom, start, end, gene_id, side)."""
    return rows.filter(F.col("side") == side).select("chrom", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "gene_id", F.lit(f"{side}UTR").alias("feature"))


def feature_table(genes: DataFrame, exons: DataFrame, utr_rows: DataFrame | None = None, features: tuple[str, ...] = tuple(k for k in PRIORITY if k != "intergenic"), up: int = 2000, down: int = 200, gene_types: list[str] | None = None) -> DataFrame:
    """All features (chrom, f_start, f_end, gene_id, feature) that are asked for."""
    if gene_types:
        genes = genes.filter(F.col("gene_type").isin(gene_types))
        exons = exons.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    make = {
        "promoter": lambda: promoters(genes, up, down),
        "TTS": lambda: tts(genes),
        "exon": lambda: exons.select("chrom", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "gene_id", F.lit("exon").alias("feature")),
        "intron": lambda: introns(exons, genes),
        "noncoding": lambda: noncoding(genes),
        "5UTR": lambda: utrs(utr_rows, "5") if utr_rows is not None else None,
        "3UTR": lambda: utrs(utr_rows, "3") if utr_rows is not None else None,
    }
    parts = [p for p in (make[f]() for f in features) if p is not None]
    return reduce(DataFrame.unionByName, parts)


def check_names(sites: DataFrame, features: DataFrame) -> None:
    """Raises where no chromosome is named alike on both sides."""
    a, b = (x.select("chrom").filter("chrom is not null").distinct() for x in (sites, features))
    if a.join(b, "chrom", "left_semi").limit(1).collect():
        return
    some, others = (sorted(r[0] for r in x.limit(3).collect()) for x in (a, b))
    if some and others:
        raise ValueError(f"chromosomes are named differently: {some} and {others}")


def as_intervals(rows: DataFrame) -> DataFrame:
    """Sites as [pos, pos + 1); regions as they are."""
    return rows if "start" in rows.columns else rows.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})


def annotate_features(rows: DataFrame, features: DataFrame, genes: DataFrame) -> DataFrame:
    """For distinct (chrom, start, end): the best feature and its gene, all features and genes, TSS distance (upstream negative) and nearest TSS.

    Best by priority, then gene id; nearest TSS on the left at equal distance.
    Raises where rows and features have no chromosome name in common.
    """
    check_names(rows, features)
    r = as_intervals(rows).select("chrom", "start", "end").distinct()
    ranks = F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    f = features.select(F.col("chrom").alias("f_chrom"), "f_start", "f_end", "gene_id", "feature").withColumn("rank", ranks[F.col("feature")])
    hits = overlapping(r, f, ends=("start", "end", "f_start", "f_end"), chroms=("chrom", "f_chrom"))
    best = hits.groupBy("chrom", "start", "end").agg(F.min(F.struct("rank", "gene_id", "feature")).alias("b"), F.array_sort(F.collect_set("feature")).alias("all_features"), F.array_sort(F.collect_set("gene_id")).alias("all_genes"))
    one = tss(genes).groupBy("gene_id").agg(F.min_by(F.struct("tss", "strand"), F.struct("chrom", "start", "end")).alias("g"))
    out = r.join(best, ["chrom", "start", "end"], "left").withColumn("gene_id", F.col("b.gene_id")).join(one, "gene_id", "left")
    mid = F.expr("(start + end - 1) div 2")
    signed = F.when(F.col("g.strand") == "-", F.col("g.tss") - mid).otherwise(mid - F.col("g.tss"))
    out = out.select("chrom", "start", "end", F.coalesce("b.feature", F.lit("intergenic")).alias("feature_type"), "gene_id", "all_features", "all_genes", signed.alias("tss_distance"), mid.alias("_mid"))
    marks = tss(genes).groupBy("chrom", F.col("tss").alias("mark")).agg(F.min("gene_id").alias("nearest_gene"))
    near = nearest(out, marks, "nearest_gene", pos="_mid")
    return near.withColumn("nearest_distance", F.abs(F.col("_mid") - F.col("mark"))).drop("_mid", "mark")


def annotate_islands(rows: DataFrame, islands: DataFrame, shore: int = 2000, shelf: int = 4000) -> DataFrame:
    """Distinct (chrom, start, end) with cpg_context: island, shore, shelf or open_sea."""
    r = as_intervals(rows).select("chrom", "start", "end").distinct()
    wide = islands.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.greatest(F.lit(0), F.col("start") - shelf).alias("r_start"), (F.col("end") + shelf).alias("r_end"))
    hits = overlapping(r, wide)
    gap = F.greatest(F.col("i_start") - F.col("end") + 1, F.col("start") - F.col("i_end") + 1, F.lit(0))
    rank = F.when(gap == 0, 0).when(gap <= shore, 1).otherwise(2)
    g = hits.groupBy("chrom", "start", "end").agg(F.min(rank).alias("rank"))
    names = F.element_at(F.array(*map(F.lit, ("island", "shore", "shelf"))), F.col("rank") + 1)
    return r.join(g, ["chrom", "start", "end"], "left").select("chrom", "start", "end", F.coalesce(F.when(F.col("rank").isNotNull(), names), F.lit("open_sea")).alias("cpg_context"))


def annotation_source(path: str) -> str:
    name = path.lower()
    return "gtf" if ".gtf" in name or ".gff" in name else "refgene" if "refgene" in name or name.endswith((".txt", ".txt.gz")) else "gtf"
