"""Text formats as DataFrames: coverage files, intervals, genes, reports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import is_canonical
from ..session import Cohort, saved
from .store import SCHEMA, write_store

COVERAGE = "chrom string, start int, end int, percent double, N_meth int, N_unmeth int"
COMBINED = "chrom string, start int, end int, fwd_m int, fwd_t int, fwd_pct double, rev_m int, rev_t int, rev_pct double, m int, t int, pct double"


#: Ways to say where positions start, and what is added to them.
BASES = {"auto": None, "one_based": -1, "zero_based": 0}


def read_samplesheet(spark: SparkSession, path: str, treatment_group: str | None = None, control_group: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """CSV of sample_id, group, path and covariates, all strings; treatment is 1 or 0 in two-group mode.

    With `groups`, only these are kept, and the first is the control.
    """
    obs = spark.read.csv(path, header=True)
    missing = {"sample_id", "group", "path"} - {*obs.columns}
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    if groups:
        obs = obs.filter(F.col("group").isin(groups))
        treatment = F.when(F.col("group") == groups[0], 0).otherwise(1)
    else:
        obs = obs.filter(F.col("group").isin([treatment_group, control_group]))
        treatment = (F.col("group") == treatment_group).cast("int")
    return obs.withColumn("treatment", treatment)


def coordinate_offset(rows: DataFrame, base: str = "auto") -> Column:
    """Aggregate: -1 where positions count from 1 (90 % of the rows start where they end), 0 where they count from 0 or it can't be told."""
    if base not in BASES:
        raise ValueError(f"the base is one of {sorted(BASES)}")
    if base != "auto":
        return F.lit(BASES[base])
    return F.when(F.avg((F.col("start") == F.col("end")).cast("double")) >= 0.9, -1).otherwise(0)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and folder, as Spark names the files that it reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _place(c: Column) -> Column:
    """A file's name without the ways to write its local scheme and its blanks."""
    return F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), "%20", " ")


def _samples_of(spark: SparkSession, obs: DataFrame) -> tuple[list[str], DataFrame]:
    """The paths of a sample sheet, and (sample, _place): files are known by their whole path, never by their name alone."""
    rows = obs.select("sample_id", "path").collect()  # one row per sample
    if len({r["sample_id"] for r in rows}) < len(rows):
        raise ValueError("a sample has two rows")
    if any(r["path"] is None for r in rows):
        raise ValueError("a sample has no path")
    paths = [qualified(spark, r["path"]) for r in rows]
    keyed = spark.createDataFrame([(r["sample_id"], p) for r, p in zip(rows, paths)], "sample string, p string")
    return sorted({*paths}), keyed.select("sample", _place(F.col("p")).alias("_place"))


def _by_sample(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of all files at once, each with the sample (or samples) whose path is its file's."""
    return rows.withColumn("_place", _place(F.col("_file"))).join(F.broadcast(keyed), "_place").drop("_place", "_file")  # one row per sample


def _offsets(spark: SparkSession, read: Callable[[list[str]], DataFrame], paths: list[str], base: str, kind: str) -> DataFrame:
    """(_place, _offset) of every file, told from its first 2,000 rows if the format leaves it open."""
    if base == "auto" and kind != "bismark":
        base = "zero_based"
    heads = reduce(DataFrame.unionByName, (read([p]).limit(2000 if base == "auto" else 1) for p in paths))
    found = heads.groupBy(_place(F.col("_file")).alias("_place")).agg(coordinate_offset(heads, base).alias("_offset")).collect()  # one row per file
    return spark.createDataFrame([(r["_place"], r["_offset"]) for r in found], "_place string, _offset int")


def _to_store(rows: DataFrame, context: str, canonical_only: bool, strand: str = "*") -> DataFrame:
    out = rows.select("chrom", (F.col("start") + F.col("_offset")).cast("int").alias("pos"), F.lit(strand).alias("strand"), F.lit(context).alias("context"), "N_meth", "N_unmeth", (F.col("N_meth") + F.col("N_unmeth")).alias("coverage"), "sample")
    return out.filter(is_canonical("chrom")) if canonical_only else out


def coverage_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Six-column coverage files (also gzipped); track lines are left out."""
    text = spark.read.text(paths).withColumn("_file", F.input_file_name()).filter(~F.col("value").startswith("track") & (F.length("value") > 0))
    parts = F.split("value", "\t")
    kinds = [x.split() for x in COVERAGE.split(", ")]
    return text.select(*(parts[i].cast(t).alias(n) for i, (n, t) in enumerate(kinds)), "_file")


def combined_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Twelve-column files with both strands collapsed, as six columns: m of t reads are methylated."""
    rows = spark.read.csv(paths, sep="\t", schema=COMBINED, comment="#").withColumn("_file", F.input_file_name()).filter("t is not null")
    return rows.select("chrom", "start", "end", F.col("pct").alias("percent"), F.col("m").alias("N_meth"), (F.col("t") - F.col("m")).alias("N_unmeth"), "_file")


#: Readers of the file formats.
FORMATS = {"bismark": coverage_rows, "methyldackel": coverage_rows, "combined_strand_bed": combined_rows}


def read_counts(spark: SparkSession, obs: DataFrame, kind: str = "bismark", context: str = "CpG", base: str = "auto", canonical_only: bool = False, reference: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """Store rows of the files of a sample sheet, all in one plan; each file has its own coordinate base."""
    from ..operators.prep import infer_strand, merge_pairs_by_position, merge_strands

    if kind not in FORMATS:
        raise ValueError(f"the format is one of {sorted(FORMATS)}")
    paths, keyed = _samples_of(spark, obs)
    read = lambda p: FORMATS[kind](spark, p)
    placed = keyed.join(_offsets(spark, read, paths, base, kind), "_place", "left").na.fill(0, ["_offset"])  # files without rows have no base
    store = _to_store(_by_sample(read(paths), placed), context, canonical_only)
    if reference is not None:
        store = infer_strand(store, reference)
        return merge_strands(store) if merge and context == "CpG" else store
    return merge_pairs_by_position(store) if merge and context == "CpG" else store


def read_bismark(spark: SparkSession, obs: DataFrame, context: str = "CpG", base: str = "auto", canonical_only: bool = False, reference: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """Six-column coverage files."""
    return read_counts(spark, obs, "bismark", context, base, canonical_only, reference, merge)


def read_methyldackel(spark: SparkSession, obs: DataFrame, context: str = "CpG", base: str = "auto", canonical_only: bool = False, reference: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """The same columns behind a track line, counted from 0."""
    return read_counts(spark, obs, "methyldackel", context, base, canonical_only, reference, merge)


def read_combined_bed(spark: SparkSession, obs: DataFrame, context: str = "CpG", canonical_only: bool = False, reference: DataFrame | None = None, merge: bool = True) -> DataFrame:
    """Twelve-column files with both strands collapsed."""
    return read_counts(spark, obs, "combined_strand_bed", context, "auto", canonical_only, reference, merge)


#: Endings of coverage files behind the sample's id, longest first.
ENDINGS = [d + b + ".cov" + z for d, b, z in product((".deduplicated", ""), (".bismark", ""), (".gz", ""))]


def sample_ids_of(name: str) -> list[str]:
    """The ids that a coverage file may stand for: its name, the name without an ending, and what is before the first dot."""
    return [name, *(name.removesuffix(e) for e in ENDINGS if name.endswith(e)), name.split(".")[0]]


def read_nfcore(spark: SparkSession, run_dir: str, treatment_group: str, control_group: str, sheet: str = "samplesheet.csv", folder: str = "results/bismark/deduplicated") -> Cohort:
    """Coverage files of a pipeline's run folder, found by exact sample id."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{run_dir}/{folder}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"{run_dir}/{folder}")
    files = sorted((x.getPath().getName() for x in fs.listStatus(where)), key=lambda n: (not n.endswith(".gz"), n))  # one per sample
    file_of: dict[str, str] = {}
    for f in files:
        if f.endswith((".cov", ".cov.gz")):
            for name in sample_ids_of(f):
                file_of.setdefault(name, f"{run_dir}/{folder}/{f}")
    obs = spark.read.csv(f"{run_dir}/{sheet}", header=True)
    if not {"sample_id", "group"} <= {*obs.columns}:
        raise ValueError("the sheet needs sample_id and group")
    obs = obs.drop("path").filter(F.col("group").isin([treatment_group, control_group]))
    names = [r[0] for r in obs.select("sample_id").collect()]
    if not names:
        raise ValueError("no sample is in either group")
    lost = [n for n in names if n not in file_of]
    if lost:
        raise FileNotFoundError(f"no coverage file for {lost}")
    paths = spark.createDataFrame([(n, file_of[n]) for n in {*names}], "sample_id string, path string")
    obs = obs.join(F.broadcast(paths), "sample_id").withColumn("treatment", (F.col("group") == treatment_group).cast("int"))
    return Cohort(spark, obs, read_bismark(spark, obs), notes={"run": run_dir})


def convert(rows: DataFrame, path: str) -> None:
    write_store(rows.select(*SCHEMA.fieldNames()), path)


def convert_sample(spark: SparkSession, path: str, sample: str, out: str, kind: str = "bismark", **options) -> None:
    """One file as the sample's part of a store; what the store has of the sample is replaced, other samples stay."""
    obs = spark.createDataFrame([(sample, path)], "sample_id string, path string")
    rows = read_counts(spark, obs, kind, **options)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/sample={sample}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = saved(rows, "converted")  # the old rows go only when the new ones are there
    fs.delete(folder, True)
    write_store(rows, out)


def read_bed(spark: SparkSession, path: str, id_column: int | None = 3) -> DataFrame:
    """chrom, start, end, region_id; comments, track and browser lines are left out, the id is a column or chrom:start-end."""
    t = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    p = F.split("value", "\\s+")
    made = F.concat(p[0], F.lit(":"), p[1], F.lit("-"), p[2])
    name = F.coalesce(F.get(p, F.lit(id_column)), made) if id_column is not None else made
    return t.select(p[0].alias("chrom"), p[1].cast("long").alias("start"), p[2].cast("long").alias("end"), name.alias("region_id"))


def _attribute(name: str):
    v = F.regexp_extract("attributes", name + r' "([^"]*)"', 1)
    return F.when(v != "", v)


def read_gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, exons, utrs), starts counted from 0."""
    kinds = "chrom string, source string, kind string, start long, end long, score string, strand string, frame string, attributes string"
    t = spark.read.csv(path, sep="\t", comment="#", quote="", schema=kinds).withColumn("start", F.col("start") - 1)
    t = t.withColumns({"gene_id": _attribute("gene_id"), "gene_name": _attribute("gene_name"), "gene_type": F.coalesce(_attribute("gene_type"), _attribute("gene_biotype"), F.lit(""))})
    cols = ["chrom", "start", "end", "strand", "gene_id"]
    side = F.when(F.col("kind") == "five_prime_utr", "5").when(F.col("kind") == "three_prime_utr", "3")
    return t.filter("kind = 'gene'").select(*cols, "gene_name", "gene_type"), t.filter("kind = 'exon'").select(*cols), t.withColumn("side", side).filter("side is not null").select(*cols, "side")


def read_refgene(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genes, exons) of a transcript table; the type is that of the accession's prefix."""
    p = F.split("value", "\t")
    t = spark.read.text(path).select(p[1].alias("gene_id"), p[2].alias("chrom"), p[3].alias("strand"), p[4].cast("long").alias("start"), p[5].cast("long").alias("end"), F.filter(F.split(p[9], ","), lambda v: v != "").alias("s"), F.filter(F.split(p[10], ","), lambda v: v != "").alias("e"), F.get(p, F.lit(12)).alias("gene_name"))
    genes = t.select("chrom", "start", "end", "strand", "gene_id", "gene_name", F.when(F.col("gene_id").startswith("NM_"), "protein_coding").otherwise("noncoding").alias("gene_type"))
    x = F.explode(F.arrays_zip("s", "e"))
    exons = t.select("chrom", "strand", "gene_id", x.alias("x")).select("chrom", F.col("x.s").cast("long").alias("start"), F.col("x.e").cast("long").alias("end"), "strand", "gene_id")
    return genes, exons


def read_vcf_het(spark: SparkSession, path: str) -> DataFrame:
    """Heterozygous SNVs of the first sample: chrom, pos (from 0), ref, alt."""
    t = spark.read.csv(path, sep="\t", comment="#", quote="").toDF(*(f"c{i}" for i in range(len(spark.read.csv(path, sep="\t", comment="#", quote="").columns))))
    gt = F.split("c9", ":")[0]
    return t.filter(gt.isin("0/1", "1/0", "0|1", "1|0") & (F.length("c3") == 1) & (F.length("c4") == 1)).select(F.col("c0").alias("chrom"), (F.col("c1").cast("int") - 1).alias("pos"), F.col("c3").alias("ref"), F.col("c4").alias("alt"))


def read_fasta_blocks(spark: SparkSession, path: str, block: int = 10_000) -> DataFrame:
    """chrom, block and bases of a FASTA file, for strand inference."""
    whole = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for v in pdf["value"]:
                head, _, body = v.partition("\n")
                seq = body.replace("\n", "").replace("\r", "")
                n = range(0, len(seq), block)
                yield pd.DataFrame({"chrom": head.split()[0], "block": [i // block for i in n], "bases": [seq[i : i + block] for i in n]})

    return whole.mapInPandas(cut, "chrom string, block int, bases string")


#: Lines of alignment reports and of coverage reports, by the metric that they give.
REPORT_LINES = {
    "bismark_aligned_reads": r"Number of alignments analysed in total:\s*(\d+)",
    "bismark_unique_alignments": r"Number of paired-end alignments with a unique best hit:\s*(\d+)",
    "bismark_mapping_efficiency": r"Mapping efficiency:\s*([0-9.]+)%",
    "bismark_pct_meth_cpg": r"C methylated in CpG context:\s*([0-9.]+)%",
    "bismark_pct_meth_chg": r"C methylated in CHG context:\s*([0-9.]+)%",
    "bismark_pct_meth_chh": r"C methylated in CHH context:\s*([0-9.]+)%",
}
QUALIMAP_LINES = {
    "qualimap_mean_coverage": r"mean coverageData =\s*([0-9.]+)X",
    "qualimap_std_coverage": r"std coverageData =\s*([0-9.]+)X",
}


def read_reports(spark: SparkSession, run_dir: str, samples: list[str]) -> DataFrame:
    """One row per sample with the metrics of its reports in a run folder, null where a report or a line is missing.

    A sample's alignment report is a `..._PE_report.txt` (or else `..._SE_report.txt`)
    whose name is the id, or goes on behind it with no letter or digit; its
    coverage report is the genome_results.txt in such a folder.
    """
    names = spark.createDataFrame([(s, re.escape(s)) for s in samples], "sample_id string, rx string")

    def found(pattern: str, part: int, ends: str, lines: dict[str, str]) -> DataFrame:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(run_dir, wholetext=True)
        files = files.select("value", F.element_at(F.split(F.input_file_name(), "/"), part).alias("name"), F.input_file_name().alias("file"))
        own = files.join(F.broadcast(names), F.expr(f"name rlike concat('^', rx, '([^A-Za-z0-9].*)?{ends}$')"))  # one row per sample
        first = own.groupBy("sample_id").agg(F.min_by("value", F.struct(F.expr("name not like '%PE_report.txt'"), "file")).alias("value"))
        metric = lambda rx: F.regexp_extract("value", rx, 1)
        return first.select("sample_id", *(F.when(metric(rx) != "", metric(rx).cast("double")).alias(n) for n, rx in lines.items()))

    out = names.select("sample_id")
    return out.join(found("*_report.txt", -1, "_[PS]E_report\\.txt", REPORT_LINES), "sample_id", "left").join(found("genome_results.txt", -2, "", QUALIMAP_LINES), "sample_id", "left")


def parse_mbias(text: str) -> list[tuple[str, str, int, int, int, float, int]]:
    """(context, read, position, methylated, unmethylated, percent, coverage) of a per-position bias report."""
    rows, context, read = [], None, None
    for line in text.splitlines():
        head = re.match(r"(CpG|CHG|CHH) context(?: \((R[12])\))?", line)
        if head:
            context, read = head[1], head[2] or "R1"
        elif context and re.match(r"\d+\t", line):
            p, m, u, pct, c = [*line.split("\t"), "", "", "", ""][:5]
            rows.append((context, read, int(p), int(m or 0), int(u or 0), float(pct) if pct else None, int(c or 0)))
    return rows


def read_mbias(spark: SparkSession, pattern: str) -> DataFrame:
    t = spark.read.text(pattern, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, v in zip(pdf["file"], pdf["value"]):
                rows = pd.DataFrame(parse_mbias(v), columns=["context", "read", "position", "meth", "unmeth", "percent", "coverage"])
                yield rows.assign(file=f)

    return t.mapInPandas(parse, "context string, read string, position int, meth int, unmeth int, percent double, coverage int, file string")
