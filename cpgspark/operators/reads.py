"""Read-level calls: decoding, entropy of patterns, allele-specific methylation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import fisher_col
from .fdr import adjust

CALLS = "read_id string, chrom string, pos int, methylation_status byte, base_qual byte, mapq byte, strand string"
#: Context letters of call strings; upper case is methylated.
CONTEXT = {"CpG": "Zz", "CHG": "Xx", "CHH": "Hh"}


def keep_reads(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Reads (flag, mapq) that are mapped, primary, unique and of good quality."""
    return reads.filter((F.col("flag").bitwiseAND(4 | 256 | 512 | 1024 | 2048) == 0) & (F.col("mapq") >= min_mapq))


def decode_call_strings(reads: DataFrame, context: str = "CpG", min_baseq: int = 20) -> DataFrame:
    """One row per call of a letter string aligned to the read (read_id, chrom, start, calls, quals, mapq, strand; quals as code points from 33)."""
    up, low = CONTEXT[context]
    r = reads.withColumn("_c", F.explode(F.expr("filter(transform(sequence(1, length(calls)), i -> struct(i - 1 as i, substring(calls, i, 1) as l, ascii(substring(quals, i, 1)) - 33 as q)), " + f"c -> c.l in ('{up}', '{low}') and c.q >= {min_baseq})")))
    return r.select("read_id", "chrom", (F.col("start") + F.col("_c.i")).cast("int").alias("pos"), (F.col("_c.l") == up).cast("byte").alias("methylation_status"), F.col("_c.q").cast("byte").alias("base_qual"), F.col("mapq").cast("byte").alias("mapq"), "strand")


def decode_mm(sequence: str, mm: str, ml: list[int], reverse: bool = False) -> list[tuple[int, int]]:
    """(offset in the read, 1 if the likelihood is at least 128) of the cytosines that an MM tag names."""
    seq = sequence[::-1].translate(str.maketrans("ACGT", "TGCA")) if reverse else sequence
    out, used = [], 0
    for part in mm.rstrip(";").split(";"):
        head, *skips = part.split(",")
        if not head.startswith("C+m"):
            used += len(skips)
            continue
        sites = [i for i, b in enumerate(seq) if b == "C"]
        at = -1
        for s in skips:
            at += int(s) + 1
            i = sites[at]
            out.append((len(seq) - 1 - i if reverse else i, int(ml[used] >= 128)))
            used += 1
    return sorted(out)


def decode_mm_reads(reads: DataFrame, min_baseq: int = 20) -> DataFrame:
    """The same for a table of reads (read_id, chrom, start, sequence, quals, mm, ml, mapq, strand) aligned without gaps."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for off, m in decode_mm(r.sequence, r.mm, list(r.ml), r.strand == "-"):
                    q = ord(r.quals[off]) - 33
                    if q >= min_baseq:
                        rows.append((r.read_id, r.chrom, r.start + off, m, q, r.mapq, r.strand))
            yield pd.DataFrame(rows, columns=["read_id", "chrom", "pos", "methylation_status", "base_qual", "mapq", "strand"])

    return reads.mapInPandas(decode, CALLS)


def entropy(calls: DataFrame, window: int = 4, min_reads: int = 10, keys: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """Shannon entropy in bits of the patterns of each run of `window` consecutive sites, over reads that cover them all."""
    w = Window.partitionBy(*keys).orderBy("pos")
    sites = calls.select(*keys, "pos").distinct()
    sites = sites.withColumns({f"p{i}": F.lead("pos", i).over(w) for i in range(1, window)}).filter(F.col(f"p{window - 1}").isNotNull())
    r = Window.partitionBy(*keys, "read_id").orderBy("pos")
    once = calls.groupBy(*keys, "read_id", "pos").agg(F.max("methylation_status").cast("int").alias("s"))
    seen = once.withColumns({**{f"q{i}": F.lead("pos", i).over(r) for i in range(1, window)}, **{f"s{i}": F.lead("s", i).over(r) for i in range(1, window)}})
    pattern = F.col("s") + sum((F.col(f"s{i}") * (1 << i) for i in range(1, window)), F.lit(0))
    seen = seen.filter(F.col(f"q{window - 1}").isNotNull()).withColumn("pattern", pattern)
    on = [*keys, "pos"]
    both = seen.join(sites, on).filter(" and ".join(f"q{i} = p{i}" for i in range(1, window)))
    g = both.groupBy(*on, "pattern").agg(F.count(F.lit(1)).alias("k"), F.max(f"p{window - 1}").alias("last"))
    t = g.groupBy(*keys, F.col("pos").alias("start"), (F.col("last") + 1).alias("end")).agg(F.sum("k").alias("n_reads"), F.sum(F.col("k") * F.log2("k")).alias("_kl"), F.count(F.lit(1)).alias("n_patterns"))
    return t.filter(F.col("n_reads") >= min_reads).withColumn("entropy", F.log2("n_reads") - F.col("_kl") / F.col("n_reads")).drop("_kl")


def phase_reads(read_bases: DataFrame, snvs: DataFrame, min_snvs: int = 1) -> DataFrame:
    """(sample, read_id, haplotype) from bases of reads at heterozygous SNVs (chrom, pos, ref, alt).

    A base that conversion may have made says nothing: T at a C on the plus
    strand, A at a G on the minus strand.  Reads that agree with both
    haplotypes are left out.
    """
    b = read_bases.join(snvs, ["chrom", "pos"])
    unclear = lambda base, strand, have: (F.col("strand") == strand) & (F.col(have) == {"+": "C", "-": "G"}[strand]) & (F.col("base") == base)
    blurred = unclear("T", "+", "ref") | unclear("T", "+", "alt") | unclear("A", "-", "ref") | unclear("A", "-", "alt")
    hap = F.when(~blurred & (F.col("base") == F.col("ref")), 0).when(~blurred & (F.col("base") == F.col("alt")), 1)
    g = b.withColumn("h", hap).filter("h is not null").groupBy("sample", "read_id").agg(F.min("h").alias("haplotype"), F.max("h").alias("other"), F.countDistinct("chrom", "pos").alias("n"))
    return g.filter((F.col("haplotype") == F.col("other")) & (F.col("n") >= min_snvs)).select("sample", "read_id", "haplotype")


def allele_counts(calls: DataFrame, phased: DataFrame, min_reads: int = 10) -> DataFrame:
    c = calls.join(phased, ["sample", "read_id"])
    one = lambda h, m: F.sum(F.when((F.col("haplotype") == h) & (F.col("methylation_status") == m), 1).otherwise(0))
    g = c.groupBy("sample", "chrom", "pos").agg(one(0, 1).alias("m0"), one(0, 0).alias("u0"), one(1, 1).alias("m1"), one(1, 0).alias("u1"))
    return g.filter((F.col("m0") + F.col("u0") >= min_reads) & (F.col("m1") + F.col("u1") >= min_reads))


def allele_specific(calls: DataFrame, read_bases: DataFrame, snvs: DataFrame, min_reads: int = 10, min_snvs: int = 1) -> DataFrame:
    """Fisher tests of the two haplotypes at each site; q over all samples together."""
    g = allele_counts(calls, phase_reads(read_bases, snvs, min_snvs), min_reads)
    g = g.withColumns({"pvalue": fisher_col("m0", "u0", "m1", "u1"), "meth_diff": F.col("m0") / (F.col("m0") + F.col("u0")) - F.col("m1") / (F.col("m1") + F.col("u1"))})
    return adjust(g)
