"""BAM files made by hand."""

import gzip
import struct

import pytest

from cpgspark.operators import reads
from cpgspark.sources import bam


def alignment(name, ref, pos, cigar, seq, qual, flag=0, mapq=30, **tags):
    codes = "=ACMGRSVTWYHKDBN"
    n = [codes.index(c) for c in seq]
    half = bytes(a << 4 | b for a, b in zip(n[::2], [*n[1::2], 0]))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(op)) for k, op in cigar) + half + bytes(ord(q) - 33 for q in qual)
    for tag, v in tags.items():
        if isinstance(v, list):
            body += tag.encode() + b"BC" + struct.pack("<i", len(v)) + bytes(v)
        elif isinstance(v, int):
            body += tag.encode() + b"i" + struct.pack("<i", v)
        else:
            body += tag.encode() + b"Z" + v.encode() + b"\0"
    return struct.pack("<i", len(body)) + body


def write(path, rows):
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2)
    for name in (b"1\0", b"chr2\0"):
        head += struct.pack("<i", len(name)) + name + struct.pack("<i", 10**6)
    whole = head + b"".join(rows)
    path.write_bytes(b"".join(gzip.compress(whole[i : i + 97]) for i in range(0, len(whole), 97)) + gzip.compress(b""))
    return str(path)


def test_calls_of_both_callers(spark, tmp_path):
    rows = [
        alignment("r1", 0, 100, [(2, "S"), (3, "M"), (1, "I"), (2, "D"), (2, "M")], "AACGTTCG", "IIIIIII!", XM="..Z.z.Zx", XG="CT", NM=3),
        alignment("r2", 1, 50, [(4, "M")], "ACGC", "IIII", 16, XM="z.X.", XG="GA"),
        alignment("low", 0, 100, [(2, "M")], "CG", "II", mapq=5, XM="ZZ"),
        alignment("dup", 0, 100, [(2, "M")], "CG", "II", 1024, XM="ZZ"),
        alignment("none", -1, -1, [], "CG", "II", 4, 0),
    ]
    mm = [alignment("m", 0, 10, [(5, "M")], "ACGCC", "IIIII", MM="C+m,1,0;", ML=[200, 10])]
    obs = spark.createDataFrame([("a", write(tmp_path / "x.bam", rows)), ("b", write(tmp_path / "y.bam", mm))], "sample_id string, path string")
    al = bam.read_bam(spark, obs).cache()
    assert al.count() == 6 and {r["chrom"] for r in al.collect()} == {"1", "chr2", None}
    got = sorted((r["sample"], r["read_id"], r["chrom"], r["pos"], r["methylation_status"]) for r in bam.calls(al).collect())
    assert got == [("a", "r1", "1", 100, 1), ("a", "r1", "1", 102, 0), ("a", "r1", "1", 105, 1), ("a", "r2", "chr2", 50, 0)]
    assert bam.calls(al, context="any").count() == 5
    inside = spark.createDataFrame([("1", 101, 105)], "chrom string, start int, end int")
    assert [r["pos"] for r in bam.calls(al, regions=inside).collect()] == [102]
    assert sorted((r["pos"], r["methylation_status"]) for r in bam.calls(al, "methyldackel").collect()) == [(13, 1), (14, 0)]
    with pytest.raises(ValueError):
        bam.calls(al, "other")
    snv = spark.createDataFrame([("1", 101, "G", "A"), ("chr2", 51, "C", "T")], "chrom string, pos int, ref string, alt string")
    assert sorted((r["read_id"], r["base"], r["strand"]) for r in bam.bases_at(al, snv).collect()) == [("r1", "G", "+"), ("r2", "C", "-")]
    with pytest.raises(ValueError):
        [*bam.records(gzip.compress(b"no"))]
    with pytest.raises(ValueError):
        [*bam.records((tmp_path / "x.bam").read_bytes()[:-40])]


def test_entropy_and_alleles_from_files(spark, tmp_path):
    rows = []
    for r in range(40):
        allele = "AG"[r % 2]
        xm = "".join("Zz"[(r % 2) ^ (k == 3 and r < 2)] if k in (1, 3) else "." for k in range(5))
        rows.append(alignment(f"r{r}", 0, 100, [(5, "M")], "ACTC" + allele, "IIIII", XM=xm, XG="CT"))
    obs = spark.createDataFrame([("s", write(tmp_path / "x.bam", rows))], "sample_id string, path string")
    al = bam.read_bam(spark, obs).cache()
    c = bam.calls(al)
    e = reads.entropy(c, 2).collect()
    assert len(e) == 1 and e[0]["n_reads"] == 40 and e[0]["n_patterns"] == 4 and 1 < e[0]["entropy"] < 2
    snv = spark.createDataFrame([("1", 104, "A", "G")], "chrom string, pos int, ref string, alt string")
    out = sorted((r["pos"], r["pvalue"]) for r in reads.allele_specific(c, bam.bases_at(al, snv), snv).collect())
    assert [p for p, _ in out] == [101, 103] and out[0][1] < 1e-6
