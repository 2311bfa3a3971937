"""Every reader on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from cpgspark.operators import prep, reads
from cpgspark.sources import readers, results, writers
from cpgspark.sources.store import count_rows, read_store


def sheet(spark, rows):
    return spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "sample_id string, path string, treatment int")


def found(store):
    return sorted((r["sample"], r["chrom"], r["pos"], r["N_meth"], r["coverage"]) for r in store.collect())


def cov(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join("\t".join(map(str, x)) + "\n" for x in lines))
    return str(path)


def test_files_of_equal_names_are_parted(spark, tmp_path):
    a = cov(tmp_path / "a" / "CpG.cov", ("chr1", 11, 11, 50, 5, 5))
    b = cov(tmp_path / "b b" / "CpG.cov", ("chr1", 11, 11, 90, 9, 1))
    got = found(readers.read_bismark(spark, sheet(spark, [("x", a), ("y", f"file://{b}"), ("z", a)])))
    assert got == [("x", "chr1", 10, 5, 10), ("y", "chr1", 10, 9, 10), ("z", "chr1", 10, 5, 10)]
    with pytest.raises(ValueError):
        readers.read_bismark(spark, sheet(spark, [("x", a), ("x", b)]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_bismark(spark, sheet(spark, [("x", a), ("y", str(tmp_path / "none.cov"))])).count()


def test_each_file_has_its_own_base(spark, tmp_path):
    one = cov(tmp_path / "one.cov", *(("chr1", p, p, 50, 1, 1) for p in range(11, 400, 10)))
    zero = cov(tmp_path / "zero.cov", *(("chr1", p, p + 1, 50, 2, 1) for p in range(10, 399, 10)))
    odd = cov(tmp_path / "odd.cov", ("chr1", 10, 12, 50, 3, 1), ("chr1", 30, 30, 50, 3, 1))
    empty = cov(tmp_path / "empty.cov")
    obs = sheet(spark, [("a", one), ("b", zero), ("c", odd), ("d", empty)])
    got = found(readers.read_bismark(spark, obs))
    assert [p for s, _, p, *_ in got if s == "a"] == [p for s, _, p, *_ in got if s == "b"] == [*range(10, 399, 10)]
    assert [p for s, _, p, *_ in got if s == "c"] == [10, 30] and not [1 for s, *_ in got if s == "d"]
    forced = found(readers.read_bismark(spark, obs, base="one_based"))
    assert min(p for s, _, p, *_ in forced if s == "b") == 9
    with pytest.raises(ValueError):
        readers.read_bismark(spark, obs, base="two_based")


def test_track_files_and_twelve_columns(spark, tmp_path):
    path = tmp_path / "m.bedGraph.gz"
    path.write_bytes(gzip.compress(b"track type=bedGraph\nchr1\t10\t11\t25\t1\t3\nchr1\t20\t20\t0\t0\t2\n"))
    assert found(readers.read_methyldackel(spark, sheet(spark, [("m", str(path))]))) == [("m", "chr1", 10, 1, 4), ("m", "chr1", 20, 0, 2)]
    bed = cov(tmp_path / "c.bed", ("chr1", 10, 11, 1, 2, 50, 2, 3, 66, 3, 5, 60), ("GL1", 7, 8, 0, 1, 0, 0, 0, 0, 0, 1, 0))
    assert found(readers.read_combined_bed(spark, sheet(spark, [("c", bed)]), canonical_only=True)) == [("c", "chr1", 10, 3, 5)]


def test_run_folder_takes_exact_ids(spark, tmp_path):
    where = tmp_path / "results" / "bismark" / "deduplicated"
    cov(where / "s1.deduplicated.bismark.cov", ("chr1", 11, 11, 100, 3, 0))
    cov(where / "s10.bismark.cov", ("chr1", 11, 11, 100, 14, 0))
    (tmp_path / "samplesheet.csv").write_text("sample_id,group,age\ns1,t,30\ns10,c,40\nother,x,50\n")
    c = readers.read_nfcore(spark, str(tmp_path), "t", "c")
    assert found(c.store) == [("s1", "chr1", 10, 3, 3), ("s10", "chr1", 10, 14, 14)] and c.treated == ["s1"] and "age" in c.obs.columns
    (tmp_path / "samplesheet.csv").write_text("sample_id,group\ns1,t\ns2,c\n")
    with pytest.raises(FileNotFoundError, match="s2"):
        readers.read_nfcore(spark, str(tmp_path), "t", "c")
    with pytest.raises(ValueError):
        readers.read_nfcore(spark, str(tmp_path), "p", "q")
    assert readers.sample_ids_of("a.b.deduplicated.bismark.cov.gz") == ["a.b.deduplicated.bismark.cov.gz", "a.b", "a.b.deduplicated", "a.b.deduplicated.bismark", "a"]


def test_strands_from_the_reference(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">chr1 x\nAACG\nTTCG\n>chr2\nCG\n")
    blocks = readers.read_fasta_blocks(spark, str(tmp_path / "r.fa"), 3)
    store = readers.read_bismark(spark, sheet(spark, [("a", cov(tmp_path / "a.cov", ("chr1", 3, 3, 0, 1, 0), ("chr1", 4, 4, 0, 2, 0), ("chr1", 8, 8, 0, 4, 0), ("chr1", 1, 1, 0, 1, 1)))]), merge=False)
    got = prep.infer_strand(store, blocks, 3)
    assert sorted((r["pos"], r["strand"]) for r in got.collect()) == [(0, "*"), (2, "+"), (3, "-"), (7, "-")]
    assert found(prep.merge_strands(got)) == [("a", "chr1", 0, 1, 2), ("a", "chr1", 2, 3, 3), ("a", "chr1", 6, 4, 4)]


def test_samples_are_converted_one_by_one(spark, tmp_path):
    a, b = cov(tmp_path / "a.cov", ("chr1", 11, 11, 0, 1, 0), ("chr2", 11, 11, 0, 1, 0)), cov(tmp_path / "b.cov", ("chr1", 11, 11, 0, 2, 0))
    out, obs = str(tmp_path / "store"), sheet(spark, [("a", a), ("b", b)])
    assert count_rows(results.ensure_converted(spark, obs, out)) == 3
    stamp = {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "sample=b").rglob("*.parquet")}
    cov(tmp_path / "a.cov", ("chr1", 21, 21, 0, 5, 0))
    assert found(results.ensure_converted(spark, obs, out)) == [("a", "chr1", 20, 5, 5), ("b", "chr1", 10, 2, 2)]  # chr2 of a is gone
    assert stamp == {f: f.stat().st_mtime_ns for f in (tmp_path / "store" / "sample=b").rglob("*.parquet")}
    assert found(results.ensure_converted(spark, obs.filter("sample_id = 'b'"), out, base="zero_based")) == [("b", "chr1", 11, 2, 2)]
    readers.convert_sample(spark, a, "c", out)
    assert found(read_store(spark, out).filter("sample = 'c'")) == [("c", "chr1", 20, 5, 5)]


def test_transcripts_and_utrs(spark, tmp_path):
    (tmp_path / "r.txt").write_text("0\tNM_1\tchr1\t+\t100\t500\t0\t0\t2\t100,300,\t200,500,\t0\tG1\n0\tNR_2\tchr1\t-\t900\t990\t0\t0\t1\t900,\t990,\t0\tG2\n")
    genes, exons = readers.read_refgene(spark, str(tmp_path / "r.txt"))
    assert sorted((r["gene_id"], r["start"], r["gene_type"], r["gene_name"]) for r in genes.collect()) == [("NM_1", 100, "protein_coding", "G1"), ("NR_2", 900, "noncoding", "G2")]
    assert sorted((r["start"], r["end"]) for r in exons.collect()) == [(100, 200), (300, 500), (900, 990)]
    (tmp_path / "g.gtf").write_text('chr1\th\tfive_prime_utr\t101\t150\t.\t+\t.\tgene_id "g";\nchr1\th\tthree_prime_utr\t401\t500\t.\t+\t.\tgene_id "g";\n')
    assert sorted((r["start"], r["end"], r["side"]) for r in readers.read_gtf(spark, str(tmp_path / "g.gtf"))[2].collect()) == [(100, 150, "5"), (400, 500, "3")]


def test_reports_of_samples(spark, tmp_path):
    one = "Number of alignments analysed in total:\t120\nMapping efficiency:\t71.5%\nC methylated in CpG context:\t66.0%\n"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "s1_bt2_PE_report.txt").write_text(one)
    (tmp_path / "x" / "s10_PE_report.txt").write_text(one.replace("120", "999"))
    (tmp_path / "x" / "s2_SE_report.txt").write_text("Mapping efficiency:\t10%\n")
    (tmp_path / "q" / "s1_stats").mkdir(parents=True)
    (tmp_path / "q" / "s1_stats" / "genome_results.txt").write_text("     mean coverageData = 12.5X\n     std coverageData = 3X\n")
    got = {r["sample_id"]: r for r in readers.read_reports(spark, str(tmp_path), ["s1", "s2", "s3"]).collect()}
    assert (got["s1"]["bismark_aligned_reads"], got["s1"]["bismark_mapping_efficiency"], got["s1"]["bismark_pct_meth_cpg"], got["s1"]["qualimap_mean_coverage"]) == (120, 71.5, 66, 12.5)
    assert got["s2"]["bismark_mapping_efficiency"] == 10 and got["s2"]["qualimap_std_coverage"] is None and got["s3"]["bismark_aligned_reads"] is None
    (tmp_path / "m.txt").write_text("CpG context (R1)\n====\nposition\n1\t3\t1\t75.0\t4\n")
    assert [(r["file"], r["context"], r["position"], r["coverage"]) for r in readers.read_mbias(spark, str(tmp_path / "m.txt")).collect()] == [("m.txt", "CpG", 1, 4)]


def test_variants_and_read_tables(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n1\t51\t.\tA\tG\t.\t.\t.\tGT:DP\t0/1:9\n1\t52\t.\tA\tG\t.\t.\t.\tGT\t1/1\n1\t53\t.\tAT\tG\t.\t.\t.\tGT\t0|1\n")
    assert [tuple(r) for r in readers.read_vcf_het(spark, str(tmp_path / "v.vcf")).collect()] == [("1", 50, "A", "G")]
    t = spark.createDataFrame([("r1", 0, 60), ("r2", 4, 60), ("r3", 1024, 60), ("r4", 2048, 60), ("r5", 16, 9), ("r6", 83, 10)], "read_id string, flag int, mapq int")
    assert [r["read_id"] for r in reads.keep_reads(t).collect()] == ["r1", "r6"]
    mm = spark.createDataFrame([("a", "1", 100, "ACGCC", "IIII!", "C+m,1,0;", [200, 250], 30, "+"), ("b", "1", 200, "GGT", "III", "C+m,0;", [10], 30, "-")], "read_id string, chrom string, start int, sequence string, quals string, mm string, ml array<int>, mapq int, strand string")
    assert sorted((r["read_id"], r["pos"], r["methylation_status"]) for r in reads.decode_mm_reads(mm).collect()) == [("a", 103, 1), ("b", 201, 0)]


def test_text_sinks(spark, tmp_path):
    regions = spark.createDataFrame([("2", 5, 9, "hypo", 1e-3, [1, 2], {"a": 1.5}), ("1", 5, 9, "hyper", 0.0, None, None), ("1", 20, 30, "mixed", None, [], None)], "chrom string, start int, end int, dmr_type string, qvalue double, l array<int>, m map<string,double>")
    assert [tuple(r) for r in writers.regions_bed(regions).orderBy("name").collect()] == [("1", 5, 9, "dmr_1", 1000, "+"), ("1", 20, 30, "dmr_2", 0, "."), ("2", 5, 9, "dmr_3", 300, "-")]
    writers.write_table(regions.orderBy("chrom", "start").coalesce(1), str(tmp_path / "t"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines[0].startswith("chrom\tstart") and "1; 2" in lines[-1] and '{\\"a\\":1.5}' in lines[-1]
    sites = spark.createDataFrame([("1", 5, 0.01, 0.02, 0.3), ("1", 9, 0.2, 0.4, 0.1)], "chrom string, pos int, pvalue double, qvalue double, qvalue_variance double")
    assert [r["pos"] for r in writers.significant_table(sites).collect()] == [5] and writers.significant_table(sites, full=True).count() == 2
    assert writers.variance_table(sites).count() == 0 and writers.variance_table(sites, 0.2).count() == 1
    writers.export_tables({"sites": sites, "regions": regions}, str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e" / "sites"), sep="\t", header=True).count() == 1 and spark.read.csv(str(tmp_path / "e" / "regions"), sep="\t", header=True).count() == 3
    store = spark.createDataFrame([("a", "1", 9, "-", "CpG", 1, 3, 4), ("b", "1", 9, "+", "CpG", 0, 0, 0)], "sample string, chrom string, pos int, strand string, context string, N_meth int, N_unmeth int, coverage int")
    writers.write_per_sample(store, str(tmp_path / "p"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["1.10\t1\t10\tR\t4\t25.0\t75.0"]
    made = writers.report_json(store.groupBy("sample").agg(F.sum("coverage").alias("c")), "x")
    assert made == '{"data": {"a": {"c": 4}, "b": {"c": 0}}, "id": "x", "plot_type": "generalstats"}'
