"""Hand-made cases and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cpgspark.functions import special
from cpgspark.operators import annotate, fdr, glm, intervals, plotdata, prep, qc, reads, regions, segment, site_tests, smooth
from cpgspark.session import Cohort
from cpgspark.sources import readers, store, writers


def counts(spark, rows):
    """rows: (sample, chrom, pos, strand, meth, unmeth)."""
    df = spark.createDataFrame(rows, "sample string, chrom string, pos int, strand string, m int, u int")
    return df.select("chrom", "pos", "strand", F.lit("CpG").alias("context"), F.col("m").alias("N_meth"), F.col("u").alias("N_unmeth"), (F.col("m") + F.col("u")).alias("coverage"), "sample")


def test_merge_pairs_takes_first_and_second_of_a_run(spark):
    s = counts(spark, [("a", "1", p, "*", 1, 2) for p in (10, 11, 12, 20, 30, 31)])
    got = {(r["pos"], r["coverage"], r["strand"]) for r in prep.merge_pairs_by_position(s).collect()}
    assert got == {(10, 6, "+"), (12, 3, "*"), (20, 3, "*"), (30, 6, "+")}


def test_merge_strands_without_minus_changes_nothing(spark):
    s = counts(spark, [("a", "1", 10, "*", 1, 2), ("a", "1", 11, "*", 3, 0)])
    assert sorted((r["pos"], r["strand"]) for r in prep.merge_strands(s).collect()) == [(10, "*"), (11, "*")]


def test_fdr_ranks_match_numpy_with_ties_and_nulls(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500) ** 2, 3)
    df = spark.createDataFrame([(i, float(v) if i % 7 else None) for i, v in enumerate(p)], "i int, pvalue double")
    got = {r["i"]: r["qvalue"] for r in fdr.adjust(df).collect()}
    keep = [i for i in range(500) if i % 7]
    q = np.sort(p[keep])
    raw = q * len(q) / np.arange(1, len(q) + 1)
    want = dict(zip(q, np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])))
    for i in range(500):
        assert got[i] is None if i % 7 == 0 else got[i] == pytest.approx(min(v for k, v in want.items() if k == p[i]), abs=1e-12)


def test_two_stage_is_never_stricter_than_bh_when_much_is_found(spark):
    p = [1e-6] * 60 + [0.3 + i / 200 for i in range(100)]
    df = spark.createDataFrame([(float(v),) for v in p], "pvalue double")
    bh = fdr.adjust(df, "fdr_bh").filter("reject").count()
    assert fdr.adjust(df, "fdr_tsbh").filter("reject").count() >= bh == 60


def test_chain_merge_by_hand(spark):
    rows = [("1", p, 0.001, 0.3) for p in (100, 200, 300)] + [("1", 250, 0.9, 0.0), ("1", 2000, 0.001, 0.3), ("1", 3000, 0.001, -0.4), ("1", 3100, 0.001, -0.4), ("1", 3200, 0.001, -0.4)]
    s = spark.createDataFrame(rows, "chrom string, pos int, pvalue double, meth_diff double")
    got = [(r["start"], r["end"], r["n_cpgs"], r["n_sig"], r["dmr_type"]) for r in regions.chain_merge(s, min_cpgs=3).orderBy("start").collect()]
    assert got == [(100, 301, 4, 3, "hyper"), (3000, 3201, 3, 3, "hypo")]


def test_point_and_interval_joins_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = [("1", int(x)) for x in rng.integers(0, 50_000, 300)]
    ivs = [("1", int(s), int(s + w)) for s, w in zip(rng.integers(0, 50_000, 60), rng.integers(1, 30_000, 60))]
    p = spark.createDataFrame(pts, "chrom string, pos int").distinct()
    i = spark.createDataFrame(ivs, "chrom string, start int, end int").distinct()
    want = sum(s <= x < e for _, x in {*pts} for _, s, e in {*ivs})
    assert intervals.points_in(p, i).count() == want
    j = i.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    assert intervals.overlapping(i, j).count() == sum(a < d and c < b for _, a, b in {*ivs} for _, c, d in {*ivs})


def test_nearest_prefers_left(spark):
    p = spark.createDataFrame([("1", 50), ("1", 51), ("2", 5)], "chrom string, pos int")
    m = spark.createDataFrame([("1", 0, "a"), ("1", 100, "b")], "chrom string, mark int, gene string")
    got = {(r["chrom"], r["pos"]): r["gene"] for r in intervals.nearest(p, m, "gene").collect()}
    assert got == {("1", 50): "a", ("1", 51): "b", ("2", 5): None}


def test_planted_effects_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for pos in range(0, 40_000, 200):
        hit = pos < 4000
        for s in range(6):
            b = np.clip((0.7 if hit and s < 3 else 0.3) + rng.normal(0, 0.03), 0.01, 0.99)
            n = int(rng.integers(15, 30))
            m = int(rng.binomial(n, b))
            rows.append((f"s{s}", "chr1", pos, "+", m, n - m))
    st = counts(spark, rows)
    out = site_tests.test_sites(st, ["s0", "s1", "s2"], ["s3", "s4", "s5"]).toPandas()
    found = out[out.reject]
    assert (found.pos < 4000).mean() > 0.9 and len(found) >= 18
    r = regions.chain_merge(spark.createDataFrame(out[["chrom", "pos", "pvalue", "meth_diff", "qvalue"]]), use_q=True).collect()
    assert len(r) >= 1 and r[0]["end"] <= 5000


def test_hmm_posteriors_and_path():
    x = np.array([0.9] * 20 + [0.1] * 20 + [np.nan] + [0.9] * 20)
    path = segment.segment(x, [0.1, 0.9], 0.9)
    assert segment.state_runs(path, 0) == [(20, 40)] or segment.state_runs(path, 0) == [(20, 41)]
    e = segment.log_emission(x, np.array([0.1, 0.9]))
    post = segment.posteriors(e, segment.transition(2, 0.9))
    assert np.allclose(post.sum(axis=1), 1) and post[30, 0] > 0.9


def test_kernels():
    pos = np.arange(0, 5000, 50)
    beta = 0.2 + pos / 10_000
    cov = np.full(len(pos), 10.0)
    assert smooth.local_polynomial(pos, beta, cov, 10, 500) == pytest.approx(beta, abs=1e-6)
    assert smooth.gaussian_beta(pos, np.full(len(pos), 0.4), cov, 300) == pytest.approx(0.4)
    gap = beta.copy()
    gap[10] = np.nan
    assert smooth.knn_impute(pos, gap, 2)[10] == pytest.approx(beta[10])
    assert np.isnan(smooth.knn_impute(np.array([0, 10**6]), np.array([0.5, np.nan]), 1)[1])


def test_irls_recovers_log_odds():
    n = np.full((1, 6), 1000.0)
    m = np.array([[700, 700, 700, 300, 300, 300]], float)
    x = np.column_stack([np.ones(6), [1, 1, 1, 0, 0, 0]])
    fit = glm.irls(m, n, x)
    assert fit["beta"][0] == pytest.approx([np.log(3 / 7), 2 * np.log(7 / 3)], abs=1e-6)
    assert glm.contrast(["Intercept", "a", "b"], "a - 2*b").tolist() == [[0, 1, -2]]
    obs = pd.DataFrame({"treatment": [1, 0, 1, 0], "age": ["30", "40", "50", "60"]})
    assert glm.design(obs, "~ treatment + age")[1] == ["Intercept", "treatment", "age"]
    with pytest.raises(ValueError):
        glm.design(obs, "~ treatment + nothing")


def test_nnls_and_power():
    a = np.random.default_rng(4).random((50, 3))
    assert qc.nnls(a, a @ [0.2, 0.0, 0.8]) == pytest.approx([0.2, 0, 0.8], abs=1e-8)
    assert qc.power(0.3, 50, 5) > qc.power(0.1, 50, 5)
    n = qc.power(0.2, 30, target=0.8)
    assert qc.power(0.2, 30, n) >= 0.8 > qc.power(0.2, 30, n - 1)


def test_permutations_are_repeatable_and_stratified():
    case, control = ["a", "b", "c"], ["d", "e", "f"]
    strata = dict(zip("abcdef", "xxyxyy"))
    one = fdr.permutation(3, case, control, strata=strata)
    assert one == fdr.permutation(3, case, control, strata=strata) and sum(strata[s] == "x" for s in one) == 2
    assert fdr.is_mirror(["d", "e", "f"], case, control)


def test_entropy_of_all_and_one_pattern(spark):
    rows = [("s", "1", f"r{r}", 4 * k, (r >> k) & 1) for r in range(16) for k in range(4)]
    rows += [("s", "2", f"q{r}", 4 * k, 1) for r in range(16) for k in range(4)]
    c = spark.createDataFrame(rows, "sample string, chrom string, read_id string, pos int, methylation_status int")
    got = {r["chrom"]: r["entropy"] for r in reads.entropy(c).collect()}
    assert got["1"] == pytest.approx(4) and got["2"] == pytest.approx(0)


def test_haplotypes_and_tags(spark):
    snv = spark.createDataFrame([("1", 50, "A", "G"), ("1", 51, "C", "G")], "chrom string, pos int, ref string, alt string")
    b = spark.createDataFrame([("s", "r1", "1", 50, "A", "+"), ("s", "r2", "1", 50, "G", "+"), ("s", "r3", "1", 51, "T", "+"), ("s", "r4", "1", 50, "A", "+"), ("s", "r4", "1", 51, "G", "+")], "sample string, read_id string, chrom string, pos int, base string, strand string")
    got = {r["read_id"]: r["haplotype"] for r in reads.phase_reads(b, snv).collect()}
    assert got == {"r1": 0, "r2": 1}
    assert reads.decode_mm("ACGCC", "C+m,1,0;", [200, 10]) == [(3, 1), (4, 0)]


def test_call_strings(spark):
    r = spark.createDataFrame([("r", "1", 100, "..Z.z..X", "IIIII!II", 30, "+")], "read_id string, chrom string, start int, calls string, quals string, mapq int, strand string")
    assert sorted((x["pos"], x["methylation_status"]) for x in reads.decode_call_strings(r).collect()) == [(102, 1), (104, 0)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.cov").write_text("chr1\t101\t101\t50\t2\t2\nchr1\t102\t102\t50\t1\t3\nchr9_x\t5\t5\t0\t0\t4\n")
    (tmp_path / "b.cov").write_text("track type=bedGraph\nchr1\t101\t101\t100\t4\t0\n")
    (tmp_path / "sheet.csv").write_text(f"sample_id,group,path,age\na,t,{tmp_path}/a.cov,30\nb,c,{tmp_path}/b.cov,40\n")
    obs = readers.read_samplesheet(spark, str(tmp_path / "sheet.csv"), "t", "c")
    s = readers.read_bismark(spark, obs, canonical_only=True)
    assert sorted((r["sample"], r["pos"], r["coverage"], r["N_meth"]) for r in s.collect()) == [("a", 100, 8, 3), ("b", 100, 4, 4)]
    c = Cohort(spark, obs, s)
    c.tables["t"] = s
    c.save(str(tmp_path / "saved"))
    back = Cohort.load(spark, str(tmp_path / "saved"))
    assert back.store.count() == 2 and back.treated == ["a"] and back.store.filter("coverage <> N_meth + N_unmeth").count() == 0
    writers.write_bedgraph(back.store, "b", str(tmp_path / "bg"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "bg")).collect()] == ["chr1\t100\t101\t1"]
    assert store.query_region(back.store, "chr1", 100, 101).count() == 2


def test_bed_and_genes(spark, tmp_path):
    (tmp_path / "x.bed").write_text("#c\ntrack\nchr1\t5\t10\tn1\nchr1\t20\t30\n")
    assert [r["region_id"] for r in readers.read_bed(spark, str(tmp_path / "x.bed")).orderBy("start").collect()] == ["n1", "chr1:20-30"]
    (tmp_path / "g.gtf").write_text('chr1\th\tgene\t101\t500\t.\t+\t.\tgene_id "g"; gene_type "protein_coding";\nchr1\th\texon\t101\t200\t.\t+\t.\tgene_id "g";\n')
    genes, exons, _ = readers.read_gtf(spark, str(tmp_path / "g.gtf"))
    assert [(r["start"], r["end"], r["gene_type"]) for r in genes.collect()] == [(100, 500, "protein_coding")] and exons.count() == 1


def test_mbias():
    rows = readers.parse_mbias("CpG context (R1)\n====\nposition\tcount methylated\tcount unmethylated\t% methylation\tcoverage\n1\t3\t1\t75.0\t4\n\nCHH context (R2)\n1\t0\t9\t0\t9\n")
    assert rows == [("CpG", "R1", 1, 3, 1, 75.0, 4), ("CHH", "R2", 1, 0, 9, 0.0, 9)]


def test_stream_sums(spark, tmp_path):
    from cpgspark.streaming.ingest import running_sums, stream_coverage

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.cov").write_text("chr1\t101\t101\t50\t2\t2\n")
    (src / "b.cov").write_text("chr1\t101\t101\t50\t1\t3\n")
    q = running_sums(stream_coverage(spark, str(src), "s")).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["pos"], r["N_meth"], r["coverage"]) for r in spark.table("sums").collect()] == [(100, 3, 8)]


def test_names_are_checked_over_all_contigs(spark):
    names = spark.range(12_000).select(F.concat(F.lit("a"), "id").alias("chrom"))
    one = spark.createDataFrame([("a11999",)], "chrom string")
    annotate.check_names(names, one.unionByName(spark.range(12_000).select(F.concat(F.lit("b"), "id").alias("chrom"))))
    sites = spark.createDataFrame([("1", 5)], "chrom string, pos int")
    genes = spark.createDataFrame([("chr1", 0, 10, "+", "g", "protein_coding")], "chrom string, start int, end int, strand string, gene_id string, gene_type string")
    with pytest.raises(ValueError, match="named differently"):
        annotate.annotate_features(sites, annotate.promoters(genes), genes)


def test_correlation_matrix_is_whole_and_in_order(spark):
    pairs = spark.createDataFrame([("b", "b", 1.0), ("b", "a", 0.25), ("b", "c", None), ("a", "a", None), ("a", "c", -0.5), ("c", "c", 1.0)], "sample_a string, sample_b string, corr double")
    m = qc.correlation_matrix(pairs, ["b", "a", "c"])
    assert m.columns == ["sample", "b", "a", "c"]
    assert [tuple(r) for r in m.collect()] == [("b", 1.0, 0.25, None), ("a", 0.25, 1.0, -0.5), ("c", None, -0.5, 1.0)]


def test_presets_and_what_is_given(spark):
    assert regions.PRESETS["strict"] == {"alpha": 1e-6, "min_abs_diff": 0.2, "merge_bp": 250, "min_cpgs": 5, "pct_sig": 0.5, "min_len": 100}
    assert regions.chain_settings("permissive", alpha=0.2, min_len=None) == regions.PRESETS["permissive"] | {"alpha": 0.2}
    assert [regions.resolve_min_cpgs(*a) for a in ((None, None), (None, "default"), (2, "strict"), (7, None))] == [5, 3, 2, 7]
    with pytest.raises(ValueError):
        regions.chain_settings("loose")
    rows = [("1", 100 * i, 1e-5, 0.3) for i in range(1, 6)]
    s = spark.createDataFrame(rows, "chrom string, pos int, pvalue double, meth_diff double")
    assert regions.chain_merge(s, "strict", combine=False).count() == 0
    assert regions.chain_merge(s, "strict", alpha=1e-4, combine=False).count() == 1
    assert regions.chain_merge(s, "default", min_cpgs=6, combine=False).count() == 0 and regions.chain_merge(s, "default", combine=False).count() == 1


def test_direction(spark):
    rows = [(-0.1, 6, 4, "hypo"), (0.1, 6, 4, "hyper"), (0.1, 5, 4, "mixed"), (0.1, 0, 0, "mixed"), (0.0, 3, 0, "hypo"), (None, 3, 1, "hyper"), (float("nan"), 1, 3, "hypo")]
    df = spark.createDataFrame(rows, "m double, up int, dn int, want string")
    assert [r["want"] for r in df.select("want", regions.direction("m", "up", "dn").alias("got")).filter("got <> want").collect()] == []


def test_power_against_simulation():
    assert qc.power(0.3, 10, 4) == pytest.approx(0.573, abs=2e-3)
    rng = np.random.default_rng(0)
    sd = np.sqrt(2 * 0.25 / 20 + 0.05**2)
    x, y = rng.normal(0.2, sd, (200_000, 5)), rng.normal(0, sd, (200_000, 5))
    t = (x.mean(1) - y.mean(1)) / np.sqrt((x.var(1, ddof=1) + y.var(1, ddof=1)) / 5)
    assert qc.power(0.2, 20, 5, dispersion=2) == pytest.approx((np.abs(t) > 2.306004).mean(), abs=5e-3)
    assert qc.power(0.2, 20, 1) == 0 and qc.power(1e-6, 20, target=0.99) == 10_000
    with pytest.raises(ValueError):
        qc.power(0.2, 0, 3)


def test_many_equal_p_values_are_one_row_of_the_ranking(spark):
    rng = np.random.default_rng(3)
    p = np.where(rng.random(4000) < 0.9, 1.0, rng.random(4000))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, pvalue double")
    got = np.array([r["qvalue"] for r in fdr.adjust(df).orderBy("i").collect()])
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert got == pytest.approx(want)
    values = df.groupBy("pvalue").agg(F.count(F.lit(1)).alias("_c"))
    r = {x["pvalue"]: (x["rank"], x["n_tests"]) for x in fdr.ranked(values, "pvalue").collect()}
    assert r[1.0] == (4000, 4000) and len(r) == len({*p}) and r[p.min()] == (1, 4000)


def glm_store(spark, n=150, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for s in range(8):
            b = 0.3 + (0.4 if i < 30 and s < 4 else 0) + (0.1 if s % 2 else 0)
            c = int(rng.integers(20, 40))
            m = int(rng.binomial(c, np.clip(b + rng.normal(0, 0.05), 0.01, 0.99)))
            rows.append((f"s{s}", f"chr{1 + i % 2}", 10 * i, "+", m, c - m))
    return counts(spark, rows), spark.createDataFrame([(f"s{s}", int(s < 4), "ab"[s % 2], float(s)) for s in range(8)], "sample_id string, treatment int, batch string, age double")


def test_one_entry_of_site_tests(spark):
    s, obs = glm_store(spark)
    auto = site_tests.dmc(s, obs).toPandas()
    assert {"pvalue", "qvalue", "ci_low", "ci_high", "phi"} <= {*auto.columns} and (auto[auto.reject].pos < 300).mean() > 0.8
    assert ((auto.ci_low <= auto.meth_diff) & (auto.meth_diff <= auto.ci_high)).all()
    out = site_tests.dmc(s, obs, formula="~ treatment + batch", contrast="treatment", dispersion="site").toPandas()
    assert ((out.pos < 300) == out.reject).mean() > 0.95
    assert ((out.ci_low <= out.meth_diff) & (out.meth_diff <= out.ci_high)).all() and out.effect_log2.values == pytest.approx(out.effect.values / np.log(2))
    dev = site_tests.dmc(s, obs, covariates=["batch"]).toPandas()
    assert ((dev.pos < 300) == dev.reject).mean() > 0.95
    assert set(site_tests.dmc(s, obs, chromosomes=["chr2"]).select("chrom").distinct().toPandas().chrom) == {"chr2"}
    perm = site_tests.dmc(s.filter("pos < 200"), obs, empirical=True, n_perm=10).toPandas()
    assert perm.p_empirical.min() >= 1 / 11
    for bad in ({"test": "score"}, {"test": "nothing"}, {"test": "lr", "contrast": "treatment"}, {"test": "welch_t", "empirical": True}):
        with pytest.raises(ValueError):
            site_tests.dmc(s, obs, **bad)
    one = obs.filter("sample_id in ('s0', 's5')")
    with pytest.raises(ValueError):
        site_tests.dmc(s, one)
    assert "phi" not in site_tests.dmc(s, one, allow_single=True).columns
    assert [site_tests.resolve_test("auto", a, b, True, m) for a, b, m in ((1, 4, False), (2, 2, False), (2, 2, True))] == ["fisher", "lr", "glm"]


def test_glm_dispersions_by_hand(spark):
    rng = np.random.default_rng(1)
    x, d = rng.gamma(3, 2, 240), np.where(np.arange(240) % 9, 4.0, 0.0)
    x[5] = np.nan
    chrom = np.where(np.arange(240) < 200, "1", "2")
    fits = spark.createDataFrame([(c, i, None if np.isnan(v) else float(v), float(k)) for i, (c, v, k) in enumerate(zip(chrom, x, d))], "chrom string, pos int, pearson double, df double")
    use = (d > 0) & np.isfinite(x)
    site = np.where(use, np.maximum(1, x / np.where(d > 0, d, 1)), 1)
    for mode in ("site", "chrom", "shrink", "eb"):
        got = glm.dispersions(fits, mode).orderBy("pos").toPandas()
        for c in "12":
            own, u = chrom == c, (chrom == c) & use
            enough = u.sum() >= 100
            pool, df = (max(1, x[u].sum() / d[u].sum()), d[u].sum()) if enough else (1.0, 1.0)
            w = max(1, 2 * (site[u].mean() ** 2 / site[u].var() + 2)) if mode == "eb" and enough else 4.0
            safe = np.where(d > 0, d, 1)
            phi = {"site": site, "chrom": np.full(240, pool)}.get(mode, np.where(use, np.maximum(1, (safe * site + w * pool) / (safe + w)), pool))
            dof = {"site": safe, "chrom": np.full(240, df)}.get(mode, np.where(use, safe + w, df))
            assert got.phi.values[own] == pytest.approx(phi[own]) and got.df_phi.values[own] == pytest.approx(dof[own])


def test_delta_interval_uses_the_slope_at_the_reference(spark):
    df = spark.createDataFrame([(0.5, 0.2, -1.0), (None, 0.2, 0.0), (0.5, 0.2, None)], "b double, se double, eta double")
    r = site_tests.delta_interval(df, "b", "se", "eta").collect()
    f = lambda v: 1 / (1 + np.exp(-v))
    d, h = f(-0.5) - f(-1), 1.959963984540054 * f(-1) * (1 - f(-1)) * 0.2
    assert (r[0]["meth_diff"], r[0]["ci_low"], r[0]["ci_high"]) == pytest.approx((d, d - h, d + h))
    assert all(x["meth_diff"] is None and x["ci_low"] is None for x in r[1:])


def test_welch_interval_ends_where_the_tail_is_5_percent(spark):
    s, _ = glm_store(spark, 40)
    w = site_tests.welch_test(s, [f"s{i}" for i in range(4)], [f"s{i}" for i in range(4, 8)], site_tests.TestConfig(test="welch_t")).toPandas()
    inner = w[(w.ci_high < 1) & (w.ci_low > -1)]
    assert len(inner) > 30 and special.t_sf2((inner.ci_high - inner.meth_diff) / inner.se, inner.dof) == pytest.approx(0.05)


def test_small_operators(spark):
    s = counts(spark, [(x, "chr1", 10 * i, "+", i % 5, 5 - i % 5 + (95 if i == 0 else 0)) for x in ("a", "b") for i in range(200)])
    assert plotdata.thinned(s, 4).count() == plotdata.thinned(s, 4).count() < 200
    marked = s.withColumn("significant", F.col("pos") < 100)
    assert plotdata.keep_significant(marked, 10).filter("significant").count() == 20 < plotdata.keep_significant(marked, 10).count() < 120
    assert prep.filter_coverage(s, 5, 99).agg(F.max("coverage")).first()[0] == 5
    r = spark.createDataFrame([("1", 5, 0.2), ("1", 1, None), ("1", 9, 0.1)], "chrom string, start int, qvalue double")
    assert [x["start"] for x in plotdata.top_regions(r, 2).collect()] == [9, 5]
    share = plotdata.scree(plotdata.site_matrix(s, ["a", "b"]), ["a", "b"], 2)
    assert share[0] >= share[1] >= 0
    obs = spark.createDataFrame([("a", "t"), ("z", "c")], "sample_id string, group string")
    both = qc.join_metrics(obs, s.groupBy("sample").agg(F.avg("coverage").alias("mean")), s.groupBy("sample").agg(F.count(F.lit(1)).alias("n")))
    assert sorted((x["sample_id"], x["n"]) for x in both.collect()) == [("a", 200), ("z", None)]
    assert [annotate.annotation_source(x) for x in ("x.gtf.gz", "refGene.txt", "y.gff3", "z.txt.gz")] == ["gtf", "refgene", "gtf", "refgene"]


def test_kernels_equal_a_loop_over_sites(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(smooth, "CELLS", 500)
    pos = np.unique(rng.integers(0, 30_000, 300))
    beta, cov = rng.random(len(pos)), rng.integers(0, 20, len(pos)).astype(float)
    beta[rng.random(len(pos)) < 0.2] = np.nan
    beta[np.abs(pos - 15_000) < 3000] = np.nan
    ok = np.isfinite(beta) & (cov > 0)
    x, b, c = pos[ok].astype(float), beta[ok], cov[ok]
    at = np.arange(-500, 31_000, 70.0)
    want = []
    for p in at:
        w = c * np.exp(-0.5 * ((x - p) / 200) ** 2) * (np.abs(x - p) <= 800)
        want.append((w @ b) / w.sum() if w.sum() > 0 else np.nan)
    assert smooth.gaussian_beta(pos, beta, cov, 200, at) == pytest.approx(np.array(want), nan_ok=True)
    for need, h_bp, degree in ((8, 300, 2), (1, 10, 2), (30, 50, 1)):
        want = []
        for p in pos.astype(float):
            h = max(h_bp, np.sort(np.abs(x - p))[need - 1]) * (1 + 1e-9)
            u = (x - p) / h
            w = np.where(np.abs(u) < 1, c * (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0)
            d = min(degree, max(0, (w > 0).sum() - 1))
            a = np.vander(u[w > 0], d + 1, increasing=True) * np.sqrt(w[w > 0])[:, None]
            want.append(np.clip(np.linalg.lstsq(a, b[w > 0] * np.sqrt(w[w > 0]), rcond=None)[0][0], 0, 1))
        assert smooth.local_polynomial(pos, beta, cov, need, h_bp, degree) == pytest.approx(np.array(want), abs=1e-6)
    have = np.flatnonzero(np.isfinite(beta))
    want = beta.copy()
    for i in np.flatnonzero(~np.isfinite(beta)):
        d = np.abs(pos[have] - pos[i])
        near = np.argsort(d, kind="stable")[:3]
        near = near[d[near] <= 2000]
        if len(near):
            want[i] = np.average(beta[have[near]], weights=1 / (d[near] + 1))
    got = smooth.knn_impute(pos, beta, 3, 2000)
    assert np.isnan(got).any() and got == pytest.approx(want, nan_ok=True)


def test_fisher_equals_exact_counts(monkeypatch):
    from math import comb

    monkeypatch.setattr(special, "CELLS", 200)
    rng = np.random.default_rng(9)
    t = np.concatenate((rng.integers(0, 40, (300, 4)), rng.integers(0, 3, (100, 4)), [[0, 0, 5, 5], [3, 0, 4, 0], [0, 3, 0, 4], [6, 9, 5, 10], [300, 700, 250, 750], [10_000, 2, 9998, 4]]))
    got = special.fisher_two_sided(*t.T)
    for (a, b, c, d), p in zip(t.tolist(), got):
        ra, rb, m = a + b, c + d, a + c
        if not ra or not rb:
            assert np.isnan(p)
            continue
        ways = {x: comb(ra, x) * comb(rb, m - x) for x in range(max(0, m - rb), min(ra, m) + 1)}
        assert p == pytest.approx(sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values()), abs=1e-9)
