import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgspark.operators import fdr, permute, prep, regions, site_tests
from cpgspark.plans.queries import ALL
from cpgspark.sources import readers, results
from cpgspark.sources.store import CONTROLS, TREATED, lineitem_store


def test_result_store_replaces_single_chromosomes(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5, 0.5), ("2", 7, 0.1), ("2", 3, 0.2)], "chrom string, pos int, pvalue double")
    s = results.ResultStore.create(rows, str(tmp_path / "r"), test="lr")
    s.update(rows.filter("chrom = '2'").withColumn("pvalue", F.lit(0.9)))
    again = results.ResultStore(spark, str(tmp_path / "r"))
    assert again.chroms() == ["1", "2"] and again.manifest["notes"] == {"test": "lr"}
    assert sorted(tuple(r) for r in again.table().collect()) == [("1", 5, 0.5), ("2", 3, 0.9), ("2", 7, 0.9)]
    assert again.chrom("1").count() == 1


def test_conversion_is_done_once(spark, tmp_path):
    (tmp_path / "a.cov").write_text("chr1\t101\t101\t50\t2\t2\n")
    (tmp_path / "sheet.csv").write_text(f"sample_id,group,path\na,t,{tmp_path}/a.cov\n")
    obs = readers.read_samplesheet(spark, str(tmp_path / "sheet.csv"), "t", "c")
    out = str(tmp_path / "store")
    assert results.ensure_converted(spark, obs, out).count() == 1
    first = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(out) for f in fs}
    results.ensure_converted(spark, obs, out)
    assert first == {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(out) for f in fs}
    (tmp_path / "a.cov").write_text("chr1\t101\t101\t50\t2\t2\nchr1\t301\t301\t50\t2\t2\n")
    assert results.ensure_converted(spark, obs, out).count() == 2


def test_permuted_regions_rank_planted_ones_first(spark, data):
    s = lineitem_store(spark, data).filter("chrom < 'chr3'")
    sites = site_tests.test_sites(s, TREATED, CONTROLS, site_tests.TestConfig(dispersion="site"))
    seen = regions.chain_merge(sites, min_cpgs=3)
    got = permute.chain_fdr(s, TREATED, CONTROLS, seen, 3, min_cpgs=3).toPandas()
    assert len(got) == seen.count() and got.p_empirical.between(1 / 4, 1).all()
    nulls, used = permute.null_regions(s, TREATED, CONTROLS, lambda x: regions.chain_merge(x, min_cpgs=3), 3)
    assert used <= 3 and "perm" in nulls.columns
    ratio = permute.chain_fdr(s, TREATED, CONTROLS, seen, 3, method="region", min_cpgs=3).toPandas().sort_values("pvalue_combined")
    assert np.all(np.diff(ratio.q_empirical) >= -1e-12)
    assert set(ALL) == {*TREATED, *CONTROLS}


def test_commands_need_replicates():
    from cpgspark.cli import check_groups, parser

    a = parser().parse_args(["dmc", "store", "out", "--case", "a", "--control", "b"])
    with pytest.raises(ValueError):
        check_groups(a.case, a.control, a.single)


def test_null_tiles_are_the_region_caller_on_each_shuffle(spark, data):
    s = spark.createDataFrame(lineitem_store(spark, data).filter("chrom = 'chr1'").toPandas()).coalesce(1)
    how = {"size": 500, "min_cpgs": 3, "alpha": 0.9, "min_abs_diff": 0.01}
    shuffles = [c for c in (fdr.permutation(i, TREATED, CONTROLS) for i in range(2)) if not fdr.is_mirror(c, TREATED, CONTROLS)]
    calls = [regions.tile_regions(s, c, [x for x in ALL if x not in c], **how).toPandas() for c in shuffles]
    nulls, used = permute.null_tile_regions(s, TREATED, CONTROLS, n_perm=2, **how)
    got = nulls.toPandas()
    assert used == len(shuffles) and got.n_tiles.max() > 1
    key = lambda d: sorted((r.chrom, r.start, r.end, r.n_cpgs, round(r.pvalue, 9), round(r.qvalue, 9)) for r in d.itertuples())
    assert key(got) == sorted(x for c in calls for x in key(c))
    best = np.array([c.pvalue.min() for c in calls if len(c)])
    seen = spark.createDataFrame([(float(p),) for p in (0.0, best.min(), best.max(), 1.0)], "pvalue double").coalesce(1)
    out = permute.tile_fdr(s, TREATED, CONTROLS, seen, n_perm=2, **how).toPandas()
    assert out.p_empirical.tolist() == pytest.approx([((best <= p + 1e-12).sum() + 1) / (used + 1) for p in out.pvalue])


def test_commands(spark, tmp_path):
    import numpy as np

    from cpgspark.cli import main

    rng = np.random.default_rng(4)
    lines = ["sample_id,group,path,batch"]
    for s in range(6):
        rows = []
        for i in range(120):
            m = int(rng.binomial(30, 0.8 if i < 20 and s < 3 else 0.3))
            rows.append(f"chr1\t{1 + 50 * i}\t{1 + 50 * i}\t0\t{m}\t{30 - m}\n")
        (tmp_path / f"s{s}.cov").write_text("".join(rows))
        lines.append(f"s{s},{'t' if s < 3 else 'c'},{tmp_path}/s{s}.cov,{'ab'[s % 2]}")
    (tmp_path / "sheet.csv").write_text("\n".join(lines) + "\n")
    at = lambda name: str(tmp_path / name)
    groups = ["--case", "s0", "s1", "s2", "--control", "s3", "s4", "s5"]
    main(["convert", at("sheet.csv"), at("store"), "--treatment", "t", "--control-group", "c"], spark)
    main(["dmc", at("store"), at("sites"), *groups, "--power-stack"], spark)
    main(["dmc", at("store"), at("glm"), *groups, "--sheet", at("sheet.csv"), "--covariates", "batch"], spark)
    main(["dvc", at("store"), at("dvc"), *groups], spark)
    sites = spark.read.parquet(at("sites"))
    assert sites.filter("pos < 1000 and qvalue < 0.05").count() >= 18 and spark.read.parquet(at("dvc")).count() == 120
    assert spark.read.parquet(at("glm")).filter("pos < 1000 and qvalue < 0.05").count() >= 15
    for method, more in (("chain_merge", ["--preset", "default"]), ("chain_merge", ["--empirical", "--n-perm", "12"]), ("sliding_window", []), ("tile_based", ["--dispersion", "chrom"]), ("rule_segment", [])):
        main(["dmr", at("store"), at(f"{method}{len(more)}"), *groups, "--method", method, *more], spark)
        found = spark.read.parquet(at(f"{method}{len(more)}")).collect()
        assert found and all(r["start"] < 1100 and r["dmr_type"] == "hyper" for r in found)
    main(["report", at("store"), at("html"), "--sites", at("sites"), "--regions", at("chain_merge2")], spark)
    text = "\n".join(r[0] for r in spark.read.text(at("html")).collect())
    assert text.startswith("<!DOCTYPE html>") and text.count("<h2>") == 7 and "Best regions" in text
    with pytest.raises(ValueError):
        main(["dmr", at("store"), at("x"), *groups, "--method", "tile_based", "--preset", "strict"], spark)
    assert [tuple(r) for r in prep.dropped_contigs(sites.selectExpr("'GL1' as chrom").limit(2)).collect()] == [("GL1", 2)]
