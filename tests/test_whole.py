"""Registered queries that do the whole job: every site, every part, every permutation."""

from math import comb

import pytest
from pyspark.sql import functions as F

from cpgspark.operators import aggregate
from cpgspark.plans.queries import QUERIES
from cpgspark.sources.store import CONTROLS, TREATED, lineitem_store


def tables(spark, folder, keys):
    """Line items of six suppliers for each part key, and the parts."""
    rows = [(1 + s, k, "R" if (k + s * s) % 3 else "N", float(1 + (k * (s + 2)) % 9)) for k in keys for s in range(6)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_returnflag string, l_quantity double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, 1 + k % 50) for k in keys], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def exact(a, ra, b, rb):
    """Two-sided Fisher p from whole numbers."""
    m = a + b
    if m in (0, ra + rb):
        return 1.0
    ways = [comb(ra, x) * comb(rb, m - x) for x in range(max(0, m - rb), min(ra, m) + 1)]
    return sum(w for w in ways if w <= comb(ra, a) * comb(rb, b)) / sum(ways)


def test_fisher_of_every_site_is_exact(spark, tmp_path):
    d = tables(spark, tmp_path, [3, 150, 199, 200, 5000, 123_456])
    want = {(r["chrom"], r["pos"]): exact(r["m_case"], r["n_case"], r["m_ctrl"], r["n_ctrl"]) for r in aggregate.site_groups(lineitem_store(spark, d), TREATED, CONTROLS, "intersect").collect()}
    got = {(r["chrom"], r["pos"]): r["pvalue"] for r in QUERIES["site_fisher"](spark, d).collect()}
    assert max(p for _, p in got) > 4000 and len(got) == 6 and got == pytest.approx(want, abs=1e-6)


def test_permuted_sites_use_the_default_number_of_shuffles(spark, monkeypatch, data):
    from cpgspark.operators import fdr

    seen = []
    monkeypatch.setattr(fdr, "permuted_statistics", lambda store, case, control, n_perm, *a: seen.append(n_perm) or spark.createDataFrame([(i, 0.5) for i in range(n_perm)], "perm int, lr double"))
    least = QUERIES["permutation_sites"](spark, data).agg(F.min("p_empirical")).first()[0]
    assert seen == [100] and least == pytest.approx(1 / 101)


def test_regions_and_clock_sites_of_all_parts(spark, tmp_path):
    keys = [3, 150, 199, 200, 5000, 123_456]
    d = tables(spark, tmp_path, keys)
    place = {k: (k % 5, k // 5 * 100 + k % 7 * 13) for k in keys}
    want = {(str(r), place[k][1]) for r in keys for k in keys if r % 5 == k % 5 and r // 5 * 100 <= place[k][1] < r // 5 * 100 + 50 + (1 + r % 50) * 10}
    got = {(r["region_id"], r["pos"]) for r in QUERIES["query_regions_full"](spark, d).collect()}
    assert got == want and len(want) > 1
    assert QUERIES["region_sizes_full"](spark, d).count() == 6 and QUERIES["region_sizes"](spark, d).count() < 6
    assert {r["n_sites"] for r in QUERIES["age_clock_full"](spark, d).collect()} == {6}
