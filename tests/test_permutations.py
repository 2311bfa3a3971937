"""Shuffled labels: the sums of every assignment are those of the site test, and the shuffle doesn't grow with the permutations."""

import uuid

import pytest
from pyspark.sql import functions as F

from cpgspark.operators import fdr, site_tests
from cpgspark.operators.aggregate import site_groups
from cpgspark.plans.queries import ALL, sites
from cpgspark.sources.store import CONTROLS, TREATED, lineitem_store

SCHEMA = "chrom string, pos int, sample string, N_meth {0}, coverage {0}"


def shuffled(spark, df):
    """Rows that the shuffles of a run of df write."""
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, stages = sc.statusTracker(), sc._jsc.sc().statusStore()
    ids = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    return sum(stages.lastStageAttempt(s).shuffleWriteRecords() for s in ids)


def odd_rows(spark, kind="int"):
    """Sites with missing samples, uncovered and repeated rows, a single sample, another cohort's sample, and nothing covered."""
    one = int if kind == "int" else lambda x: x + 0.25 * (x > 0)
    rows = [("chr1", p, s, (p * (k + 3)) % 7, 7 + (p + k * k) % 5) for p in range(40) for k, s in enumerate(ALL) if (p + k) % 9]
    rows += [("chr1", 3, "s0", 2, 4), ("chr1", 3, "s4", 0, 0), ("chr2", 3, "s5", 1, 9), ("chr2", 5, "other", 1, 9), ("chr2", 7, "s1", 0, 0)]
    return spark.createDataFrame([(c, p, s, one(m), one(n)) for c, p, s, m, n in rows], SCHEMA.format(kind))


@pytest.mark.parametrize(("kind", "unite", "dispersion"), [("int", "union", "site"), ("int", "intersect", "site"), ("double", "union", "site"), ("int", "union", "shrink")])
def test_every_assignment_has_the_statistics_of_the_site_test(spark, kind, unite, dispersion):
    store = odd_rows(spark, kind)
    got = fdr.permuted_statistics(store, TREATED, CONTROLS, 30, unite=unite, dispersion=dispersion)
    names = [c for c in got.columns if c not in ("perm", "chrom", "pos")]
    rows = got.collect()
    assert {r["perm"] for r in rows} == set(range(30)) and len({tuple(fdr.permutation(i, TREATED, CONTROLS)) for i in range(30)}) < 30
    want = {}
    for i in (0, 1, 2, 29):
        case = fdr.permutation(i, TREATED, CONTROLS)
        g = site_groups(store, case, [x for x in ALL if x not in case], "union")
        if unite == "intersect":  # counted in rows
            g = g.join(store.filter(F.col("sample").isin(ALL)).groupBy("chrom", "pos").count().filter("count = 6").drop("count"), ["chrom", "pos"])
        own = site_tests.lr_statistic(g, dispersion)
        assert dict(own.dtypes) == {k: v for k, v in got.dtypes if k != "perm"}
        want |= {(i, r["chrom"], r["pos"]): [r[c] for c in names] for r in own.collect()}
    found = {(r["perm"], r["chrom"], r["pos"]): [r[c] for c in names] for r in rows if r["perm"] in (0, 1, 2, 29)}
    assert found.keys() == want.keys() and len(rows) == 30 * len(want) // 4
    for k, v in want.items():
        assert [x is None for x in found[k]] == [x is None for x in v]
        assert [x for x in found[k] if x is not None] == pytest.approx([x for x in v if x is not None], abs=1e-9)


def test_shuffled_rows_do_not_grow_with_the_permutations(spark, data):
    store = lineitem_store(spark, data)
    few, many = (shuffled(spark, fdr.permuted_statistics(store, TREATED, CONTROLS, n)) for n in (2, 60))
    assert 0 < few == many


def test_statistics_that_differ_by_rounding_are_equal(spark):
    seen = spark.createDataFrame([(3.0 + 4e-15,), (3.1,), (None,)], "lr double")
    best = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 9.0)], "perm int, best double")
    assert [r["p_empirical"] for r in fdr.max_t_pvalues(seen, best).orderBy(F.asc_nulls_last("lr")).collect()] == [3 / 4, 2 / 4, None]


def test_the_best_site_ties_with_its_own_labels(spark, data):
    seen = sites(spark, data)
    got = fdr.empirical_site_fdr(lineitem_store(spark, data), TREATED, CONTROLS, seen).toPandas()
    own = sum(fdr.is_mirror(fdr.permutation(i, TREATED, CONTROLS), TREATED, CONTROLS) for i in range(100))
    assert own and got.p_empirical.min() >= (own + 1) / 101 - 1e-12
