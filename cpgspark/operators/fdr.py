"""Multiple testing over all sites, and permutation nulls.

The tested rows are written once, so that nothing behind them is computed again.
Ranks are those of the distinct p values with their counts: equal values, such
as the many ones of exact tests, are a single row wherever they are.  No window
runs over the whole table: p values are put into buckets by a monotone function
of p, which every task computes alike.  Buckets are counted and their offsets
summed (a table of at most BUCKETS rows), ranks come from a window within the
bucket, and the running minimum from above is the minimum within the bucket and
of the buckets above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

BUCKETS = 4096
METHODS = ("fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky", "fdr_storey")


def _bucketed(rows: DataFrame, p: str) -> DataFrame:
    # the fourth root spreads both small and null p values evenly enough
    return rows.withColumn("_b", F.least(F.lit(BUCKETS - 1), F.floor(F.pow(F.col(p), 0.25) * BUCKETS)).cast("int"))


def ranked(values: DataFrame, p: str, rank: str = "rank", by: tuple[str, ...] = (), n: str = "_c") -> DataFrame:
    """Adds the ascending rank (1 on; of equal values the highest) and n_tests to distinct values with their counts `n`, in each group `by`."""
    b = _bucketed(values, p)
    counts = b.groupBy(*by, "_b").agg(F.sum(n).alias("_k"))
    offset = counts.select(*by, "_b", (F.sum("_k").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_k")).alias("_off"), F.sum("_k").over(Window.partitionBy(*by)).alias("n_tests"))  # at most BUCKETS rows a group
    w = Window.partitionBy(*by, "_b").orderBy(p)
    return b.join(F.broadcast(offset), [*by, "_b"]).withColumn(rank, F.sum(n).over(w) + F.col("_off")).drop("_off")


def suffix_min(rows: DataFrame, value: str, order: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the minimum of `value` over this row and all rows of larger `order`; rows from `ranked` (with _b)."""
    w = Window.partitionBy(*by, "_b").orderBy(F.desc(order))
    least = rows.groupBy(*by, "_b").agg(F.min(value).alias("_min"))
    above = least.select(*by, "_b", F.min("_min").over(Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))  # at most BUCKETS rows a group
    return rows.join(F.broadcast(above), [*by, "_b"]).withColumn(out, F.least(F.min(value).over(w), "_above")).drop("_above")


def _pi0(high: int, n: int, lam: float = 0.5) -> float:
    """Share of true nulls: p values above lam over those expected there, from 1/n to 1."""
    return min(1.0, max(1.0 / max(n, 1), high / ((1 - lam) * max(n, 1))))


def _step_up(values: DataFrame, p: str, q: str, factor, by: tuple[str, ...] = ()) -> DataFrame:
    """The groups, p, _c and q of distinct p values with their counts _c."""
    r = ranked(values, p, by=by).withColumn("_raw", F.col(p) * F.col("n_tests") / F.col("rank") * factor)
    return suffix_min(r, "_raw", p, "_q", by).select(*by, p, "_c", F.least(F.lit(1.0), "_q").alias(q))


#: Distinct p values (about 32 bytes each) up to this number are broadcast to the rows, more are joined by a shuffle.
BROADCAST_VALUES = 500_000


def adjust(rows: DataFrame, method: str = "fdr_bh", p: str = "pvalue", q: str = "qvalue", reject: str = "reject", alpha: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds q values and rejections; rows without a p value don't count, and get null and false.

    With `by`, each group is a family of its own (fdr_bh only).

    Two-stage methods: the number of true nulls is estimated from a first
    step-up at alpha (or alpha / (1 + alpha)), and scales the second.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if by and method != "fdr_bh":
        raise ValueError("families are for fdr_bh only")
    rows = saved(rows, "tested")
    values = saved(rows.filter(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_c")), "values")
    size = values.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col(p) > 0.5, F.col("_c"))), F.lit(0)).alias("high")).first()
    n = size["n"]
    factor = 1.0
    if method == "fdr_by" and n:
        factor = float(np.log(n) + 0.5772156649015329 + 1 / (2 * n)) if n > 10_000 else float((1 / np.arange(1, n + 1)).sum())
    elif method == "fdr_storey":
        factor = _pi0(size["high"], n)
    elif method in ("fdr_tsbh", "fdr_tsbky"):
        level, stretch = (alpha, 1.0) if method == "fdr_tsbh" else (alpha / (1 + alpha), 1 + alpha)
        r = _step_up(values, p, "_first", F.lit(1.0)).agg(F.sum(F.when(F.col("_first") <= level, F.col("_c")))).first()[0] or 0
        factor = ((n - r) / n if 0 < r < n else 1.0) * stretch
    done = _step_up(values, p, q, F.lit(factor), by).drop("_c")
    if size["distinct"] <= BROADCAST_VALUES:
        done = F.broadcast(done)
    return rows.join(done, [*by, p], "left").select(*rows.columns, q, F.coalesce(F.col(q) <= alpha, F.lit(False)).alias(reject))


def adjust_by_chrom(rows: DataFrame, p: str = "pvalue", q: str = "qvalue") -> DataFrame:
    """Benjamini-Hochberg within each chromosome (few rows each: regions)."""
    w = Window.partitionBy("chrom").orderBy(p)
    n = F.count(p).over(Window.partitionBy("chrom"))
    raw = rows.withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * n / F.count(p).over(w)))
    down = Window.partitionBy("chrom").orderBy(F.desc_nulls_last(p))
    return raw.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")


# ---- permutations ----------------------------------------------------------

#: Relative difference up to which a statistic of shuffled labels equals the observed one.
SAME = 1e-9


def permutation(i: int, case: list[str], control: list[str], seed: int = 42, strata: dict[str, str] | None = None) -> list[str]:
    """The samples treated in permutation i, shuffled within strata if there are any."""
    rng = np.random.default_rng(seed + i + 1)
    everyone = [*case, *control]
    if not strata:
        return sorted(everyone[k] for k in rng.permutation(len(everyone))[: len(case)])
    out: list[str] = []
    for s in sorted({strata[x] for x in everyone}):
        own = [x for x in everyone if strata[x] == s]
        out += [own[k] for k in rng.permutation(len(own))[: sum(x in case for x in own)]]
    return sorted(out)


def is_mirror(chosen: list[str], case: list[str], control: list[str]) -> bool:
    return set(chosen) in (set(case), set(control))


def permuted_statistics(store: DataFrame, case: list[str], control: list[str], n_perm: int, seed: int = 42, strata: dict[str, str] | None = None, unite: str = "union", dispersion: str = "site") -> DataFrame:
    """(perm, chrom, pos, lr, ...) of every permutation in one job.

    The shuffle moves a row of the store once, however many permutations there
    are: sites are grouped with the list of their rows, and each task makes the
    sums of every assignment from that list.  Permutations that give the same
    assignment share its sums.
    """
    from .aggregate import listed_rows, listed_sums
    from .site_tests import lr_statistic

    everyone = [*case, *control]
    perms: dict[tuple[str, ...], list[int]] = {}
    for i in range(n_perm):
        perms.setdefault(tuple(permutation(i, case, control, seed, strata)), []).append(i)
    shuffles = F.array(*(F.struct(F.lit(k).alias("id"), F.array(*(F.lit(x in c) for x in everyone)).alias("t")) for k, c in enumerate(perms)))
    sites = store.filter(F.col("sample").isin(everyone)).groupBy("chrom", "pos").agg(listed_rows(everyone).alias("_rows"), F.count(F.lit(1)).alias("n_samples"))
    if unite == "intersect":
        sites = sites.filter(F.col("n_samples") == len(everyone))
    spread = sites.select("chrom", "pos", "_rows", F.explode(shuffles).alias("_s"))
    parted = spread.select("chrom", "pos", F.col("_s.id").alias("_id"), F.filter("_rows", lambda x: F.get("_s.t", x["i"])).alias("_case"), F.filter("_rows", lambda x: ~F.get("_s.t", x["i"])).alias("_ctrl"))
    counts = "long" if {store.schema[c].dataType.typeName() for c in ("N_meth", "coverage")} <= {"byte", "short", "integer", "long"} else "double"  # smoothed counts are no whole numbers
    g = parted.select("_id", "chrom", "pos", *listed_sums("_case", "case", counts), *listed_sums("_ctrl", "ctrl", counts))
    if dispersion == "site":
        s = lr_statistic(g, dispersion)
    else:  # the other modes pool chromosomes, each assignment's own
        s = lr_statistic(g.withColumn("chrom", F.concat_ws("|", "_id", "chrom")), dispersion).withColumn("chrom", F.split("chrom", r"\|", 2)[1])
    same = F.array(*(F.array(*map(F.lit, own)) for own in perms.values()))
    return s.select(F.explode(F.get(same, F.col("_id"))).alias("perm"), *(c for c in s.columns if c != "_id"))


def max_t_pvalues(observed: DataFrame, null_best: DataFrame, stat: str = "lr") -> DataFrame:
    """Adds p_empirical = (permutations whose best statistic is at least the observed + 1) / (permutations + 1); null_best has a row per permutation.

    Statistics that differ by the order of their sums only (SAME) are equal: the
    labels and their mirror are among the shuffles.
    """
    best = null_best.agg(F.sort_array(F.collect_list("best")).alias("_null"), F.count("best").alias("_n"))  # a value per permutation
    out = observed.crossJoin(F.broadcast(best))
    k = F.size(F.filter("_null", lambda v: v >= F.col(stat) * (1 - SAME)))
    return out.withColumn("p_empirical", F.when(F.col(stat).isNotNull(), (k + 1) / (F.col("_n") + 1))).drop("_null", "_n")


def empirical_site_fdr(store: DataFrame, case: list[str], control: list[str], observed: DataFrame, n_perm: int = 100, seed: int = 42, strata: dict[str, str] | None = None) -> DataFrame:
    nulls = permuted_statistics(store, case, control, n_perm, seed, strata).groupBy("perm").agg(F.max("lr").alias("best"))
    return adjust(max_t_pvalues(observed, nulls), "fdr_bh", "p_empirical", "q_empirical", "reject_empirical")


def empirical_region_fdr(observed: DataFrame, nulls: DataFrame, used: int, method: str = "max_t", p: str = "pvalue") -> DataFrame:
    """Region p or q values from null regions (perm, pvalue) of `used` permutations, those without regions included.

    max_t: share of permutations with a region at least as good, then BH.
    region: null regions at least as good per permutation over the observed ones
    at least as good, made monotone.
    """
    if method == "max_t":
        best = nulls.groupBy("perm").agg(F.min(p).alias("b")).agg(F.collect_list("b").alias("_null"))  # a value per permutation
        out = observed.crossJoin(F.broadcast(best)).withColumn("p_empirical", (F.size(F.filter("_null", lambda v: v <= F.col(p))) + 1) / F.lit(used + 1)).drop("_null")
        return adjust(out, "fdr_bh", "p_empirical", "q_empirical", "reject_empirical")
    return region_count_ratio(observed, nulls, used, p)


def region_count_ratio(observed: DataFrame, nulls: DataFrame, used: int, p: str = "pvalue") -> DataFrame:
    """q_empirical by counts of null and observed regions up to each p, from one ranking of both."""
    both = observed.withColumn("_own", F.lit(1)).unionByName(nulls.select(F.col(p), F.lit(0).alias("_own")), allowMissingColumns=True)
    values = both.filter(F.col(p).isNotNull()).groupBy(p).agg(F.sum("_own").alias("_o"), F.sum(1 - F.col("_own")).alias("_d"))
    b = _bucketed(saved(values, "values"), p)
    counts = b.groupBy("_b").agg(F.sum("_o").alias("_o"), F.sum("_d").alias("_d"))
    w = Window.orderBy("_b")
    off = counts.select("_b", (F.sum("_o").over(w) - F.col("_o")).alias("_oo"), (F.sum("_d").over(w) - F.col("_d")).alias("_dd"))  # at most BUCKETS rows
    inner = Window.partitionBy("_b").orderBy(p)
    r = b.join(F.broadcast(off), "_b").withColumns({"_n_obs": F.sum("_o").over(inner) + F.col("_oo"), "_n_null": F.sum("_d").over(inner) + F.col("_dd")}).filter("_o > 0")
    r = r.withColumn("_raw", F.col("_n_null") / F.lit(max(used, 1)) / F.col("_n_obs"))
    q = suffix_min(r, "_raw", p, "_q").select(F.col(p), F.least(F.lit(1.0), "_q").alias("q_empirical"))
    return observed.filter(F.col(p).isNotNull()).join(q, p).select(*observed.columns, "q_empirical")
