"""Per-site tests of two groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, is_canonical, log2_odds_ratio, prob
from ..functions.special import chi2_sf_col, f_sf_col, fisher_col, t_isf2_col, t_sf2_col
from .aggregate import site_groups

DISPERSIONS = ("site", "chrom", "shrink", "eb")
MIN_SITES, PSEUDO_DF, FLOOR_DF = 100, 4.0, 50.0


@dataclass
class TestConfig:
    """Knobs of a per-site test; `power_stack` turns on the neighbour combination, two-stage FDR and the separation fallback."""

    test: str = "lr"
    unite: str = "union"
    dispersion: str = "eb"
    reference: str = "adaptive"
    min_case: int | None = None
    min_control: int = 0
    fdr: str = "fdr_bh"
    neighbours: bool = False
    neighbour_bp: int = 500
    separation: bool = False
    smoothing_bp: int | None = None
    power_stack: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.test not in ENGINES:
            raise ValueError(f"test is one of {sorted(ENGINES)}")
        if self.dispersion not in DISPERSIONS or self.reference not in ("adaptive", "f", "chi2"):
            raise ValueError("unknown dispersion or reference")
        if self.power_stack:
            self.neighbours, self.fdr, self.separation = True, "fdr_tsbh", True


def _chi(name: str) -> Column:
    s0, s1, s2 = (F.col(f"{x}_{name}").cast("double") for x in ("n", "m", "q"))
    den = s1 * (s0 - s1) / (s0 * s0)
    return F.when((s0 > 0) & (den > 0), (s2 - s1 * s1 / s0) / den).otherwise(0.0)


def _informs() -> Column:
    def inner(n: str) -> Column:
        return (F.col(f"n_{n}") > 0) & (F.col(f"m_{n}") > 0) & (F.col(f"m_{n}") < F.col(f"n_{n}"))

    return inner("case") & inner("ctrl")


def dispersions(groups: DataFrame, mode: str = "eb") -> DataFrame:
    """Adds phi (at least 1) and df_phi by site, from the sums of site_groups."""
    base = groups.withColumns({"_inf": _informs(), "_x": _chi("case") + _chi("ctrl"), "_df": (F.col("k_case") + F.col("k_ctrl") - 2).cast("double")})
    base = base.withColumn("_site", F.when(F.col("_inf"), F.greatest(F.lit(1.0), F.col("_x") / F.when(F.col("_df") > 0, F.col("_df")).otherwise(1.0))).otherwise(1.0))
    if mode == "site":
        return base.withColumns({"phi": F.col("_site"), "df_phi": F.when(F.col("_df") > 0, F.col("_df")).otherwise(1.0)}).drop("_inf", "_x", "_df", "_site")
    k = F.col("k_case") + F.col("k_ctrl")
    use = F.col("_inf") & (F.col("_df") > 0)
    chrom = base.groupBy("chrom").agg(
        F.count(F.when(F.col("_inf"), True)).alias("_sites"),
        F.sum(F.when(F.col("_inf"), F.col("_x"))).alias("_sx"),
        F.sum(F.when(F.col("_inf"), k)).alias("_k"),
        F.avg(F.when(use, F.col("_site"))).alias("_mean"),
        F.var_pop(F.when(use, F.col("_site"))).alias("_var"),
    )
    df_c = F.greatest(F.col("_k") - 2 * F.col("_sites"), F.lit(1)).cast("double")
    enough = F.col("_sites") >= MIN_SITES
    weight = F.when((F.col("_var") > 0) & (F.col("_mean") > 0), F.greatest(F.lit(1.0), 2 * (F.col("_mean") * F.col("_mean") / F.col("_var") + 2))).otherwise(PSEUDO_DF)
    chrom = chrom.select("chrom", F.when(enough, F.greatest(F.lit(1.0), F.col("_sx") / df_c)).otherwise(1.0).alias("_phi_c"), F.when(enough, df_c).otherwise(1.0).alias("_df_c"), (weight if mode == "eb" else F.lit(PSEUDO_DF)).alias("_w"))
    joined = base.join(chrom, "chrom")
    if mode == "chrom":
        phi, df = F.col("_phi_c"), F.col("_df_c")
    else:
        mixed = F.greatest(F.lit(1.0), (F.col("_df") * F.col("_site") + F.col("_w") * F.col("_phi_c")) / (F.col("_df") + F.col("_w")))
        phi, df = F.when(use, mixed).otherwise(F.greatest(F.lit(1.0), F.col("_phi_c"))), F.when(use, F.col("_df") + F.col("_w")).otherwise(F.col("_df_c"))
    return joined.withColumns({"phi": phi, "df_phi": df}).drop("_inf", "_x", "_df", "_site", "_phi_c", "_df_c", "_w")


def _effects(groups: DataFrame, pooled: bool) -> DataFrame:
    case = F.col("m_case") / F.when(F.col("n_case") > 0, F.col("n_case")) if pooled else F.col("mean_case")
    ctrl = F.col("m_ctrl") / F.when(F.col("n_ctrl") > 0, F.col("n_ctrl")) if pooled else F.col("mean_ctrl")
    return groups.withColumns({"beta_case": case, "beta_ctrl": ctrl}).withColumns({"meth_diff": F.col("beta_case") - F.col("beta_ctrl"), "log2_odds_ratio": log2_odds_ratio("beta_case", "beta_ctrl")})


def lr_statistic(groups: DataFrame, dispersion: str = "eb") -> DataFrame:
    """Adds phi, df_phi and lr, the likelihood-ratio statistic over the dispersion, all in Catalyst expressions."""
    d = _effects(dispersions(groups, dispersion), True)
    na, ma, nb, mb = (F.col(c).cast("double") for c in ("n_case", "m_case", "n_ctrl", "m_ctrl"))
    raw0 = (ma + mb) / (na + nb)
    p0 = prob(raw0)

    def part(n: Column, m: Column) -> Column:
        p = prob(m / n)
        return m * F.ln(p / p0) + (n - m) * F.ln((1 - p) / (1 - p0))

    usable = (na > 0) & (nb > 0) & (ma + mb > 0) & (ma + mb < na + nb)
    return d.withColumn("lr", F.when(usable, F.greatest(F.lit(0.0), 2 * (part(na, ma) + part(nb, mb)) / F.col("phi"))))


def reference_p(stat: Column, phi: Column, df: Column, reference: str = "adaptive") -> Column:
    """Tail of the statistic: chi-squared, F, or F where the dispersion is above 1."""
    chi, f = chi2_sf_col(stat), f_sf_col(stat, F.lit(1.0), F.greatest(df, F.lit(FLOOR_DF)))
    return chi if reference == "chi2" else f if reference == "f" else F.when(phi > 1, f).otherwise(chi)


def lr_test(store: DataFrame, case: list[str], control: list[str], cfg: TestConfig) -> DataFrame:
    g = site_groups(store, case, control, cfg.unite, cfg.min_case, cfg.min_control)
    s = lr_statistic(g, cfg.dispersion)
    s = s.withColumn("pvalue", reference_p(F.col("lr"), F.col("phi"), F.col("df_phi"), cfg.reference))
    if cfg.separation:
        exact = fisher_col("m_case", F.col("n_case") - F.col("m_case"), "m_ctrl", F.col("n_ctrl") - F.col("m_ctrl"))
        s = s.withColumn("pvalue", F.when((F.abs("meth_diff") >= 0.9) & (F.col("pvalue") > 0.05), F.least("pvalue", exact)).otherwise(F.col("pvalue")))
    return s


def fisher_test(store: DataFrame, case: list[str], control: list[str], cfg: TestConfig) -> DataFrame:
    g = _effects(site_groups(store, case, control, cfg.unite, cfg.min_case, cfg.min_control), True)
    h = F.log2((F.col("m_case") + 0.5) * (F.col("n_ctrl") - F.col("m_ctrl") + 0.5) / ((F.col("n_case") - F.col("m_case") + 0.5) * (F.col("m_ctrl") + 0.5)))
    return g.withColumns({"log2_odds_ratio": h, "pvalue": fisher_col("m_case", F.col("n_case") - F.col("m_case"), "m_ctrl", F.col("n_ctrl") - F.col("m_ctrl"))})


def welch_statistic(groups: DataFrame) -> DataFrame:
    """Adds t and dof (Satterthwaite, at least 1); null with fewer than two values in a group or without variance."""
    a, b = F.col("var_case") / F.col("k_case"), F.col("var_ctrl") / F.col("k_ctrl")
    ok = (F.col("k_case") >= 2) & (F.col("k_ctrl") >= 2) & (a + b > 0)
    g = _effects(groups, False)
    dof = (a + b) * (a + b) / (a * a / (F.col("k_case") - 1) + b * b / (F.col("k_ctrl") - 1))
    return g.withColumns({"t": F.when(ok, F.col("meth_diff") / F.sqrt(a + b)), "dof": F.when(ok, F.greatest(F.lit(1.0), dof)), "se": F.when(ok, F.sqrt(a + b))})


def welch_test(store: DataFrame, case: list[str], control: list[str], cfg: TestConfig) -> DataFrame:
    s = welch_statistic(site_groups(store, case, control, cfg.unite, cfg.min_case, cfg.min_control))
    half = t_isf2_col(F.lit(0.05), F.col("dof")) * F.col("se")
    return s.withColumns({"pvalue": t_sf2_col("t", "dof"), "ci_low": clip(F.col("meth_diff") - half, -1, 1), "ci_high": clip(F.col("meth_diff") + half, -1, 1)})


ENGINES = {"lr": lr_test, "fisher": fisher_test, "welch_t": welch_test}


#: What to use instead of engines that are no more.
REMOVED = {"logit_t": "welch_t or lr", "bb_lr": "lr", "score": "lr", "cmh": "a formula with the strata as a covariate"}


def engine(test: str):
    if test in REMOVED:
        raise ValueError(f"{test} was removed; use {REMOVED[test]}")
    if test not in ENGINES:
        raise ValueError(f"{test} is no engine; use one of {sorted(ENGINES)}")
    return ENGINES[test]


def resolve_test(test: str, n_case: int, n_control: int, allow_single: bool, modelled: bool) -> str:
    """The engine that `auto` stands for: glm with a formula or covariates, fisher below two samples in a group (on demand), else lr."""
    if modelled:
        if test not in ("auto", "glm"):
            raise ValueError("a formula, contrast or covariates need test glm")
        return "glm"
    single = min(n_case, n_control) < 2
    if single and not allow_single:
        raise ValueError("each group needs two samples, unless single ones are allowed")
    if test == "auto":
        return "fisher" if single else "lr"
    if test == "glm":
        return "glm"
    engine(test)
    return test


def resolve_chromosomes(store: DataFrame, chromosomes: list[str] | None = None, canonical_only: bool = False) -> DataFrame:
    """The store's rows of the chromosomes given as they are, or else of all, or of the canonical ones."""
    if chromosomes is not None:
        return store.filter(F.col("chrom").isin(chromosomes))
    return store.filter(is_canonical("chrom")) if canonical_only else store


def dmc(store: DataFrame, obs: DataFrame, test: str = "auto", chromosomes: list[str] | None = None, canonical_only: bool = False, allow_single: bool = False, formula: str | None = None, contrast: str | None = None, covariates: list[str] | None = None, reference_level: str | None = None, empirical: bool = False, n_perm: int = 100, seed: int = 42, **knobs) -> DataFrame:
    """The one entry of site tests: `obs` has sample_id, treatment (1 or 0) and covariates; further arguments are those of TestConfig.

    Gives p and q values, the difference with its interval, and with `empirical`
    (lr only) the max-statistic p and q over shuffled labels as well.
    """
    from .fdr import adjust, empirical_site_fdr
    from .glm import test_design

    rows = obs.toPandas()  # one row per sample
    case, control = (sorted(rows.loc[rows["treatment"] == t, "sample_id"]) for t in (1, 0))
    modelled = bool(formula or contrast or covariates)
    test = resolve_test(test, len(case), len(control), allow_single or modelled, modelled)
    store = resolve_chromosomes(store, chromosomes, canonical_only)
    cfg = TestConfig(**({} if test == "glm" else {"test": test}), **knobs)
    if empirical and test != "lr":
        raise ValueError("shuffled labels are for test lr")
    if test == "glm":
        out = test_design(store, rows, formula, contrast, covariates, reference_level, cfg.dispersion, cfg.reference)
        return adjust(out, cfg.fdr)
    out = test_sites(store, case, control, cfg)
    if test in ("lr", "fisher"):
        out = newcombe_interval(out, phi="phi" if test == "lr" else None)
    return empirical_site_fdr(store, case, control, out, n_perm, seed) if empirical else out


def test_sites(store: DataFrame, case: list[str], control: list[str], cfg: TestConfig | None = None) -> DataFrame:
    """The whole test: statistics, p and q values, and what the configuration adds."""
    from .fdr import adjust
    from .smooth import box_smooth, combine_neighbours

    cfg = cfg or TestConfig()
    if cfg.smoothing_bp:
        store = box_smooth(store, cfg.smoothing_bp)
    out = engine(cfg.test)(store, case, control, cfg)
    out = adjust(out, cfg.fdr)
    if cfg.neighbours:
        out = combine_neighbours(out, cfg.neighbour_bp)
        out = adjust(out, cfg.fdr, "pvalue_combined", "qvalue_combined", "reject_combined")
    return out


def newcombe_interval(groups: DataFrame, z: float = 1.959963984540054, phi: str | None = None) -> DataFrame:
    """Adds ci_low and ci_high of the difference of pooled proportions: hybrid Wilson, widened by the root of a dispersion above 1."""
    zz = F.lit(z) * (F.sqrt(F.greatest(F.lit(1.0), F.col(phi))) if phi else F.lit(1.0))

    def wilson(n: str) -> tuple[Column, Column, Column]:
        size, m = F.col(f"n_{n}").cast("double"), F.col(f"m_{n}").cast("double")
        p = m / size
        mid, half = p + zz * zz / (2 * size), zz * F.sqrt(p * (1 - p) / size + zz * zz / (4 * size * size))
        low = 1 + zz * zz / size
        return p, (mid - half) / low, (mid + half) / low

    p1, l1, u1 = wilson("case")
    p2, l2, u2 = wilson("ctrl")
    d, ok = p1 - p2, (F.col("n_case") > 0) & (F.col("n_ctrl") > 0)
    lo = d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    hi = d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    return groups.withColumns({"ci_low": F.when(ok, clip(lo, -1, 1)), "ci_high": F.when(ok, clip(hi, -1, 1))})


def delta_interval(rows: DataFrame, coef: str, se: str, reference: str | None = None, z: float = 1.959963984540054) -> DataFrame:
    """A logit coefficient with its error on the scale of the difference, from the reference linear predictor (0 if none).

    The difference is that of the two predicted shares; its error is the
    coefficient's times the slope of the curve at the reference.
    """
    eta = clip(F.col(reference), -30, 30) if reference else F.lit(0.0)
    logistic = lambda x: 1 / (1 + F.exp(-clip(x, -30, 30)))
    base = logistic(eta)
    d, s = logistic(eta + F.col(coef)) - base, base * (1 - base) * F.col(se)
    return rows.withColumns({"meth_diff": d, "ci_low": clip(d - F.lit(z) * s, -1, 1), "ci_high": clip(d + F.lit(z) * s, -1, 1)})


def shrink_effects(rows: DataFrame, z: float = 1.959963984540054, diff: str = "meth_diff", low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """Adds meth_diff_shrunk: effects drawn to 0 by their error against the spread of all effects."""
    se = (F.col(high) - F.col(low)) / F.lit(2 * z)
    s = rows.withColumn("_se", se)
    use = F.col(diff).isNotNull() & F.col("_se").isNotNull()
    tau = s.agg(F.greatest(F.lit(0.0), F.var_samp(F.when(use, F.col(diff))) - F.avg(F.when(use, F.col("_se") * F.col("_se")))).alias("_tau"))
    out = s.crossJoin(F.broadcast(tau))  # one row
    factor = F.when(F.col("_tau") + F.col("_se") * F.col("_se") > 0, F.col("_tau") / (F.col("_tau") + F.col("_se") * F.col("_se"))).otherwise(0.0)
    return out.withColumn("meth_diff_shrunk", F.col(diff) * factor).drop("_se", "_tau")


# ---- differences of variance -----------------------------------------------


def brown_forsythe(store: DataFrame, case: list[str], control: list[str], min_coverage: int = 1) -> DataFrame:
    """F statistic of the distances from the group medians of beta, at sites with 3 covered samples in each group; with variances."""
    rows = store.filter(F.col("sample").isin([*case, *control]) & (F.col("coverage") >= min_coverage) & (F.col("coverage") > 0)).select("chrom", "pos", F.col("sample").isin(case).alias("case"), (F.col("N_meth") / F.col("coverage")).alias("b"))
    listed = rows.groupBy("chrom", "pos", "case").agg(F.collect_list("b").alias("bs"), F.median("b").alias("med"), F.var_samp("b").alias("v"), F.avg("b").alias("mu"), F.count("b").alias("n"))  # one value per sample
    z = listed.withColumn("z", F.expr("transform(bs, x -> abs(x - med))"))
    z = z.withColumns({"zs": F.expr("aggregate(z, 0D, (a, x) -> a + x)"), "zq": F.expr("aggregate(z, 0D, (a, x) -> a + x * x)")})
    pick = lambda c, case_: F.max(F.when(F.col("case") == case_, F.col(c)))
    wide = z.groupBy("chrom", "pos").agg(*(pick(c, s).alias(f"{c}_{n}") for c in ("n", "zs", "zq", "v", "mu") for n, s in (("a", True), ("b", False)))).filter("n_a >= 3 and n_b >= 3")
    n = F.col("n_a") + F.col("n_b")
    grand = (F.col("zs_a") + F.col("zs_b")) / n
    ma, mb = F.col("zs_a") / F.col("n_a"), F.col("zs_b") / F.col("n_b")
    between = F.col("n_a") * (ma - grand) * (ma - grand) + F.col("n_b") * (mb - grand) * (mb - grand)
    within = F.col("zq_a") - F.col("n_a") * ma * ma + F.col("zq_b") - F.col("n_b") * mb * mb
    return wide.select("chrom", "pos", F.col("n_a").alias("n_case"), F.col("n_b").alias("n_ctrl"), F.col("v_a").alias("var_case"), F.col("v_b").alias("var_ctrl"), F.col("mu_a").alias("mean_case"), F.col("mu_b").alias("mean_ctrl"), F.when(within > 1e-15, between / (within / (n - 2))).alias("f_stat"), F.when((F.col("v_a") > 0) & (F.col("v_b") > 0), F.log2(F.col("v_a") / F.col("v_b"))).alias("var_log_ratio"))


def variance_test(store: DataFrame, case: list[str], control: list[str], alpha: float = 0.05, mean_alpha: float = 0.05, min_coverage: int = 1) -> DataFrame:
    """Brown-Forsythe p and q, Welch p and q of the means, and is_dvc: variance differs and the mean doesn't."""
    from .fdr import adjust

    b = brown_forsythe(store, case, control, min_coverage)
    b = b.withColumn("pvalue_variance", f_sf_col(F.col("f_stat"), F.lit(1.0), (F.col("n_case") + F.col("n_ctrl") - 2).cast("double")))
    w = welch_statistic(b.withColumns({"k_case": F.col("n_case"), "k_ctrl": F.col("n_ctrl")}))
    w = w.withColumn("pvalue_mean", t_sf2_col("t", "dof"))
    w = adjust(w, "fdr_bh", "pvalue_variance", "qvalue_variance", "_r1")
    w = adjust(w, "fdr_bh", "pvalue_mean", "qvalue_mean", "_r2")
    quiet = F.col("pvalue_mean").isNull() | (F.col("pvalue_mean") > mean_alpha)
    return w.withColumn("is_dvc", F.coalesce(F.col("qvalue_variance") < alpha, F.lit(False)) & quiet).drop("_r1", "_r2", "k_case", "k_ctrl", "beta_case", "beta_ctrl")
