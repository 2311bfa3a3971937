"""Binomial regression at each site: design, IRLS, deviance and Wald tests."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, clip
from ..functions.special import chi2_sf_col, chi2k_sf_col, f_sf_col
from .site_tests import DISPERSIONS, FLOOR_DF, MIN_SITES, PSEUDO_DF, delta_interval


def _column(name: str, values: list, reference: str | None = None) -> tuple[list[str], list[np.ndarray]]:
    """Names and columns of one variable: numbers as they are, classes by treatment contrasts."""
    try:
        return [name], [np.array([float(v) for v in values])]
    except (TypeError, ValueError):
        levels = sorted({str(v) for v in values})
        if reference is not None and reference in levels:
            levels.remove(reference)
            levels.insert(0, reference)
        return [f"{name}[{x}]" for x in levels[1:]], [np.array([float(str(v) == x) for v in values]) for x in levels[1:]]


def design(obs: pd.DataFrame, formula: str | None = None, covariates: list[str] | None = None, treatment: str = "treatment", reference: str | None = None) -> tuple[np.ndarray, list[str]]:
    """(matrix, names) of a formula like `~ treatment + age + treatment:age`; without one, of the treatment and covariates.

    Rows are the samples in the order of `obs`.
    """
    terms = [t.strip() for t in (formula.lstrip("~ ").split("+") if formula else [treatment, *(covariates or [])])]
    names, cols = ["Intercept"], [np.ones(len(obs))]
    for t in terms:
        if t in ("1", ""):
            continue
        if t in ("0", "-1"):
            names, cols = names[1:], cols[1:]
            continue
        parts = []
        for v in t.split(":"):
            v = re.sub(r"^C\((.*)\)$", r"\1", v.strip())
            if v not in obs.columns:
                raise ValueError(f"no covariate {v}")
            if obs[v].isna().any():
                raise ValueError(f"{v} is missing for some samples")
            parts.append(_column(v, obs[v].tolist(), reference))
        pn, pc = parts[0]
        for n2, c2 in parts[1:]:
            pn, pc = [f"{a}:{b}" for a in pn for b in n2], [a * b for a in pc for b in c2]
        names += pn
        cols += pc
    x = np.column_stack(cols)
    if x.shape[1] >= x.shape[0]:
        raise ValueError("as many columns as samples")
    return x, names


def contrast(names: list[str], spec: str) -> np.ndarray:
    """Rows over the coefficients: of a column, of all columns of a factor, or of a sum like `a - 2*b`."""
    if spec in names:
        return np.eye(len(names))[[names.index(spec)]]
    of = [i for i, n in enumerate(names) if n.startswith(f"{spec}[")]
    if of:
        return np.eye(len(names))[of]
    row = np.zeros(len(names))
    for sign, factor, name in re.findall(r"([+-]?)\s*(?:([0-9.]+)\s*\*\s*)?([A-Za-z_][\w\[\]:.]*)", spec):
        if name not in names:
            raise ValueError(f"no coefficient {name}")
        row[names.index(name)] += (-1 if sign == "-" else 1) * float(factor or 1)
    return row[None, :]


def irls(meth: np.ndarray, cov: np.ndarray, x: np.ndarray, max_iter: int = 25, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """Logistic fits of all rows at once; meth and cov are (sites, samples).

    Sites that don't converge, separate or have fewer than two covered samples are NaN.
    """
    n, p = meth.shape[0], x.shape[1]
    have = cov > 0
    rate = np.where(have, meth / np.where(have, cov, 1), 0.5)
    mu = np.clip((meth + 0.5) / (cov + 1), 1e-6, 1 - 1e-6)
    eta = np.log(mu / (1 - mu))
    beta, last = np.zeros((n, p)), np.full(n, np.inf)
    done = np.zeros(n, bool)
    covb = np.full((n, p, p), np.nan)
    for _ in range(max_iter):
        w = np.where(have, cov * mu * (1 - mu), 0)
        z = eta + (rate - mu) / np.maximum(mu * (1 - mu), 1e-12)
        a = np.einsum("sn,ni,nj->sij", w, x, x)
        b = np.einsum("sn,ni,sn->si", w, x, z)
        singular = np.linalg.cond(a) > 1e12
        a[singular] += 1e-8 * np.eye(p)
        inv = np.linalg.pinv(a, hermitian=True)
        new = np.einsum("sij,sj->si", inv, b)
        beta = np.where(done[:, None], beta, new)
        covb = np.where(done[:, None, None], covb, inv)
        eta = np.clip(beta @ x.T, -30, 30)
        mu = np.clip(1 / (1 + np.exp(-eta)), 1e-10, 1 - 1e-10)
        dev = deviance(meth, cov, mu)
        done |= np.abs(dev - last) < tol * (np.abs(dev) + 0.1)
        last = dev
        if done.all():
            break
    bad = ~done | (have.sum(axis=1) < 2) | (np.abs(eta) >= 29).any(axis=1, where=have)
    beta[bad], last = np.nan, np.where(bad, np.nan, last)
    pearson = np.where(have, (meth - cov * mu) ** 2 / np.maximum(cov * mu * (1 - mu), 1e-12), 0).sum(axis=1)
    return {"beta": beta, "cov": covb, "deviance": last, "pearson": np.where(bad, np.nan, pearson), "df": have.sum(axis=1) - p}


def deviance(meth: np.ndarray, cov: np.ndarray, mu: np.ndarray) -> np.ndarray:
    un = cov - meth
    part = lambda k, e: np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / np.maximum(e, 1e-300)), 0)
    return 2 * (part(meth, cov * mu) + part(un, cov * (1 - mu))).sum(axis=1)


def dispersions(fits: DataFrame, mode: str = "site") -> DataFrame:
    """Adds phi (at least 1) and df_phi from pearson and df: by site, by chromosome, or the site's drawn to the chromosome's."""
    if mode not in DISPERSIONS:
        raise ValueError(f"dispersion is one of {DISPERSIONS}")
    use = F.col("pearson").isNotNull() & (F.col("df") > 0)
    safe = F.when(F.col("df") > 0, F.col("df")).otherwise(1.0)
    site = F.when(use, F.greatest(F.lit(1.0), F.col("pearson") / safe)).otherwise(1.0)
    if mode == "site":
        return fits.withColumns({"phi": site, "df_phi": safe})
    own = F.when(use, site)
    pool = fits.groupBy("chrom").agg(F.count(own).alias("n"), F.sum(F.when(use, F.col("pearson"))).alias("x"), F.sum(F.when(use, F.col("df"))).alias("d"), F.avg(own).alias("m"), F.var_pop(own).alias("v"))
    enough, df = F.col("n") >= MIN_SITES, F.greatest(F.col("d"), F.lit(1.0))
    drawn = F.greatest(F.lit(1.0), 2 * (F.col("m") * F.col("m") / F.col("v") + 2))
    weight = F.when(enough & (F.col("v") > 1e-9) & (F.col("m") > 0), drawn).otherwise(PSEUDO_DF) if mode == "eb" else F.lit(PSEUDO_DF)
    pool = pool.select("chrom", F.when(enough, F.greatest(F.lit(1.0), F.col("x") / df)).otherwise(1.0).alias("_phi"), F.when(enough, df).otherwise(1.0).alias("_df"), weight.alias("_w"))
    both = fits.join(F.broadcast(pool), "chrom")  # one row per chromosome
    if mode == "chrom":
        return both.withColumns({"phi": F.col("_phi"), "df_phi": F.col("_df")}).drop("_phi", "_df", "_w")
    mixed = F.greatest(F.lit(1.0), (safe * site + F.col("_w") * F.col("_phi")) / (safe + F.col("_w")))
    return both.withColumns({"phi": F.when(use, mixed).otherwise(F.col("_phi")), "df_phi": F.when(use, safe + F.col("_w")).otherwise(F.col("_df"))}).drop("_phi", "_df", "_w")


def reference_p(statistic: Column, phi: Column, df: Column, k: int, reference: str = "adaptive") -> Column:
    """Tail of a statistic over its k degrees: F with the dispersion's (at least FLOOR_DF), chi-squared, or F where the dispersion is above 1."""
    f = f_sf_col(statistic, F.lit(float(k)), F.greatest(df, F.lit(FLOOR_DF)))
    chi = chi2_sf_col(statistic) if k == 1 else chi2k_sf_col(statistic * k, F.lit(float(k)))
    return chi if reference == "chi2" else f if reference == "f" else F.when(phi > 1, f).otherwise(chi)


def wald(beta: np.ndarray, cov: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Quadratic form of the contrast over its covariance without dispersion."""
    e = beta @ c.T
    v = np.einsum("ki,sij,lj->skl", c, cov, c)
    return np.einsum("sk,skl,sl->s", e, np.linalg.pinv(v, hermitian=True), e)


def fit_sites(store: DataFrame, samples: list[str], x: np.ndarray, c: np.ndarray, less: list[int] | None, control: list[int], case: list[int]) -> DataFrame:
    """GLM at each site: coefficient and error of the contrast's first row, raw statistic, Pearson sum, degrees and the mean betas.

    The statistic is Wald's for the contrast c, or with `less` (columns that
    stay) the deviance's.  Sites are dealt to tasks by hash in blocks, each
    fitted at once in NumPy; a site's samples are one row before that, so blocks
    are bounded.
    """
    one = lambda v, s: F.coalesce(F.sum(F.when(F.col("sample") == s, F.col(v))), F.lit(0)).cast("double")
    wide = store.filter(F.col("sample").isin(samples)).groupBy("chrom", "pos").agg(F.array(*(one("N_meth", s) for s in samples)).alias("m"), F.array(*(one("coverage", s) for s in samples)).alias("c"))

    def means(m: np.ndarray, n: np.ndarray, own: list[int]) -> np.ndarray:
        have = (n[:, own] > 0).sum(axis=1)
        total = np.where(n[:, own] > 0, m[:, own] / np.where(n[:, own] > 0, n[:, own], 1), 0).sum(axis=1)
        return np.where(have > 0, total / np.maximum(have, 1), np.nan)

    def fit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m, n = np.stack(pdf["m"].to_numpy()), np.stack(pdf["c"].to_numpy())
            full = irls(m, n, x)
            if less is None:
                raw = wald(full["beta"], full["cov"], c)
            else:
                raw = np.maximum(0, irls(m, n, x[:, less])["deviance"] - full["deviance"])
            effect = (full["beta"] @ c.T)[:, 0]
            se = np.sqrt(np.maximum(np.einsum("i,sij,j->s", c[0], full["cov"], c[0]), 0))
            yield pd.DataFrame({"chrom": pdf["chrom"], "pos": pdf["pos"], "effect": effect, "se": np.where(np.isnan(effect), np.nan, se), "raw": raw, "pearson": full["pearson"], "df": full["df"].astype(float), "beta_case": means(m, n, case), "beta_ctrl": means(m, n, control)})

    names = ("effect", "se", "raw", "pearson", "df", "beta_case", "beta_ctrl")
    out = wide.mapInPandas(fit, "chrom string, pos int, " + ", ".join(f"{v} double" for v in names))
    return out.withColumns({v: F.nanvl(F.col(v), F.lit(None).cast("double")) for v in names})


def test_design(store: DataFrame, obs: pd.DataFrame, formula: str | None = None, spec: str | None = None, covariates: list[str] | None = None, reference_level: str | None = None, dispersion: str = "site", reference: str = "adaptive", drop: str | None = None) -> DataFrame:
    """GLM test of a contrast (Wald) or, without one, of the treatment or the term `drop` (deviance against the design without it).

    Gives effect (logit) with its error under the dispersion, log2 effect,
    statistic, phi, df_phi, pvalue, and for one degree of freedom the adjusted
    difference at the controls' mean with its interval.
    """
    if spec is not None and drop is not None:
        raise ValueError("give a contrast or a term to drop")
    if reference not in ("adaptive", "f", "chi2"):
        raise ValueError("unknown reference")
    samples = obs["sample_id"].tolist()
    x, names = design(obs, formula, covariates, reference=reference_level)
    less = None
    if spec is not None:
        c = contrast(names, spec)
        k = int(np.linalg.matrix_rank(c))
    else:
        drop = drop or "treatment"
        of = [i for i, n in enumerate(names) if n == drop or n.startswith(f"{drop}[")]
        if not of:
            raise ValueError(f"no term {drop}")
        less, c, k = [i for i in range(len(names)) if i not in of], np.eye(len(names))[of], len(of)
    groups = obs["treatment"].tolist() if "treatment" in obs.columns else [None] * len(samples)
    control, case = ([i for i, t in enumerate(groups) if t == v] for v in (0, 1))
    fits = dispersions(fit_sites(store, samples, x, c, less, control, case), dispersion)
    out = fits.withColumn("statistic", F.col("raw") / F.col("phi") / k)
    out = out.withColumns({"se": F.col("se") * F.sqrt("phi"), "effect_log2": F.col("effect") / F.lit(float(np.log(2))), "pvalue": reference_p(F.col("statistic"), F.col("phi"), F.col("df_phi"), k, reference)})
    if k > 1:
        return out.drop("raw")
    p = clip("beta_ctrl", EPS, 1 - EPS)
    out = delta_interval(out.withColumn("_eta", F.when(F.col("beta_case").isNotNull(), F.ln(p / (1 - p)))), "effect", "se", "_eta")
    return out.drop("raw", "_eta")


def test_formula(store: DataFrame, obs: pd.DataFrame, formula: str, spec: str | None = None, drop: str | None = None) -> DataFrame:
    """test_design with dispersion by site, of a contrast or a term to drop."""
    if (spec is None) == (drop is None):
        raise ValueError("give a contrast or a term to drop")
    return test_design(store, obs, formula, spec, drop=drop)
