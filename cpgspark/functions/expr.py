"""Catalyst expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float, hi: float) -> Column:
    """Kept within bounds; null stays null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi)))


def prob(c: Column | str) -> Column:
    """A proportion kept off 0 and 1."""
    return clip(c, EPS, 1 - EPS)


def beta(meth: Column | str = "N_meth", cov: Column | str = "coverage") -> Column:
    """Methylated share; null without coverage."""
    return F.when(col(cov) > 0, col(meth) / col(cov))


def log2_odds_ratio(case: Column | str, control: Column | str) -> Column:
    a, b = prob(case), prob(control)
    return F.log2(a / (1 - a)) - F.log2(b / (1 - b))


#: Canonical chromosomes without their prefix.
CANONICAL = [*map(str, range(1, 23)), "X", "Y", "M", "MT"]


def bare_chrom(c: Column | str = "chrom") -> Column:
    return F.upper(F.regexp_replace(col(c), "^(?i:chr)", ""))


def is_canonical(c: Column | str = "chrom") -> Column:
    return bare_chrom(c).isin(CANONICAL)


def chrom_order(c: Column | str = "chrom") -> Column:
    """1 to 22, X, Y, M, then all others."""
    b = bare_chrom(c)
    return F.when(b.rlike("^[0-9]{1,2}$") & b.isin(CANONICAL), F.expr("0") + b.try_cast("int")).when(b == "X", 23).when(b == "Y", 24).when(b.isin("M", "MT"), 25).otherwise(26)


def value_of(kind: str) -> Column:
    """beta, coverage or N_meth as a double; beta is null without coverage."""
    return {"beta": beta(), "coverage": F.col("coverage").cast("double"), "N_meth": F.col("N_meth").cast("double")}[kind]
