"""Column expressions for the statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from driftloom.functions import thresholds as T


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Limiting Kolmogorov series with 100 terms, as a SQL fold."""
    n, m = n.cast("double"), m.cast("double")
    lam = d * F.sqrt(n * m / (n + m))
    terms = F.sequence(F.lit(1), F.lit(100))
    total = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0 or a <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15 or i > 100000:
            return h * scale


@F.pandas_udf(DoubleType())
def chi2_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square law; runs on aggregated rows only."""
    pairs = zip(statistic.to_numpy(dtype=float), dof.to_numpy(dtype=float), strict=True)
    return pd.Series([np.nan if s != s else upper_gamma(k / 2, s / 2) if k > 0 else 1.0 for s, k in pairs])


def psi_severity(score: Column) -> Column:
    return band(score, T.PSI_WARNING, T.PSI_CRITICAL)


def band(score: Column, warning: float, critical: float) -> Column:
    """none / warning / critical with strict limits."""
    return (
        F.when(score > critical, F.lit("critical")).when(score > warning, F.lit("warning")).otherwise(F.lit("none"))
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, NULL where b is 0."""
    b = b.cast("double")
    return a.cast("double") / F.when(b != 0, b)


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """Limit to [lo, hi]; NULL stays NULL."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))
