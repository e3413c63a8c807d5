"""Effect sizes and their sampling variances as column expressions, with quality guards."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Effect = tuple[Column, Column]


@F.pandas_udf(T.DoubleType())
def hedges_j(df: pd.Series) -> pd.Series:
    """The exact small-sample factor; null for one degree of freedom or less."""
    return df.map(lambda m: math.exp(math.lgamma(m / 2) - math.lgamma((m - 1) / 2)) / math.sqrt(m / 2) if m is not None and m > 1 else None).astype("float64")


def md(m1: Column, sd1: Column, n1: Column, m2: Column, sd2: Column, n2: Column) -> Effect:
    """Mean difference."""
    return m1 - m2, sd1 * sd1 / n1 + sd2 * sd2 / n2


def smd(m1: Column, sd1: Column, n1: Column, m2: Column, sd2: Column, n2: Column) -> Effect:
    """Standardised mean difference with Hedges' factor."""
    df = n1 + n2 - 2
    pooled = F.sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / df)
    g = (m1 - m2) / pooled * hedges_j(df.cast("double"))
    return g, 1 / n1 + 1 / n2 + g * g / (2 * (n1 + n2))


def _corrected(*cells: Column) -> list[Column]:
    """Half a count is added to every cell if one is zero."""
    zero = F.greatest(*[(c == 0).cast("double") for c in cells])
    return [c + zero * 0.5 for c in cells]


def log_or(a: Column, b: Column, c: Column, d: Column) -> Effect:
    """Log odds ratio from events and non-events of two arms."""
    a, b, c, d = _corrected(a, b, c, d)
    return F.ln(a * d / (b * c)), 1 / a + 1 / b + 1 / c + 1 / d


def log_rr(a: Column, b: Column, c: Column, d: Column) -> Effect:
    """Log risk ratio."""
    a, b, c, d = _corrected(a, b, c, d)
    return F.ln((a / (a + b)) / (c / (c + d))), 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)


def risk_difference(a: Column, b: Column, c: Column, d: Column) -> Effect:
    p, q = a / (a + b), c / (c + d)
    return p - q, p * (1 - p) / (a + b) + q * (1 - q) / (c + d)


def fisher_z(r: Column, n: Column) -> Effect:
    return F.atanh(r), 1 / (n - 3)


def logit(x: Column, n: Column) -> Effect:
    """Logit of a proportion; half a count is added to both cells at the ends."""
    end = ((x == 0) | (x == n)).cast("double") * 0.5
    return F.ln((x + end) / (n - x + end)), 1 / (x + end) + 1 / (n - x + end)


def freeman_tukey(x: Column, n: Column) -> Effect:
    """Double arcsine."""
    return 0.5 * (F.asin(F.sqrt(x / (n + 1))) + F.asin(F.sqrt((x + 1) / (n + 1)))), 1 / (4 * n + 2)


def inverse_freeman_tukey(t: Column, n: Column) -> Column:
    """Miller's inverse of the double arcsine."""
    s = F.sin(2 * t)
    inner = s + (s - 1 / s) / n
    p = 0.5 * (1 - F.signum(F.cos(2 * t)) * F.sqrt(F.greatest(F.lit(0.0), 1 - inner * inner)))
    return F.when(s == 0, F.when(F.cos(2 * t) > 0, 0.0).otherwise(1.0)).otherwise(p)


def log_hr(hr: Column, lo: Column, hi: Column, z: float = 1.959963984540054) -> Effect:
    """Log hazard ratio from its confidence interval."""
    se = (F.ln(hi) - F.ln(lo)) / (2 * z)
    return F.ln(hr), se * se


def smcr(post: Column, pre: Column, sd_pre: Column, n: Column, r: Column) -> Effect:
    """Standardised mean change with raw-score standardisation."""
    y = (post - pre) / sd_pre * hedges_j((n - 1).cast("double"))
    return y, 2 * (1 - r) / n + y * y / (2 * n)


def d_from_t(t: Column, n1: Column, n2: Column) -> Effect:
    d = t * F.sqrt(1 / n1 + 1 / n2)
    return d, 1 / n1 + 1 / n2 + d * d / (2 * (n1 + n2))


def d_from_f(f: Column, n1: Column, n2: Column) -> Effect:
    return d_from_t(F.sqrt(f), n1, n2)


def d_from_r(r: Column, n: Column) -> Effect:
    d = 2 * r / F.sqrt(1 - r * r)
    return d, 4 * (1 - r * r) ** 2 / (n - 1) / (1 - r * r) ** 3


def d_from_log_or(y: Column, v: Column) -> Effect:
    k = math.sqrt(3) / math.pi
    return y * k, v * k * k


def sd_from_se(se: Column, n: Column) -> Column:
    return se * F.sqrt(n)


def aggregated(effects: DataFrame, study: str, rho: float) -> DataFrame:
    """Mean effect of each study and its variance under correlation ``rho`` of its effects; closed form, one aggregate."""
    m = F.count(F.lit(1))
    s = F.sum(F.sqrt("vi"))
    return effects.groupBy(study).agg(F.avg("yi").alias("yi"), ((F.sum("vi") + rho * (s * s - F.sum("vi"))) / (m * m)).alias("vi"), m.alias("effects"))


def guards(e: DataFrame) -> DataFrame:
    """Warnings of arm-level rows (outcome, m, sd, n, yi): an SD more than three times or less than a third of its peers' median, an effect beyond three."""
    peers = e.groupBy("outcome").agg(F.median("sd").alias("_mid"), F.count(F.lit(1)).alias("_n"))
    j = e.join(peers, "outcome")
    odd = (F.col("_n") > 2) & ((F.col("sd") > 3 * F.col("_mid")) | (F.col("sd") * 3 < F.col("_mid")))
    return j.withColumn("warnings", F.array_compact(F.array(F.when(odd, "sd-outlier"), F.when(F.abs("yi") > 3, "extreme-effect")))).drop("_mid", "_n")


def overall_bias(judged: DataFrame, order: tuple[str, ...] = ("low", "some", "high")) -> DataFrame:
    """The worst judgement of each study's domains; 'no information' if one is missing."""
    rank = F.coalesce(*[F.when(F.col("judgement") == x, k) for k, x in enumerate(order)])
    g = judged.groupBy("study").agg(F.max(rank).alias("r"), F.count(F.when(rank.isNull(), 1)).alias("missing"), F.count(F.lit(1)).alias("domains"))
    name = F.coalesce(*[F.when(F.col("r") == k, x) for k, x in enumerate(order)])
    return g.select("study", F.when(F.col("missing") > 0, "no information").otherwise(name).alias("overall"), "domains")
