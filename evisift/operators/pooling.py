"""Pooling on DataFrames: aggregates where a closed form exists, grouped functions on one row-set a model elsewhere.

A model is fitted to the studies of one outcome, tens to hundreds of rows, after all aggregation to studies has been done by
Spark; the number of models, not the size of one, grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evisift.meta import bias, models


def sums(e: DataFrame, by: list[str]) -> DataFrame:
    """Weighted moments of effects (yi, vi) per model."""
    w = 1 / F.col("vi")
    y = F.col("yi")
    return e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"), F.sum(w * w).alias("sww"),
        F.avg("yi").alias("ybar"), F.var_samp("yi").alias("s2"), F.avg("vi").alias("vbar"),
    )


def common_effect(e: DataFrame, by: list[str]) -> DataFrame:
    """``mu, se, q, df, i2, h2`` of the common-effect model, from sums only."""
    q = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    s = sums(e, by).withColumn("q", q).withColumn("df", F.col("k") - 1)
    return s.select(*by, "k", (F.col("swy") / F.col("sw")).alias("mu"), F.sqrt(1 / F.col("sw")).alias("se"), "q", "df", F.greatest(F.lit(0.0), F.try_divide(100 * (F.col("q") - F.col("df")), F.col("q"))).alias("i2"), F.try_divide("q", "df").alias("h2"))


def tau2_closed(e: DataFrame, by: list[str], how: str) -> DataFrame:
    """``tau2`` by DL, HE, HS or SJ without moderators, from sums (SJ: two passes); zero for a single study."""
    s = sums(e, by).withColumn("q", F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    if how == "DL":
        t = F.try_divide(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sww") / F.col("sw"))
    elif how == "HS":
        t = (F.col("q") - F.col("k")) / F.col("sw")
    elif how == "HE":
        t = F.col("s2") - F.col("vbar")
    elif how == "SJ":
        seed = e.groupBy(*by).agg(F.var_pop("yi").alias("seed"))
        j = e.join(seed, by) if by else e.crossJoin(seed)
        w = 1 / (F.col("vi") + F.col("seed"))
        r = j.groupBy(*by, "seed").agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col("yi")).alias("swy"), F.sum(w * F.col("yi") * F.col("yi")).alias("swyy"))
        t = F.try_divide(F.col("seed") * (F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")), F.col("k") - 1)
        return r.select(*by, "k", F.coalesce(F.greatest(F.lit(0.0), t), F.lit(0.0)).alias("tau2"))
    else:
        raise ValueError(how)
    return s.select(*by, "k", F.when(F.col("k") > 1, F.coalesce(F.greatest(F.lit(0.0), t), F.lit(0.0))).otherwise(0.0).alias("tau2"))


def random_effects(e: DataFrame, tau: DataFrame, by: list[str]) -> DataFrame:
    """``mu, se`` at a given ``tau2``."""
    j = e.join(tau.select(*by, "tau2"), by) if by else e.crossJoin(tau.select("tau2"))
    w = 1 / (F.col("vi") + F.col("tau2"))
    return j.groupBy(*by, "tau2").agg((F.sum(w * F.col("yi")) / F.sum(w)).alias("mu"), F.sqrt(1 / F.sum(w)).alias("se"), F.count(F.lit(1)).alias("k"))


def leave_one_out(e: DataFrame, by: list[str], study: str) -> DataFrame:
    """Common-effect estimate without each study: totals less its own terms."""
    s = sums(e, by).select(*by, "sw", "swy")
    j = e.join(s, by) if by else e.crossJoin(s)
    w = 1 / F.col("vi")
    return j.select(*by, study, ((F.col("swy") - w * F.col("yi")) / (F.col("sw") - w)).alias("mu"), F.sqrt(1 / (F.col("sw") - w)).alias("se"))


def cumulative(e: DataFrame, by: list[str], study: str, order: list[str]) -> DataFrame:
    """Common-effect estimate of each growing prefix: running sums."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sw = F.sum(1 / F.col("vi")).over(w)
    return e.select(*by, study, F.count(F.lit(1)).over(w).alias("k"), (F.sum(F.col("yi") / F.col("vi")).over(w) / sw).alias("mu"), F.sqrt(1 / sw).alias("se"))


def baujat(e: DataFrame, by: list[str], study: str) -> DataFrame:
    """Contribution of a study to Q and its influence on the estimate."""
    s = sums(e, by).select(*by, "sw", "swy")
    j = e.join(s, by) if by else e.crossJoin(s)
    w = 1 / F.col("vi")
    mu, rest = F.col("swy") / F.col("sw"), (F.col("swy") - w * F.col("yi")) / (F.col("sw") - w)
    return j.select(*by, study, ((F.col("yi") - mu) ** 2 / F.col("vi")).alias("contribution"), ((mu - rest) ** 2 * (F.col("sw") - w)).alias("influence"))


def egger_line(e: DataFrame, by: list[str]) -> DataFrame:
    """Intercept and slope of effects on their standard errors, weights 1/vi, from sums."""
    w, x, y = 1 / F.col("vi"), F.sqrt("vi"), F.col("yi")
    s = e.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.count(F.lit(1)).alias("k"))
    slope = F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.withColumn("slope", slope).select(*by, "k", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("w")).alias("intercept"), "slope")


def _grouped(e: DataFrame, by: list[str], f, schema: str) -> DataFrame:
    keys = {c: e.schema[c].dataType.simpleString() for c in by}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf.sort_values([c for c in ("study", "yi") if c in pdf]))
        for c in by:
            out.insert(0, c, pdf[c].iloc[0])
        out = out[[*by, *[c for c in out.columns if c not in by]]]
        # a frame without rows has no types that Arrow could take over
        return out if len(out) else pd.DataFrame({c: pd.Series([], dtype=object) for c in out.columns})

    return e.groupBy(*by).applyInPandas(run, ", ".join([f"{c} {t}" for c, t in keys.items()]) + ", " + schema)


def pooled(e: DataFrame, by: list[str], how: str = "REML", test: str = "z") -> DataFrame:
    """``mu, se, lo, hi, p, tau2, tau2_lo, tau2_hi, q, i2, h2, pi_lo, pi_hi, k`` by any estimator."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, v = p["yi"].to_numpy(float), p["vi"].to_numpy(float)
        f = models.fit(y, v, how=how, test=test)
        t = models.q_profile(y, v, np.ones((len(y), 1))) if len(y) > 1 else (0.0, 0.0)
        pi = models.prediction_interval(f) or (None, None)
        return pd.DataFrame([{"mu": f.b[0], "se": f.se[0], "lo": f.lo[0], "hi": f.hi[0], "p": f.p[0], "tau2": f.tau2, "tau2_lo": t[0], "tau2_hi": t[1], "q": f.q, "i2": f.i2, "h2": f.h2, "pi_lo": pi[0], "pi_hi": pi[1], "k": f.k}])

    return _grouped(e, by, run, "mu double, se double, lo double, hi double, p double, tau2 double, tau2_lo double, tau2_hi double, q double, i2 double, h2 double, pi_lo double, pi_hi double, k bigint")


def regression(e: DataFrame, by: list[str], numbers: list[str], how: str = "REML", test: str = "z") -> DataFrame:
    """``term, b, se, p, tau2, qm, r2`` of a meta-regression on numeric moderators."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, v = p["yi"].to_numpy(float), p["vi"].to_numpy(float)
        x, names = models.design({c: p[c].astype(float).tolist() for c in numbers}, centre=False)
        f = models.fit(y, v, x, how, test)
        m = models.moderators(f, models.tau2(y, v, np.ones((len(y), 1)), how))
        return pd.DataFrame({"term": names, "b": f.b, "se": f.se, "p": f.p, "tau2": f.tau2, "qm": m["qm"], "r2": m["r2"]})

    return _grouped(e, by, run, "term string, b double, se double, p double, tau2 double, qm double, r2 double")


def bias_tests(e: DataFrame, by: list[str], force: bool = False) -> DataFrame:
    """``test, estimate, p`` of Egger, Begg, PET-PEESE and trim-and-fill. Fewer than ten studies give no row, as these tests say little there; with ``force`` three are enough."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, v = p["yi"].to_numpy(float), p["vi"].to_numpy(float)
        if len(y) < (3 if force else 10):
            return pd.DataFrame({"test": [], "estimate": [], "p": []})
        try:
            be = bias.begg(y, v)
        except ValueError:  # effects that cannot be standardised: no result, and no end for the other groups
            be = {"tau": None, "p": None}
        eg, pp, tf = bias.egger(y, v), bias.pet_peese(y, v), bias.trim_and_fill(y, v)
        rows = [("egger", eg["slope"], eg["p_slope"]), ("begg", be["tau"], be["p"]), ("pet-peese", pp["chosen"], None), ("trim-fill", tf["b"], None), ("trim-fill-k0", float(tf["k0"]), None)]
        return pd.DataFrame(rows, columns=["test", "estimate", "p"])

    return _grouped(e, by, run, "test string, estimate double, p double")


def influence(e: DataFrame, by: list[str]) -> DataFrame:
    """Deletion diagnostics of each study (column ``study``)."""
    names = ["rstudent", "dffits", "cook", "cov_ratio", "tau2_del", "q_del", "hat", "weight", "dfbetas", "flag"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) < 3:
            return pd.DataFrame({c: [] for c in ("study", *names)})
        out = pd.DataFrame(bias.influence(p["yi"].to_numpy(float), p["vi"].to_numpy(float)))
        out.insert(0, "study", p["study"].to_numpy())
        return out

    return _grouped(e, by, run, "study string, " + ", ".join(f"{c} double" for c in names))


def robust(e: DataFrame, by: list[str], rho: float = 0.8) -> DataFrame:
    """CHE model with CR2 standard errors; effects nested in column ``study``."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y, v = p["yi"].to_numpy(float), p["vi"].to_numpy(float)
        x = np.ones((len(y), 1))
        m = models.che(y, v, x, p["study"].to_numpy(), rho)
        work = [np.linalg.inv(i) for i in m["inverse"]]
        r = models.cr2(y, x, m["b"], m["groups"], m["inverse"], work)
        return pd.DataFrame([{"mu": m["b"][0], "se": r["se"][0], "df": r["df"][0], "p": r["p"][0], "sigma2_study": m["sigma2_study"], "sigma2_effect": m["sigma2_effect"], "few_clusters": len(m["groups"]) < 20}])

    return _grouped(e, by, run, "mu double, se double, df double, p double, sigma2_study double, sigma2_effect double, few_clusters boolean")
