"""Effect sizes and meta-analysis over the order tables: a brand is a study, a part type an outcome, return flags are arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisift.operators import effects, pooling
from evisift.session import table


def _lines(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("study"), F.col("p_type").alias("outcome"), "p_size")
    l = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")  # noqa: E741
    return l.join(p, F.col("l_partkey") == F.col("p_partkey"))


def _arms(spark, d):
    """Means, deviations and counts of two arms per study and outcome."""
    g = _lines(spark, d).where("l_returnflag in ('A', 'R')").groupBy("study", "outcome")
    stat = lambda f, flag, a: f(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))).alias(a)
    return g.agg(
        stat(F.avg, "A", "m1"), stat(F.stddev_samp, "A", "sd1"), stat(F.count, "A", "n1"), stat(F.avg, "R", "m2"), stat(F.stddev_samp, "R", "sd2"), stat(F.count, "R", "n2"),
    ).where("n1 > 1 and n2 > 1")


def _cells(spark, d):
    """2x2 tables: events are finished lines, arms are return flags."""
    c = lambda flag, s, a: F.count(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == s), 1)).cast("double").alias(a)
    return _lines(spark, d).groupBy("study", "outcome").agg(c("A", "F", "a"), c("A", "O", "b"), c("R", "F", "c"), c("R", "O", "d")).where("a + b > 0 and c + d > 0")


def _six(df, *names):
    return df.select(*[F.bround(F.col(c), 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _effect(df, e, *keep):
    return _six(df.select(*keep, e[0].alias("yi"), e[1].alias("vi")), "yi", "vi")


_SIX = ("m1", "sd1", "n1", "m2", "sd2", "n2")
_FOUR = ("a", "b", "c", "d")


def effect_md(spark, d):
    return _effect(_arms(spark, d), effects.md(*map(F.col, _SIX)), "study", "outcome")


def effect_smd(spark, d):
    return _effect(_arms(spark, d), effects.smd(*map(F.col, _SIX)), "study", "outcome")


def effect_logor(spark, d):
    return _effect(_cells(spark, d), effects.log_or(*map(F.col, _FOUR)), "study", "outcome")


def effect_logrr(spark, d):
    return _effect(_cells(spark, d), effects.log_rr(*map(F.col, _FOUR)), "study", "outcome")


def effect_rd(spark, d):
    return _effect(_cells(spark, d), effects.risk_difference(*map(F.col, _FOUR)), "study", "outcome")


def effect_zcor(spark, d):
    g = _lines(spark, d).groupBy("study", "outcome").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n")).where("n > 3")
    return _effect(g, effects.fisher_z(F.col("r"), F.col("n")), "study", "outcome")


def _proportions(spark, d):
    return _lines(spark, d).groupBy("study", "outcome").agg(F.count(F.when(F.col("l_linestatus") == "F", 1)).cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))


def effect_plo(spark, d):
    return _effect(_proportions(spark, d), effects.logit(F.col("x"), F.col("n")), "study", "outcome")


def effect_pft(spark, d):
    p = _proportions(spark, d)
    e = effects.freeman_tukey(F.col("x"), F.col("n"))
    return _six(p.select("study", "outcome", e[0].alias("yi"), e[1].alias("vi"), effects.inverse_freeman_tukey(e[0], F.col("n")).alias("back")), "yi", "vi", "back")


def effect_loghr(spark, d):
    """A ratio of means stands for the hazard ratio, a tenth either way for its interval."""
    a = _arms(spark, d).withColumn("hr", F.col("m1") / F.col("m2"))
    return _effect(a, effects.log_hr(F.col("hr"), F.col("hr") * 0.9, F.col("hr") * 1.1), "study", "outcome")


def effect_smcr(spark, d):
    return _effect(_arms(spark, d), effects.smcr(F.col("m1"), F.col("m2"), F.col("sd2"), F.col("n2"), F.lit(0.5)), "study", "outcome")


def effect_conversions(spark, d):
    a = _arms(spark, d)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("sd1") ** 2 / F.col("n1") + F.col("sd2") ** 2 / F.col("n2"))
    a = a.withColumn("t", t)
    dt, df_, dr = effects.d_from_t(F.col("t"), F.col("n1"), F.col("n2")), effects.d_from_f(F.col("t") ** 2, F.col("n1"), F.col("n2")), effects.d_from_r(F.lit(0.3), F.col("n1"))
    do = effects.d_from_log_or(F.lit(0.7), F.lit(0.05))
    return _six(a.select("study", "outcome", dt[0].alias("d_t"), dt[1].alias("v_t"), df_[0].alias("d_f"), dr[1].alias("v_r"), do[0].alias("d_or"), effects.sd_from_se(F.col("sd1") / F.sqrt("n1"), F.col("n1")).alias("sd")), "d_t", "v_t", "d_f", "v_r", "d_or", "sd")


def _effects(spark, d):
    e = effects.log_or(*map(F.col, _FOUR))
    return _cells(spark, d).select("study", "outcome", e[0].alias("yi"), e[1].alias("vi"))


def aggregate_effects(spark, d):
    return _six(effects.aggregated(_effects(spark, d), "study", 0.6), "yi", "vi")


def pool_ce(spark, d):
    return _six(pooling.common_effect(_effects(spark, d), ["outcome"]), "mu", "se", "q", "i2", "h2")


def _tau(how):
    def query(spark, d):
        return _six(pooling.tau2_closed(_effects(spark, d), ["outcome"], how), "tau2")

    return query


def pool_dl(spark, d):
    e = _effects(spark, d)
    return _six(pooling.random_effects(e, pooling.tau2_closed(e, ["outcome"], "DL"), ["outcome"]), "tau2", "mu", "se")


def leave_one_out(spark, d):
    return _six(pooling.leave_one_out(_effects(spark, d), ["outcome"], "study"), "mu", "se")


def cumulative_ce(spark, d):
    return _six(pooling.cumulative(_effects(spark, d), ["outcome"], "study", ["study"]), "mu", "se")


def baujat(spark, d):
    return _six(pooling.baujat(_effects(spark, d), ["outcome"], "study"), "contribution", "influence")


def egger(spark, d):
    return _six(pooling.egger_line(_effects(spark, d), ["outcome"]), "intercept", "slope")


def quality_guards(spark, d):
    e = effects.smd(*map(F.col, _SIX))
    a = _arms(spark, d).select("study", "outcome", F.col("sd1").alias("sd"), e[0].alias("yi"))
    return effects.guards(a.withColumn("sd", F.when(F.col("study") == "Brand#7", F.col("sd") * 4).otherwise(F.col("sd")))).select("study", "outcome", F.array_join("warnings", ",").alias("warnings"))


def risk_of_bias(spark, d):
    j = _cells(spark, d).select("study", F.when(F.col("a") % 3 == 0, "low").when(F.col("a") % 3 == 1, "some").when(F.col("a") % 7 == 0, None).otherwise("high").alias("judgement"))
    return effects.overall_bias(j)


def pool_reml(spark, d):
    return pooling.pooled(_effects(spark, d), ["outcome"], "REML", "knha")


def pool_pm(spark, d):
    return pooling.pooled(_effects(spark, d), ["outcome"], "PM")


def meta_regression(spark, d):
    e = _effects(spark, d)
    size = _lines(spark, d).groupBy("study", "outcome").agg(F.avg("p_size").alias("size"))
    return pooling.regression(e.join(size, ["study", "outcome"]), ["outcome"], ["size"])


def bias_tests(spark, d):
    return pooling.bias_tests(_effects(spark, d), ["outcome"])


def influence(spark, d):
    return pooling.influence(_effects(spark, d), ["outcome"])


def robust_che(spark, d):
    return pooling.robust(_effects(spark, d).withColumn("all", F.lit("all")), ["all"])


QUERIES = {
    f.__name__: f
    for f in (
        effect_md, effect_smd, effect_logor, effect_logrr, effect_rd, effect_zcor, effect_plo, effect_pft, effect_loghr, effect_smcr, effect_conversions, aggregate_effects, pool_ce, pool_dl, leave_one_out,
        cumulative_ce, baujat, egger, quality_guards, risk_of_bias, pool_reml, pool_pm, meta_regression, bias_tests, influence, robust_che,
    )
} | {f"tau2_{how.lower()}": _tau(how) for how in ("DL", "HE", "HS", "SJ")}

_LINES = "l AS (SELECT p_brand AS study, p_type AS outcome, p_size, l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey)"
_ARMS = f"""WITH {_LINES}, arms AS (SELECT study, outcome, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS sd1, count(*) FILTER (l_returnflag = 'A') AS n1,
  avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS sd2, count(*) FILTER (l_returnflag = 'R') AS n2 FROM l GROUP BY ALL HAVING n1 > 1 AND n2 > 1)"""
_CELLS = f"""WITH {_LINES}, cells AS (SELECT study, outcome, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F')::DOUBLE AS a, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O')::DOUBLE AS b,
  count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F')::DOUBLE AS c, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O')::DOUBLE AS d FROM l GROUP BY ALL HAVING a + b > 0 AND c + d > 0),
  h AS (SELECT study, outcome, a + z AS a, b + z AS b, c + z AS c, d + z AS d FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS z FROM cells)),
  e AS (SELECT study, outcome, ln(a * d / (b * c)) AS yi, 1 / a + 1 / b + 1 / c + 1 / d AS vi FROM h)"""
_PROP = f"WITH {_LINES}, pr AS (SELECT study, outcome, count(*) FILTER (l_linestatus = 'F')::DOUBLE AS x, count(*)::DOUBLE AS n FROM l GROUP BY ALL)"
_J = "exp(lgamma(({0}) / 2.0) - lgamma((({0}) - 1) / 2.0)) / sqrt(({0}) / 2.0)"
_OUT = "round_even({0}, 6) AS {1}"


def _r(**kw: str) -> str:
    return ", ".join(_OUT.format(v, k) for k, v in kw.items())


_SUMS = _CELLS + """, s AS (SELECT outcome, count(*) AS k, sum(1 / vi) AS sw, sum(yi / vi) AS swy, sum(yi * yi / vi) AS swyy, sum(1 / (vi * vi)) AS sww, var_samp(yi) AS s2, avg(vi) AS vbar, var_pop(yi) AS seed FROM e GROUP BY outcome),
  q AS (SELECT *, swyy - swy * swy / sw AS q FROM s)"""
_BACK = """CASE WHEN sin(2 * t) = 0 THEN CASE WHEN cos(2 * t) > 0 THEN 0 ELSE 1 END ELSE 0.5 * (1 - sign(cos(2 * t)) * sqrt(greatest(0, 1 - pow(sin(2 * t) + (sin(2 * t) - 1 / sin(2 * t)) / n, 2)))) END"""

ORACLE = {
    "effect_md": _ARMS + " SELECT study, outcome, " + _r(yi="m1 - m2", vi="sd1 * sd1 / n1 + sd2 * sd2 / n2") + " FROM arms",
    "effect_smd": _ARMS + f", g AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) * {_J.format('n1 + n2 - 2')} AS g FROM arms) SELECT study, outcome, " + _r(yi="g", vi="1.0 / n1 + 1.0 / n2 + g * g / (2 * (n1 + n2))") + " FROM g",
    "effect_logor": _CELLS + " SELECT study, outcome, " + _r(yi="yi", vi="vi") + " FROM e",
    "effect_logrr": _CELLS + " SELECT study, outcome, " + _r(yi="ln((a / (a + b)) / (c / (c + d)))", vi="1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)") + " FROM h",
    "effect_rd": _CELLS + " SELECT study, outcome, " + _r(yi="a / (a + b) - c / (c + d)", vi="(a / (a + b)) * (1 - a / (a + b)) / (a + b) + (c / (c + d)) * (1 - c / (c + d)) / (c + d)") + " FROM cells",
    "effect_zcor": f"WITH {_LINES}, c AS (SELECT study, outcome, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM l GROUP BY ALL HAVING n > 3) SELECT study, outcome, " + _r(yi="atanh(r)", vi="1.0 / (n - 3)") + " FROM c",
    "effect_plo": _PROP + ", z AS (SELECT *, CASE WHEN x = 0 OR x = n THEN 0.5 ELSE 0 END AS z FROM pr) SELECT study, outcome, " + _r(yi="ln((x + z) / (n - x + z))", vi="1 / (x + z) + 1 / (n - x + z)") + " FROM z",
    "effect_pft": _PROP + ", z AS (SELECT *, 0.5 * (asin(sqrt(x / (n + 1))) + asin(sqrt((x + 1) / (n + 1)))) AS t FROM pr) SELECT study, outcome, " + _r(yi="t", vi="1 / (4 * n + 2)", back=_BACK) + " FROM z",
    "effect_loghr": _ARMS + " SELECT study, outcome, " + _r(yi="ln(m1 / m2)", vi="pow(ln(1.1::DOUBLE / 0.9::DOUBLE) / (2 * 1.959963984540054), 2)") + " FROM arms",
    "effect_smcr": _ARMS + f", g AS (SELECT *, (m1 - m2) / sd2 * {_J.format('n2 - 1')} AS y FROM arms) SELECT study, outcome, " + _r(yi="y", vi="1.0 / n2 + y * y / (2 * n2)") + " FROM g",
    "effect_conversions": _ARMS + ", t AS (SELECT *, (m1 - m2) / sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS t FROM arms) SELECT study, outcome, "
    + _r(d_t="t * sqrt(1.0 / n1 + 1.0 / n2)", v_t="1.0 / n1 + 1.0 / n2 + pow(t * sqrt(1.0 / n1 + 1.0 / n2), 2) / (2 * (n1 + n2))", d_f="abs(t) * sqrt(1.0 / n1 + 1.0 / n2)", v_r="4 / ((n1 - 1) * 0.91::DOUBLE)", d_or="0.7 * sqrt(3) / pi()", sd="sd1") + " FROM t",
    "aggregate_effects": _CELLS + " SELECT study, " + _r(yi="avg(yi)", vi="(sum(vi) + 0.6 * (pow(sum(sqrt(vi)), 2) - sum(vi))) / (count(*) * count(*))") + ", count(*) AS effects FROM e GROUP BY study",
    "pool_ce": _SUMS + " SELECT outcome, k, " + _r(mu="swy / sw", se="sqrt(1 / sw)", q="greatest(0, q)", i2="greatest(0, 100 * (q - (k - 1)) / q)", h2="greatest(0, q) / (k - 1)") + ", k - 1 AS df FROM q",
    "tau2_dl": _SUMS + " SELECT outcome, k, " + _r(tau2="greatest(0, (q - (k - 1)) / (sw - sww / sw))") + " FROM q",
    "tau2_he": _SUMS + " SELECT outcome, k, " + _r(tau2="greatest(0, s2 - vbar)") + " FROM q",
    "tau2_hs": _SUMS + " SELECT outcome, k, " + _r(tau2="greatest(0, (q - k) / sw)") + " FROM q",
    "tau2_sj": _SUMS + ", w AS (SELECT outcome, seed, count(*) AS k, sum(1 / (vi + seed)) AS sw, sum(yi / (vi + seed)) AS swy, sum(yi * yi / (vi + seed)) AS swyy FROM e JOIN (SELECT outcome, seed FROM s) USING (outcome) GROUP BY ALL) SELECT outcome, k, " + _r(tau2="greatest(0, seed * (swyy - swy * swy / sw) / (k - 1))") + " FROM w",
    "pool_dl": _SUMS + ", t AS (SELECT outcome, greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2 FROM q) SELECT outcome, " + _r(tau2="tau2", mu="sum(yi / (vi + tau2)) / sum(1 / (vi + tau2))", se="sqrt(1 / sum(1 / (vi + tau2)))") + ", count(*) AS k FROM e JOIN t USING (outcome) GROUP BY outcome, tau2",
    "leave_one_out": _SUMS + " SELECT outcome, study, " + _r(mu="(swy - yi / vi) / (sw - 1 / vi)", se="sqrt(1 / (sw - 1 / vi))") + " FROM e JOIN s USING (outcome)",
    "cumulative_ce": _CELLS + ", w AS (SELECT outcome, study, count(*) OVER w AS k, sum(yi / vi) OVER w AS a, sum(1 / vi) OVER w AS b FROM e WINDOW w AS (PARTITION BY outcome ORDER BY study ROWS UNBOUNDED PRECEDING)) SELECT outcome, study, k, " + _r(mu="a / b", se="sqrt(1 / b)") + " FROM w",
    "baujat": _SUMS + " SELECT outcome, study, " + _r(contribution="pow(yi - swy / sw, 2) / vi", influence="pow(swy / sw - (swy - yi / vi) / (sw - 1 / vi), 2) * (sw - 1 / vi)") + " FROM e JOIN s USING (outcome)",
    "egger": _CELLS + ", s AS (SELECT outcome, sum(1 / vi) AS w, sum(sqrt(vi) / vi) AS x, sum(yi / vi) AS y, sum(vi / vi) AS xx, sum(sqrt(vi) * yi / vi) AS xy, count(*) AS k FROM e GROUP BY outcome), b AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM s) SELECT outcome, k, " + _r(intercept="(y - slope * x) / w", slope="slope") + " FROM b",
    "quality_guards": _ARMS + f""", g AS (SELECT study, outcome, CASE WHEN study = 'Brand#7' THEN sd1 * 4 ELSE sd1 END AS sd, (m1 - m2) / sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) * {_J.format('n1 + n2 - 2')} AS y FROM arms),
      m AS (SELECT outcome, median(sd) AS mid, count(*) AS n FROM g GROUP BY outcome)
      SELECT study, outcome, concat_ws(',', CASE WHEN n > 2 AND (sd > 3 * mid OR sd * 3 < mid) THEN 'sd-outlier' END, CASE WHEN abs(y) > 3 THEN 'extreme-effect' END) AS warnings FROM g JOIN m USING (outcome)""",
    "risk_of_bias": _CELLS + """, j AS (SELECT study, CASE WHEN a % 3 = 0 THEN 0 WHEN a % 3 = 1 THEN 1 WHEN a % 7 = 0 THEN NULL ELSE 2 END AS r FROM cells)
      SELECT study, CASE WHEN count(*) FILTER (r IS NULL) > 0 THEN 'no information' ELSE ['low', 'some', 'high'][max(r) + 1] END AS overall, count(*) AS domains FROM j GROUP BY study""",
}
