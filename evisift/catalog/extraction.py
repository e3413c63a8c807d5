"""Queries over extracted values: effects by design, analysis rows, risk of bias, provenance, two extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisift.catalog import effects as fx
from evisift.operators import extraction
from evisift.session import table


def _reports(spark, d):
    """Arms as each design would report them, by the size of a study; every fifth lacks a mean or a count."""
    arms = fx._arms(spark, d).join(fx._cells(spark, d), ["study", "outcome"])
    kind = F.expr("cast((n1 * 7 + n2) % 11 as int)")
    num = {k: F.col(k).cast("double") for k in ("n1", "m1", "sd1", "n2", "m2", "sd2", "a", "b", "c", "d")}
    lacking = (F.col("n1") % 5) == 0
    t = (num["m1"] - num["m2"]) / F.sqrt(num["sd1"] ** 2 / num["n1"] + num["sd2"] ** 2 / num["n2"])
    one = F.when(t < 0, -1.0).otherwise(1.0)
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    inputs = {
        0: m(n1=num["n1"], m1=F.when(~lacking, num["m1"]), sd1=num["sd1"], n2=num["n2"], m2=num["m2"], se2=num["sd2"] / F.sqrt(num["n2"])),
        1: m(n1=num["n1"], m1=num["m1"], sd1=F.when(~lacking, num["sd1"]), n2=num["n2"], m2=num["m2"], sd2=num["sd2"]),
        2: m(t=F.when(~lacking, t), n1=num["n1"], n2=num["n2"]),
        3: m(F=t * t, n1=num["n1"], n2=num["n2"], direction=F.when(~lacking, one)),
        4: m(chi2=t * t / (1 + t * t), n=num["n1"] + num["n2"], direction=one),
        5: m(events1=num["a"], n1=num["a"] + num["b"], events2=num["c"], n2=F.when(~lacking, num["c"] + num["d"])),
        6: m(events=num["a"], n=num["a"] + num["b"]), 7: m(r=t / (1 + F.abs(t)), n=num["n1"]),
        8: m(hr=num["m1"] / num["m2"], ci_lo=num["m1"] / num["m2"] * 0.9, ci_hi=num["m1"] / num["m2"] * 1.1),
        9: m(yi=t, vi=1 / num["n1"]), 10: m(n=num["n1"]),
    }
    designs = ["two-group-means", "two-group-means", "t-test", "f-test", "chi-square", "two-group-binary", "single-group-proportion", "correlation", "hazard-ratio", "precomputed", "interview"]
    pick, name = F.lit(None).cast("map<string,double>"), F.lit(None).cast("string")
    for k, x in inputs.items():
        pick, name = F.when(kind == k, x).otherwise(pick), F.when(kind == k, designs[k]).otherwise(name)
    measure = F.when(kind == 1, "MD").when(kind == 5, F.when(F.col("n2") % 2 == 0, "logRR")).when(kind == 9, "SMD").when((kind == 2) & (F.col("n2") % 3 == 0), "logOR")
    return arms.select("study", "outcome", name.alias("design"), measure.alias("measure"), pick.alias("inputs"))


def effect_dispatch(spark, d):
    e = extraction.dispatched(_reports(spark, d))
    return e.select("study", "outcome", "design", F.col("measure_out").alias("measure"), F.bround("yi", 6).alias("yi"), F.bround("vi", 6).alias("vi"), F.coalesce("problem", F.lit("")).alias("problem"))


def effect_rows(spark, d):
    """Rows of an analysis of standardised mean differences where lower is better, and how many were left out for which reason."""
    r = extraction.analysis_rows(extraction.dispatched(_reports(spark, d)), "SMD", True, ~F.col("outcome").startswith("Type#1"))
    return r.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("reason").isNull(), F.col("n"))).alias("people"), F.bround(F.sum(F.when(F.col("reason").isNull(), F.col("yi"))), 5).alias("total"))


_Q = sorted({"1.1", "1.2", "1.3", "2.1", "2.2", "2.3", "2.4", "2.5", "2.6", "2.7", "3.1", "3.2", "3.3", "3.4", "4.1", "4.2", "4.3", "4.4", "4.5", "5.1", "5.2", "5.3"})
_SAID = ["Y", "PY", "PN", "N", "NI", "NA", None, "N", "Y"]


def _answers(spark, d):
    said = F.array(*[F.lit(x) for x in _SAID])
    q = [x for k, n in enumerate(_Q) for x in (F.lit(n), F.get(said, ((F.col("c_custkey") * (2 * k + 3) + F.floor(F.col("c_custkey") / (k + 2))) % len(_SAID)).cast("int")))]
    return table(spark, d, "customer").select("c_custkey", F.create_map(*q).alias("answers"))


def bias_flows(spark, d):
    """Judgements of the six domain flows for made-up answers, and the question needed next."""
    out = []
    for n in extraction.FLOWS:
        judgement, needed = extraction.bias_flow(n)
        out.append(F.struct(F.lit(n).alias("domain"), judgement.alias("judgement"), needed.alias("needed")))
    return _answers(spark, d).select("c_custkey", F.explode(F.array(*out)).alias("x")).select("c_custkey", "x.domain", "x.judgement", "x.needed")


def bias_moderators(spark, d):
    b = bias_flows(spark, d).where("domain in ('d1', 'd3', 'd5')").select(F.concat(F.lit("s"), F.col("c_custkey") % 40).alias("study"), "domain", "judgement", F.col("c_custkey").alias("ts"), F.col("c_custkey").alias("id"))
    return extraction.bias_moderators(b, ["d1", "d3", "d5"]).withColumnsRenamed({"rob.d1": "d1", "rob.d3": "d3", "rob.d5": "d5"})


def bias_overall(spark, d):
    """Overall grades by the rule with 'no information'; judgements of four grades."""
    b = table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 40).alias("study"), F.lit("d").alias("domain"), F.get(F.array(*map(F.lit, ("low", "moderate", "no information", "low"))), (F.floor(F.col("c_custkey") / 40) % 4).cast("int")).alias("judgement"), "c_custkey")
    b = b.where("c_custkey % 40 < 30 or c_custkey % 3 = 0")
    return extraction.overall_bias(b, ("low", "moderate", "serious", "critical"))


def provenance_values(spark, d):
    return extraction.provenance_table(table(spark, d, "extraction_values"))


def reconciliation(spark, d):
    r = extraction.reconciled(table(spark, d, "extraction_values"))
    return r.select("study", "field", "extractors", "status", F.when(F.col("resolved") == "NR", "NR").when(F.col("resolved").isNotNull(), "answer").alias("resolved"))


def sweep_rho(spark, d):
    """Pooled mean of the studies' aggregated effects for three assumed correlations of the effects within a study."""
    from evisift.operators import effects, pooling

    e, out = fx._effects(spark, d), None
    for rho in (0.2, 0.5, 0.8):
        a = effects.aggregated(e, "study", rho).select(F.lit(rho).alias("rho"), "yi", "vi")
        out = a if out is None else out.unionByName(a)
    p = pooling.common_effect(out, ["rho"])
    return p.select("rho", "k", F.bround("mu", 6).alias("mu"), F.bround("se", 6).alias("se"))


def sensitivity(spark, d):
    """Pooled means of everything, of one subset, without extreme effects, and of the largest effects left out."""
    from evisift.operators import pooling

    e = fx._effects(spark, d)
    runs = {"all": F.lit(True), "subset": F.col("study").endswith("1"), "no-extremes": F.abs("yi") <= 1.0, "precise": F.col("vi") < 0.5}
    x = e.select("yi", "vi", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in runs.items()]))).alias("run"))
    p = pooling.common_effect(x, ["run"])
    return p.select("run", "k", F.bround("mu", 6).alias("mu"), F.bround("se", 6).alias("se"))


def freeman_tukey_instability(spark, d):
    """Outcomes whose largest study has more than ten times the people of the smallest."""
    n = fx._lines(spark, d).groupBy("outcome", "study").agg(F.count(F.lit(1)).alias("n"))
    g = n.where("n > 0").groupBy("outcome").agg((F.max("n") / F.min("n")).alias("ratio"))
    return g.select("outcome", F.bround("ratio", 6).alias("ratio"), (F.col("ratio") > 10).alias("unstable"))


QUERIES = {f.__name__: f for f in (effect_dispatch, effect_rows, bias_flows, bias_moderators, bias_overall, provenance_values, reconciliation, sweep_rho, sensitivity, freeman_tukey_instability)}

_REP = f"""{fx._CELLS.replace('WITH', 'WITH', 1)}, arms AS (SELECT study, outcome, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS sd1, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS n1,
  avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, stddev_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS sd2, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS n2 FROM l GROUP BY ALL HAVING n1 > 1 AND n2 > 1),
  rep AS (SELECT *, CAST((n1 * 7 + n2) % 11 AS INT) AS k, n1 % 5 = 0 AS lack, (m1 - m2) / sqrt(sd1 * sd1 / n1 + sd2 * sd2 / n2) AS t FROM arms JOIN cells USING (study, outcome)),
  jj AS (SELECT *, {fx._J.format('n1 + n2 - 2')} AS j, sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2)) AS sp, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS z, CASE WHEN a = 0 OR b = 0 THEN 0.5 ELSE 0 END AS ze,
    sqrt(t * t / (1 + t * t) / (n1 + n2)) * CASE WHEN t < 0 THEN -1 ELSE 1 END AS phi FROM rep),
  raw AS (SELECT *, CASE k WHEN 0 THEN 'two-group-means' WHEN 1 THEN 'two-group-means' WHEN 2 THEN 't-test' WHEN 3 THEN 'f-test' WHEN 4 THEN 'chi-square' WHEN 5 THEN 'two-group-binary' WHEN 6 THEN 'single-group-proportion' WHEN 7 THEN 'correlation' WHEN 8 THEN 'hazard-ratio' WHEN 9 THEN 'precomputed' ELSE 'interview' END AS design,
    CASE WHEN k = 1 THEN 'MD' WHEN k = 2 AND n2 % 3 = 0 THEN 'logOR' WHEN k IN (0, 2, 3, 4, 9) THEN 'SMD' WHEN k = 5 AND n2 % 2 = 0 THEN 'logRR' WHEN k = 5 THEN 'logOR' WHEN k = 6 THEN 'PLO' WHEN k = 7 THEN 'ZCOR' WHEN k = 8 THEN 'logHR' END AS measure,
    CASE k WHEN 0 THEN (m1 - m2) / sp * j WHEN 1 THEN m1 - m2 WHEN 2 THEN t * sqrt(1 / n1 + 1 / n2) WHEN 3 THEN t * sqrt(1 / n1 + 1 / n2) WHEN 4 THEN 2 * phi / sqrt(1 - phi * phi)
      WHEN 5 THEN CASE WHEN n2 % 2 = 0 THEN ln(((a + z) / (a + b + 2 * z)) / ((c + z) / (c + d + 2 * z))) ELSE ln((a + z) * (d + z) / ((b + z) * (c + z))) END
      WHEN 6 THEN CASE WHEN a + b > 0 THEN ln((a + ze) / (b + ze)) END WHEN 7 THEN atanh(t / (1 + abs(t))) WHEN 8 THEN ln(m1 / m2) WHEN 9 THEN t END AS y FROM jj),
  val AS (SELECT *, CASE k WHEN 0 THEN 1 / n1 + 1 / n2 + y * y / (2 * (n1 + n2)) WHEN 1 THEN sd1 * sd1 / n1 + sd2 * sd2 / n2 WHEN 2 THEN 1 / n1 + 1 / n2 + y * y / (2 * (n1 + n2)) WHEN 3 THEN 1 / n1 + 1 / n2 + y * y / (2 * (n1 + n2))
      WHEN 4 THEN 4 / ((n1 + n2 - 1) * (1 - phi * phi)) WHEN 5 THEN CASE WHEN n2 % 2 = 0 THEN 1 / (a + z) - 1 / (a + b + 2 * z) + 1 / (c + z) - 1 / (c + d + 2 * z) ELSE 1 / (a + z) + 1 / (b + z) + 1 / (c + z) + 1 / (d + z) END
      WHEN 6 THEN 1 / (a + ze) + 1 / (b + ze) WHEN 7 THEN CASE WHEN n1 <> 3 THEN 1 / (n1 - 3) END WHEN 8 THEN pow(ln(1.1::DOUBLE / 0.9::DOUBLE) / (2 * 1.959963984540054), 2) WHEN 9 THEN 1 / n1 END AS v FROM raw),
  eff AS (SELECT *, CASE WHEN k = 10 THEN 'unknown design' WHEN k = 2 AND measure = 'logOR' THEN 'measure not of this design' WHEN lack AND k IN (0, 1, 2, 3, 5) THEN 'missing: ' || ['m1', 'sd1', 't', 'direction', '', 'n2'][k + 1] WHEN y IS NULL OR v IS NULL OR NOT isfinite(y) OR NOT isfinite(v) THEN 'no finite effect' END AS problem FROM val)"""
_ANS = "ans AS (SELECT c_custkey, " + ", ".join(f"[{', '.join('NULL' if x is None else repr(x) for x in _SAID)}][1 + CAST((c_custkey * {2 * k + 3} + c_custkey // {k + 2}) % {len(_SAID)} AS INT)] AS q{n.replace('.', '')}" for k, n in enumerate(_Q)) + " FROM customer)"
_Y, _N = "IN ('Y', 'PY')", "IN ('N', 'PN')"


def _flow(name: str, *steps: tuple[str, str]) -> str:
    """Steps of (condition, result) in the order in which a reader of the printed flow meets them; the first that holds decides."""
    return f"SELECT c_custkey, '{name}' AS domain, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in steps) + " END AS r FROM ans"


def _null(q: str, more: str = "true") -> tuple[str, str]:
    return f"({more}) AND q{q.replace('.', '')} IS NULL", f"?{q}"


_AWARE = f"NOT (q21 {_N} AND q22 {_N})"
_FLOWS = " UNION ALL ".join([
    _flow("d1", _null("1.2"), (f"q12 {_N}", "high"), _null("1.3", "q12 = 'NI'"), (f"q12 = 'NI' AND q13 {_Y}", "high"), ("q12 = 'NI'", "some concerns"), _null("1.1"), (f"q11 {_N}", "some concerns"), _null("1.3"), (f"q13 {_Y}", "some concerns"), ("true", "low")),
    _flow("d2-adhering", _null("2.1"), _null("2.2", f"q21 {_N}"), _null("2.3", _AWARE), (f"{_AWARE} AND q23 NOT IN ('Y', 'PY', 'NA') AND q26 IS NULL", "?2.6"), (f"{_AWARE} AND q23 NOT IN ('Y', 'PY', 'NA') AND q26 {_Y}", "some concerns"),
          (f"{_AWARE} AND q23 NOT IN ('Y', 'PY', 'NA')", "high"), _null("2.4"), _null("2.5"), ("q24 IN ('N', 'PN', 'NA') AND q25 IN ('N', 'PN', 'NA')", "low"), _null("2.6"), (f"q26 {_Y}", "some concerns"), ("true", "high")),
    _flow("d3", _null("3.1"), (f"q31 {_Y}", "low"), _null("3.2"), (f"q32 {_Y}", "low"), _null("3.3"), (f"q33 {_N}", "low"), _null("3.4"), (f"q34 {_N}", "some concerns"), ("true", "high")),
    _flow("d4", _null("4.1"), (f"q41 {_Y}", "high"), _null("4.2"), (f"q42 {_Y}", "high"), _null("4.3"), (f"q43 {_N} AND q42 = 'NI'", "some concerns"), (f"q43 {_N}", "low"), _null("4.4"), (f"q44 {_N} AND q42 = 'NI'", "some concerns"), (f"q44 {_N}", "low"), _null("4.5"), (f"q45 {_N}", "some concerns"), ("true", "high")),
    _flow("d5", _null("5.2"), (f"q52 {_Y}", "high"), _null("5.3"), (f"q53 {_Y}", "high"), (f"NOT (q52 {_N} AND q53 {_N})", "some concerns"), _null("5.1"), (f"q51 {_Y}", "low"), ("true", "some concerns")),
])
_D2_ONE = _flow("one", _null("2.1"), _null("2.2", f"q21 {_N}"), (f"q21 {_N} AND q22 {_N}", "low"), _null("2.3"), (f"q23 {_N}", "low"), ("q23 = 'NI'", "some concerns"), _null("2.4"), (f"q24 {_N}", "some concerns"), _null("2.5"), (f"q25 {_Y}", "some concerns"), ("true", "high"))
_D2_TWO = _flow("two", _null("2.6"), (f"q26 {_Y}", "low"), _null("2.7"), (f"q27 {_N}", "some concerns"), ("true", "high"))
_BIAS = f"""WITH {_ANS}, p AS ({_FLOWS} UNION ALL SELECT o.c_custkey, 'd2-assignment', CASE WHEN o.r LIKE '?%' THEN o.r WHEN w.r LIKE '?%' THEN w.r WHEN 'high' IN (o.r, w.r) THEN 'high' WHEN 'some concerns' IN (o.r, w.r) THEN 'some concerns' ELSE 'low' END FROM ({_D2_ONE}) o JOIN ({_D2_TWO}) w USING (c_custkey)),
  b AS (SELECT c_custkey, domain, CASE WHEN r NOT LIKE '?%' THEN r END AS judgement, CASE WHEN r LIKE '?%' THEN r[2:] END AS needed FROM p)"""

ORACLE = {
    "effect_dispatch": _REP + " SELECT study, outcome, design, measure, round_even(CASE WHEN problem IS NULL THEN y END, 6) AS yi, round_even(CASE WHEN problem IS NULL THEN v END, 6) AS vi, coalesce(problem, '') AS problem FROM eff",
    "effect_rows": _REP + """, x AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'cannot be computed' WHEN measure <> 'SMD' THEN 'other measure' WHEN NOT v > 0 THEN 'zero variance' WHEN starts_with(outcome, 'Type#1') THEN 'filter' ELSE 'kept' END AS reason,
      CASE WHEN k IN (0, 1, 2, 3) THEN n1 + n2 WHEN k = 4 THEN n1 + n2 END AS n FROM eff)
      SELECT reason, count(*) AS rows, CAST(sum(n) FILTER (reason = 'kept') AS BIGINT) AS people, round_even(sum(-y) FILTER (reason = 'kept'), 5) AS total FROM x GROUP BY reason""",
    "bias_flows": _BIAS + " SELECT c_custkey, domain, judgement, needed FROM b",
    "bias_moderators": _BIAS + """, z AS (SELECT 's' || (c_custkey % 40) AS study, domain, judgement, c_custkey AS id FROM b WHERE domain IN ('d1', 'd3', 'd5')), last AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY study, domain ORDER BY id DESC) = 1)
      SELECT study, CASE WHEN count(judgement) < 3 THEN NULL WHEN count(*) FILTER (judgement = 'high') > 0 THEN 'high' WHEN count(*) FILTER (judgement = 'some concerns') > 0 THEN 'some concerns' ELSE 'low' END AS rob_overall,
      max(judgement) FILTER (domain = 'd1') AS d1, max(judgement) FILTER (domain = 'd3') AS d3, max(judgement) FILTER (domain = 'd5') AS d5 FROM last GROUP BY study""",
    "bias_overall": """WITH j AS (SELECT 's' || (c_custkey % 40) AS study, ['low', 'moderate', 'no information', 'low'][1 + CAST(c_custkey // 40 % 4 AS INT)] AS g FROM customer WHERE c_custkey % 40 < 30 OR c_custkey % 3 = 0)
      SELECT study, CASE WHEN bool_or(g = 'no information') THEN 'no information' WHEN bool_or(g = 'moderate') THEN 'moderate' ELSE 'low' END AS overall FROM j GROUP BY study""",
    "provenance_values": "SELECT study, field, value, unit, not_reported, source, extracted_by, entered_at FROM extraction_values WHERE study IS NOT NULL AND field IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study, field ORDER BY entered_at DESC NULLS LAST, value_id DESC) = 1",
    "reconciliation": """WITH a AS (SELECT study, field, extracted_by, entered_at, value_id, CASE WHEN coalesce(not_reported, false) OR value IS NULL AND entered IS NULL THEN 'NR' WHEN value IS NOT NULL THEN round_even(value, 6)::VARCHAR || coalesce(' ' || unit, '') ELSE trim(entered) END AS answer
        FROM extraction_values WHERE study IS NOT NULL AND field IS NOT NULL AND extracted_by IS NOT NULL), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY study, field, extracted_by ORDER BY entered_at DESC NULLS LAST, value_id DESC) = 1),
      g AS (SELECT study, field, count(*) AS extractors, count(DISTINCT answer) AS kinds, count(*) FILTER (answer = 'NR') AS nr, min(answer) AS one FROM l GROUP BY ALL)
      SELECT study, field, extractors, CASE WHEN extractors = 1 THEN 'one' WHEN kinds = 1 THEN 'agree' WHEN nr > 0 THEN 'presence' ELSE 'differ' END AS status, CASE WHEN kinds = 1 THEN CASE WHEN one = 'NR' THEN 'NR' ELSE 'answer' END END AS resolved FROM g""",
    "sweep_rho": fx._CELLS + """, a AS (SELECT rho, study, avg(yi) AS yi, (sum(vi) + rho * (pow(sum(sqrt(vi)), 2) - sum(vi))) / (count(*) * count(*)) AS vi FROM e CROSS JOIN (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) AS r(rho) GROUP BY rho, study)
      SELECT rho, count(*) AS k, round_even(sum(yi / vi) / sum(1 / vi), 6) AS mu, round_even(sqrt(1 / sum(1 / vi)), 6) AS se FROM a GROUP BY rho""",
    "sensitivity": fx._CELLS + """, x AS (SELECT 'all' AS run, * FROM e UNION ALL SELECT 'subset', * FROM e WHERE study LIKE '%1' UNION ALL SELECT 'no-extremes', * FROM e WHERE abs(yi) <= 1 UNION ALL SELECT 'precise', * FROM e WHERE vi < 0.5)
      SELECT run, count(*) AS k, round_even(sum(yi / vi) / sum(1 / vi), 6) AS mu, round_even(sqrt(1 / sum(1 / vi)), 6) AS se FROM x GROUP BY run""",
    "freeman_tukey_instability": f"WITH {fx._LINES}, n AS (SELECT outcome, study, count(*) AS n FROM l GROUP BY ALL) SELECT outcome, round_even(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 10 AS unstable FROM n GROUP BY outcome",
}
