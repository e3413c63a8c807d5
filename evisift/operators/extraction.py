"""Effects from reported numbers by design, rows for an analysis, risk-of-bias flows, and the values of two extractors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.meta import dist
from evisift.operators import effects as fx
from evisift.operators.folds import last_write

# The inputs that each design needs, and the measures it can give (the first one where none is named).
DESIGNS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "two-group-means": (("n1", "m1", "sd1", "n2", "m2", "sd2"), ("SMD", "MD")),
    "two-group-binary": (("events1", "n1", "events2", "n2"), ("logOR", "logRR", "RD")),
    "single-group-proportion": (("events", "n"), ("PLO", "PFT")),
    "correlation": (("r", "n"), ("ZCOR",)),
    "precomputed": (("yi", "vi"), ()),
    "pre-post": (("n", "m_pre", "sd_pre", "m_post", "sd_post", "r"), ("SMCR",)),
    "t-test": (("t", "n1", "n2"), ("SMD",)),
    "f-test": (("F", "n1", "n2", "direction"), ("SMD",)),
    "chi-square": (("chi2", "n", "direction"), ("SMD",)),
    "p-value-only": (("p", "n1", "n2", "direction"), ("SMD",)),
    "hazard-ratio": (("hr", "ci_lo", "ci_hi"), ("logHR",)),
}


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """Quantile of Student's t; null outside of 0 < p < 1 or for no degree of freedom."""
    return pd.Series([dist.t_ppf(a, b) if a is not None and b is not None and 0 < a < 1 and b >= 1 else None for a, b in zip(p.astype(object), df.astype(object))], dtype="float64")


def missing_inputs(design: Column, inputs: Column) -> Column:
    """Required inputs of a design that ``inputs`` (map<string,double>) lacks; a standard deviation is also met by a standard error or a confidence interval."""
    needed = F.element_at(F.create_map(*[x for d, (need, _) in DESIGNS.items() for x in (F.lit(d), F.array(*map(F.lit, need)))]), design)
    has = lambda k: F.try_element_at(inputs, k).isNotNull()

    def lacks(name: Column) -> Column:
        arm = F.substring(name, 3, 1)
        other = name.isin("sd1", "sd2") & (has(F.concat(F.lit("se"), arm)) | has(F.concat(F.lit("ci_lo"), arm)) & has(F.concat(F.lit("ci_hi"), arm)))
        return ~(has(name) | other)

    return F.filter(needed, lacks)


def dispatched(df: DataFrame) -> DataFrame:
    """``df`` (design, measure or null, inputs map<string,double>, other columns) with ``measure_out, yi, vi, double_zero, problem``.

    problem says why no effect can be had: an unknown design, a measure the design does not give, missing inputs, or inputs from which nothing finite follows; else null.
    A null design or map is an unknown design or has no input.
    """
    x = lambda k: F.try_element_at("inputs", F.lit(k))
    level = F.coalesce(x("ci_level"), F.lit(0.95))

    def sd(k: str) -> Column:
        n = x(f"n{k}")
        from_ci = (x(f"ci_hi{k}") - x(f"ci_lo{k}")) * F.sqrt(n) / (2 * t_quantile((1 + level) / 2, n - 1))
        return F.coalesce(x(f"sd{k}"), fx.sd_from_se(x(f"se{k}"), n), F.when(x(f"ci_hi{k}") > x(f"ci_lo{k}"), from_ci))

    sign = F.when(x("direction") < 0, -1.0).otherwise(1.0)
    arms = (x("m1"), sd("1"), x("n1"), x("m2"), sd("2"), x("n2"))
    cells = (x("events1"), x("n1") - x("events1"), x("events2"), x("n2") - x("events2"))
    t = F.when(F.col("design") == "t-test", x("t")).when(F.col("design") == "f-test", F.when(F.coalesce(x("df1"), F.lit(1.0)) == 1, sign * F.sqrt(x("F")))).otherwise(sign * t_quantile(1 - x("p") / 2, x("n1") + x("n2") - 2))
    phi = sign * F.sqrt(x("chi2") / x("n"))
    # interval of a hazard ratio at another level than 0.95: scaled by the ratio of the normal quantiles
    z = F.when(level == 0.95, 1.959963984540054).otherwise(t_quantile((1 + level) / 2, F.lit(1e7)))
    hr = (F.ln(x("hr")), ((F.ln(x("ci_hi")) - F.ln(x("ci_lo"))) / (2 * z)) ** 2)
    first = F.element_at(F.create_map(*[v for d, (_, m) in DESIGNS.items() for v in (F.lit(d), F.lit(m[0] if m else None).cast("string"))]), F.col("design"))
    allowed = F.element_at(F.create_map(*[v for d, (_, m) in DESIGNS.items() for v in (F.lit(d), F.array(*map(F.lit, m)).cast("array<string>"))]), F.col("design"))
    known = F.col("design").isin(*DESIGNS)
    out = df.withColumn("_known", F.coalesce(known, F.lit(False)))
    out = out.withColumn("measure_out", F.coalesce("measure", F.when(F.col("_known"), first)))
    lack = F.when(F.col("_known"), missing_inputs(F.col("design"), F.coalesce("inputs", F.create_map().cast("map<string,double>"))))
    out = out.withColumn("_lack", lack)
    kind = F.concat_ws("/", "design", "measure_out")
    cases: dict[str, fx.Effect] = {
        "two-group-means/SMD": fx.smd(*arms), "two-group-means/MD": fx.md(*arms), "two-group-binary/logOR": fx.log_or(*cells), "two-group-binary/logRR": fx.log_rr(*cells), "two-group-binary/RD": fx.risk_difference(*cells),
        "single-group-proportion/PLO": fx.logit(x("events"), x("n")), "single-group-proportion/PFT": fx.freeman_tukey(x("events"), x("n")), "correlation/ZCOR": fx.fisher_z(x("r"), x("n")),
        "pre-post/SMCR": fx.smcr(x("m_post"), x("m_pre"), x("sd_pre"), x("n"), x("r")), "chi-square/SMD": fx.d_from_r(phi, x("n")), "hazard-ratio/logHR": hr,
        **{f"{d}/SMD": fx.d_from_t(t, x("n1"), x("n2")) for d in ("t-test", "f-test", "p-value-only")},
    }
    pick = [F.when(F.col("design") == "precomputed", x(c)) for c in ("yi", "vi")]
    for k, pair in cases.items():
        pick = [p.when(kind == k, c) for p, c in zip(pick, pair)]
    out = out.withColumn("_y", pick[0]).withColumn("_v", pick[1])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    wrong = (F.col("design") != "precomputed") & ~F.array_contains(allowed, F.col("measure_out")) | F.col("measure_out").isNull()
    problem = (
        F.when(~F.col("_known"), "unknown design").when(wrong, "measure not of this design")
        .when(F.size("_lack") > 0, F.concat(F.lit("missing: "), F.array_join("_lack", ", "))).when(~(finite("_y") & finite("_v")), "no finite effect")
    )
    zero = (F.col("design") == "two-group-binary") & (x("events1") == 0) & (x("events2") == 0)
    return out.select(*df.columns, "measure_out", F.when(problem.isNull(), F.col("_y")).alias("yi"), F.when(problem.isNull(), F.col("_v")).alias("vi"), F.coalesce(zero, F.lit(False)).alias("double_zero"), problem.alias("problem"))


def analysis_rows(dispatch: DataFrame, measure: str, lower_is_better: bool = False, keep: Column | None = None) -> DataFrame:
    """``dispatch`` (of :func:`dispatched`) with ``reason`` of exclusion (null: the row takes part), turned ``yi`` and the sample size ``n``.

    keep: a condition on the columns; a row for which it is not true is left out, as are null results of it.
    """
    x = lambda k: F.try_element_at("inputs", F.lit(k))
    reason = (
        F.when(F.col("problem").isNotNull(), "cannot be computed").when(F.col("measure_out") != measure, "other measure")
        .when(F.col("double_zero") & F.lit(measure in ("logOR", "logRR")), "double-zero").when(~(F.col("vi") > 0), "zero variance")
    )
    if keep is not None:
        reason = reason.when(~F.coalesce(keep, F.lit(False)), "filter")
    n = F.coalesce(x("n1") + x("n2"), x("n")).cast("bigint")
    return dispatch.withColumn("reason", reason).withColumn("yi", F.col("yi") * (-1.0 if lower_is_better else 1.0)).withColumn("n", n)


# The published decision flows of the revised tool for randomised trials. A node asks a question; Y stands for yes and probably yes,
# N for no and probably no, NI for no information, NA for not applicable, and * for any other answer.
LOW, SOME, HIGH = "low", "some concerns", "high"
_D2_TWO = ("2.6", {"Y": LOW, "*": ("2.7", {"N": SOME, "*": HIGH})})
_D2_CARE = ("2.4", {"N": SOME, "*": ("2.5", {"Y": SOME, "*": HIGH})})
_D2_LATE = ("2.3", {"N": LOW, "NI": SOME, "*": _D2_CARE})
_D2_END = ("2.6", {"Y": SOME, "*": HIGH})
_D2_FAIL = ("2.5", {"N": LOW, "NA": LOW, "*": _D2_END})
_D2_KEPT = ("2.4", {"N": _D2_FAIL, "NA": _D2_FAIL, "*": ("2.5", {"*": _D2_END})})
_D2_OTHER = ("2.3", {"Y": _D2_KEPT, "NA": _D2_KEPT, "*": _D2_END})
FLOWS: dict[str, tuple] = {
    "d1": (("1.2", {"N": HIGH, "NI": ("1.3", {"Y": HIGH, "*": SOME}), "*": ("1.1", {"N": SOME, "*": ("1.3", {"Y": SOME, "*": LOW})})}),),
    "d2-assignment": (("2.1", {"N": ("2.2", {"N": LOW, "*": _D2_LATE}), "*": _D2_LATE}), _D2_TWO),
    "d2-adhering": (("2.1", {"N": ("2.2", {"N": _D2_KEPT, "*": _D2_OTHER}), "*": _D2_OTHER}),),
    "d3": (("3.1", {"Y": LOW, "*": ("3.2", {"Y": LOW, "*": ("3.3", {"N": LOW, "*": ("3.4", {"N": SOME, "*": HIGH})})})}),),
    "d4": (("4.1", {"Y": HIGH, "*": ("4.2", {"Y": HIGH,
        "NI": ("4.3", {"N": SOME, "*": ("4.4", {"N": SOME, "*": ("4.5", {"N": SOME, "*": HIGH})})}),
        "*": ("4.3", {"N": LOW, "*": ("4.4", {"N": LOW, "*": ("4.5", {"N": SOME, "*": HIGH})})})})}),),
    "d5": (("5.2", {"Y": HIGH, "N": ("5.3", {"Y": HIGH, "N": ("5.1", {"Y": LOW, "*": SOME}), "*": SOME}), "*": ("5.3", {"Y": HIGH, "*": SOME})}),),
}
#: Answers that a key of a node stands for.
ANSWERS = {"Y": ("Y", "PY"), "N": ("N", "PN"), "NI": ("NI",), "NA": ("NA",)}


def _walk(node, answer) -> Column:
    """A judgement, or ``?`` and the question that must be answered next."""
    if isinstance(node, str):
        return F.lit(node)
    question, ways = node
    out = F.when(answer(question).isNull(), F.lit(f"?{question}"))
    for key, after in ways.items():
        if key != "*":
            out = out.when(answer(question).isin(*ANSWERS[key]), _walk(after, answer))
    return out.otherwise(_walk(ways["*"], answer))


def bias_flow(domain: str, answers: str = "answers") -> tuple[Column, Column]:
    """Judgement of a domain (null while an answer is missing) and the question needed next (null once decided) from a map of answers; only answers on the way are read."""
    answer = lambda q: F.try_element_at(answers, F.lit(q))
    parts = [_walk(p, answer) for p in FLOWS[domain]]
    needed = F.coalesce(*[F.when(p.startswith("?"), F.substring(p, 2, 9)) for p in parts])
    grade = F.greatest(*[F.when(p == HIGH, 2).when(p == SOME, 1).otherwise(0) for p in parts]) if len(parts) > 1 else F.when(parts[0] == HIGH, 2).when(parts[0] == SOME, 1).otherwise(0)
    return F.when(needed.isNull(), F.element_at(F.array(*map(F.lit, (LOW, SOME, HIGH))), grade + 1)), needed


def overall_bias(judged: DataFrame, order: tuple[str, ...], rule: str = "worst") -> DataFrame:
    """``(study, overall)`` of domain judgements (study, domain, judgement): the worst of ``order``, or for rule 'sum' their sum as text; null while one is missing.

    'no information' counts as no grade, and is the result where it occurs and no domain has one of the two worst grades.
    """
    grade = F.coalesce(*[F.when(F.col("judgement") == x, k) for k, x in enumerate(order)])
    g = judged.groupBy("study").agg(
        F.max(grade).alias("g"), F.count(F.when(F.col("judgement").isNull(), 1)).alias("open"), F.count(F.when(F.col("judgement") == "no information", 1)).alias("unknown"), F.sum(F.col("judgement").try_cast("bigint")).alias("total")
    )
    if rule == "sum":
        return g.select("study", F.when(F.col("open") == 0, F.col("total").cast("string")).alias("overall"))
    unknown = (F.col("unknown") > 0) & (F.col("g").isNull() | (F.col("g") < len(order) - 2))
    return g.select("study", F.when(F.col("open") == 0, F.when(unknown, "no information").otherwise(F.get(F.array(*map(F.lit, order)), F.col("g")))).alias("overall"))


def bias_moderators(judged: DataFrame, domains: list[str]) -> DataFrame:
    """``(study, rob_overall, rob.<domain>…)`` of the latest judgements (study, domain, judgement, ts, id): one row a study; the overall one is the worst, null while a domain lacks one."""
    last = last_write(judged.select("study", "domain", "judgement", "ts", "id"), ["study", "domain"])
    grade = F.coalesce(*[F.when(F.col("judgement") == x, k) for k, x in enumerate((LOW, SOME, HIGH))])
    g = last.groupBy("study").agg(F.max(grade).alias("g"), F.count("judgement").alias("n"), *[F.max(F.when(F.col("domain") == d, F.col("judgement"))).alias(f"rob.{d}") for d in domains])
    overall = F.when(F.col("n") == len(domains), F.element_at(F.array(*map(F.lit, (LOW, SOME, HIGH))), F.col("g") + 1))
    return g.select("study", overall.alias("rob_overall"), *[F.col(f"`rob.{d}`") for d in domains])


def provenance_table(values: DataFrame) -> DataFrame:
    """The latest value of each study and field with where it came from: ``study, field, value, unit, not_reported, source, extracted_by, entered_at``."""
    v = values.where("study is not null and field is not null").select("study", "field", "value", "unit", "not_reported", "source", "extracted_by", "entered_at", "value_id")
    return last_write(v, ["study", "field"], ["entered_at", "value_id"]).drop("value_id")


def reconciled(values: DataFrame) -> DataFrame:
    """``(study, field, extractors, status, resolved)``: each extractor's latest answer to a field compared.

    status: 'one' (a single extractor), 'agree', 'differ', or 'presence' (some report a value, some say it is not reported). resolved: the common answer, null for differences.
    An answer is the value in the entered unit, or 'NR'. Nulls of study, field or extractor give no row; no answer at all counts as not reported.
    """
    v = values.where("study is not null and field is not null and extracted_by is not null")
    answer = F.when(F.coalesce("not_reported", F.lit(False)) | F.col("value").isNull() & F.col("entered").isNull(), "NR").when(F.col("value").isNotNull(), F.concat_ws(" ", F.bround("value", 6).cast("string"), "unit")).otherwise(F.trim("entered"))
    last = last_write(v.select("study", "field", "extracted_by", answer.alias("answer"), "entered_at", "value_id"), ["study", "field", "extracted_by"], ["entered_at", "value_id"])
    g = last.groupBy("study", "field").agg(F.count(F.lit(1)).alias("extractors"), F.count_distinct("answer").alias("kinds"), F.count(F.when(F.col("answer") == "NR", 1)).alias("nr"), F.min("answer").alias("one"))
    status = F.when(F.col("extractors") == 1, "one").when(F.col("kinds") == 1, "agree").when(F.col("nr") > 0, "presence").otherwise("differ")
    return g.select("study", "field", "extractors", status.alias("status"), F.when(F.col("kinds") == 1, F.col("one")).alias("resolved"))
