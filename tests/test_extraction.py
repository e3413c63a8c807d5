import math

import pytest
from pyspark.sql import functions as F

from evisift.meta import dist
from evisift.operators import extraction, review
from evisift.streaming import folds

IN = "id string, design string, measure string, inputs map<string,double>, yi double"


def dispatch(spark, *rows):
    return {r["id"]: r for r in extraction.dispatched(spark.createDataFrame(rows, IN).drop("yi")).collect()}


def test_designs(spark):
    arms = {"n1": 20.0, "m1": 5.0, "n2": 25.0, "m2": 4.0, "sd2": 2.0}
    t = dist.t_ppf(0.975, 19)
    got = dispatch(
        spark,
        ("sd", "two-group-means", "MD", arms | {"sd1": 2.0}, None), ("se", "two-group-means", "MD", arms | {"se1": 2.0 / math.sqrt(20)}, None),
        ("ci", "two-group-means", "MD", arms | {"ci_lo1": 5 - t * 2 / math.sqrt(20), "ci_hi1": 5 + t * 2 / math.sqrt(20)}, None),
        ("p", "p-value-only", None, {"p": 0.03, "n1": 20.0, "n2": 25.0, "direction": -1.0}, None), ("t", "t-test", None, {"t": -dist.t_ppf(0.985, 43), "n1": 20.0, "n2": 25.0}, None),
        ("lack", "two-group-means", None, arms, None), ("none", "two-group-means", None, None, None), ("what", "interview", None, {}, None), ("null", None, None, None, None),
        ("wrong", "correlation", "SMD", {"r": 0.1, "n": 9.0}, None), ("edge", "correlation", None, {"r": 1.0, "n": 9.0}, None), ("f", "f-test", None, {"F": 4.0, "n1": 9.0, "n2": 9.0, "direction": 1.0, "df1": 2.0}, None),
        ("pre", "precomputed", None, {"yi": 1.0, "vi": 0.1}, None), ("zero", "two-group-binary", None, {"events1": 0.0, "n1": 9.0, "events2": 0.0, "n2": 9.0}, None),
    )
    assert got["sd"]["vi"] == pytest.approx(4 / 20 + 4 / 25) and got["se"]["vi"] == pytest.approx(got["sd"]["vi"]) and got["ci"]["vi"] == pytest.approx(got["sd"]["vi"])
    assert got["p"]["yi"] == pytest.approx(got["t"]["yi"]) and got["p"]["yi"] < 0
    assert {k: got[k]["problem"] for k in ("lack", "none", "what", "null", "wrong", "edge", "f", "pre")} == {
        "lack": "missing: sd1", "none": "missing: n1, m1, sd1, n2, m2, sd2", "what": "unknown design", "null": "unknown design", "wrong": "measure not of this design", "edge": "no finite effect", "f": "no finite effect", "pre": "measure not of this design",
    }
    assert got["zero"]["double_zero"] and got["zero"]["problem"] is None


def test_analysis_rows(spark):
    rows = [("a", "two-group-binary", None, {"events1": 0.0, "n1": 9.0, "events2": 0.0, "n2": 9.0}, None), ("b", "two-group-binary", None, {"events1": 3.0, "n1": 9.0, "events2": 1.0, "n2": 9.0}, None), ("c", "correlation", None, {"r": 0.2, "n": 30.0}, None), ("d", "x", None, None, None)]
    e = extraction.dispatched(spark.createDataFrame(rows, IN).drop("yi"))
    got = {r["id"]: (r["reason"], r["n"]) for r in extraction.analysis_rows(e, "logOR").collect()}
    assert got == {"a": ("double-zero", 18), "b": (None, 18), "c": ("other measure", 30), "d": ("cannot be computed", None)}
    assert {r["id"] for r in extraction.analysis_rows(e, "logOR", keep=F.col("id") == "z").where("reason = 'filter'").collect()} == {"b"}
    assert extraction.dispatched(spark.createDataFrame([], IN).drop("yi")).count() == 0


@pytest.mark.parametrize(("domain", "said", "judgement", "needed"), [
    ("d1", {}, None, "1.2"), ("d1", {"1.2": "N"}, "high", None), ("d1", {"1.2": "PY", "1.1": "Y", "1.3": "N"}, "low", None), ("d1", {"1.2": "NI", "1.3": "Y"}, "high", None), ("d1", {"1.2": "Y", "1.1": "NI"}, None, "1.3"),
    ("d2-assignment", {"2.1": "N", "2.2": "PN", "2.6": "Y"}, "low", None), ("d2-assignment", {"2.1": "Y", "2.3": "Y", "2.4": "Y", "2.5": "N", "2.6": "Y"}, "high", None), ("d2-assignment", {"2.1": "Y", "2.3": "NI", "2.6": "N", "2.7": "PN"}, "some concerns", None), ("d2-assignment", {"2.1": "N", "2.2": "N"}, None, "2.6"),
    ("d2-adhering", {"2.1": "N", "2.2": "N", "2.4": "NA", "2.5": "N"}, "low", None), ("d2-adhering", {"2.1": "N", "2.2": "N", "2.4": "Y"}, None, "2.5"), ("d2-adhering", {"2.1": "Y", "2.3": "N", "2.6": "N"}, "high", None),
    ("d3", {"3.1": "N", "3.2": "N", "3.3": "Y", "3.4": "PN"}, "some concerns", None), ("d4", {"4.1": "N", "4.2": "NI", "4.3": "N"}, "some concerns", None), ("d4", {"4.1": "N", "4.2": "N", "4.3": "Y", "4.4": "Y", "4.5": "Y"}, "high", None), ("d5", {"5.2": "N", "5.3": "N", "5.1": "Y"}, "low", None), ("d5", {"5.2": "NI", "5.3": "N"}, "some concerns", None),
])
def test_flows(spark, domain, said, judgement, needed):
    j, n = extraction.bias_flow(domain)
    r = spark.createDataFrame([(said,)], "answers map<string,string>").select(j.alias("j"), n.alias("n")).first()
    assert (r["j"], r["n"]) == (judgement, needed)


def test_overall_rules(spark):
    rows = [("a", "d1", "low"), ("a", "d2", "no information"), ("b", "d1", "serious"), ("b", "d2", "no information"), ("c", "d1", None), ("d", "d1", "low"), ("d", "d2", "moderate"), ("e", "d1", "2"), ("e", "d2", "3")]
    j = spark.createDataFrame(rows, "study string, domain string, judgement string")
    got = {r["study"]: r["overall"] for r in extraction.overall_bias(j, ("low", "moderate", "serious", "critical")).collect()}
    assert {k: got[k] for k in "abcd"} == {"a": "no information", "b": "serious", "c": None, "d": "moderate"}
    assert {r["study"]: r["overall"] for r in extraction.overall_bias(j.where("study in ('c', 'e')"), ("1", "2", "3"), "sum").collect()} == {"c": None, "e": "5"}


def test_relinked_chain_is_one_chain(spark):
    rows = [("f", 3, "c", "x"), ("f", 1, "a", "x"), ("f", 2, "b", None), ("f", 2, "b", None), ("g", 1, "z", "y")]
    e = spark.createDataFrame(rows, "file string, t int, id string, body string").select("file", F.timestamp_seconds("t").alias("ts"), "id", "body")
    got = {(r["file"], r["seq"]): r for r in review.relinked(e).collect()}
    assert [got["f", k]["id"] for k in (1, 2, 3)] == ["a", "b", "c"] and got["f", 1]["prev"] is None and got["f", 2]["prev"] == got["f", 1]["digest"] and len(got) == 4


def test_transitions_over_batches(spark, tmp_path):
    for k, rows in enumerate([[("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], [("a", "y", 3), ("a", "x", 4), ("b", None, 2)]]):
        spark.createDataFrame(rows, "who string, state string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    s = spark.readStream.schema("who string, state string, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(r["who"], r["before"], r["after"], r["n"]) for r in folds.run_available(folds.transitions(s, "who", "state", ["n"]), "test", "append").collect()}
    assert got == {("a", None, "x", 1), ("a", "x", "y", 2), ("b", None, "x", 1), ("a", "y", "x", 4)}
