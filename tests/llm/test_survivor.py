from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from evisift.llm import survivor
from evisift.llm.survivor import CLAIMS, MORE, OTHER, PART, SAME, Model, date_kind, fuse, fused_values, pattern_of, survivors, title_kind, title_kinds
from tests.llm.test_neardup import BASE, SCHEMA, record

AM = "event_id string, record_id string, field string, new_value string, ts timestamp, id string"
T = [datetime(2024, 1, d) for d in range(1, 9)]


def run(spark, rows, fixes=()):
    trust = spark.createDataFrame([("m", 1), ("n", 2), ("o", 3), (None, 4)], "db_name string, trust_rank int")
    am = spark.createDataFrame([(f"e{k}", *f, "clash") for k, f in enumerate(fixes)], AM)
    return {r["group_id"]: (r["title_from"], r["issued_from"]) for r in survivors(spark.createDataFrame(rows, SCHEMA), am, trust).collect()}


def test_trust_damage_dates(spark):
    rows = [
        record("a", BASE.upper(), db=("m",), date=(2010, 2)), record("b", BASE, db=("o", "n"), date=(2010,)), record("c", BASE + ".", db=("o",), date=(2010, 2, 3)),
        record("d", "Effect of light boxes on sleep quality in adults with migraine", db=("m",), date=(2099, 1, 1)), record("b", BASE, db=("o", "n"), date=(2010,)), record("lonely", "Quite another thing altogether", page="77"),
    ]
    assert run(spark, rows) == {"a": ("b", "c")}


def test_corrections(spark):
    rows = [record("a", BASE, db=("m",), date=(2010, 2, 3)), record("b", BASE + ".", db=("o",), date=(2010,)), record("c", BASE, db=("o",), date=None)]
    fixes = [
        ("b", " Title ", BASE, T[1]), ("c", "title", "Something new", T[0]), ("c", "title", "Something else", T[2]), ("c", "title", BASE, T[4]),  # taken back
        ("a", "year", "2010-02-03", T[5]),  # changes nothing
        ("c", "Issued", "2010-07-01", T[1]), ("c", "Issued", "2010-07-01", T[1]), ("nobody", "title", "x", T[6]), (None, "title", "x", T[6]), ("a", "title", None, None),
    ]
    out = run(spark, rows, fixes)
    assert out["a"][1] == "c" and out["a"][0] in ("a", "b")
    assert run(spark, rows, fixes[:1])["a"][0] == "b"


def test_nothing_whole_nothing_dated(spark):
    rows = [record("a", BASE.upper(), date=None), record("b", BASE.upper(), date=(0, 0, 0))]
    assert run(spark, rows) == {"a": ("a", None)}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [record("a", BASE), record("a", BASE)]) == {}


def _claims(spark, rows):
    out = []
    for k, values in rows:
        pattern, titles = pattern_of([(f"t{s}", v) for s, v in enumerate(values)], lambda a, b: (OTHER, OTHER))
        out.append((k, "|".join(",".join(map(str, x)) for x in pattern), titles, None, None, [], []))
    return spark.createDataFrame(out, CLAIMS)


def test_copied_votes_count_less(spark, monkeypatch):
    """A source that repeats another one's slips is found dependent, and its votes are discounted."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        own = ["t" if rng.random() < p else f"f{rng.integers(5)}" for p in (0.95, 0.9, 0.85, 0.85)]
        s2 = "t" if rng.random() < 0.6 else f"f{rng.integers(5)}"
        rows.append((k, [*own, s2, s2 if rng.random() < 0.95 else "t"]))
    claims = _claims(spark, rows)
    m = fuse(claims, rounds=4)
    honest = [m.copies.get((f"t{s}", f"t{t}"), 0) for s in range(4) for t in range(s + 1, 4)]
    assert m.copies["t4", "t5"] > 0.9 > 0.5 > max(honest) and min(m.accuracy[f"t{s}"] for s in range(4)) > m.accuracy["t4"]
    monkeypatch.setattr(survivor, "PATTERNS_MOST", 3)
    other = fuse(claims, rounds=4)
    assert other.accuracy == pytest.approx(m.accuracy) and other.copies == pytest.approx(m.copies)
    pattern, values = pattern_of([("t0", "t"), ("t4", "f1"), ("t5", "f1")], lambda a, b: (OTHER, OTHER))
    p = dict(zip(values, m.posterior(pattern)))
    m.copies = {}
    free = dict(zip(values, m.posterior(pattern)))
    assert p["t"] > p["f1"] and p["f1"] < free["f1"]


def test_plain_posterior():
    assert Model().posterior(pattern_of([("t0", "x"), ("t1", "x")], title_kinds)[0])[0] > 0.99


def test_kinds():
    whole = "effect of light on sleep a cluster randomised trial with metaanalysis"
    assert title_kind("effect of light on slep a randomised cluster trial with meta analysis", whole) == SAME
    assert title_kind("effect of light on sleep", whole) == PART and title_kind(whole, "effect of light on sleep") == MORE
    assert title_kind("effect of light on cats and dogs", whole) == OTHER
    assert [date_kind(x, 20100203) for x in (20100203, 20100299, 20109999, 20110101, 20150203)] == [SAME, PART, PART, MORE, OTHER]


def test_a_cut_title_of_the_best_source_loses_by_the_fusion(spark, monkeypatch):
    rows = [record("a", BASE[:52], db=("m",), date=(2010,)), record("b", BASE, db=("n",), date=(2010, 3)), record("c", BASE + ".", db=("o",), date=(2011, 4, 1))]
    assert run(spark, rows)["a"] == ("b", "c")
    monkeypatch.setattr(survivor, "fused_values", lambda c, m: fused_values(c, m).selectExpr("group", "cast(null as string) title", "cast(null as int) date", "cast(null as int) year", "cast(array() as array<bigint>) carried", "cast(array() as array<bigint>) other"))
    assert run(spark, rows)["a"][0] == "a"  # without the fused title nothing tells that it is cut


def test_many_sources(spark):
    """Each database keeps its own accuracy, however many there are."""
    rows = [record(f"r{k:03d}", BASE, db=(f"db{k:03d}",), date=(2010, 1, k % 28 + 1)) for k in range(260)]
    assert run(spark, rows)["r000"][0] == "r000"


@pytest.mark.parametrize("text", ["", "a", "effect of light boxes on sleep quality in adults with migraine", "влияние света 光"])
def test_hash_is_sparks(spark, text):
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == survivor._hash(text)
