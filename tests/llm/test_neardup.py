import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import neardup, setsketch, titles
from evisift.llm.neardup import near_duplicate_pairs

SCHEMA = """id string, title string, author array<struct<family:string,given:string,literal:string>>, issued struct<date_parts:array<array<int>>>, container_title string, volume string, issue string,
 page string, doi string, meta struct<sources:array<struct<db_name:string>>>, words string, rid string"""


def record(i, title, authors=("Doe", "Roe"), date=(2010,), journal="Journal of Test Work", volume="3", issue="2", page="10-19", doi=None, db=("m",)):
    a = [(f, "A.", None) for f in authors] if authors is not None else None
    return (i, title, a, ([list(date)],) if date else None, journal, volume, issue, page, doi, ([(x,) for x in db],), "clash", "clash")


def pairs(spark, rows):
    return {(r[0], r[1]) for r in near_duplicate_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


BASE = "Effect of light boxes on sleep quality in adults with migraine: a cluster randomised trial"


def test_same_publication(spark):
    rows = [
        record("a", BASE), record("b", BASE.upper(), page="10"), record("c", "Effect of <i>light</i> boxes on sleep quality in adults with migraine: a cluster randomised trial", volume=None),
        record("d", "A cluster randomised trial: Effect of light boxes on sleep quality in adults with migraine", page=None), record("e", "Effect of light boxs on quality sleep in adults with migraine: a new cluster randomised trial", date=(2011, 4)),
        record("f", "Effect of light boxes on sleep quality in ...", authors=("Doe",), date=(9999, 12, 31)), record("a", BASE),
    ]
    got = pairs(spark, rows)
    assert got == {(x, y) for x in "abcdef" for y in "abcdef" if x < y}


@pytest.mark.parametrize("other", [
    record("z", f"Correction to: {BASE}", page="90"), record("z", f"{BASE}, part 2", page=None), record("z", f"{BASE}: study protocol", page=None, date=(2008,)), record("z", BASE, authors=("Other",), volume="5", page="99"),
    record("z", BASE.replace("adults with migraine", "young athletes"), page=None), record("z", BASE, doi="10.1234/other"), record("z", BASE, date=(2014,)), record("z", None), record("z", ""), record(None, BASE),
])
def test_different_publications(spark, other):
    assert pairs(spark, [record("a", f"{BASE}" if "part" not in (other[1] or "") else f"{BASE} (Part I)", doi="10.1234/own"), other]) == set()


def test_records_without_locators(spark):
    bare = {"volume": None, "issue": None, "page": None}
    rows = [record("a", BASE, doi="10.1234/own"), record("b", BASE, **bare), record("c", BASE.replace("light boxes", "light boxs"), date=(2011,), **bare), record("z", BASE.replace("migraine", "asthma"), authors=("Other",), **bare)]
    assert pairs(spark, rows) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_same_volume_without_authors(spark):
    assert pairs(spark, [record("a", BASE), record("b", BASE, authors=None, issue=None, page=None)]) == {("a", "b")}


def test_doi_binds_records_without_title(spark):
    assert pairs(spark, [record("a", None, doi="10.1234/X.", page=None), record("b", BASE, doi="https://doi.org/10.1234/x", page=None)]) == {("a", "b")}


def test_empty_and_all_null(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [("a", *[None] * 11), ("b", *[None] * 11)]) == set()


def test_long_title(spark):
    assert pairs(spark, [record("a", BASE + " word" * 5000), record("b", BASE + " word" * 5000)]) == {("a", "b")}


def test_hot_heading_is_no_publication(spark):
    rows = [record(f"r{k:03d}", "Editorial", authors=(f"N{k}",), volume=str(k % 7), page=str(k)) for k in range(120)]
    assert pairs(spark, rows) == set()


def test_registers_tell_similarity():
    rng = np.random.default_rng(0)
    words = ["w%05d" % x for x in rng.integers(0, 99999, 400)]
    a, b = " ".join(words[:300]), " ".join(words[100:])
    row, el = setsketch.text_elements([a, b, a + " " + b])
    reg, size = setsketch.sketches(row, el, 3)
    sets = [set(el[row == k].tolist()) for k in range(3)]
    exact = len(sets[0] & sets[1])
    est = setsketch.joint_estimate(reg[:1], reg[1:2], size[:1], size[1:2])[0]
    assert abs(est - exact) < 0.35 * exact
    assert (setsketch.merge(reg[0], reg[1]) == reg[2]).mean() > 0.95


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_normal_is_stable(t):
    assert titles.normal(titles.normal(t)) == titles.normal(t)


@pytest.mark.parametrize(("title", "bad"), [("A plain title", False), ("A PLAIN TITLE IN CAPITALS", True), ("A title that is…", True), ("A title: a", True), ("A <b>title</b>", True), ("A &amp; b title", True), ("inÂ title", True), ("A title [abstract 3]", True), ("A title Full text available", True), (None, True), (" ", True), ("Étude of a thing.", False)])
def test_damage(title, bad):
    assert titles.evident_damage(title) is bad


def test_plausible_dates(spark):
    rows = [record(f"r{k}", BASE, date=d) for k, d in enumerate([(2010, 13, 45), (0, 0, 0), (2099, 1, 1), (2010, None), (2010, 5, 1)])]
    got = {r["id"]: r["year"] for r in neardup.prepare(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"r0": -1, "r1": -1, "r2": -1, "r3": 2010, "r4": 2010}


def test_other_scripts(spark):
    one = "Влияние световой терапии на качество сна у взрослых с мигренью: рандомизированное исследование"
    rows = [record("a", one), record("b", one.upper(), page=None, issue=None), record("c", one.replace("мигренью", "астмой"), authors=("Other",), volume="9", page="70")]
    assert pairs(spark, rows) == {("a", "b")}


def test_long_title_alone(spark):
    """A record without author, page, volume and issue is found by the band of the title alone, in its journal and year."""
    bare = {"volume": None, "issue": None, "page": None, "authors": None}
    rows = [record("a", BASE), record("b", BASE, **bare), record("c", BASE, date=(2015,), **bare), record("d", BASE, journal="Annals of Other Things", **bare), record("e", "Editorial", **bare), record("f", "Editorial")]
    assert pairs(spark, rows) == {("a", "b")}


def test_doi_clash_and_repeated_id(spark):
    rows = [record("a", BASE, doi="10.1234/one"), record("b", BASE, doi="10.1234/two"), record("c", BASE, volume="9", page="70"), record("c", "Quite another text about something", volume="8", page="1"), record("d", "Quite another text about something", volume="8", page="1")]
    assert pairs(spark, rows) == {("c", "d")}


def _variants(n=60):
    out = []
    for k in range(n):
        base = f"Effect of thing{k} boxes on sleep quality in adults with condition{k * 7} in place{k * 3}: a cluster randomised trial"
        out += [record(f"r{k:03d}a", base, volume=str(k), page=str(100 + k)), record(f"r{k:03d}b", base.replace("boxes", "boxs"), volume=str(k), page=None), record(f"r{k:03d}c", base[:60], volume=str(k), page=str(100 + k))]
    return out


def test_registers_and_estimate_decide(spark):
    """Ablation: with registers that say nothing of the title hardly a pair shares a band, and the estimate lets none through."""
    prepared = spark.createDataFrame(neardup.prepare(spark.createDataFrame(_variants(), SCHEMA)).collect(), neardup.PREPARED)
    found = neardup.candidates(prepared, 180).distinct()
    links = neardup.verified(prepared, found)
    noise = prepared.withColumn("registers", F.unhex(F.sha2(F.col("id"), 256)))
    assert links.count() >= 170 and neardup.candidates(noise, 180).distinct().count() < 0.1 * found.count()
    assert neardup.verified(noise, found).count() < 0.2 * links.count()


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    rows = _variants(20) + [record(f"h{k:03d}", BASE, volume=str(k // 2), page=str(k // 2), issue=None) for k in range(200)]
    plain = pairs(spark, rows)
    monkeypatch.setattr(neardup, "HOT_BUCKET", 3)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    assert pairs(spark, rows) == plain and {("h000", "h001"), ("h198", "h199")} <= plain and ("h001", "h002") not in plain
