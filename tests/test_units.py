from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.operators.units import alias_dictionary, convert_quantities, weighted_distance

V = "value_id bigint, study string, field string, value double, unit string, entered string, source string, not_reported boolean, entered_at timestamp, to_unit string"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def tables(spark):
    form = spark.createDataFrame([("follow_up", "time", "weeks"), ("height", "length", "centimetres"), ("dose", "dose", "milligrams per kilogram"), ("n", None, None)], "field string, dimension string, unit string")
    reg = spark.createDataFrame(
        [("days", "time", 86400.0), ("weeks", "time", 604800.0), ("centimetres", "length", 0.01), ("feet", "length", 0.3048), ("inches", "length", 0.0254), ("milligrams", "mass", 0.001), ("milligrams per kilogram", "dose", 1.0), ("grams per kilogram", "dose", 1000.0)],
        "unit string, dimension string, factor double",
    )
    return form, reg


def run(spark, tables, rows):
    v = spark.createDataFrame([(i, "s", f, x, u, e, s, nr, t, "clash") for i, f, x, u, e, s, nr, t in rows], V)
    return {r["value_id"]: (r["unit"], r["value_milli"]) for r in convert_quantities(v, *tables).collect()}


def test_cases(spark, tables):
    got = run(spark, tables, [
        (1, "follow_up", 14.0, "d", None, None, False, T0),
        (2, "follow_up", None, None, "2 weeks (planned)", "Table 1", False, T0),
        (3, "height", None, None, "5 ft and 9 in", None, False, T0),
        (4, "height", 1.5, "hundred cm", None, None, False, T0),
        (5, "dose", 3.0, None, None, "Table 2, column head 'g per kg'", False, T0),
        (6, "dose", 3.0, "mg·kg⁻¹", "3", None, False, T0),
        (7, "follow_up", 3.0, "cm", None, None, False, T0),  # another dimension
        (8, "follow_up", 3.0, "mmHg", None, None, False, T0),  # unknown
        (9, "n", 30.0, None, "n = 30", None, False, T0),  # a count
        (10, "follow_up", 1.0, "week", None, None, True, T0),  # not reported
        (11, "follow_up", None, None, "1.4e1 days", None, False, T0),
        (12, "follow_up", None, None, "three weeeks", None, False, T0),  # a slip
        (13, None, 1.0, "week", None, None, False, T0),
        (14, "follow_up", 2.0, None, "2 (units unclear)", "Table 1", False, T0),
        (None, "follow_up", 1.0, "week", None, None, False, T0),
        (15, "follow_up", 1.0, "week", None, None, False, T0), (15, "follow_up", 1.0, "week", None, None, False, T0), (15, "follow_up", 2.0, "week", None, None, False, T1),
        (16, "follow_up", float("nan"), "week", None, None, False, T0),
        (17, "follow_up", 1.0, "w" * 5000, None, None, False, T0),
        (18, "follow_up", 0.0005, "weeks", None, None, None, T0),
    ])
    assert got == {
        1: ("weeks", 2000), 2: ("weeks", 2000), 3: ("centimetres", 175260), 4: ("centimetres", 150000), 5: ("milligrams per kilogram", 3000000), 6: ("milligrams per kilogram", 3000),
        11: ("weeks", 2000), 12: ("weeks", 3000), 15: ("weeks", 2000), 18: ("weeks", 1),
    }


def test_empty(spark, tables):
    assert run(spark, tables, []) == {}


def test_dictionary_leaves_strangers_out(spark, tables):
    words = ["week", "weeeks", "sessions", "score", "centimetters", "inch", "x"]
    got = dict(tuple(r) for r in alias_dictionary(spark.createDataFrame([(w,) for w in words], "spelling string"), tables[1]).collect())
    assert got == {"week": "weeks", "weeeks": "weeks", "centimetters": "centimetres", "inch": "inches"}


@settings(max_examples=60, deadline=None)
@given(st.text("abcde", max_size=8), st.text("abcde", max_size=8))
def test_distance(a, b):
    d = weighted_distance(a, b)
    assert d >= 0 and weighted_distance(a, a) == 0 and (d > 0) == (a != b) and d <= max(len(a), len(b))


def test_swapped_letters_in_short_names(spark):
    from tests.conftest import data

    registry = spark.read.parquet(f"{data()}/unit_registry.parquet")
    said = spark.createDataFrame([(x,) for x in ("years", "yaers", "hours", "horus")], "spelling string")
    got = {r["spelling"]: r["unit"] for r in alias_dictionary(said, registry).collect()}
    assert len(got) == 4 and got["yaers"] == got["years"] and got["horus"] == got["hours"]
