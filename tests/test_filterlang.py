import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from evisift.plans.filterlang import FilterError, fields_of, parse, where

ROWS = [(1, "Alpha", 2.5, ["x"], True, None), (2, "beta", None, [], False, "p"), (3, None, 3.0, None, None, ""), (4, "it's", -1.0, ["x", "y"], True, "q")]
SCHEMA = "id int, name string, v double, tags array<string>, ok boolean, note string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


CASES = {
    "id == 1": [1], "name == null": [3], "name != 'beta'": [1, 3, 4], "id == '1'": [], "id == 1.0": [1], "ok == 1": [1, 4], "v > 2": [1, 3], "name contains 'ALPH'": [1],
    "tags contains 'x'": [1, 4], "name matches '^b'": [2], "tags": [1, 4], "not tags": [2, 3], "ok": [1, 4], "note": [2, 4], "name in ['beta', null]": [2, 3], "name not in ['beta', null]": [1, 4],
    "id == 1 or id == 2 and ok": [1], "(id == 1 or id == 2) and not ok": [2], "NOT (v > 2) AND id >= 2": [2, 4], 'name == "it\'s"': [4],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(df, text):
    assert sorted(r["id"] for r in where(df, text).collect()) == CASES[text]


@pytest.mark.parametrize("text", ["id ==", "nosuch == 1", "name < 3", "name matches '(a+)+'", "name matches '('", "id in 3", "id == 1 id == 2", "v contains 1", "@"])
def test_wrong(df, text):
    with pytest.raises(FilterError):
        where(df, text)


def test_strict_order_refuses_null(df):
    with pytest.raises(PySparkException):
        where(df, "v > 2", lenient=False).collect()


def test_fields():
    assert fields_of(parse("a == 1 and not (b in [1] or c)")) == {"a", "b", "c"}


leaf = st.sampled_from(["id == 1", "id > 2", "name == null", "ok", "v >= 2.5", "note == ''"])
tree = st.recursive(leaf, lambda x: st.one_of(x.map(lambda a: f"not ({a})"), st.tuples(x, st.sampled_from(["and", "or"]), x).map(lambda t: f"({t[0]}) {t[1]} ({t[2]})")), max_leaves=5)


def plainly(text: str, r) -> bool:
    env = {"id == 1": r[0] == 1, "id > 2": r[0] > 2, "name == null": r[1] is None, "ok": bool(r[4]), "v >= 2.5": r[2] is not None and r[2] >= 2.5, "note == ''": r[5] == ""}
    for k, v in env.items():
        text = text.replace(k, str(v))
    return eval(text)


@settings(max_examples=25, deadline=None)
@given(tree)
def test_like_a_plain_evaluator(df, text):
    assert sorted(r["id"] for r in where(df, text).collect()) == [r[0] for r in ROWS if plainly(text, r)]


@pytest.mark.parametrize("pattern", ["((a+)b)*", "((a+))+", "(a|b+)*", "(?:x(y*)z)+", "(a+){2,}"])
def test_repeats_of_repeats_are_refused(pattern):
    from evisift.plans.filterlang import repeats_a_repeat

    assert repeats_a_repeat(pattern) and not repeats_a_repeat("a+(b|c)*d{2,3}(ef?){3}") and not repeats_a_repeat("[(a+)*]+")
