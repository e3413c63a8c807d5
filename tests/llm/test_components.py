import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import components as c


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = ((x or "").strip().lower() for x in (a, b))
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "clash") for a, b in pairs], "record_a string, record_b string, group_id string")
    return {r["record_id"]: r["group_id"] for r in c.grouped_pairs(df, "record_a", "record_b").collect()}


def test_dirt(spark):
    pairs = [("B", "a "), ("a", "b"), ("b", "A"), (" c", "C "), (None, "a"), ("", "b"), ("d", None), ("x", "y"), ("y", "z"), ("\tz", "q\n")]
    assert run(spark, pairs) == {"a": "a", "b": "a", "q": "q", "x": "q", "y": "q", "z": "q"}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [("a", "a"), (None, None)]) == {}


def test_long_chain_and_hub(spark):
    chain = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(300)]
    random.Random(1).shuffle(chain)
    hub = [("zz", f"h{k:04d}") for k in range(400)]
    assert run(spark, chain + hub) == brute(chain + hub)


def test_hot_vertices_are_salted(spark, monkeypatch):
    monkeypatch.setattr(c, "HOT_LEAST", 5)
    monkeypatch.setattr(c, "HOT_MOST", 10**9)
    pairs = [("zz", f"h{k:03d}") for k in range(60)] + [("h000", f"i{k:03d}") for k in range(60)] + [("u", "v")]
    assert run(spark, pairs) == brute(pairs)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_like_union_find(spark, pairs):
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a, b in pairs]
    assert run(spark, pairs) == brute(pairs)
