import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evisift.llm import leakage as k

WORDS = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in ("lan", "mor", "tis", "vek")]


def sentence(rnd, n=14):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def setting(seed=1):
    rnd = random.Random(seed)
    stock = sentence(rnd, 16)
    items = [(f"i{n}", " ".join([sentence(rnd), sentence(rnd), stock, sentence(rnd)])) for n in range(6)]
    fill = [" ".join([sentence(rnd), stock, sentence(rnd), sentence(rnd)]) for _ in range(60)]
    return rnd, stock, items, fill


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, words string")
    return {(r["doc_id"], r["item_id"]) for r in k.leaks(d, it).collect()}


def test_forms_of_leaks(spark):
    rnd, stock, items, fill = setting()
    s = items[0][1].split(". ")
    changed = items[1][1].split()
    for p in (6, 20, 33):
        changed[p] = "quux"
    docs = list(enumerate(fill)) + [
        (100, fill[0] + " " + items[0][1] + " " + fill[1]), (101, f"{s[3]} {sentence(rnd)} {s[1]}. {s[0]}."), (102, items[2][1].upper().replace(".", "").replace(" ", "  \n")), (103, "<p>" + " ".join(changed) + "</p>"),
        (104, sentence(rnd) + " " + s[0][:60]), (105, "see i0 of the evaluation"), (106, stock + " " + stock), (107, None), (108, ""), (109, "x" * 100_000), (100, fill[0] + " " + items[0][1] + " " + fill[1]),
    ]
    assert run(spark, docs, items) == {(100, "i0"), (101, "i0"), (102, "i2"), (103, "i1")}


def test_empty(spark):
    assert run(spark, [], [("i", "a b c d e f")]) == set() and run(spark, [(1, "a b c d e f")], []) == set() and run(spark, [(1, "a")], [(None, "x"), ("i", None), ("j", "")]) == set()


def test_blocks_of_items(spark, monkeypatch):
    _, _, items, fill = setting()
    docs = list(enumerate(fill)) + [(100 + n, t) for n, (_, t) in enumerate(items)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(k, "BLOCK_WORDS", 100)
    assert run(spark, docs, items) == whole == {(100 + n, f"i{n}") for n in range(6)}


def test_leak_in_a_third_of_the_rows(spark):
    rnd, stock, items, fill = setting()
    long = [(f"j{n}", " ".join(sentence(rnd) for _ in range(5))) for n in range(2)]
    copied = fill[0] + " " + items[0][1] + " " + fill[1]
    # copies of one document, and a passage in documents of their own
    docs = list(enumerate(fill)) + [(100 + n, copied.upper() if n % 2 else copied) for n in range(30)] + [(200 + n, f"{sentence(rnd)} {long[0][1]} {sentence(rnd)}") for n in range(30)]
    want = {(100 + n, "i0") for n in range(30)} | {(200 + n, "j0") for n in range(30)}
    assert run(spark, docs, items + long) == want


def test_true_copy_behind_repeated_parts(spark):
    rnd, stock, items, fill = setting()
    w = sentence(rnd, 40).rstrip(".").split()
    # a part of the sentence stands four times, more often than any run of the edited copy behind it, whose words shift
    part, copy = " ".join(w[:12]), []
    for n, x in enumerate(w):
        copy += [x, "quux"] if n % 8 == 7 else [x]
    doc = f" {sentence(rnd, 30)} ".join([part] * 4) + f" {sentence(rnd, 30)} " + " ".join(copy)
    docs = [*enumerate(fill), (100, doc)]
    assert run(spark, docs, [*items, ("k0", " ".join(w) + ".")]) == {(100, "k0")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.lists(st.integers(0, 4), min_size=5, max_size=12), max_size=4))
def test_search_like_brute_force(doc, items):
    text = lambda w: " ".join("abcde"[x] for x in w)
    p = k.Patterns([(str(n), text(w)) for n, w in enumerate(items)])
    w = p.numbers(text(doc))
    runs = {}
    for s in p.sentences:
        for q in range(len(s[1]) - k.RUN + 1):
            runs.setdefault(tuple(s[1][q : q + k.RUN]), len(runs))
    want = [(q, runs[tuple(w[q : q + k.RUN])]) for q in range(len(w) - k.RUN + 1) if tuple(w[q : q + k.RUN]) in runs]
    assert p.search(w) == want
