import random

import numpy as np

from evisift.llm import reading as r

PLAIN = ["We had a walk and it was fun.", "The cup of tea is hot for the men.", "If you feel bad then stop and call us.", "They read the note and kept the bag."]
HARD = ["Notwithstanding the heteroscedastic assumptions underlying multivariate estimation, residual confounding necessitated reinterpretation of the consortium.", "Identifiability of hierarchical standardisation presupposes exchangeability, a condition that misclassification demonstrably precluded in the repository."]


def text(kind, rnd, n=14):
    return " ".join(rnd.choice(PLAIN if kind == "plain" else HARD) for _ in range(n))


def tables(spark, n=160):
    rnd = random.Random(2)
    docs = [(k, text("plain" if k % 2 else "specialist", rnd), f"s{k % 7}") for k in range(n)]
    docs += [(900, None, None), (901, "", "s"), (902, "La recherche a été complétée par les auteurs. " * 12, "s"), (903, "1. Doe J. Arch Comm. 2021;22(5):49-99\n" * 12, "s"), (904, '{"ev":"screen","seq":1}\n' * 30, "s"), (905, "We had a walk.", "s"), (906, "w" * 100_000, "s")]
    docs += [(907, "References\n" + text("plain", rnd), "s"), (908, text("plain", rnd) + "\nReferences\n1. Doe J. Arch Comm. 2021;22(5):49-99", None)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, source string, grade string")
    lab = spark.createDataFrame([(k, "plain" if k % 2 else "Specialist ", "g") for k in range(0, 60)] + [(1, "general", "h"), (None, "plain", "h"), (5, None, "h"), (7, "unknown", "h"), (900, "plain", "h")], "doc_id bigint, level_name string, grader string")
    return d, lab


def test_levels(spark):
    d, lab = tables(spark)
    got = {x["doc_id"]: x["level_name"] for x in r.reading_levels(d, lab).collect()}
    assert set(got) == set(range(160)) | {907, 908}  # texts are read whole: prose behind a heading of references counts, entries of the list do not
    assert np.mean([got[k] == ("plain" if k % 2 else "specialist") for k in range(160)]) > 0.97


def test_no_labels(spark):
    d, lab = tables(spark)
    assert r.reading_levels(d, lab.limit(0)).count() == 0 and r.reading_levels(d.limit(0), lab).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + np.where(x[:, 1] * x[:, 0] > 0, 1.0, 0.0)
    t = r.Trees(trees=80).fit(x[:400], y[:400])
    assert np.mean((t.predict(x[400:]) - y[400:]) ** 2) < 0.25 * y.var()


def test_cuts():
    c = r.cut_points(np.array([0.1, 0.9, 2.2, 3.0]), np.array([0, 1, 2, 3]))
    assert (np.searchsorted(c, [0.1, 0.9, 2.2, 3.0]) == [0, 1, 2, 3]).all()


def test_prose_counts_words():
    assert r.Prose("Two people looked at the list and agreed on it.\nNo one felt cold in the test.").words == 17
    assert r.Prose(None).words == 0
