import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from evisift.llm import consensus as c

T = datetime(2024, 1, 1)
LOG = "ev string, stage string, record_id string, actor string, decision string, ts timestamp, id string, posterior double"
TOOL = "tool string, row_no bigint, record_id string, stage string, decision string, reviewer string, imported_at timestamp, q double"


def tables(spark, log, tool=()):
    rows = [(ev, s, r, a, d, T + timedelta(minutes=m), i, 1.0) for ev, s, r, a, d, m, i in log]
    return spark.createDataFrame(rows, LOG), spark.createDataFrame([(*t, T, 0.0) for t in tool], TOOL)


def got(spark, *args):
    return {(r["record_id"], r["stage"]): r for r in c.consensus(*tables(spark, *args)).collect()}


def test_rules(spark):
    log = [
        ("screen", "s", "r1", "rev-001", "include", 1, "a"), ("screen", "s", "r1", "rev-002", "include", 1, "b"), ("screen", "s", "r1", "rev-002", "include", 1, "b"),
        ("screen", "s", "r2", "rev-001", "include", 1, "c"), ("screen", "s", "r2", "rev-001", "exclude", 2, "d"), ("screen", "s", "r2", "rev-002", "exclude", 1, "e"),
        ("screen", "s", "r3", "rev-001", "include", 1, "f"), ("screen", "s", "r3", "rev-002", "include", 1, "g"), ("adjudicate", "s", "r3", "rev-009", "include", 5, "h"), ("adjudicate", "s", "r3", "rev-009", "exclude", 6, "i"),
        ("screen", "s", "r4", "rev-001", "include", 1, "j"), ("note", "s", "r4", "rev-002", None, 1, "k"), ("screen", None, "r5", "rev-001", "include", 1, "l"), ("screen", "s", None, "rev-001", "include", 1, "m"),
        ("screen", "s", "r6", "rev-001", "maybe", 1, "n"), ("screen", "s", "r6", None, "include", 1, "o"), ("screen", "s", "r7", "rev-001", "include", 2, "p"), ("screen", "s", "r7", "rev-001", "exclude", 2, "q"),
    ]
    tool = [("t", 1, "r4", "s", " Excluded ", "Rev 1"), ("t", 2, "r6", "s", "?", "reviewer 2"), ("t", 3, "r6", "s", "n/a", "REV-003"), ("t", 4, "r6", "s", None, "rev_4"), ("t", 5, "r7", "s", "EXCLUDE on design", " rev-010 "), ("t", 6, "r8", "s", "Yes", None)]
    out = got(spark, log, tool)
    assert {k[0]: r["decision"] for k, r in out.items()} == {"r1": "include", "r2": "exclude", "r3": "exclude", "r6": out[("r6", "s")]["decision"], "r7": "exclude"}
    assert out[("r1", "s")]["agreement"] == 1.0 and out[("r6", "s")]["agreement"] is None and out[("r3", "s")]["support"] == 1.0 and out[("r7", "s")]["reviewers"] == 2


def test_empty(spark):
    assert got(spark, []) == {}


def crowd(n=600, seed=3):
    """Two able annotators, one that mostly says no, one that guesses and one that turns labels round."""
    rnd, truth, log = random.Random(seed), {}, []
    for k in range(n):
        y = truth[f"r{k}"] = rnd.random() < 0.4
        votes = {"a": y if rnd.random() < 0.92 else not y, "b": y if rnd.random() < 0.9 else not y, "no": y and rnd.random() < 0.3, "coin": rnd.random() < 0.5, "round": not y if rnd.random() < 0.9 else y}
        log += [("screen", "s", f"r{k}", w, "include" if v else "exclude", 1, f"{k}{w}") for w, v in votes.items() if rnd.random() < 0.8]
    return truth, log


@pytest.fixture(scope="module")
def fitted(spark):
    truth, log = crowd()
    return truth, log


def test_better_than_majority(spark, fitted):
    truth, log = fitted
    out = got(spark, log)
    count = {}
    for _, _, r, _, d, _, _ in log:
        count[r] = count.get(r, 0) + (1 if d == "include" else -1)
    ours = np.mean([(r["decision"] == "include") == truth[k[0]] for k, r in out.items()])
    majority = np.mean([(count[k[0]] > 0) == truth[k[0]] for k in out])
    assert ours > 0.9 and ours > majority + 0.05
    rel = {r["reviewer"]: r for r in c.reliability(*tables(spark, log)).collect()}
    assert rel["a"]["truthful"] > 0.7 > rel["coin"]["truthful"] and rel["round"]["contrary"] > 0.6 and rel["no"]["guess_include"] < 0.2


def test_joins_give_the_same(spark, fitted, monkeypatch):
    _, log = fitted
    log, tools = tables(spark, log)
    plain = {(r["record_id"], r["stage"]): (r["decision"], r["support"]) for r in c.consensus(log, tools).collect()}
    sure = {r["reviewer"]: tuple(r)[1:] for r in c.reliability(log, tools).collect()}
    monkeypatch.setattr(c, "ANNOTATORS_MOST", 2)
    joined = {(r["record_id"], r["stage"]): (r["decision"], r["support"]) for r in c.consensus(log, tools).collect()}
    assert joined.keys() == plain.keys() and all(joined[k][0] == plain[k][0] and abs(joined[k][1] - plain[k][1]) < 1e-6 for k in plain)
    again = {r["reviewer"]: tuple(r)[1:] for r in c.reliability(log, tools).collect()}
    assert again.keys() == sure.keys() and all(abs(x - y) < 1e-6 for k in sure for x, y in zip(again[k], sure[k]))
