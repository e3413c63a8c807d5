from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evisift.operators import folds, linkage, screening

T = datetime(2024, 1, 1)
LOG = "id string, ev string, ts timestamp, actor string, stage string, record_id string, decision string, criteria array<string>, criteria_version int"


def log(spark, rows):
    return spark.createDataFrame([(f"e{k}", ev, T + timedelta(minutes=m), a, s, r, d, c, v) for k, (ev, m, a, s, r, d, c, v) in enumerate(rows)], LOG)


TA, FT = "title-abstract", "full-text"


@pytest.fixture(scope="module")
def events(spark):
    return log(spark, [
        ("screen", 1, "a", TA, "r1", "include", [], 1), ("screen", 2, "b", TA, "r1", "include", [], 2), ("screen", 3, "a", TA, "r2", "include", [], 1), ("screen", 4, "b", TA, "r2", "exclude", ["c1"], 1),
        ("adjudicate", 9, "z", TA, "r2", "exclude", ["c1"], 1), ("screen", 5, "a", TA, "r3", "maybe", [], 1), ("screen", 6, "b", TA, "r3", "include", [], 1), ("screen", 7, "a", TA, "r3", "include", [], 1),
        ("screen", 8, "c", TA, "r1", "exclude", ["c2"], 1), ("screen", 10, "a", FT, "r1", "include", [], 1),
    ])


def test_states(spark, events):
    assigned = spark.createDataFrame([(TA, r, a) for r in ("r1", "r2", "r3", "r4") for a in ("a", "b")] + [(FT, "r1", "a"), (FT, "r1", "b")], "stage string, record_id string, actor string")
    got = {(r["stage"], r["record_id"]): r["status"] for r in screening.states(events, assigned).collect()}
    assert got == {(TA, "r1"): "include", (TA, "r2"): "exclude", (TA, "r3"): "include", (TA, "r4"): "unscreened", (FT, "r1"): "partial"}
    assert [r["record_id"] for r in screening.queue(events, assigned, "b").collect() if r["stage"] == FT] == ["r1"]


def test_folds(spark, events):
    twice = events.union(events)
    assert folds.once(twice).count() == events.count()
    assert folds.last_write(twice.where("ev = 'screen'").select("record_id", "decision", "ts", "id"), ["record_id"]).where("record_id = 'r3'").first()["decision"] == "include"
    assert folds.first_write(events.where("ev = 'screen'").select("record_id", "decision", "ts", "id"), ["record_id"]).where("record_id = 'r3'").first()["decision"] == "maybe"
    assert folds.without(events, "e0").count() == events.count() - 1


def test_chain(spark):
    c = spark.createDataFrame([("f", 1, "d1", None), ("f", 2, "d2", "d1"), ("f", 3, "d3", "d1"), ("f", 4, "d4", "d4"), ("f", 5, "d5", "d9"), ("g", 1, "d6", "d1")], "file string, line int, digest string, prev string")
    assert {(r["file"], r["line"]) for r in folds.broken_links(c).collect()} == {("f", 4), ("f", 5), ("g", 1)}


def test_staleness(spark):
    decided = spark.createDataFrame([(TA, "i", "include", [], 1), (TA, "e", "exclude", ["c1"], 1), (TA, "x", "exclude", ["c9"], 1), (TA, "m", "maybe", [], 1), (TA, "new", "include", [], 3)], "stage string, record_id string, decision string, cited array<string>, version int")
    changes = spark.createDataFrame([("c1", "edited", "loosened", 2, [TA]), ("c2", "added", "neutral", 3, [TA]), ("c3", "edited", "editorial", 3, [TA]), ("c4", "edited", "both", 4, [FT])], "criterion string, kind string, direction string, to_version int, stages array<string>")
    got = {r["record_id"]: (r["reason"], r["causes"]) for r in screening.stale(decided, changes, 3).collect()}
    assert got == {"i": ("criterion-added", "c2"), "e": ("criterion-loosened", "c1"), "m": ("maybe-any-change", "c1,c2")}


def test_kappa(spark, events):
    got = screening.agreement(events).where("actor_a = 'a' and actor_b = 'b'").first()
    assert (got["n"], got["maybes"], got["agreement"]) == (2, 1, 0.5)


def test_cluster(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("f", "f"), ("c", "z")], "a string, b string")
    assert dict(tuple(r) for r in linkage.cluster(links).collect()) == {"a": "a", "b": "a", "c": "a", "z": "a", "d": "d", "e": "d"}


def test_greedy_merges_every_component(spark):
    # one block of more than BLOCK_MOST records: a chain of pairs that are the same, and pairs that are not
    n = linkage.BLOCK_MOST + 10
    rows = [(f"r{x:05d}", f"t{x // 3}", ["doe", "roe"], 2010, "j", "1", str(x // 3), None, None, False, x % 2) for x in range(n)]
    k = spark.createDataFrame(rows, "id string, title string, authors array<string>, year int, journal string, volume string, page string, doi string, pmid string, best_effort boolean, complete int")
    pairs = spark.createDataFrame([(rows[x][0], rows[y][0]) for x in range(n) for y in (x + 1, x + 2) if y < n], "a string, b string")
    gone, want = set(), set()
    for x in range(n):
        for y in (x + 1, x + 2):
            if y < n and x // 3 == y // 3 and not {x, y} & gone:
                keep, drop = (x, y) if (-(x % 2), x) <= (-(y % 2), y) else (y, x)
                gone.add(drop)
                want.add((rows[keep][0], rows[drop][0]))
    whole = {(r["canonical"], r["absorbed"]) for r in linkage.greedy(k, pairs, spark.createDataFrame([(r[0], "r00000") for r in rows], "id string, cluster string")).collect()}
    assert whole == want and len(want) > 1000
    assert {(r["canonical"], r["absorbed"]) for r in linkage.greedy(k, pairs).collect()} == want


def test_characteristics_show_every_field(spark):
    from evisift.catalog.records import QUERIES
    from tests.conftest import data

    form = {r["field"] for r in spark.read.parquet(f"{data()}/form_fields.parquet").collect()}
    want = {(r["study"], r["field"], r["value_id"], r["value"]) for r in spark.read.parquet(f"{data()}/extraction_values.parquet").collect() if r["field"] in form}
    rows = QUERIES["characteristics_values"](spark, data()).collect()
    assert {(r["study"], f, x["value_id"], x["value"]) for r in rows for f in form for x in r[f]} == want and len({x[1] for x in want}) == 11
    assert all(r[f"{f}_n"] == sum(x["value"] is not None for x in r[f]) for r in rows for f in form)


def test_metrics(spark):
    f = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    t = spark.createDataFrame([("a", "b"), ("d", "e")], "a string, b string")
    r = linkage.metrics(f, t).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 1, 1, 0.5, 0.5)


def test_oversized_blocks_lose_nothing(spark):
    keys = spark.createDataFrame([(f"r{k}", 2000 + k % 3, "doi", "k") for k in range(9)], "id string, year int, kind string, key string")
    out, warn = linkage.split_oversized(keys, most=5)
    assert out.count() == 9 and warn.count() == 1 and out.select("key").distinct().count() == 3


def test_no_row_is_no_error(spark):
    e = log(spark, [])
    assert screening.states(e, screening.assignment(e)).count() == 0
    assert linkage.cluster(spark.createDataFrame([], "a string, b string")).count() == 0
    assert e.agg(F.count("*")).first()[0] == 0


EVENTS = "ev string, id string, ts int, study string, reports array<string>, report string, studies array<string>"


def studies_of(report, events):
    """One report's studies by following all events one by one."""
    alone = "std_" + report.split("_", 1)[1]
    now, rest = {alone}, set()
    for ev, _, _, study, reports, split, parts in sorted(events, key=lambda e: (e[2], e[1])):
        if ev == "study-split":
            if split == report:
                now, rest = set(parts), set(parts)
        elif report in reports:
            now, rest = (set(rest), rest) if study in rest else ({study}, set())
        else:
            now.discard(study)
            rest.discard(study)
            now = now or {alone}
    return now


def test_study_fold(spark):
    import random

    from evisift.operators.studies import study_map

    fixed = [
        ("study-group", "1", 1, "std_0a", ["rpt_0a", "rpt_0b", "rpt_x"], None, None), ("study-split", "2", 2, None, None, "rpt_0c", ["std_c1", "std_c2"]), ("study-group", "3", 3, "std_c1", ["rpt_0c", "rpt_0d"], None, None), ("study-group", "4", 4, "std_0a", ["rpt_0a"], None, None),
        # a report dropped from one part of its split forgets that part
        ("study-split", "5", 5, None, None, "rpt_0e", ["std_e1", "std_e2"]), ("study-group", "6", 6, "std_e2", ["rpt_0f"], None, None), ("study-group", "7", 7, "std_e1", ["rpt_0e"], None, None), ("study-group", "7", 7, "std_e1", ["rpt_0e"], None, None),
    ]
    events, reports = list(fixed), [f"rpt_0{x}" for x in "abcdef"]
    rng = random.Random(7)
    for run in range(1, 60):  # runs do not share a name
        own = [f"rpt_{run}{x}" for x in "abc"]
        names = [f"std_{run}{x}" for x in "abcs"]
        reports += own
        for k in range(rng.randint(1, 7)):
            if rng.random() < 0.4:
                events.append(("study-split", f"{run}-{k}", rng.randint(1, 5), None, None, rng.choice(own), rng.sample(names, 2)))
            else:
                events.append(("study-group", f"{run}-{k}", rng.randint(1, 5), rng.choice(names), rng.sample(own, rng.randint(1, 3)), None, None))
    got = {}
    for r in study_map(spark.createDataFrame(events, EVENTS), spark.createDataFrame([(r,) for r in [*reports, None]], "report string")).collect():
        got.setdefault(r["report"], set()).add(r["study"])
    assert got == {r: studies_of(r, events) for r in reports}
    assert got["rpt_0e"] == {"std_e1"} and got["rpt_0c"] == {"std_c1", "std_c2"} and got["rpt_0b"] == {"std_0b"}
    assert study_map(spark.createDataFrame([], EVENTS), spark.createDataFrame([("rpt_q",)], "report string")).first()["study"] == "std_q"


def test_staleness_reasons(spark):
    rows = [(f"r{k}", d, ["c1"] if k != 5 else [], 1) for k, d in enumerate(["include", "exclude", "maybe", "include", "exclude", "exclude"])]
    decided = spark.createDataFrame([("title-abstract", *r) for r in rows], "stage string, record_id string, decision string, cited array<string>, version int")
    change = "criterion string, kind string, direction string, to_version int, stages array<string>"
    s = lambda *c: {r["record_id"]: (r["reason"], r["causes"]) for r in screening.stale(decided, spark.createDataFrame([(*x, ["title-abstract"]) for x in c], change), 9).collect()}
    both = s(("c1", "edited", "both", 2), ("c2", "added", "neutral", 3))
    assert both == {"r0": ("criterion-both", "c1,c2"), "r3": ("criterion-both", "c1,c2"), "r1": ("criterion-both", "c1"), "r4": ("criterion-both", "c1"), "r2": ("maybe-any-change", "c1,c2")}
    assert s(("c1", "edited", "tightened", 2), ("c2", "added", "neutral", 3))["r0"] == ("criterion-added", "c1,c2")
    assert s(("c1", "retired", "neutral", 2)) == {"r1": ("criterion-retired", "c1"), "r4": ("criterion-retired", "c1"), "r2": ("maybe-any-change", "c1")}
    assert s(("c1", "edited", "editorial", 2)) == {}


def test_chains_of_any_length(spark):
    far = spark.createDataFrame([(k, k - 1) for k in range(1, 200)] + [(1000, 1000), (2001, 2002), (2002, 2001)], "id int, to int")
    got = {r["id"]: r["to"] for r in linkage.chain_ends(far).collect()}
    assert all(got[k] == 0 for k in range(1, 200)) and got[1000] == 1000 and got[2001] in (2001, 2002)


def odd_records(spark, n=400):
    """Keyed records of few values each, so that many pairs share several keys; nulls, empty texts, equal and single authors among them."""
    import random

    rng = random.Random(3)
    words, names = ["effect", "of", "sleep", "on", "pain", "trial"], ["doe", "roe", "poe", "", "van a"]
    row = lambda k: (
        f"r{k:04d}", rng.choice(["", "effect of sleep on pain", " ".join(["effect", "of", "sleep", *rng.choices(words, k=3)])]), rng.choice([[], ["doe"], ["doe", "roe"], ["doe", "roe", "poe"], rng.choices(names, k=rng.randint(1, 4))]), rng.choice([None, 2009, 2010, 2010]),
        rng.choice([None, "", "j of a", "j of a", "j of b"]), rng.choice([None, "1", "1", "2"]), rng.choice([None, "7", "7", "8"]), rng.choice([None, None, None, f"10.1234/{rng.randint(0, 40)}"]), rng.choice([None, None, str(rng.randint(0, 60))]), rng.random() < 0.1, rng.randint(0, 4),
    )
    return spark.createDataFrame([row(k) for k in range(n)], "id string, title string, authors array<string>, year int, journal string, volume string, page string, doi string, pmid string, best_effort boolean, complete int")


def test_block_pairs_are_the_candidates_once(spark):
    from evisift.catalog.records import QUERIES
    from tests.conftest import data

    k = odd_records(spark)
    want = sorted(tuple(r) for r in linkage.candidate_pairs(linkage.block_keys(k)).collect())
    assert sorted(tuple(r) for r in linkage.block_pairs(k).collect()) == want and len(want) > 1000
    # no pair is shuffled or gathered: above the join nothing but columns
    plan = QUERIES["block_candidates"](spark, data())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_likely_pairs_are_all_that_can_merge(spark):
    k = odd_records(spark)
    every = linkage.scored(k, linkage.candidate_pairs(linkage.block_keys(k))).cache()
    row = lambda r: (r["a"], r["b"], r["score"], bool(r["doi_veto"]), r["best_effort"])
    for least in (linkage.REVIEW, linkage.AUTO, 1.0):
        want = {row(r) for r in every.where((F.col("plain_score") >= least) | F.col("same_doi")).collect()}
        got = [row(r) for r in linkage.likely(k, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
        assert {row(r) for r in linkage.likely(k, least, vetoed=False).collect()} == {r for r in want if not r[3]}
    assert {(r["a"], r["b"], r["score"]) for r in linkage.accepted(k).collect()} == {tuple(r) for r in linkage.accepted(k, every.select("a", "b")).collect()}
    assert sorted(map(tuple, linkage.greedy(k).collect())) == sorted(map(tuple, linkage.greedy(k, every.select("a", "b")).collect()))
    with pytest.raises(ValueError):
        linkage.likely(k, 0.7)


def test_class_counts_visit_no_distinct_pair(spark):
    k = odd_records(spark)
    every = linkage.scored(k, linkage.candidate_pairs(linkage.block_keys(k)))
    judged = every.where("a like '%7'").select(F.col("b").alias("a"), F.col("a").alias("b")).union(every.where("b like '%3'").select("a", "b")).union(spark.createDataFrame([("r0001", "x"), ("r0002", "r0002")], "a string, b string"))
    want = {r["class"]: r["n"] for r in linkage.classified(every, judged).groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["class"]: r["n"] for r in linkage.class_counts(k, judged).collect()} == want and len(want) == 3


def test_lsh_pairs_are_the_candidates_once(spark, monkeypatch):
    import random

    from evisift.catalog.records import QUERIES
    from tests.conftest import data

    rng = random.Random(5)
    titles = [None, "", "ab", "abc", "žluť 睡眠 и боль 😀", "žluť 睡眠 и боль 😀!", *[" ".join(rng.choices(["effect", "of", "sleep", "on", "pain", "trial", "睡眠", "боль"], k=rng.randint(1, 6))) for _ in range(300)]]
    k = spark.createDataFrame([(f"r{rng.random():.9f}", t) for t in [*titles, *titles[:40]]], "id string, title string").repartition(3)
    want = sorted(tuple(r) for r in linkage.candidate_pairs(linkage.lsh_bands(k)).collect())
    assert len(want) > 1000
    # all in one block and in blocks of a few records, meetings one by one and in chunks
    for rows, most in ((1000, 1 << 20), (50, 100), (7, 1)):
        monkeypatch.setattr(linkage, "TILE_MEETINGS", most)
        assert sorted(tuple(r) for r in linkage.lsh_pairs(k, rows=rows).collect()) == want
    assert linkage.lsh_pairs(k.where("length(title) < 3")).count() == 0
    records = spark.read.parquet(f"{data()}/records.parquet")
    assert sorted(map(tuple, linkage.titled(records).collect()), key=str) == sorted(map(tuple, linkage.keyed(records).select("id", "title").collect()), key=str)
    # no pair is shuffled: above the join nothing but columns
    plan = QUERIES["minhash_candidates"](spark, data())._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_lsh_pairs_come_in_runs_over_few_ids_a_task(spark):
    import random

    rng = random.Random(7)
    k = spark.createDataFrame([(f"rec_{rng.getrandbits(80):020x}", f"effect of sleep on pain in trial {n % 9}") for n in range(400)], "id string, title string").repartition(5)
    want = linkage.candidate_pairs(linkage.lsh_bands(k)).count()
    tasks: dict[int, list] = {}
    for r in linkage.lsh_pairs(k, rows=32).select(F.spark_partition_id().alias("task"), "a", "b").collect():
        tasks.setdefault(r["task"], []).append((r["a"], r["b"]))
    assert sum(map(len, tasks.values())) == want > 10_000
    for pairs in tasks.values():
        # what a dictionary of b has to hold, and runs of a
        assert len({b for _, b in pairs}) <= 32
        assert sum(x[0] != y[0] for x, y in zip(pairs, pairs[1:])) + 1 == len({a for a, _ in pairs})
