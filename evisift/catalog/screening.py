"""Queries over the screening log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.operators import folds, screening
from evisift.plans.filterlang import where
from evisift.session import table

# Changes of criteria as a review team would record them; a few rows, given with each query.
CHANGES = [
    ("c1", "edited", "tightened", 2, ["title-abstract", "full-text"]),
    ("c4", "edited", "loosened", 2, ["title-abstract"]),
    ("c7", "added", "neutral", 3, ["full-text"]),
    ("c5", "edited", "both", 3, ["full-text"]),
    ("c2", "edited", "editorial", 3, ["title-abstract", "full-text"]),
    ("c8", "retired", "neutral", 4, ["title-abstract", "full-text"]),
]
_CHANGE_SQL = "(VALUES " + ", ".join(f"('{c}', '{k}', '{d}', {v}, {s})" for c, k, d, v, s in CHANGES) + ") AS ch(criterion, kind, direction, to_version, stages)"
_EXTRA = "(VALUES ('c3', 'edited', 'tightened', 5, ['title-abstract'])) AS ch(criterion, kind, direction, to_version, stages)"
CUT = "2023-01-01"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The log as it is: repeated rows change nothing in a fold, so nothing is shuffled to leave them out."""
    return table(spark, d, "screen_log").select("id", "ev", "ts", "actor", "stage", "record_id", "decision", "criteria", "criteria_version")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return folds.once(_rows(spark, d))


def _changes(spark: SparkSession, extra: bool = False) -> DataFrame:
    rows = CHANGES + ([("c3", "edited", "tightened", 5, ["title-abstract"])] if extra else [])
    return spark.createDataFrame(rows, "criterion string, kind string, direction string, to_version int, stages array<string>")


def _assigned(log: DataFrame) -> DataFrame:
    return screening.assignment(log)


def fold_last_write(spark, d):
    return folds.last_write(_rows(spark, d).where("ev = 'screen'").select("stage", "record_id", "actor", "decision", "ts", "id"), ["stage", "record_id", "actor"])


def fold_first_write(spark, d):
    return folds.first_write(_rows(spark, d).where("ev = 'screen'").select("stage", "record_id", "actor", "decision", "ts", "id"), ["stage", "record_id", "actor"])


def event_dedup(spark, d):
    return _log(spark, d).groupBy("ev", "stage").agg(F.count(F.lit(1)).alias("events"))


def event_sequence(spark, d):
    return folds.sequenced(_log(spark, d).where("ev = 'adjudicate'").select("actor", "ts", "id"), ["actor"])


def undo_fold(spark, d):
    log = _log(spark, d).where("ev = 'adjudicate'").select("stage", "record_id", "decision", "ts", "id")
    last = folds.last_write(log, ["stage", "record_id"]).select("id")
    return folds.last_write(log.join(last, "id", "left_anti"), ["stage", "record_id"])


def hash_chain_check(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line"))
    c = e.withColumn("digest", F.sha2(F.concat_ws(":", "file", "line"), 256))
    # every 97th line refers to its own digest, which no earlier line has; the others to the line five before in the log of all events
    prev = e.select(F.col("file"), (F.col("line") + 5).alias("line"), F.sha2(F.concat_ws(":", "file", "line"), 256).alias("prev"))
    j = c.join(prev, ["file", "line"], "left").withColumn("prev", F.when(F.col("line") % 97 == 0, F.col("digest")).otherwise(F.col("prev")))
    return folds.broken_links(j)


def screening_state(spark, d):
    log = _rows(spark, d)
    return screening.states(log, _assigned(log))


def stage_status_counts(spark, d):
    log = _rows(spark, d)
    return screening.status_counts(screening.states(log, _assigned(log)))


def stage_status_stale(spark, d):
    """Items of each stage, settled ones, included ones, and of these those whose decision later changes of criteria put in doubt."""
    log = _rows(spark, d)
    st = screening.states(log, _assigned(log)).join(screening.stale_with_upstream(log, _changes(spark), 4).select("stage", "record_id", F.lit(1).alias("stale")), ["stage", "record_id"], "left")
    count = lambda c: F.count(F.when(F.expr(c), 1))
    return st.groupBy("stage").agg(
        F.count(F.lit(1)).alias("items"), count("status in ('include', 'exclude')").alias("resolved"), count("stale = 1").alias("stale"), count("status = 'include'").alias("included"), count("status = 'include' and stale = 1").alias("stale_included")
    )


def conflicts_view(spark, d):
    log = _rows(spark, d)
    return screening.conflicts(log, _assigned(log))


def screening_queue(spark, d):
    log = _rows(spark, d)
    everyone = log.where("ev = 'screen'").select("stage", "record_id").distinct().withColumn("actor", F.lit("rev-001"))
    return screening.queue(log, everyone, "rev-001")


def irr_pairs(spark, d):
    return screening.agreement(_rows(spark, d))


def included_reports(spark, d):
    log = _rows(spark, d)
    return screening.included_reports(screening.states(log, _assigned(log)))


def stale_decisions(spark, d):
    return screening.stale_with_upstream(_rows(spark, d), _changes(spark), 4)


def stale_preview(spark, d):
    log = _rows(spark, d)
    before, after = screening.stale_with_upstream(log, _changes(spark), 4), screening.stale_with_upstream(log, _changes(spark, True), 5)
    return after.select("stage", "record_id").subtract(before.select("stage", "record_id"))


def stale_asof(spark, d):
    return screening.stale(screening.resolved(folds.as_of(_rows(spark, d), CUT)), _changes(spark), 3)


def stale_counts(spark, d):
    return stale_decisions(spark, d).groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))


def criteria_at_version(spark, d):
    return screening.criteria_at(_changes(spark), 3).select("criterion", "kind", "direction", "to_version")


def criteria_diff(spark, d):
    c = _changes(spark).where("to_version > 2 and to_version <= 4")
    return c.groupBy("kind", "direction").agg(F.count(F.lit(1)).alias("n"))


def amendment_impact(spark, d):
    """Of each change: decisions it made stale, and of these: taken again with the same or with another result."""
    log = _rows(spark, d)
    before = screening.resolved(folds.as_of(log, CUT))
    s = screening.stale(before, _changes(spark), 4).select("stage", "record_id")
    now = screening.resolved(log).select("stage", "record_id", F.col("decision").alias("now"), F.col("version").alias("now_version"))
    j = s.join(before.select("stage", "record_id", "decision", "version"), ["stage", "record_id"]).join(now, ["stage", "record_id"], "left")
    return j.groupBy("stage").agg(
        F.count(F.lit(1)).alias("touched"), F.count(F.when(F.col("now_version") > F.col("version"), 1)).alias("taken_again"),
        F.count(F.when((F.col("decision") == "include") & (F.col("now") == "exclude"), 1)).alias("now_excluded"),
        F.count(F.when((F.col("decision") == "exclude") & (F.col("now") == "include"), 1)).alias("now_included"),
    )


def pool_view(spark, d):
    """Records that a filter keeps, with their states at both stages; by record."""
    log = _rows(spark, d)
    s = screening.states(log, _assigned(log))
    per = s.groupBy("record_id").agg(F.max(F.when(F.col("stage") == "title-abstract", F.col("status"))).alias("tiab"), F.max(F.when(F.col("stage") == "full-text", F.col("status"))).alias("fulltext"))
    r = table(spark, d, "records").select("id", "title", F.expr("get(get(issued.date_parts, 0), 0)").alias("year"), F.expr("get(author, 0).family").alias("first_author"), "lang").dropDuplicates(["id"])
    kept = where(r, "year >= 2005 and year < 2020 and not lang in ['de', 'pt'] and (title contains 'trial' or title matches '^The [A-Z]+ study')")
    title = F.when(F.length("title") > 120, F.concat(F.substring("title", 1, 120), F.lit("…"))).otherwise(F.col("title"))
    return kept.join(per, kept["id"] == per["record_id"], "left").select(
        "id", title.alias("title"), "year", F.coalesce("first_author", F.lit("")).alias("first_author"), F.coalesce("tiab", F.lit("unscreened")).alias("tiab"), F.coalesce("fulltext", F.lit("unscreened")).alias("fulltext")
    )


def audit_excludes(spark, d):
    """Standing excludes without an adjudication: a sample of fifty, in the order of a hash of seed and key."""
    log = _rows(spark, d)
    s = screening.states(log, _assigned(log)).where("status = 'exclude'").select("stage", "record_id")
    rest = s.join(screening.adjudications(log).select("stage", "record_id"), ["stage", "record_id"], "left_anti")
    return rest.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "stage", "record_id")), "record_id").limit(50)


def asof_join(spark, d):
    """The last opinion given on an item before each of its adjudications."""
    log = _rows(spark, d)
    a = log.where("ev = 'adjudicate'").select("stage", "record_id", F.col("id").alias("adj_id"), F.col("ts").alias("adj_ts"))
    o = log.where("ev = 'screen'").select("stage", "record_id", "actor", "decision", "ts", "id")
    j = a.join(o, ["stage", "record_id"]).where("ts < adj_ts")
    return j.groupBy("adj_id").agg(F.max_by(F.struct("actor", "decision"), F.struct("ts", "id")).alias("x")).select("adj_id", "x.actor", "x.decision")


def range_join(spark, d):
    """Opinions and the changes of criteria made since at their stage."""
    o = screening.opinions(_rows(spark, d)).select("stage", "record_id", "actor", "criteria_version")
    c = _changes(spark).select("criterion", "to_version", "stages")
    return o.join(c, (F.col("to_version") > F.col("criteria_version")) & F.expr("array_contains(stages, stage)")).groupBy("stage", "criterion").agg(F.count(F.lit(1)).alias("n"))


def containment_join(spark, d):
    return _log(spark, d).where("ev = 'screen'").select("stage", "decision", F.explode("criteria").alias("criterion")).groupBy("criterion", "stage", "decision").agg(F.count(F.lit(1)).alias("n"))


def compare_reviewers(spark, d):
    """Two reviewers' opinions side by side, whichever of them has one."""
    o = screening.opinions(_rows(spark, d)).select("stage", "record_id", "actor", "decision")
    a, b = o.where("actor = 'rev-001'").select("stage", "record_id", F.col("decision").alias("a")), o.where("actor = 'rev-002'").select("stage", "record_id", F.col("decision").alias("b"))
    return a.join(b, ["stage", "record_id"], "full").select("stage", "record_id", "a", "b", F.col("a").eqNullSafe(F.col("b")).alias("agree"))


def snapshot_diff(spark, d):
    """Items that entered and left the included pool between two times."""
    log = _rows(spark, d)
    state = lambda x: screening.resolved(x).where("decision = 'include'").select("stage", "record_id")
    was, now = state(folds.as_of(log, CUT)), state(log)
    return now.subtract(was).withColumn("change", F.lit("entered")).unionByName(was.subtract(now).withColumn("change", F.lit("left")))


def ledger(spark, d):
    """What each tool contributed."""
    return _log_tool(spark, d).groupBy("tool", "ev").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("actor").alias("actors"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"),
    )


def _log_tool(spark, d):
    log = table(spark, d, "screen_log")
    return folds.once(log.select("id", "ev", "ts", "actor", "stage", F.coalesce("tool", F.lit("none")).alias("tool")))


def provenance(spark, d):
    """The history of one record in order of time."""
    log = _log(spark, d)
    # the record with most events, the smallest id among equals
    one = log.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "record_id").limit(1)
    return log.join(F.broadcast(one.select("record_id")), "record_id").select("record_id", "ts", "id", "ev", "stage", "actor", F.coalesce("decision", F.lit("")).alias("decision"))


def verify_log(spark, d):
    """Rules of the log that are broken, by code."""
    log = _log(spark, d)
    rec = table(spark, d, "records").select(F.col("id").alias("record_id")).distinct()
    codes = [
        ("E_DANGLING_REF", log.join(rec, "record_id", "left_anti")),
        ("E_EXCLUSION_NO_CRITERION", log.where("ev = 'screen' and stage = 'full-text' and decision = 'exclude' and size(criteria) = 0")),
        ("E_INCLUDE_WITH_CRITERION", log.where("ev = 'screen' and decision = 'include' and size(criteria) > 0")),
        ("E_SCHEMA", log.where("ev in ('screen', 'adjudicate') and (decision is null or record_id is null or actor is null)")),
    ]
    out = None
    for code, rows in codes:
        one = rows.select(F.lit(code).alias("code"), "id")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def late_events(spark, d):
    """Events received more than a day after they happened, by whole days."""
    log = folds.once(table(spark, d, "screen_log").select("id", "ts", "received_at", "ev"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    days = F.floor((micros("received_at") - micros("ts")) / 86_400_000_000).cast("bigint")
    return log.withColumn("days", days).where("days >= 1").groupBy("ev", "days").agg(F.count(F.lit(1)).alias("n"))


def status_report(spark, d):
    """Share of items resolved per stage, and the next action."""
    c = stage_status_counts(spark, d)
    done = F.col("include") + F.col("exclude")
    action = F.when(F.col("unscreened") + F.col("partial") > 0, "screen").when(F.col("conflict") > 0, "adjudicate").otherwise("done")
    return c.select("stage", "items", F.bround(100.0 * done / F.col("items"), 2).alias("resolved_percent"), action.alias("next_action"))


def cohort_reviewers(spark, d):
    """Running number of opinions by reviewer and month."""
    from pyspark.sql import Window

    m = _log(spark, d).where("ev = 'screen'").groupBy("actor", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.select("actor", "month", "n", F.sum("n").over(Window.partitionBy("actor").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


QUERIES = {
    f.__name__: f
    for f in (
        fold_last_write, fold_first_write, event_dedup, event_sequence, undo_fold, hash_chain_check, screening_state, stage_status_counts, stage_status_stale, conflicts_view,
        screening_queue, irr_pairs, included_reports, stale_decisions, stale_preview, stale_asof, stale_counts, criteria_at_version, criteria_diff, amendment_impact,
        pool_view, audit_excludes, asof_join, range_join, containment_join, compare_reviewers, snapshot_diff, ledger, provenance, verify_log, late_events, status_report, cohort_reviewers,
    )
}

_L = "log AS (SELECT DISTINCT id, ev, ts, actor, stage, record_id, decision, criteria, criteria_version FROM screen_log)"
_OP = "op AS (SELECT stage, record_id, actor, arg_max(decision, (ts, id)) AS decision, arg_max(criteria, (ts, id)) AS criteria, arg_max(criteria_version, (ts, id)) AS criteria_version, max(ts) AS ts FROM log WHERE ev = 'screen' GROUP BY ALL)"
_FI = "fi AS (SELECT stage, record_id, actor, arg_min(decision, (ts, id)) AS decision, min(ts) AS ts, arg_min(id, (ts, id)) AS id FROM log WHERE ev = 'screen' GROUP BY ALL)"
_AS = "asg AS (SELECT stage, record_id, actor FROM (SELECT *, row_number() OVER (PARTITION BY stage, record_id ORDER BY ts, id, actor) AS rn FROM fi) WHERE rn <= 2)"
_AD = "adj AS (SELECT stage, record_id, arg_max(decision, (ts, id)) AS adjudicated, arg_max(criteria, (ts, id)) AS criteria, arg_max(criteria_version, (ts, id)) AS criteria_version FROM log WHERE ev = 'adjudicate' GROUP BY ALL)"
_ST = """st AS (SELECT stage, record_id, CASE WHEN adjudicated IS NOT NULL THEN adjudicated WHEN n_opinions = 0 THEN 'unscreened' WHEN n_opinions < n_assigned THEN 'partial'
  WHEN maybes > 0 OR kinds > 1 THEN 'conflict' ELSE one END AS status, n_assigned, n_opinions FROM (
  SELECT asg.stage, asg.record_id, count(*) AS n_assigned, count(op.decision) AS n_opinions, count(DISTINCT op.decision) AS kinds, max(op.decision) AS one, count(*) FILTER (op.decision = 'maybe') AS maybes
  FROM asg LEFT JOIN op USING (stage, record_id, actor) GROUP BY ALL) LEFT JOIN adj USING (stage, record_id))"""
_STATE = f"WITH {_L}, {_OP}, {_FI}, {_AS}, {_AD}, {_ST} "


def _resolved(name: str, log: str) -> str:
    op = f"op_{name} AS (SELECT stage, record_id, actor, arg_max(decision, (ts, id)) AS decision, arg_max(criteria, (ts, id)) AS criteria, arg_max(criteria_version, (ts, id)) AS v FROM {log} WHERE ev = 'screen' GROUP BY ALL)"
    ad = f"ad_{name} AS (SELECT stage, record_id, arg_max(decision, (ts, id)) AS decision, list_sort(arg_max(criteria, (ts, id))) AS cited, arg_max(criteria_version, (ts, id)) AS version FROM {log} WHERE ev = 'adjudicate' GROUP BY ALL)"
    agg = f"ag_{name} AS (SELECT stage, record_id, max(decision) AS decision, list_sort(list_distinct(flatten(list(criteria)))) AS cited, min(v) AS version FROM op_{name} GROUP BY ALL HAVING count(DISTINCT decision) = 1)"
    return f"{op}, {ad}, {agg}, {name} AS (SELECT * FROM ad_{name} UNION ALL SELECT * FROM ag_{name} ANTI JOIN ad_{name} USING (stage, record_id))"


def _stale(name: str, decided: str, changes: str, current: int) -> str:
    return f"""{name} AS (SELECT stage, record_id, arg_min(reason, (r, reason)) AS reason, array_to_string(list_sort(list(DISTINCT criterion)), ',') AS causes FROM (
      SELECT z.stage, z.record_id, c.criterion, CASE WHEN z.decision = 'maybe' THEN 0 WHEN c.d = 'both' THEN 1 WHEN z.decision = 'include' AND c.kind = 'added' OR z.decision = 'exclude' AND c.kind = 'retired' THEN 2 ELSE 3 END AS r,
        CASE r WHEN 0 THEN 'maybe-any-change' WHEN 1 THEN 'criterion-both' WHEN 2 THEN 'criterion-' || c.kind ELSE if(z.decision = 'include', 'criterion-tightened', 'criterion-loosened') END AS reason
      FROM {decided} z JOIN (SELECT *, CASE WHEN kind = 'added' THEN 'tightened' WHEN kind = 'retired' THEN 'loosened' ELSE direction END AS d FROM {changes}) c
        ON c.d <> 'editorial' AND c.to_version <= {current} AND c.to_version > z.version AND list_contains(c.stages, z.stage)
        AND ((z.decision = 'include' AND c.d IN ('tightened', 'both')) OR (z.decision = 'exclude' AND c.d IN ('loosened', 'both') AND list_contains(z.cited, c.criterion)) OR z.decision = 'maybe'))
    GROUP BY ALL)"""


def _upstream(name: str, s: str, r: str) -> str:
    return f"""{name} AS (SELECT * FROM {s} UNION ALL SELECT stage, record_id, 'upstream-stale', '' FROM (SELECT stage, record_id FROM {r} WHERE stage = 'full-text')
      SEMI JOIN (SELECT record_id FROM {s} WHERE stage = 'title-abstract') USING (record_id) ANTI JOIN (SELECT record_id FROM {s} WHERE stage = 'full-text') USING (record_id))"""


_CH = f"ch AS (SELECT * FROM {_CHANGE_SQL})"
_CH5 = f"ch5 AS (SELECT * FROM ch UNION ALL SELECT * FROM {_EXTRA})"
_STALE = f"WITH {_L}, {_CH}, {_resolved('res', 'log')}, {_stale('s0', 'res', 'ch', 4)}, {_upstream('s1', 's0', 'res')} "
_PAST = f"past AS (SELECT * FROM log WHERE ts < TIMESTAMP '{CUT}')"

ORACLE = {
    "fold_last_write": f"WITH {_L} SELECT stage, record_id, actor, arg_max(decision, (ts, id)) AS decision, max(ts) AS ts, arg_max(id, (ts, id)) AS id FROM log WHERE ev = 'screen' GROUP BY ALL",
    "fold_first_write": f"WITH {_L} SELECT stage, record_id, actor, arg_min(decision, (ts, id)) AS decision, min(ts) AS ts, arg_min(id, (ts, id)) AS id FROM log WHERE ev = 'screen' GROUP BY ALL",
    "event_dedup": f"WITH {_L} SELECT ev, stage, count(*) AS events FROM log GROUP BY ALL",
    "event_sequence": f"WITH {_L} SELECT actor, ts, id, row_number() OVER w AS n, lag(id) OVER w AS prev FROM log WHERE ev = 'adjudicate' WINDOW w AS (PARTITION BY actor ORDER BY ts, id)",
    "undo_fold": f"WITH {_L}, a AS (SELECT * FROM log WHERE ev = 'adjudicate'), r AS (SELECT *, row_number() OVER (PARTITION BY stage, record_id ORDER BY ts DESC, id DESC) AS rn FROM a) SELECT stage, record_id, decision, ts, id FROM r WHERE rn = 2",
    "hash_chain_check": """WITH c AS (SELECT event_type AS file, event_id AS line, sha256(event_type || ':' || event_id) AS digest FROM events),
      j AS (SELECT c.file, c.line, c.digest, CASE WHEN c.line % 97 = 0 THEN c.digest ELSE p.digest END AS prev FROM c LEFT JOIN c p ON p.file = c.file AND p.line + 5 = c.line)
      SELECT j.file, j.line, j.digest, j.prev FROM j WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j e WHERE e.file = j.file AND e.digest = j.prev AND e.line < j.line)""",
    "screening_state": _STATE + "SELECT * FROM st",
    "stage_status_counts": _STATE + "SELECT stage, count(*) AS items, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("include", "exclude", "conflict", "partial", "unscreened")) + " FROM st GROUP BY stage",
    "stage_status_stale": f"""WITH {_L}, {_OP}, {_FI}, {_AS}, {_AD}, {_ST}, {_CH}, {_resolved('res', 'log')}, {_stale('s0', 'res', 'ch', 4)}, {_upstream('s1', 's0', 'res')}, x AS (SELECT st.*, s1.reason IS NOT NULL AS stale FROM st LEFT JOIN s1 USING (stage, record_id))
      SELECT stage, count(*) AS items, count(*) FILTER (status IN ('include', 'exclude')) AS resolved, count(*) FILTER (stale) AS stale, count(*) FILTER (status = 'include') AS included, count(*) FILTER (status = 'include' AND stale) AS stale_included FROM x GROUP BY stage""",
    "conflicts_view": _STATE + """SELECT stage, record_id, array_to_string(list_sort(list(DISTINCT actor || '=' || op.decision)), ';') AS said, array_to_string(list_sort(list_distinct(flatten(list(op.criteria)))), ',') AS cited, min(op.ts) AS first_seen
      FROM asg JOIN op USING (stage, record_id, actor) JOIN (SELECT stage, record_id FROM st WHERE status = 'conflict') USING (stage, record_id) GROUP BY ALL""",
    "screening_queue": f"WITH {_L} SELECT DISTINCT stage, record_id FROM log WHERE ev = 'screen' EXCEPT SELECT stage, record_id FROM log WHERE ev = 'screen' AND actor = 'rev-001'",
    "irr_pairs": f"""WITH {_L}, {_FI}, g AS (SELECT stage, a.actor AS actor_a, b.actor AS actor_b, count(*) FILTER (a.decision = 'include' AND b.decision = 'include') AS yy, count(*) FILTER (a.decision = 'include' AND b.decision = 'exclude') AS yn,
      count(*) FILTER (a.decision = 'exclude' AND b.decision = 'include') AS ny, count(*) FILTER (a.decision = 'exclude' AND b.decision = 'exclude') AS nn, count(*) FILTER (a.decision = 'maybe' OR b.decision = 'maybe') AS maybes
      FROM fi a JOIN fi b USING (stage, record_id) WHERE a.actor < b.actor GROUP BY ALL), h AS (SELECT *, yy + yn + ny + nn AS n, (yy + nn) / (yy + yn + ny + nn) AS po,
      ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / ((yy + yn + ny + nn) * (yy + yn + ny + nn)) AS pe FROM g WHERE yy + yn + ny + nn > 0)
      SELECT stage, actor_a, actor_b, n, maybes, round_even(po, 6) AS agreement, round_even((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round_even(2 * po - 1, 6) AS pabak FROM h""",
    "included_reports": _STATE + "SELECT record_id FROM st WHERE stage = 'full-text' AND status = 'include' AND record_id NOT IN (SELECT record_id FROM st WHERE stage = 'title-abstract' AND status = 'exclude')",
    "stale_decisions": _STALE + "SELECT * FROM s1",
    "stale_counts": _STALE + "SELECT stage, reason, count(*) AS n FROM s1 GROUP BY ALL",
    "stale_preview": f"WITH {_L}, {_CH}, {_CH5}, {_resolved('res', 'log')}, {_stale('s0', 'res', 'ch', 4)}, {_upstream('s1', 's0', 'res')}, {_stale('t0', 'res', 'ch5', 5)}, {_upstream('t1', 't0', 'res')} SELECT stage, record_id FROM t1 EXCEPT SELECT stage, record_id FROM s1",
    "stale_asof": f"WITH {_L}, {_PAST}, {_CH}, {_resolved('res', 'past')}, {_stale('s0', 'res', 'ch', 3)} SELECT * FROM s0",
    "criteria_at_version": f"WITH {_CH} SELECT criterion, arg_max(kind, to_version) AS kind, arg_max(direction, to_version) AS direction, max(to_version) AS to_version FROM ch WHERE to_version <= 3 GROUP BY criterion HAVING arg_max(kind, to_version) <> 'retired'",
    "criteria_diff": f"WITH {_CH} SELECT kind, direction, count(*) AS n FROM ch WHERE to_version > 2 AND to_version <= 4 GROUP BY ALL",
    "amendment_impact": f"""WITH {_L}, {_PAST}, {_CH}, {_resolved('old', 'past')}, {_stale('s0', 'old', 'ch', 4)}, {_resolved('res', 'log')}
      SELECT stage, count(*) AS touched, count(*) FILTER (res.version > old.version) AS taken_again, count(*) FILTER (old.decision = 'include' AND res.decision = 'exclude') AS now_excluded,
      count(*) FILTER (old.decision = 'exclude' AND res.decision = 'include') AS now_included FROM s0 JOIN old USING (stage, record_id) LEFT JOIN res USING (stage, record_id) GROUP BY stage""",
    "pool_view": _STATE + """, per AS (SELECT record_id, max(status) FILTER (stage = 'title-abstract') AS tiab, max(status) FILTER (stage = 'full-text') AS fulltext FROM st GROUP BY ALL),
      r AS (SELECT DISTINCT id, title, issued.date_parts[1][1] AS year, author[1].family AS first_author, lang FROM records)
      SELECT id, CASE WHEN length(title) > 120 THEN substring(title, 1, 120) || '…' ELSE title END AS title, year, coalesce(first_author, '') AS first_author, coalesce(tiab, 'unscreened') AS tiab, coalesce(fulltext, 'unscreened') AS fulltext
      FROM r LEFT JOIN per ON per.record_id = r.id WHERE year >= 2005 AND year < 2020 AND coalesce(lang, '') NOT IN ('de', 'pt') AND (contains(lower(title), 'trial') OR regexp_matches(title, '^The [A-Z]+ study'))""",
    "audit_excludes": _STATE + "SELECT stage, record_id FROM st ANTI JOIN adj USING (stage, record_id) WHERE status = 'exclude' ORDER BY md5('42|' || stage || '|' || record_id), record_id LIMIT 50",
    "asof_join": f"WITH {_L} SELECT a.id AS adj_id, arg_max(o.actor, (o.ts, o.id)) AS actor, arg_max(o.decision, (o.ts, o.id)) AS decision FROM log a JOIN log o ON o.ev = 'screen' AND a.ev = 'adjudicate' AND o.stage = a.stage AND o.record_id = a.record_id AND o.ts < a.ts GROUP BY a.id",
    "range_join": f"WITH {_L}, {_OP}, {_CH} SELECT stage, criterion, count(*) AS n FROM op JOIN ch ON ch.to_version > op.criteria_version AND list_contains(ch.stages, op.stage) GROUP BY ALL",
    "containment_join": f"WITH {_L}, x AS (SELECT stage, decision, unnest(criteria) AS criterion FROM log WHERE ev = 'screen') SELECT criterion, stage, decision, count(*) AS n FROM x GROUP BY ALL",
    "compare_reviewers": f"WITH {_L}, {_OP}, a AS (SELECT stage, record_id, decision AS a FROM op WHERE actor = 'rev-001'), b AS (SELECT stage, record_id, decision AS b FROM op WHERE actor = 'rev-002') SELECT stage, record_id, a, b, a IS NOT DISTINCT FROM b AS agree FROM a FULL JOIN b USING (stage, record_id)",
    "snapshot_diff": f"""WITH {_L}, {_PAST}, {_resolved('old', 'past')}, {_resolved('res', 'log')}, w AS (SELECT stage, record_id FROM old WHERE decision = 'include'), n AS (SELECT stage, record_id FROM res WHERE decision = 'include')
      SELECT *, 'entered' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'left' FROM (SELECT * FROM w EXCEPT SELECT * FROM n)""",
    "ledger": "WITH l AS (SELECT DISTINCT id, ev, ts, actor, stage, coalesce(tool, 'none') AS tool FROM screen_log) SELECT tool, ev, count(*) AS events, count(DISTINCT actor) AS actors, min(ts) AS first, max(ts) AS last, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM l GROUP BY ALL",
    "provenance": f"WITH {_L}, one AS (SELECT record_id FROM log GROUP BY record_id ORDER BY count(*) DESC, record_id LIMIT 1) SELECT record_id, ts, id, ev, stage, actor, coalesce(decision, '') AS decision FROM log SEMI JOIN one USING (record_id)",
    "verify_log": f"""WITH {_L} SELECT code, count(*) AS n FROM (SELECT 'E_DANGLING_REF' AS code, id FROM log WHERE record_id NOT IN (SELECT id FROM records WHERE id IS NOT NULL)
      UNION ALL SELECT 'E_EXCLUSION_NO_CRITERION', id FROM log WHERE ev = 'screen' AND stage = 'full-text' AND decision = 'exclude' AND len(criteria) = 0
      UNION ALL SELECT 'E_INCLUDE_WITH_CRITERION', id FROM log WHERE ev = 'screen' AND decision = 'include' AND len(criteria) > 0
      UNION ALL SELECT 'E_SCHEMA', id FROM log WHERE ev IN ('screen', 'adjudicate') AND (decision IS NULL OR record_id IS NULL OR actor IS NULL)) GROUP BY code""",
    "late_events": "WITH l AS (SELECT DISTINCT id, ts, received_at, ev FROM screen_log), x AS (SELECT ev, CAST(floor((epoch_us(received_at) - epoch_us(ts)) / 86400000000) AS BIGINT) AS days FROM l) SELECT ev, days, count(*) AS n FROM x WHERE days >= 1 GROUP BY ALL",
    "status_report": _STATE + "SELECT stage, count(*) AS items, round_even(100.0 * count(*) FILTER (status IN ('include', 'exclude')) / count(*), 2) AS resolved_percent, CASE WHEN count(*) FILTER (status IN ('unscreened', 'partial')) > 0 THEN 'screen' WHEN count(*) FILTER (status = 'conflict') > 0 THEN 'adjudicate' ELSE 'done' END AS next_action FROM st GROUP BY stage",
    "cohort_reviewers": f"WITH {_L}, m AS (SELECT actor, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM log WHERE ev = 'screen' GROUP BY ALL) SELECT actor, month, n, CAST(sum(n) OVER (PARTITION BY actor ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM m",
}
