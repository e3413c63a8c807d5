"""Flow rows, bibliography sets, suggestions, validation and analysis facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisift.catalog import effects as fx
from evisift.catalog import records as rec
from evisift.catalog import screening as scr
from evisift.functions import text
from evisift.operators import folds, pooling, screening, studies
from evisift.session import table


def flow_rows(spark, d):
    """The flow of records as ``data, n`` rows."""
    log = scr._log(spark, d)
    state = screening.states(log, screening.assignment(log))
    s = state.agg(*[F.count(F.when((F.col("stage") == st) & F.expr(cond), 1)).alias(name) for name, st, cond in (
        ("screened", "title-abstract", "true"), ("excluded_on_title", "title-abstract", "status = 'exclude'"), ("assessed", "full-text", "true"), ("excluded_on_text", "full-text", "status = 'exclude'"), ("included", "full-text", "status = 'include'"))])
    r = table(spark, d, "records").agg(F.count(F.lit(1)).alias("identified"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicates"))
    j = r.crossJoin(s)  # one row each
    names = ["identified", "duplicates", "screened", "excluded_on_title", "assessed", "excluded_on_text", "included"]
    return j.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (data, n)"))


def bibliography_sets(spark, d):
    log = scr._log(spark, d)
    s = screening.states(log, screening.assignment(log))
    included = screening.included_reports(s).select("record_id", F.lit("included").alias("set"))
    excluded = s.where("stage = 'full-text' and status = 'exclude'").select("record_id", F.lit("excluded-at-fulltext").alias("set"))
    every = s.where("stage = 'title-abstract' and status <> 'unscreened'").select("record_id", F.lit("all-screened").alias("set"))
    r = rec._one(spark, d).select(F.col("id").alias("record_id"), text.normal_doi(F.col("doi")).alias("doi"))
    return included.unionByName(excluded).unionByName(every).join(r, "record_id").groupBy("set").agg(F.count(F.lit(1)).alias("records"), F.count("doi").alias("with_doi"))


def sync_summary(spark, d):
    """Events received after a time, by kind, and the items whose settled decision they change."""
    log = folds.once(table(spark, d, "screen_log").select("id", "ev", "ts", "received_at", "actor", "stage", "record_id", "decision", "criteria", "criteria_version"))
    base = log.where(F.col("received_at") < F.lit(scr.CUT).cast("timestamp"))
    new = log.join(base.select("id"), "id", "left_anti")
    was, now = screening.resolved(base), screening.resolved(log)
    changed = now.join(was.select("stage", "record_id", F.col("decision").alias("old")), ["stage", "record_id"]).where("decision <> old")
    return new.groupBy("ev").agg(F.count(F.lit(1)).alias("n")).unionByName(changed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("changed decisions").alias("ev"), "n"))


def fulltext_manifest(spark, d):
    """The latest export row of each record at full text, found by DOI if there is one."""
    t = table(spark, d, "tool_decisions").where("stage = 'full-text'").select("record_id", "tool", "row_no", "imported_at")
    last = folds.last_write(t, ["record_id"], ["imported_at", "tool", "row_no"])
    r = rec._one(spark, d).select(F.col("id").alias("record_id"), text.normal_doi(F.col("doi")).alias("doi"))
    return last.join(r, "record_id", "left").select(F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("rec:"), "record_id")).alias("locator"), "record_id", "tool", "row_no")


def informed_opinions(spark, d):
    """First opinions given once a note on the item was there to see (by time alone)."""
    log = scr._log(spark, d)
    notes = log.where("ev = 'note'").groupBy("stage", "record_id").agg(F.min("ts").alias("seen"))
    return screening.first_opinions(log).join(notes, ["stage", "record_id"]).where("ts >= seen").select("stage", "record_id", "actor")


def suggestion_status(spark, d):
    """Each note as a suggestion; the first adjudication after it resolves it."""
    log = scr._log(spark, d)
    n = log.where("ev = 'note'").select(F.col("id").alias("suggestion"), "stage", "record_id", F.col("ts").alias("made"))
    a = log.where("ev = 'adjudicate'").select("stage", "record_id", "decision", "ts", "id")
    first = n.join(a, ["stage", "record_id"]).where("ts > made").groupBy("suggestion").agg(F.min_by("decision", F.struct("ts", "id")).alias("outcome"))
    return n.select("suggestion").join(first, "suggestion", "left").select("suggestion", F.coalesce("outcome", F.lit("pending")).alias("status"))


def form_violations(spark, d):
    """Rows of the extraction that break the coding form."""
    e = table(spark, d, "extraction_values").dropDuplicates(["value_id"])
    f = F.broadcast(table(spark, d, "form_fields").select("field", F.col("unit").alias("form_unit")))
    j = e.join(f, "field", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("not_reported") & F.col("value").isNotNull(), "value-though-not-reported"), F.when(F.col("value") < 0, "negative"),
        F.when(F.col("form_unit").isNull() & F.col("unit").isNotNull(), "unit-of-a-count"), F.when(~F.col("not_reported") & F.col("value").isNull() & F.col("entered").isNull(), "no-value"),
        F.when((F.col("field") == "sample_size") & (F.col("value") != F.floor("value")), "not-a-number-of-people"),
    ))
    return j.select("field", F.explode(codes).alias("code")).groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"))


def study_suggestions(spark, d):
    a = table(spark, d, "records").dropDuplicates(["id"]).select("id", F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), r"^The ([A-Z]{3,8}) study", 1), F.lit("")).alias("registration"), text.family_key(F.expr("get(author, 0).family")).alias("first_author"), F.expr("transform(author, a -> coalesce(a.family, a.literal))").alias("authors"), F.expr(r"try_cast(nullif(regexp_extract(abstract, '(\\d+) participants', 1), '') as int)").alias("sample_size"))
    return studies.suggestions(a)


def study_map(spark, d):
    """Study events made of the merges of the dedup runs: each merge groups its two reports under the first one's study."""
    m = table(spark, d, "dedup_runs").select("run_id", "started_at", F.posexplode("auto_merged").alias("n", "m")).select("run_id", "started_at", "n", F.trim("m.record_a").alias("a"), F.trim("m.record_b").alias("b")).where("a <> '' and b <> '' and a <> b").dropDuplicates(["run_id", "n"])
    ev = m.select(F.lit("study-group").alias("ev"), F.concat_ws(":", "run_id", "n").alias("id"), F.col("started_at").alias("ts"), F.concat(F.lit("std_"), F.col("a")).alias("study"), F.array("a", "b").alias("reports"), F.lit(None).cast("string").alias("report"), F.lit(None).cast("array<string>").alias("studies"))
    return studies.study_map(ev, table(spark, d, "records").select(F.col("id").alias("report")).distinct())


def forest_rows(spark, d):
    """Rows of a forest plot: estimate, interval and weight of each study of an outcome."""
    e = fx._effects(spark, d)
    total = pooling.sums(e, ["outcome"]).select("outcome", "sw")
    se = F.sqrt("vi")
    return fx._six(e.join(total, "outcome").select("outcome", "study", F.col("yi"), (F.col("yi") - 1.959963984540054 * se).alias("lo"), (F.col("yi") + 1.959963984540054 * se).alias("hi"), (100 / F.col("vi") / F.col("sw")).alias("weight")), "yi", "lo", "hi", "weight")


def guardrails(spark, d):
    """Warnings about an analysis of each outcome."""
    s = pooling.common_effect(fx._effects(spark, d), ["outcome"])
    codes = F.array_compact(F.array(F.when(F.col("k") < 10, "few-studies-for-bias-tests"), F.when(F.col("i2") > 75, "high-heterogeneity"), F.when(F.col("i2") < 25, "low-heterogeneity"), F.when(F.col("k") < 3, "no-prediction-interval"), F.when(F.abs(F.col("mu")) < 1.959963984540054 * F.col("se"), "interval-holds-zero")))
    return s.select("outcome", "k", F.array_join(codes, ",").alias("warnings"))


def input_digest(spark, d):
    """A digest of each outcome's input; an analysis whose recorded digest differs is stale."""
    c = fx._cells(spark, d).select("outcome", F.concat_ws(":", "study", *[F.col(x).cast("bigint").cast("string") for x in "abcd"]).alias("row"))
    return c.groupBy("outcome").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), "\n"), 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (flow_rows, bibliography_sets, sync_summary, fulltext_manifest, informed_opinions, suggestion_status, form_violations, study_suggestions, study_map, forest_rows, guardrails, input_digest)
}

_ONE = rec._R
ORACLE = {
    "study_map": """WITH m AS (SELECT DISTINCT run_id, started_at AS ts, n, trim(m.record_a) AS a, trim(m.record_b) AS b FROM (SELECT run_id, started_at, unnest(auto_merged) AS m, generate_subscripts(auto_merged, 1) - 1 AS n FROM dedup_runs)),
      g AS (SELECT 'std_' || a AS study, (ts, run_id || ':' || n) AS o, a, b FROM m WHERE a <> '' AND b <> '' AND a <> b), named AS (SELECT a AS report, study, o FROM g UNION ALL SELECT b, study, o FROM g),
      mine AS (SELECT report, arg_max(study, o) AS study, max(o) AS o FROM named GROUP BY report), last AS (SELECT study, max(o) AS last FROM g GROUP BY study)
      SELECT r.id AS report, CASE WHEN last <= o THEN mine.study ELSE 'std_' || regexp_replace(r.id, '^rpt_', '') END AS study FROM (SELECT DISTINCT id FROM records WHERE id IS NOT NULL) r LEFT JOIN mine ON mine.report = r.id LEFT JOIN last USING (study)""",
    "flow_rows": scr._STATE + """, r AS (SELECT count(*) AS n, count(DISTINCT id) AS u FROM records) SELECT 'identified' AS data, n FROM r UNION ALL SELECT 'duplicates', n - u FROM r
      UNION ALL SELECT 'screened', count(*) FROM st WHERE stage = 'title-abstract' UNION ALL SELECT 'excluded_on_title', count(*) FROM st WHERE stage = 'title-abstract' AND status = 'exclude'
      UNION ALL SELECT 'assessed', count(*) FROM st WHERE stage = 'full-text' UNION ALL SELECT 'excluded_on_text', count(*) FROM st WHERE stage = 'full-text' AND status = 'exclude'
      UNION ALL SELECT 'included', count(*) FROM st WHERE stage = 'full-text' AND status = 'include'""",
    "bibliography_sets": scr._STATE + f""", {_ONE}, x AS (SELECT record_id, 'included' AS "set" FROM st WHERE stage = 'full-text' AND status = 'include' AND record_id NOT IN (SELECT record_id FROM st WHERE stage = 'title-abstract' AND status = 'exclude')
      UNION ALL SELECT record_id, 'excluded-at-fulltext' FROM st WHERE stage = 'full-text' AND status = 'exclude' UNION ALL SELECT record_id, 'all-screened' FROM st WHERE stage = 'title-abstract' AND status <> 'unscreened')
      SELECT "set", count(*) AS records, count({rec._doi('doi')}) AS with_doi FROM x JOIN r ON r.id = record_id GROUP BY "set" """,
    "sync_summary": f"""WITH log AS (SELECT DISTINCT id, ev, ts, received_at, actor, stage, record_id, decision, criteria, criteria_version FROM screen_log), base AS (SELECT * FROM log WHERE received_at < TIMESTAMP '{scr.CUT}'),
      {scr._resolved('was', 'base')}, {scr._resolved('now_', 'log')} SELECT ev, count(*) AS n FROM log WHERE id NOT IN (SELECT id FROM base) GROUP BY ev
      UNION ALL SELECT 'changed decisions', count(*) FROM now_ JOIN was USING (stage, record_id) WHERE now_.decision <> was.decision""",
    "fulltext_manifest": f"""WITH {_ONE}, t AS (SELECT record_id, arg_max(tool, (imported_at, tool, row_no)) AS tool, arg_max(row_no, (imported_at, tool, row_no)) AS row_no FROM tool_decisions WHERE stage = 'full-text' GROUP BY record_id)
      SELECT coalesce('doi:' || {rec._doi('r.doi')}, 'rec:' || record_id) AS locator, record_id, tool, row_no FROM t LEFT JOIN r ON r.id = record_id""",
    "informed_opinions": f"WITH {scr._L}, {scr._FI}, n AS (SELECT stage, record_id, min(ts) AS seen FROM log WHERE ev = 'note' GROUP BY ALL) SELECT stage, record_id, actor FROM fi JOIN n USING (stage, record_id) WHERE ts >= seen",
    "suggestion_status": f"WITH {scr._L}, n AS (SELECT id AS suggestion, stage, record_id, ts AS made FROM log WHERE ev = 'note'), f AS (SELECT suggestion, arg_min(l.decision, (l.ts, l.id)) AS outcome FROM n JOIN log l ON l.ev = 'adjudicate' AND l.stage = n.stage AND l.record_id = n.record_id AND l.ts > made GROUP BY suggestion) SELECT suggestion, coalesce(outcome, 'pending') AS status FROM n LEFT JOIN f USING (suggestion)",
    "form_violations": """WITH e AS (SELECT DISTINCT ON (value_id) * FROM extraction_values), j AS (SELECT e.*, f.unit AS form_unit FROM e LEFT JOIN form_fields f USING (field)),
      c AS (SELECT field, unnest([CASE WHEN not_reported AND value IS NOT NULL THEN 'value-though-not-reported' END, CASE WHEN value < 0 THEN 'negative' END, CASE WHEN form_unit IS NULL AND unit IS NOT NULL THEN 'unit-of-a-count' END,
        CASE WHEN NOT not_reported AND value IS NULL AND entered IS NULL THEN 'no-value' END, CASE WHEN field = 'sample_size' AND value <> floor(value) THEN 'not-a-number-of-people' END]) AS code FROM j)
      SELECT field, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL""",
    "study_suggestions": f"""WITH RECURSIVE {_ONE}, f AS (SELECT id, nullif(regexp_extract(coalesce(title, ''), '^The ([A-Z]{{3,8}}) study', 1), '') AS registration, {rec._family('author[1].family')} AS fa, [coalesce(a.family, a.literal) for a in author] AS au, TRY_CAST(nullif(regexp_extract(abstract, '(\\d+) participants', 1), '') AS INT) AS ss FROM r),
      l AS (SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.registration = y.registration AND x.id < y.id UNION SELECT x.id, y.id FROM f x JOIN f y ON x.fa = y.fa AND x.ss = y.ss AND x.id < y.id AND len(list_intersect(x.au, y.au)) / least(len(x.au), len(y.au)) >= 0.5),
      e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w(id, g) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.id AND w.g < e.b) SELECT id, min(g) AS study FROM w GROUP BY id""",
    "forest_rows": fx._SUMS + " SELECT outcome, study, " + fx._r(yi="yi", lo="yi - 1.959963984540054::DOUBLE * sqrt(vi)", hi="yi + 1.959963984540054::DOUBLE * sqrt(vi)", weight="100 / vi / sw") + " FROM e JOIN s USING (outcome)",
    "guardrails": fx._SUMS + """, g AS (SELECT *, greatest(0, 100 * (greatest(0, q) - (k - 1)) / q) AS i2 FROM q) SELECT outcome, k, concat_ws(',', CASE WHEN k < 10 THEN 'few-studies-for-bias-tests' END, CASE WHEN i2 > 75 THEN 'high-heterogeneity' END,
      CASE WHEN i2 < 25 THEN 'low-heterogeneity' END, CASE WHEN k < 3 THEN 'no-prediction-interval' END, CASE WHEN abs(swy / sw) < 1.959963984540054::DOUBLE * sqrt(1 / sw) THEN 'interval-holds-zero' END) AS warnings FROM g""",
    "input_digest": fx._CELLS + ", x AS (SELECT outcome, concat_ws(':', study, a::BIGINT, b::BIGINT, c::BIGINT, d::BIGINT) AS row_ FROM cells) SELECT outcome, sha256(array_to_string(list_sort(list(row_)), chr(10))) AS digest FROM x GROUP BY outcome",
}
