"""Queries over the workflow of a review: queues, blinding, checks, migration, logs in order, identifiers, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisift.catalog import records as rec
from evisift.catalog import screening as scr
from evisift.operators import folds, review, screening
from evisift.plans.filterlang import where
from evisift.session import table

ACTOR = "rev-001"
WORDS = [("include", "include"), ("included", "include"), ("yes", "include"), ("exclude", "exclude"), ("excluded", "exclude"), ("no", "exclude"), ("maybe", "maybe")]
_WORDS_SQL = "(VALUES " + ", ".join(f"('{w}', '{x}')" for w, x in WORDS) + ") AS w(word, verdict)"
NOTES = ["id", "ev", "ts", "actor", "stage", "record_id", "decision", "criteria", "note"]


def rescreen_queue(spark, d):
    log = scr._rows(spark, d)
    return review.rescreen_queue(log, screening.assignment(log), scr._changes(spark), 4, ACTOR)


def blinded_view(spark, d):
    """Opinions of others that a reviewer may see, by stage: none on items that wait for their own."""
    log = scr._rows(spark, d)
    others = screening.opinions(log).where(F.col("actor") != ACTOR).select("stage", "record_id", "actor")
    return review.visible(others, log, screening.assignment(log), ACTOR).groupBy("stage").agg(F.count(F.lit(1)).alias("opinions"), F.count_distinct("record_id").alias("records"))


def adjudication_checks(spark, d):
    return review.adjudication_checks(table(spark, d, "screen_log").select(*NOTES))


def migrated_decisions(spark, d):
    """Rows of the tools' exports carried over or skipped, by reason; records that runs merged away lead to the record that took them up."""
    t = table(spark, d, "tool_decisions").select("tool", "row_no", "record_id", "stage", "decision")
    m = table(spark, d, "records").select(F.col("id").alias("canonical"), F.explode("meta.absorbed").alias("id")).where("id is not null").groupBy("id").agg(F.min("canonical").alias("canonical"))
    words = F.broadcast(spark.createDataFrame(WORDS, "word string, decision string"))
    out = review.migrated(t, table(spark, d, "records").where("id is not null"), m, words)
    return out.groupBy("tool", F.coalesce("skipped", F.lit("carried over")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("records"))


def retrieval_fold(spark, d):
    """Status of every record at full text by the tools' exports."""
    t = table(spark, d, "tool_decisions").where("stage = 'full-text' and record_id is not null")
    status = F.when(F.array_contains("reasons", "not retrievable"), "not-retrieved").when(F.lower(F.trim("decision")).rlike("^(includ|exclud|yes|no)"), "retrieved").when(F.trim(F.coalesce("decision", F.lit(""))) == "", "ill-requested").otherwise("sought")
    ev = t.select("record_id", status.alias("status"), F.array_min("reasons").alias("reason"), F.col("imported_at").alias("ts"), F.concat_ws(":", "tool", F.lpad(F.col("row_no").cast("string"), 12, "0"), "decision", "reviewer").alias("id"))
    reports = screening.opinions(scr._rows(spark, d)).where("stage = 'full-text'").select("record_id")
    return review.retrieval(ev, reports)


def split_suggestions(spark, d):
    t = table(spark, d, "records").dropDuplicates(["id"]).select("id", F.concat_ws(" ", "title", "abstract").alias("text"))
    extra = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("We ran "), F.get(F.array(*map(F.lit, ("two", "3", "Four independent", "many", "six randomised"))), (F.col("c_custkey") % 5).cast("int")), F.lit(" trials in all")).alias("text"))
    return review.split_suggestions(t.unionByName(extra))


def register_split(spark, d):
    s = table(spark, d, "records").dropDuplicates(["id"]).select("id", F.explode("meta.sources").alias("s")).select("id", F.when(F.col("s.row_no") % 7 == 0, " ICTRP").otherwise(F.col("s.db_name")).alias("name"))
    return s.groupBy(review.source_kind(F.col("name")).alias("kind")).agg(F.count_distinct("id").alias("records"), F.count(F.lit(1)).alias("sources"))


def timeline(spark, d):
    """The lines of one record's history as text, oldest first."""
    p = scr.provenance(spark, d)
    verb = F.when(F.col("ev") == "screen", F.concat(F.lit("said "), "decision")).when(F.col("ev") == "adjudicate", F.concat(F.lit("ruled "), "decision")).otherwise(F.col("ev"))
    return p.select("record_id", "id", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm"), "actor", verb, F.concat(F.lit("at "), "stage")).alias("line"))


def log_filter(spark, d):
    """Events of one actor at one stage that cite criteria, by day."""
    e = scr._log(spark, d).where(F.col("actor") == ACTOR).where("stage = 'title-abstract' and size(criteria) > 0")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def relink(spark, d):
    """Each actor's adjudications as a file in order of arrival, put in order of time."""
    e = table(spark, d, "screen_log").where("ev = 'adjudicate'").select(F.col("actor").alias("file"), F.struct("received_at", "id").alias("line"), "ts", "id")
    return review.relink_counts(e)


def relink_chain(spark, d):
    e = table(spark, d, "screen_log").where("ev = 'adjudicate' and actor is not null").select(F.col("actor").alias("file"), "ts", "id", F.coalesce("decision", F.lit("")).alias("body"))
    return review.relinked(e.dropDuplicates(["file", "id"])).groupBy("file").agg(F.max("seq").alias("events"), F.max_by("digest", "seq").alias("head"))


def next_ids(spark, d):
    return review.next_number(table(spark, d, "records").select(F.explode("meta.sources.import_id").alias("x")).unionAll(table(spark, d, "dedup_runs").select(F.col("run_id").alias("x"))), "x")


def derived_ids(spark, d):
    r = table(spark, d, "records").select("id").where("id is not null").distinct()
    e = review.derived_id(F.col("id"), "std")
    return r.select("id", review.derived_id(F.col("id"), "rpt").alias("report"), e.alias("study"), review.effect_id(e, F.length("id") * 7).alias("effect"))


def stored_identifiers(spark, d):
    r = table(spark, d, "records").dropDuplicates(["id"])
    return r.select("id", *review.identifiers(F.col("doi"), F.col("pmid"), F.concat(F.lit("pmc "), "pmid"), F.concat_ws("-", "volume", "issue")))


def author_text(spark, d):
    r = table(spark, d, "records").dropDuplicates(["id"])
    t = review.authors_text(F.col("author"))
    return r.select("id", t.alias("authors"), F.size(review.parsed_authors(t)).alias("parsed"), F.array_join(F.transform(review.parsed_authors(t), lambda a: F.coalesce(a["family"], a["literal"])), "|").alias("names"))


def page_ranges(spark, d):
    r = table(spark, d, "records").dropDuplicates(["id"])
    first, last = review.page_range(F.col("page"))
    return r.select("id", first.alias("first"), last.alias("last"), review.tex(F.col("title")).alias("tex"))


def bibtex_export(spark, d):
    r = table(spark, d, "records").dropDuplicates(["id"])
    first, last = review.page_range(F.col("page"))
    pages = F.when(last != "", F.concat(first, F.lit("--"), last)).otherwise(first)
    return r.select("id", review.bibtex(F.col("id"), F.col("rec_type"), {"title": F.col("title"), "journal": F.col("container_title"), "volume": F.col("volume"), "pages": pages, "doi": F.col("doi")}).alias("entry"))


def csl_export(spark, d):
    """Records as CSL-JSON objects of the fields that are there."""
    r = table(spark, d, "records").dropDuplicates(["id"])
    return r.select("id", F.to_json(F.struct(F.col("doi").alias("DOI"), F.col("id"), F.col("page"), "title", F.col("rec_type").alias("type"), "volume")).alias("json"))


def rounded_numbers(spark, d):
    e = table(spark, d, "extraction_values").where("value is not null").select("value_id", "value").distinct()
    return e.select("value_id", review.rounded12(F.col("value") / 3).alias("third"))


def value_source(spark, d):
    e = table(spark, d, "extraction_values").where("entered is not null").select("value_id", "entered", "source").distinct()
    value, source = review.value_and_source(F.concat_ws(" @ ", "entered", "source"))
    return e.select("value_id", value.alias("value"), source.alias("locator"))


def record_list(spark, d):
    return review.record_list(table(spark, d, "records"))


def filter_record_fields(spark, d):
    """A filter over the named fields of records, order comparisons strict; the year is known of all rows that are compared."""
    r = review.record_fields(table(spark, d, "records").dropDuplicates(["id"]).where("get(get(issued.date_parts, 0), 0) is not null"))
    return where(r, "via == 'search' and year >= 2010 and (title contains 'trial' or authors contains 'Doe') and not journal == ''", lenient=False).select("id", "year", "via")


QUERIES = {
    f.__name__: f
    for f in (
        rescreen_queue, blinded_view, adjudication_checks, migrated_decisions, retrieval_fold, split_suggestions, register_split, timeline, log_filter, relink, relink_chain, next_ids, derived_ids,
        stored_identifiers, author_text, page_ranges, bibtex_export, csl_export, rounded_numbers, value_source, record_list, filter_record_fields,
    )
}

_ONE = "r AS (SELECT DISTINCT ON (id) * FROM records WHERE id IS NOT NULL)"
_FIRST = "trim(coalesce(regexp_split_to_array(trim(coalesce(page, '')), '\\s*[-–—]+\\s*')[1], ''))"
_LAST = "trim(coalesce(array_to_string(regexp_split_to_array(trim(coalesce(page, '')), '\\s*[-–—]+\\s*')[2:], '-'), ''))"


def _tex(c: str) -> str:
    out = f"replace({c}, '\\', chr(1))"
    for x in "{}&%$#_":
        out = f"replace({out}, '{x}', '\\{x}')"
    return f"replace(replace(replace({out}, '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}'), chr(1), '\\textbackslash{{}}')"


def _line(name: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '  {name} = {{' || {_tex(c)} || '}}' END"


ORACLE = {
    "rescreen_queue": f"WITH {scr._L}, {scr._CH}, {scr._OP}, {scr._FI}, {scr._AS}, own AS (SELECT stage, record_id, decision, criteria AS cited, criteria_version AS version FROM op SEMI JOIN asg USING (stage, record_id, actor) WHERE actor = '{ACTOR}'), {scr._stale('s0', 'own', 'ch', 4)} SELECT * FROM s0",
    "blinded_view": f"WITH {scr._L}, {scr._OP}, {scr._FI}, {scr._AS}, q AS (SELECT stage, record_id FROM asg ANTI JOIN op USING (stage, record_id, actor) WHERE actor = '{ACTOR}') SELECT stage, count(*) AS opinions, count(DISTINCT record_id) AS records FROM op ANTI JOIN q USING (stage, record_id) WHERE actor <> '{ACTOR}' GROUP BY stage",
    "adjudication_checks": """WITH log AS (SELECT DISTINCT id, ev, ts, actor, stage, record_id, decision, criteria, note FROM screen_log), a AS (SELECT * FROM log WHERE ev = 'adjudicate'),
      b AS (SELECT a.id, o.actor, arg_max(o.decision, (o.ts, o.id)) AS decision, arg_max(o.id, (o.ts, o.id)) AS opinion FROM a JOIN log o ON o.ev = 'screen' AND o.stage = a.stage AND o.record_id = a.record_id AND o.ts < a.ts GROUP BY ALL),
      p AS (SELECT id, array_to_string(list_sort(list(opinion)), ',') AS supersedes, list(actor) AS actors, count(DISTINCT decision) AS kinds, count(*) FILTER (decision = 'maybe') AS maybes FROM b GROUP BY id)
      SELECT a.id, coalesce(supersedes, '') AS supersedes, coalesce(list_contains(actors, a.actor), false) AS own_conflict, concat_ws(',', CASE WHEN coalesce(kinds, 0) < 2 AND coalesce(maybes, 0) = 0 THEN 'no-conflict' END,
        CASE WHEN stage = 'full-text' AND decision = 'exclude' AND coalesce(len(criteria), 0) = 0 THEN 'full-text-exclusion-needs-reason' END, CASE WHEN trim(coalesce(note, '')) = '' THEN 'no-rationale' END) AS problems FROM a LEFT JOIN p USING (id)""",
    "migrated_decisions": f"""WITH t AS (SELECT tool, row_no, min(struct_pack(a := coalesce(record_id, ''), b := coalesce(stage, ''), c := coalesce(decision, ''))) AS x FROM tool_decisions GROUP BY ALL), m AS (SELECT id, min(canonical) AS canonical FROM (SELECT id AS canonical, unnest(meta.absorbed) AS id FROM records) WHERE id IS NOT NULL GROUP BY id),
      g AS (SELECT tool, row_no, trim(x.a) AS given, lower(trim(x.c)) AS word FROM t), j AS (SELECT g.*, coalesce(m.canonical, given) AS record_id FROM g LEFT JOIN m ON m.id = given),
      k AS (SELECT j.*, verdict, record_id IN (SELECT id FROM records WHERE id IS NOT NULL) AS there FROM j LEFT JOIN {_WORDS_SQL} ON w.word = j.word)
      SELECT tool, CASE WHEN coalesce(given, '') = '' THEN 'no record' WHEN NOT coalesce(there, false) THEN 'unknown record' WHEN coalesce(word, '') = '' THEN 'no decision' WHEN verdict IS NULL THEN 'unknown decision' ELSE 'carried over' END AS outcome, count(*) AS n, count(DISTINCT record_id) AS records FROM k GROUP BY ALL""",
    "retrieval_fold": f"""WITH {scr._L}, {scr._OP}, t AS (SELECT record_id, CASE WHEN list_contains(reasons, 'not retrievable') THEN 'not-retrieved' WHEN regexp_matches(lower(trim(decision)), '^(includ|exclud|yes|no)') THEN 'retrieved' WHEN trim(coalesce(decision, '')) = '' THEN 'ill-requested' ELSE 'sought' END AS status,
        list_min(reasons) AS reason, imported_at AS ts, concat_ws(':', tool, lpad(row_no::VARCHAR, 12, '0'), decision, reviewer) AS id FROM tool_decisions WHERE stage = 'full-text' AND record_id IS NOT NULL), l AS (SELECT DISTINCT ON (record_id) * FROM t ORDER BY record_id, ts DESC, id DESC)
      SELECT record_id, coalesce(status, 'sought') AS status, reason, coalesce(status, 'sought') IN ('sought', 'ill-requested') AS outstanding FROM (SELECT DISTINCT record_id FROM op WHERE stage = 'full-text') LEFT JOIN l USING (record_id)""",
    "split_suggestions": f"""WITH {_ONE}, t AS (SELECT id, concat_ws(' ', title, abstract) AS text FROM r UNION ALL SELECT c_custkey::VARCHAR, 'We ran ' || ['two', '3', 'Four independent', 'many', 'six randomised'][1 + c_custkey % 5] || ' trials in all' FROM customer),
      x AS (SELECT id, regexp_extract(text, '(?i)\\b(two|three|four|five|six|[2-6])\\s+(?:independent\\s+|separate\\s+|randomi[sz]ed\\s+)?(?:experiments|studies|trials|samples|cohorts)\\b', ['w'], '') AS g, regexp_extract(text, '(?i)\\b(two|three|four|five|six|[2-6])\\s+(?:independent\\s+|separate\\s+|randomi[sz]ed\\s+)?(?:experiments|studies|trials|samples|cohorts)\\b') AS evidence FROM t)
      SELECT id, CASE lower(g.w) WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 WHEN 'six' THEN 6 ELSE TRY_CAST(g.w AS INT) END AS parts, evidence FROM x WHERE evidence <> ''""",
    "register_split": f"""WITH {_ONE}, s AS (SELECT id, unnest(meta.sources) AS s FROM r), n AS (SELECT id, CASE WHEN s.row_no % 7 = 0 THEN ' ICTRP' ELSE s.db_name END AS name FROM s)
      SELECT CASE WHEN lower(trim(name)) = 'ictrp' THEN 'register' ELSE 'database' END AS kind, count(DISTINCT id) AS records, count(*) AS sources FROM n GROUP BY ALL""",
    "timeline": f"WITH {scr._L}, one AS (SELECT record_id FROM log GROUP BY record_id ORDER BY count(*) DESC, record_id LIMIT 1) SELECT record_id, id, concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M'), actor, CASE ev WHEN 'screen' THEN 'said ' || coalesce(decision, '') WHEN 'adjudicate' THEN 'ruled ' || coalesce(decision, '') ELSE ev END, 'at ' || stage) AS line FROM log SEMI JOIN one USING (record_id)",
    "log_filter": f"WITH {scr._L} SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM log WHERE actor = '{ACTOR}' AND stage = 'title-abstract' AND len(criteria) > 0 GROUP BY ALL",
    "relink": """WITH e AS (SELECT actor AS file, received_at, ts, id FROM screen_log WHERE ev = 'adjudicate'), w AS (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY received_at, id) AS pos FROM e), n AS (SELECT file, id AS new, row_number() OVER (PARTITION BY file ORDER BY ts, id, received_at) AS pos FROM e)
      SELECT file, count(DISTINCT id) AS kept, count(*) - count(DISTINCT id) AS dropped, count(*) FILTER (id <> new) AS reordered FROM w JOIN n USING (file, pos) GROUP BY file""",
    "relink_chain": """WITH RECURSIVE e AS (SELECT DISTINCT actor AS file, ts, id, coalesce(decision, '') AS body FROM screen_log WHERE ev = 'adjudicate' AND actor IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, id) AS seq FROM e),
      c AS (SELECT file, seq, sha256(seq || '|' || id || '|' || body || '|') AS digest FROM o WHERE seq = 1 UNION ALL SELECT o.file, o.seq, sha256(o.seq || '|' || o.id || '|' || o.body || '|' || c.digest) FROM c JOIN o ON o.file = c.file AND o.seq = c.seq + 1)
      SELECT file, CAST(max(seq) AS INT) AS events, arg_max(digest, seq) AS head FROM c GROUP BY file""",
    "next_ids": "WITH x AS (SELECT s.import_id AS x FROM (SELECT unnest(meta.sources) AS s FROM records) UNION ALL SELECT run_id FROM dedup_runs), p AS (SELECT regexp_extract(x, '^(.*?)(\\d+)$', 1) AS prefix, TRY_CAST(regexp_extract(x, '^(.*?)(\\d+)$', 2) AS BIGINT) AS n FROM x) SELECT prefix, max(n) + 1 AS next FROM p WHERE n IS NOT NULL GROUP BY prefix",
    "derived_ids": "WITH r AS (SELECT DISTINCT id FROM records WHERE id IS NOT NULL), s AS (SELECT id, CASE WHEN regexp_matches(id, '^(rec|rpt|std)_[0-9a-z]{16}$') THEN id[5:] END AS s FROM r) SELECT id, 'rpt_' || s AS report, 'std_' || s AS study, 'eff_' || s || '_' || lpad((length(id) * 7)::VARCHAR, 4, '0') AS effect FROM s",
    "stored_identifiers": f"WITH {_ONE} SELECT id, coalesce({rec._doi('doi')}, doi) AS doi, coalesce(nullif(regexp_replace(pmid, '\\D', '', 'g'), ''), pmid) AS pmid, coalesce('PMC' || nullif(regexp_replace(pmid, '\\D', '', 'g'), ''), 'pmc ' || pmid) AS pmcid, coalesce(nullif(regexp_replace(concat_ws('-', volume, issue), '\\D', '', 'g'), ''), concat_ws('-', volume, issue)) AS isbn FROM r",
    "author_text": f"""WITH {_ONE}, n AS (SELECT id, author, [x for x in [CASE WHEN a.family IS NOT NULL THEN concat_ws(', ', nullif(trim(a.family), ''), nullif(trim(a.given), '')) ELSE trim(a.literal) END for a in author] if x <> ''] AS names FROM r)
      SELECT id, array_to_string(names, '; ') AS authors, len(names) AS parsed, array_to_string([CASE WHEN contains(x, ',') THEN split_part(x, ',', 1) ELSE x END for x in names], '|') AS names FROM n""",
    "page_ranges": f"WITH {_ONE} SELECT id, {_FIRST} AS first, {_LAST} AS last, {_tex('title')} AS tex FROM r",
    "bibtex_export": f"""WITH {_ONE}, p AS (SELECT *, {_FIRST} AS pf, {_LAST} AS pl FROM r), q AS (SELECT *, CASE WHEN pl <> '' THEN pf || '--' || pl ELSE pf END AS pages FROM p)
      SELECT id, '@' || coalesce(CASE rec_type WHEN 'article-journal' THEN 'article' WHEN 'book' THEN 'book' WHEN 'chapter' THEN 'incollection' WHEN 'paper-conference' THEN 'inproceedings' WHEN 'report' THEN 'techreport' WHEN 'thesis' THEN 'phdthesis' END, 'misc') || '{{' || id || ',' || chr(10)
        || concat_ws(',' || chr(10), {_line('title', 'title')}, {_line('journal', 'container_title')}, {_line('volume', 'volume')}, {_line('pages', 'pages')}, {_line('doi', 'doi')}) || chr(10) || '}}' || chr(10) AS entry FROM q""",
    "rounded_numbers": "SELECT DISTINCT value_id, printf('%.11e', value / 3)::DOUBLE AS third FROM extraction_values WHERE value IS NOT NULL",
    "value_source": "WITH e AS (SELECT DISTINCT value_id, entered, source FROM extraction_values WHERE entered IS NOT NULL) SELECT value_id, trim(entered) AS value, nullif(trim(source), '') AS locator FROM e",
    "record_list": f"WITH r AS (SELECT DISTINCT ON (id) * FROM records WHERE coalesce(meta.canonical, true)) SELECT id, issued.date_parts[1][1] AS year, coalesce(author[1].family, author[1].literal, '') AS first_author, regexp_replace(coalesce(title, ''), '[\\t\\r\\n]', ' ', 'g') AS title, coalesce(container_title, '') AS journal, coalesce(doi, '') AS doi FROM r",
    "filter_record_fields": f"WITH {_ONE} SELECT id, issued.date_parts[1][1] AS year, meta.sources[1].via AS via FROM r WHERE meta.sources[1].via = 'search' AND issued.date_parts[1][1] >= 2010 AND (contains(lower(coalesce(title, '')), 'trial') OR list_contains([a.family for a in author], 'Doe')) AND coalesce(container_title, '') <> ''",
}
