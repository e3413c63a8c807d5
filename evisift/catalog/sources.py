"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisift.catalog import records as rec
from evisift.functions import text
from evisift.sources import readers
from evisift.session import table


def _plain(spark, d):
    r = table(spark, d, "records").dropDuplicates(["id"]).where("title is not null and trim(title) <> ''")
    return r.select("id", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.expr("transform(author, a -> coalesce(a.family, a.literal))").alias("families"), F.expr("get(get(issued.date_parts, 0), 0)").alias("year"), F.col("container_title").alias("journal"), "volume", "page", "doi")


def roundtrip_ris(spark, d):
    """Records written as RIS, a file a record, and read again."""
    files = _plain(spark, d).select(F.concat(F.col("id"), F.lit(".ris")).alias("path"), readers.ris_text().cast("binary").alias("content"))
    p = readers.parse_files(files).where("error is null")
    return p.select(F.regexp_replace("file", r"\.ris$", "").alias("id"), "journal", "volume", "page", "doi", F.size("authors").alias("n_authors"))


def import_manifest(spark, d):
    """Rows read, rejected, added and appended if the records of one half came as files and those of the other were there before."""
    r = table(spark, d, "records").dropDuplicates(["id"]).select("id", "title", text.normal_doi(F.col("doi")).alias("key")).withColumn("half", F.substring("id", -1, 1) < "g")
    parsed = r.where("half").select("key", F.col("id").alias("file"), F.when(F.col("title").isNull() | (F.trim("title") == ""), "no title").alias("error"))
    there = r.where("not half and key is not null").select("key")
    actions = readers.import_records(parsed.where("key is not null"), there).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    counts = parsed.agg(F.count(F.lit(1)).alias("read"), F.count("error").alias("rejected"))
    return actions.unionByName(counts.select(F.explode(F.array(F.struct(F.lit("read").alias("action"), F.col("read").alias("n")), F.struct(F.lit("rejected").alias("action"), F.col("rejected").alias("n")))).alias("x")).select("x.action", "x.n"))


def canonical_json(spark, d):
    return readers.canonical_json(table(spark, d, "nation"))


def json_props(spark, d):
    return table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def stream_latest_state(spark, d):
    from evisift.streaming import folds

    s = folds.stream(spark, f"{d}/events.parquet")
    return folds.run_available(folds.latest_state(s, ["user_id", "event_type"], ["event_id", "value"], ["ts", "event_id"]), "latest", "update", ["user_id", "event_type"])


def stream_sessions(spark, d):
    """Sessions of each user so far, the open ones too."""
    from evisift.streaming import folds

    e = folds.stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return folds.run_available(folds.sessions(e, "ts", "user_id", "6 hours"), "sessions").select("user_id", "start", "n")


def stream_dedup(spark, d):
    """Events that arrive twice count once."""
    from evisift.streaming import folds

    e = lambda: folds.stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return folds.run_available(folds.deduplicated(e().union(e()), "ts", "event_id", "4000 days"), "dedup", "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def stream_transitions(spark, d):
    """Changes of the kind of event of each user."""
    from evisift.streaming import folds

    e = folds.stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type")
    t = folds.run_available(folds.transitions(e, "user_id", "event_type", ["ts", "event_id"]), "transitions", "append")
    return t.groupBy(F.coalesce("before", F.lit("none")).alias("before"), "after").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


def stream_windows(spark, d):
    from evisift.streaming import folds

    e = folds.stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return folds.run_available(folds.windowed_counts(e, "ts", "event_type", "1 day"), "windows", "complete")


QUERIES = {f.__name__: f for f in (roundtrip_ris, import_manifest, canonical_json, json_props, stream_latest_state, stream_sessions, stream_dedup, stream_transitions, stream_windows)}

_R = "r AS (SELECT DISTINCT ON (id) * FROM records)"
ORACLE = {
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "stream_transitions": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
      SELECT coalesce(before, 'none') AS before, event_type AS after, count(*) AS n, max(event_id) AS last_event FROM e WHERE before IS DISTINCT FROM event_type GROUP BY ALL""",
    "import_manifest": f"""WITH r AS (SELECT DISTINCT ON (id) id, title, {rec._doi('doi')} AS key, right(id, 1) < 'g' AS half FROM records), p AS (SELECT * FROM r WHERE half), k AS (SELECT DISTINCT key FROM p WHERE key IS NOT NULL AND trim(coalesce(title, '')) <> '')
      SELECT CASE WHEN key IN (SELECT key FROM r WHERE NOT half AND key IS NOT NULL) THEN 'append' ELSE 'add' END AS action, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'read', count(*) FROM p UNION ALL SELECT 'rejected', count(*) FILTER (trim(coalesce(title, '')) = '') FROM p""",
    "roundtrip_ris": f"WITH {_R} SELECT id, container_title AS journal, nullif(volume, '') AS volume, nullif(page, '') AS page, nullif(doi, '') AS doi, CAST(coalesce(len([a for a in author if coalesce(a.family, a.literal) IS NOT NULL]), 0) AS INT) AS n_authors FROM r WHERE trim(coalesce(title, '')) <> ''",
    "canonical_json": "SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation",
    "json_props": "SELECT event_type, count(CAST(json_extract(props, '$.k') AS INT)) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "stream_latest_state": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "stream_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
}
