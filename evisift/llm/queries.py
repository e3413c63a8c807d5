"""Queries of the subpackage; ``__spark_entry__`` adds them if it can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.neardup import near_duplicate_pairs

    return near_duplicate_pairs(table(spark, d, "records"))


def _opinions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "screen_log"), table(spark, d, "tool_decisions")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.consensus import consensus

    return consensus(*_opinions(spark, d)).select("record_id", "stage", "decision")


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.consensus import consensus

    return consensus(*_opinions(spark, d)).groupBy("stage").agg(
        F.count(F.lit(1)).alias("items"), F.avg("agreement").alias("pairwise_agreement"), F.avg("support").alias("mean_support"), F.avg("reviewers").alias("mean_reviewers")
    )


def p2_votes(spark: SparkSession, d: str) -> DataFrame:
    """What each item's reviewers said, before any estimation: opinions, decided votes, the share of pairs of them that agree, the standing adjudication."""
    from evisift.llm.consensus import item_votes

    pairs = (F.col("yes") + F.col("no")) * (F.col("yes") + F.col("no") - 1) / 2
    same = (F.col("yes") * (F.col("yes") - 1) + F.col("no") * (F.col("no") - 1)) / 2
    items = item_votes(*_opinions(spark, d)).where("n >= 2")
    return items.select("record_id", "stage", F.col("n").cast("bigint").alias("reviewers"), F.col("yes").cast("bigint").alias("yes"), F.col("no").cast("bigint").alias("no"), F.bround(F.try_divide(same, pairs), 6).alias("agreement"), F.when(F.col("known") == 1, "include").when(F.col("known") == 0, "exclude").alias("adjudicated"))


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.consensus import reliability

    return reliability(*_opinions(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.survivor import survivors

    return survivors(table(spark, d, "records"), table(spark, d, "amendments"), table(spark, d, "source_trust"))


def p4_fused(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.survivor import fused_records

    return fused_records(table(spark, d, "records"), table(spark, d, "source_trust"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.components import grouped_pairs

    queued = table(spark, d, "review_candidates").select("record_a", "record_b")
    merged = table(spark, d, "dedup_runs").select(F.explode("auto_merged").alias("m")).select("m.record_a", "m.record_b")
    return grouped_pairs(queued.unionByName(merged), "record_a", "record_b")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.tokenizer import encode_texts

    return encode_texts(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from evisift.llm.reading import reading_levels

    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "level_name")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_agreement": p2_agreement, "p2_votes": p2_votes, "p2_reliability": p2_reliability, "p4_found": p4_found, "p4_fused": p4_fused, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

_VOTE = r"CASE WHEN regexp_matches(lower(trim(decision)), '^(includ|yes\b|accept|relevant\b)') THEN 1 WHEN regexp_matches(lower(trim(decision)), '^(exclud|no$|reject|irrelevant\b|not relevant\b)') THEN 0 WHEN regexp_matches(lower(trim(decision)), '^(maybe|unsure|unclear|undecided|second opinion|\?+$)') THEN 2 END"


def _who(c: str) -> str:
    number = rf"regexp_extract(lower(trim({c})), '^(?:rev|reviewer)[\s_.-]*0*(\d+)$', 1)"
    return f"nullif(CASE WHEN {number} <> '' THEN 'rev-' || lpad({number}, greatest(length({number}), 3)::INT, '0') ELSE lower(trim({c})) END, '')"


ORACLE = {
    "p2_votes": f"""
        WITH e AS (SELECT record_id, stage, CASE WHEN ev = 'screen' THEN {_who('actor')} ELSE '' END AS who, {_VOTE} AS v, ts, id FROM screen_log WHERE ev IN ('screen', 'adjudicate')
          UNION ALL SELECT record_id, stage, {_who('reviewer')}, {_VOTE}, imported_at, tool || ':' || row_no FROM tool_decisions),
        l AS (SELECT record_id, stage, who, arg_max(v, (ts, id, v)) AS v FROM e WHERE record_id IS NOT NULL AND stage IS NOT NULL AND who IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
        i AS (SELECT record_id, stage, count(*) FILTER (who <> '') AS n, count(*) FILTER (who <> '' AND v = 1) AS yes, count(*) FILTER (who <> '' AND v = 0) AS no, max(v) FILTER (who = '') AS known FROM l GROUP BY ALL)
        SELECT record_id, stage, n AS reviewers, yes, no, round_even((yes * (yes - 1) + no * (no - 1)) / nullif((yes + no) * (yes + no - 1), 0), 6) AS agreement, CASE known WHEN 1 THEN 'include' WHEN 0 THEN 'exclude' END AS adjudicated FROM i WHERE n >= 2""",
    "p5_found": r"""
        WITH RECURSIVE raw AS (
          SELECT record_a AS a, record_b AS b FROM review_candidates
          UNION ALL SELECT m.record_a, m.record_b FROM (SELECT unnest(auto_merged) AS m FROM dedup_runs)),
        c AS (SELECT lower(trim(a)) AS a, lower(trim(b)) AS b FROM raw),
        e AS (SELECT DISTINCT a, b FROM c WHERE a <> '' AND b <> '' AND a <> b),
        e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(id, g) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT e2.b, r.g FROM r JOIN e2 ON e2.a = r.id AND r.g < e2.b)
        SELECT id AS record_id, min(g) AS group_id FROM r GROUP BY id""",
}
