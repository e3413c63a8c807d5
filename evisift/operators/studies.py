"""Studies made of reports: the fold of group and split events, and suggestions for grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.operators.linkage import cluster


def study_map(events: DataFrame, reports: DataFrame) -> DataFrame:
    """``(report, study)`` after all events, in the order of (ts, id).

    events: ev ('study-group' with study and reports, 'study-split' with report and studies), id, ts; repeated ids count once. reports: report. A report is alone
    in a study named after it until an event names it. What holds for a report follows from its last split and what came later: as long as it is named only for
    studies of that split that have not been regrouped without it, it keeps what is left of the split; once it is named for any other study, it belongs to the study it
    was named for last, unless that study was regrouped without it since. With nothing left it is alone again. Events about other reports are ignored; null names nothing.
    """
    o = F.struct("ts", "id").alias("o")
    known = reports.select("report").where("report is not null").distinct()
    e = events.dropDuplicates(["id"])
    grouped = e.where("ev = 'study-group' and study is not null").select("study", "reports", o)
    named = grouped.select("study", "o", F.explode(F.array_distinct("reports")).alias("report")).join(known, "report", "left_semi")
    split = e.where("ev = 'study-split'").select("report", "studies", o).join(known, "report", "left_semi")
    split = split.groupBy("report").agg(F.max_by("studies", "o").alias("studies"), F.max("o").alias("since"))
    part = split.select("report", "since", F.explode(F.array_distinct("studies")).alias("study"))
    # regroupings of a part of the split that leave the report out
    left_out = grouped.select("study", "o", "reports").join(part, "study").where("o > since and not coalesce(array_contains(reports, report), false)")
    part = part.join(left_out.groupBy("report", "study").agg(F.min("o").alias("dropped")), ["report", "study"], "left").select("report", "study", "dropped")
    later = named.join(split.select("report", "since"), "report", "left").where("since is null or o > since").join(part.withColumn("of_split", F.lit(True)), ["report", "study"], "left")
    moved = later.groupBy("report").agg(F.max(F.coalesce(F.col("of_split") & (F.col("dropped").isNull() | (F.col("dropped") > F.col("o"))), F.lit(False)) == F.lit(False)).alias("moved"), F.max_by("study", "o").alias("study"), F.max("o").alias("o")).where("moved")
    last = grouped.groupBy("study").agg(F.max("o").alias("last"))
    single = moved.join(last, "study").where("last <= o").select("report", "study")
    kept = part.where("dropped is null").join(moved.select("report"), "report", "left_anti").select("report", "study")
    found = single.unionByName(kept)
    alone = known.join(found.select("report").distinct(), "report", "left_anti").select("report", F.concat(F.lit("std_"), F.regexp_replace("report", "^rpt_", "")).alias("study"))
    return found.unionByName(alone)


def suggestions(facts: DataFrame) -> DataFrame:
    """``(id, study)`` groups of reports that probably tell of one study: a shared registration is enough; otherwise the same first author with
    half of the smaller author set in common and a shared sample size. Pairs form within a registration or within author and sample size.

    facts: id, registration, first_author, authors, sample_size.
    """
    side = lambda k: facts.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "registration", "first_author", "authors", "sample_size")])
    a, b = side("a"), side("b")
    same = a.join(b, (F.col("registration_a") == F.col("registration_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    near = a.join(b, (F.col("first_author_a") == F.col("first_author_b")) & (F.col("sample_size_a") == F.col("sample_size_b")) & (F.col("id_a") < F.col("id_b")))
    common = F.size(F.array_intersect("authors_a", "authors_b")) / F.least(F.size("authors_a"), F.size("authors_b"))
    near = near.where(common >= 0.5).select("id_a", "id_b")
    return cluster(same.union(near).distinct(), "id_a", "id_b").select("id", F.col("cluster").alias("study"))
