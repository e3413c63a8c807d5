"""Screening states, agreement between reviewers, criteria and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.operators.folds import first_write, last_write

STAGES = ("title-abstract", "full-text")


def opinions(log: DataFrame) -> DataFrame:
    """The latest opinion of each actor on an item."""
    return last_write(log.where("ev = 'screen'").select("stage", "record_id", "actor", "decision", "criteria", "criteria_version", "ts", "id"), ["stage", "record_id", "actor"])


def first_opinions(log: DataFrame) -> DataFrame:
    return first_write(log.where("ev = 'screen'").select("stage", "record_id", "actor", "decision", "ts", "id"), ["stage", "record_id", "actor"])


def adjudications(log: DataFrame) -> DataFrame:
    return last_write(log.where("ev = 'adjudicate'").select("stage", "record_id", F.col("decision").alias("adjudicated"), "criteria", "criteria_version", "ts", "id"), ["stage", "record_id"])


def assignment(log: DataFrame, reviewers: int = 2) -> DataFrame:
    """Where the log has no assign events: the first ``reviewers`` actors of an item."""
    first = first_opinions(log).groupBy("stage", "record_id").agg(F.array_sort(F.collect_set(F.struct("ts", "id", "actor"))).alias("a"))
    return first.select("stage", "record_id", F.explode(F.slice("a", 1, reviewers)).alias("x")).select("stage", "record_id", "x.actor")


def states(log: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(stage, record_id, status, n_assigned, n_opinions)`` of every assigned item.

    A standing adjudication decides. Otherwise without an opinion of an assigned actor 'unscreened', with fewer than assigned
    'partial', with a maybe or different decisions 'conflict', else the common decision. Opinions of others do not count.
    """
    o = assigned.join(opinions(log).select("stage", "record_id", "actor", "decision"), ["stage", "record_id", "actor"], "left")
    per = o.groupBy("stage", "record_id").agg(
        F.count(F.lit(1)).alias("n_assigned"), F.count("decision").alias("n_opinions"), F.count_distinct("decision").alias("kinds"),
        F.max("decision").alias("one"), F.count(F.when(F.col("decision") == "maybe", 1)).alias("maybes"),
    )
    j = per.join(adjudications(log).select("stage", "record_id", "adjudicated"), ["stage", "record_id"], "left")
    status = (
        F.when(F.col("adjudicated").isNotNull(), F.col("adjudicated"))
        .when(F.col("n_opinions") == 0, "unscreened")
        .when(F.col("n_opinions") < F.col("n_assigned"), "partial")
        .when((F.col("maybes") > 0) | (F.col("kinds") > 1), "conflict")
        .otherwise(F.col("one"))
    )
    return j.select("stage", "record_id", status.alias("status"), "n_assigned", "n_opinions")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("stage").agg(
        F.count(F.lit(1)).alias("items"),
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("include", "exclude", "conflict", "partial", "unscreened")],
    )


def conflicts(log: DataFrame, assigned: DataFrame) -> DataFrame:
    """Conflicting items with who said what, all criteria cited, and when the first opinion was given."""
    c = states(log, assigned).where("status = 'conflict'").select("stage", "record_id")
    o = assigned.join(opinions(log), ["stage", "record_id", "actor"]).join(c, ["stage", "record_id"])
    return o.groupBy("stage", "record_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "actor", "decision"))), ";").alias("said"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("criteria")))), ",").alias("cited"),
        F.min("ts").alias("first_seen"),
    )


def queue(log: DataFrame, assigned: DataFrame, actor: str) -> DataFrame:
    """Items assigned to an actor who has not given an opinion on them."""
    mine = assigned.where(F.col("actor") == actor).select("stage", "record_id")
    return mine.join(opinions(log).where(F.col("actor") == actor).select("stage", "record_id"), ["stage", "record_id"], "left_anti")


def kappa_columns(yes_yes: Column, yes_no: Column, no_yes: Column, no_no: Column) -> list[Column]:
    """Raw agreement, Cohen's kappa (null where chance agreement is complete) and PABAK, rounded half to even at six places."""
    n = yes_yes + yes_no + no_yes + no_no
    po = (yes_yes + no_no) / n
    pe = ((yes_yes + yes_no) * (yes_yes + no_yes) + (no_yes + no_no) * (yes_no + no_no)) / (n * n)
    return [F.bround(po, 6).alias("agreement"), F.bround(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"), F.bround(2 * po - 1, 6).alias("pabak")]


def agreement(log: DataFrame) -> DataFrame:
    """Cohen's kappa of every pair of actors per stage over their first opinions; items with a maybe are left out and counted.

    Pairs form within an item, whose actors are few (60 in all), not within a stage.
    """
    o = first_opinions(log).select("stage", "record_id", "actor", "decision")
    a, b = o.withColumnsRenamed({"actor": "actor_a", "decision": "da"}), o.withColumnsRenamed({"actor": "actor_b", "decision": "db"})
    j = a.join(b, ["stage", "record_id"]).where("actor_a < actor_b")
    cell = lambda x, y: F.count(F.when((F.col("da") == x) & (F.col("db") == y), 1))
    g = j.groupBy("stage", "actor_a", "actor_b").agg(
        cell("include", "include").alias("yy"), cell("include", "exclude").alias("yn"), cell("exclude", "include").alias("ny"), cell("exclude", "exclude").alias("nn"),
        F.count(F.when((F.col("da") == "maybe") | (F.col("db") == "maybe"), 1)).alias("maybes"),
    )
    return g.where("yy + yn + ny + nn > 0").select("stage", "actor_a", "actor_b", (F.col("yy") + F.col("yn") + F.col("ny") + F.col("nn")).alias("n"), "maybes", *kappa_columns(*map(F.col, ("yy", "yn", "ny", "nn"))))


def effective_direction(kind: Column, direction: Column) -> Column:
    """What a change of a criterion means: adding one tightens, retiring one loosens, else as declared."""
    return F.when(kind == "added", "tightened").when(kind == "retired", "loosened").otherwise(direction)


def stale(decided: DataFrame, changes: DataFrame, current: int) -> DataFrame:
    """``(stage, record_id, reason, causes)`` of decisions that later changes of criteria put in doubt.

    decided: stage, record_id, decision, cited (array), version. changes (a few rows; broadcast after Spark has checked their size): criterion, kind,
    direction, to_version, stages (array). An include is touched by tightening, an exclude by loosening of a criterion it cites, a maybe by any but editorial changes.
    Of several reasons the one of a change in both directions comes first, then that of an added (include) or retired (exclude) criterion; a maybe's is always 'maybe-any-change'.
    """
    c = changes.select("criterion", "kind", effective_direction(F.col("kind"), F.col("direction")).alias("d"), "to_version", "stages").where((F.col("to_version") <= current) & (F.col("d") != "editorial"))
    hit = (
        ((F.col("decision") == "include") & F.col("d").isin("tightened", "both"))
        | ((F.col("decision") == "exclude") & F.col("d").isin("loosened", "both") & F.array_contains("cited", F.col("criterion")))
        | (F.col("decision") == "maybe")
    )
    j = decided.join(c, (F.col("to_version") > F.col("version")) & F.expr("array_contains(stages, stage)") & hit)
    origin = F.when(F.col("decision") == "include", F.col("kind") == "added").otherwise(F.col("kind") == "retired")
    rank = F.when(F.col("d") == "both", 0).when(origin, 1).otherwise(2)
    name = (
        F.when(F.col("decision") == "maybe", "maybe-any-change").when(F.col("d") == "both", "criterion-both")
        .when(origin, F.concat(F.lit("criterion-"), F.col("kind"))).otherwise(F.when(F.col("decision") == "include", "criterion-tightened").otherwise("criterion-loosened"))
    )
    g = j.groupBy("stage", "record_id").agg(F.min(F.struct(rank.alias("r"), name.alias("reason"))).alias("x"), F.array_join(F.array_sort(F.collect_set("criterion")), ",").alias("causes"))
    return g.select("stage", "record_id", F.col("x.reason").alias("reason"), "causes")


def resolved(log: DataFrame) -> DataFrame:
    """The decision of each settled item with the version and citations it rests on.

    An adjudication's own; else, where all opinions agree, the smallest version and the union of citations.
    """
    o = opinions(log).groupBy("stage", "record_id").agg(
        F.max("decision").alias("decision"), F.count_distinct("decision").alias("kinds"), F.min("criteria_version").alias("version"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("criteria")))).alias("cited"),
    ).where("kinds = 1")
    a = adjudications(log).select("stage", "record_id", F.col("adjudicated").alias("decision"), F.array_sort("criteria").alias("cited"), F.col("criteria_version").alias("version"))
    rest = o.join(a.select("stage", "record_id"), ["stage", "record_id"], "left_anti")
    cols = ["stage", "record_id", "decision", "cited", "version"]
    return a.select(*cols).unionByName(rest.select(*cols))


def stale_with_upstream(log: DataFrame, changes: DataFrame, current: int) -> DataFrame:
    """Stale items; a full-text decision whose title-abstract decision is stale is 'upstream-stale' unless it has a reason of its own."""
    r = resolved(log)
    s = stale(r, changes, current)
    up = r.where("stage = 'full-text'").join(s.where("stage = 'title-abstract'").select("record_id"), "record_id", "left_semi").join(s.where("stage = 'full-text'").select("record_id"), "record_id", "left_anti")
    return s.unionByName(up.select("stage", "record_id", F.lit("upstream-stale").alias("reason"), F.lit("").alias("causes")))


def criteria_at(changes: DataFrame, version: int) -> DataFrame:
    """Each criterion's last change up to a version; retired ones are left out."""
    return last_write(changes.where(F.col("to_version") <= version), ["criterion"], ["to_version"]).where("kind <> 'retired'")


def included_reports(state: DataFrame) -> DataFrame:
    """Included at the last stage and not excluded before."""
    last = state.where("stage = 'full-text' and status = 'include'").select("record_id")
    return last.join(state.where("stage = 'title-abstract' and status = 'exclude'").select("record_id"), "record_id", "left_anti")
