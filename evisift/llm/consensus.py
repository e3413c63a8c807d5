"""Problem 2: a consensus per item, an agreement measure, a reliability per annotator.

Competence-and-spamming mixture, fitted by expectation-maximisation. An annotator
labels an item truthfully with probability ``truth``, or spams: draws the label from a
guess distribution of their own, or (``contrary``, which the plain mixture lacks and which
annotators who turn labels round make necessary) gives the opposite label. An undecided
label can only be a guess, so it favours no side. Items with a standing adjudication are
known items of the fit. The prior of a positive item is estimated per stage.

Distribution: opinions are reduced to the latest per annotator and item, then to one row
an item with its votes, written once. A round of the fit is one map over those rows whose
partial sums per annotator are added up; only sums per annotator return to the driver.
With more than ``ANNOTATORS_MOST`` annotators the round is a join of votes with parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.plans.lineage import Workspace

ANNOTATORS_MOST = 100_000
ROUNDS = 25
CLOSE = 2e-3
START = (0.7, 0.05, 0.5)
#: Pseudo-counts: an annotator with few votes is taken for a fairly truthful one.
PRIOR_TRUTH, PRIOR_CONTRARY, PRIOR_GUESS = 6.0, 0.2, 1.0

SUMS = ["n", "truth", "contrary", "guess1", "guess0"]


def vote_of(decision: Column) -> Column:
    """1 include, 0 exclude, 2 undecided in any wording; null for words that are no opinion."""
    t = F.lower(F.trim(decision))
    return (
        F.when(t.rlike(r"^(includ|yes\b|accept|relevant\b)"), F.lit(1))
        .when(t.rlike(r"^(exclud|no$|reject|irrelevant\b|not relevant\b)"), F.lit(0))
        .when(t.rlike(r"^(maybe|unsure|unclear|undecided|second opinion|\?+$)"), F.lit(2))
        .cast("tinyint")
    )


def reviewer_of(name: Column) -> Column:
    """Freely spelled reviewer names (``Rev 1``, ``REV-001``, ``reviewer 1``) as ``rev-001``; others trimmed and in lower case."""
    t = F.lower(F.trim(name))
    number = F.regexp_extract(t, r"^(?:rev|reviewer)[\s_.-]*0*(\d+)$", 1)
    return F.nullif(F.when(number != "", F.concat(F.lit("rev-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0"))).otherwise(t), F.lit(""))


def item_votes(log: DataFrame, tools: DataFrame) -> DataFrame:
    """One row a (record_id, stage) with opinions: ``who`` and ``vote`` arrays (undecided left out), ``n`` annotators, ``known`` adjudication.

    log: ev, record_id, stage, actor, decision, ts, id; tools: record_id, stage, reviewer, decision, imported_at, tool, row_no.
    Repeated rows, revised opinions and a decision found in both tables leave one opinion per annotator, the latest by (ts, id).
    Rows without record, stage, reviewer or opinion count for nothing.
    """
    said = log.where("ev in ('screen', 'adjudicate')").select(
        "record_id", "stage", F.when(F.col("ev") == "screen", reviewer_of(F.col("actor"))).otherwise(F.lit("")).alias("who"),
        vote_of(F.col("decision")).alias("vote"), "ts", "id",
    )
    told = tools.select("record_id", "stage", reviewer_of(F.col("reviewer")).alias("who"), vote_of(F.col("decision")).alias("vote"), F.col("imported_at").alias("ts"), F.concat_ws(":", "tool", "row_no").alias("id"))
    every = said.unionByName(told).where("record_id is not null and stage is not null and who is not null and vote is not null")
    latest = every.groupBy("record_id", "stage", "who").agg(F.max(F.struct("ts", "id", "vote")).getField("vote").alias("vote"))
    items = latest.groupBy("record_id", "stage").agg(
        F.count(F.when(F.col("who") != "", 1)).cast("int").alias("n"),
        F.max(F.when(F.col("who") == "", F.col("vote"))).alias("known"),
        F.collect_list(F.when((F.col("who") != "") & (F.col("vote") < 2), F.struct(F.xxhash64("who").alias("who"), "vote"))).alias("votes"),
        F.count(F.when((F.col("who") != "") & (F.col("vote") == 1), 1)).cast("int").alias("yes"),
        F.count(F.when((F.col("who") != "") & (F.col("vote") == 0), 1)).cast("int").alias("no"),
    )
    return items.where("n > 0").select("record_id", "stage", "n", F.when(F.col("known") < 2, F.col("known")).alias("known"), F.col("votes.who").alias("who"), F.col("votes.vote").alias("vote"), "yes", "no")


class Model:
    """Parameters per annotator (sorted by key) and the prior per stage."""

    def __init__(self, keys: np.ndarray, truth: np.ndarray, contrary: np.ndarray, guess: np.ndarray, prior: dict[str, float]):
        self.keys, self.truth, self.contrary, self.guess, self.prior = keys, truth, contrary, guess, prior

    def probabilities(self, at: np.ndarray, vote: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(vote | item positive) and P(vote | item negative)."""
        t, c = self.truth[at], self.contrary[at]
        spam = (1 - t - c) * np.where(vote == 1, self.guess[at], 1 - self.guess[at])
        return spam + np.where(vote == 1, t, c), spam + np.where(vote == 1, c, t)

    def posterior(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Probability of a positive item for each row; also its votes, flat."""
        lists = batch.column("who")
        sizes = np.diff(lists.offsets.to_numpy())
        who, vote = lists.flatten().to_numpy(), batch.column("vote").flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.keys, who), max(len(self.keys) - 1, 0))
        row = np.repeat(np.arange(len(sizes)), sizes)
        p1, p0 = self.probabilities(at, vote)
        stages = batch.column("stage").to_pandas().map(self.prior).fillna(0.5).to_numpy(dtype=float)
        odds = np.log(stages / (1 - stages)) + np.bincount(row, np.log(p1 / p0), len(sizes))
        q = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        return q, row, at, vote, p1, p0


def _round(items: DataFrame, model: Model) -> pd.DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stages = np.zeros((5, len(model.keys))), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            q, row, at, vote, p1, p0 = model.posterior(batch)
            known = batch.column("known").to_pandas().to_numpy(dtype=float)
            q = np.where(np.isnan(known), q, known)
            for s, x in pd.Series(q).groupby(batch.column("stage").to_pandas().to_numpy()):
                a = stages.setdefault(s, [0.0, 0.0])
                a[0] += len(x)
                a[1] += x.sum()
            if not len(row):
                continue
            qv, t, c = q[row], model.truth[at], model.contrary[at]
            yes = vote == 1
            same, other = np.where(yes, qv / p1, (1 - qv) / p0), np.where(yes, (1 - qv) / p0, qv / p1)
            spam = (1 - t - c) * np.where(yes, model.guess[at], 1 - model.guess[at]) * (same + other)
            for k, w in enumerate((np.ones(len(at)), t * same, c * other, spam * yes, spam * ~yes)):
                total[k] += np.bincount(at, w, len(model.keys))
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(model.keys)), pa.array(model.keys), *map(pa.array, total)], names=["stage", "who", *SUMS])
        if stages:
            z = pa.array(np.zeros(len(stages)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(stages)), pa.array(np.zeros(len(stages), np.int64)), pa.array([a[0] for a in stages.values()]), pa.array([a[1] for a in stages.values()]), z, z, z], names=["stage", "who", *SUMS]
            )

    sums = items.select("stage", "known", "who", "vote").mapInArrow(run, "stage string, who bigint, " + ", ".join(f"{c} double" for c in SUMS))
    return sums.groupBy("stage", "who").agg(*[F.sum(c).alias(c) for c in SUMS]).toPandas()


def _estimates(n, truth, contrary, guess1, guess0):
    """Parameters from expected counts; works on arrays and on columns."""
    most = n + (PRIOR_TRUTH + PRIOR_CONTRARY + 2 * PRIOR_GUESS)
    return (truth + PRIOR_TRUTH) / most, (contrary + PRIOR_CONTRARY) / most, (guess1 + PRIOR_GUESS) / (guess1 + guess0 + 2 * PRIOR_GUESS)


def fit(items: DataFrame, keys: np.ndarray, stages: list[str], rounds: int = ROUNDS, close: float = CLOSE) -> Model:
    """Fit the mixture to the rows of :func:`item_votes`."""
    n = len(keys)
    model = Model(np.sort(keys), *(np.full(n, x) for x in START), {s: 0.5 for s in stages})
    for _ in range(rounds if n else 0):
        sums = _round(items, model)
        by_stage = sums[sums["stage"] != ""]
        prior = {s: float((pos + 1) / (cnt + 2)) for s, cnt, pos in zip(by_stage["stage"], by_stage["n"], by_stage["truth"])}
        a = sums[sums["stage"] == ""].sort_values("who")
        new = Model(a["who"].to_numpy(), *_estimates(*(a[c].to_numpy() for c in SUMS)), prior)
        moved = max(np.abs(new.truth - model.truth).max(), np.abs(new.contrary - model.contrary).max())
        model = new
        if moved < close:
            break
    return model


def fit_by_joins(items: DataFrame, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, DataFrame]:
    """The same fit where annotators are too many for one task, by joins on the annotator: ``(record_id, stage, q)`` and ``(who, t, c, g)``."""
    ws = Workspace(items.sparkSession, "consensus")
    votes = ws.write(items.select("record_id", "stage", "known", F.explode(F.arrays_zip("who", "vote")).alias("v")).select("record_id", "stage", "known", "v.who", "v.vote"), "votes")
    params = ws.write(votes.select("who").distinct().select("who", *[F.lit(x).alias(c) for c, x in zip(("t", "c", "g"), START)]), "params")
    prior = ws.write(items.select("stage").distinct().select("stage", F.lit(0.5).alias("p")), "prior")
    spam = "(1 - t - c) * if(vote = 1, g, 1 - g)"

    def weighed() -> tuple[DataFrame, DataFrame]:
        v = votes.join(params, "who").selectExpr("*", f"{spam} + if(vote = 1, t, c) as p1", f"{spam} + if(vote = 1, c, t) as p0")
        q = items.join(v.groupBy("record_id", "stage").agg(F.expr("sum(ln(p1 / p0))").alias("l")), ["record_id", "stage"], "left").join(prior, "stage")
        free = "1 / (1 + exp(-greatest(-500, least(500, ln(p / (1 - p)) + coalesce(l, 0)))))"
        return v, ws.write(q.selectExpr("record_id", "stage", f"coalesce(known, {free}) as q", f"{free} as free"), "q")

    for _ in range(rounds):
        v, q = weighed()
        r = v.join(q, ["record_id", "stage"]).selectExpr("who", "vote", "t", "c", f"{spam} as s", "if(vote = 1, q / p1, (1 - q) / p0) as same", "if(vote = 1, (1 - q) / p0, q / p1) as other")
        a = r.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(t * same)").alias("st"), F.expr("sum(c * other)").alias("sc"), F.expr("sum(if(vote = 1, s * (same + other), 0))").alias("g1"), F.expr("sum(if(vote = 0, s * (same + other), 0))").alias("g0"), F.first("t").alias("t0"), F.first("c").alias("c0"))
        t, c, g = _estimates(*(F.col(x) for x in ("n", "st", "sc", "g1", "g0")))
        new = ws.write(a.select("who", t.alias("t"), c.alias("c"), g.alias("g"), "t0", "c0"), "params")
        new_prior = ws.write(q.groupBy("stage").agg(((F.sum("q") + 1) / (F.count(F.lit(1)) + 2)).alias("p")), "prior")
        ws.drop(params, prior, q)
        params, prior = new, new_prior
        moved = new.agg(F.max(F.greatest(F.abs(F.col("t") - F.col("t0")), F.abs(F.col("c") - F.col("c0"))))).first()[0]
        if moved is None or moved < close:
            break
    return weighed()[1].select("record_id", "stage", F.col("free").alias("q")), params.select("who", "t", "c", "g")


def consensus(log: DataFrame, tools: DataFrame) -> DataFrame:
    """``(record_id, stage, decision, support, agreement, reviewers)`` of every item with opinions of two or more annotators.

    decision: the standing adjudication, else the side with the larger posterior (a tie, such as only undecided opinions in an
    even stage, is 'exclude'). support: posterior of the decision. agreement: share of agreeing pairs among decided opinions,
    null if fewer than two. Empty tables give no row.
    """
    items, model = _fitted(log, tools)
    spoken = items.where("n >= 2")
    if model is None:
        scored = spoken.join(fit_by_joins(items)[0], ["record_id", "stage"])
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keep = [batch.column(c) for c in ("record_id", "stage", "n", "known", "yes", "no")]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(model.posterior(batch)[0])], names=["record_id", "stage", "n", "known", "yes", "no", "q"])

        scored = spoken.mapInArrow(run, "record_id string, stage string, n int, known tinyint, yes int, no int, q double")
    decided = F.coalesce(F.col("known"), (F.col("q") > 0.5).cast("tinyint"))
    pairs = (F.col("yes") + F.col("no")) * (F.col("yes") + F.col("no") - 1) / 2
    return scored.select(
        "record_id", "stage", F.when(decided == 1, F.lit("include")).otherwise(F.lit("exclude")).alias("decision"),
        F.when(F.col("known").isNotNull(), F.lit(1.0)).otherwise(F.greatest("q", 1 - F.col("q"))).alias("support"),
        F.try_divide((F.col("yes") * (F.col("yes") - 1) + F.col("no") * (F.col("no") - 1)) / 2, pairs).alias("agreement"),
        F.col("n").alias("reviewers"),
    )


def _fitted(log: DataFrame, tools: DataFrame) -> tuple[DataFrame, Model | None]:
    items = Workspace(log.sparkSession, "consensus").write(item_votes(log, tools), "items")
    stages = [r[0] for r in items.select("stage").distinct().limit(1_001).collect()]
    keys = [r[0] for r in items.select(F.explode("who").alias("who")).distinct().limit(ANNOTATORS_MOST + 1).collect()]
    if len(keys) > ANNOTATORS_MOST or len(stages) > 1_000:
        return items, None
    return items, fit(items, np.array(keys, dtype=np.int64), stages)


def reliability(log: DataFrame, tools: DataFrame) -> DataFrame:
    """``(reviewer, truthful, contrary, guess_include)`` of every annotator with a decided opinion."""
    items, model = _fitted(log, tools)
    spark = log.sparkSession
    schema = "who bigint, truthful double, contrary double, guess_include double"
    names = log.where("ev = 'screen'").select(reviewer_of(F.col("actor")).alias("reviewer")).union(tools.select(reviewer_of(F.col("reviewer")))).where("reviewer is not null").distinct()
    if model is None:
        many = fit_by_joins(items)[1].selectExpr("who", "t as truthful", "c as contrary", "g as guess_include")
        return names.join(many, F.xxhash64("reviewer") == F.col("who")).select("reviewer", "truthful", "contrary", "guess_include")
    rows = [(int(k), float(t), float(c), float(g)) for k, t, c, g in zip(model.keys, model.truth, model.contrary, model.guess)]
    return names.join(F.broadcast(spark.createDataFrame(rows, schema)), F.xxhash64("reviewer") == F.col("who")).select("reviewer", "truthful", "contrary", "guess_include")
