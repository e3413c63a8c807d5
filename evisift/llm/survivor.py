"""Problem 4: the best representative of each group of records of one publication, field by field.

Bayesian fusion with copy detection. Every source database claims values of a group's fields (the title as folded words,
the date). Values that differ by slips or word order only are one value; any other claim is, given a true value, a part of it (a cut title, a date without its day), more
than it, or something else. Accuracies of sources and the dependence of pairs of sources are estimated in turns, field by field: a source is as accurate as
the posterior of what it claims; two sources that share false values more often than accuracy explains copy; votes
that a more accurate source probably lent are discounted; posteriors follow from the discounted votes. The value of largest posterior is the
title, and the members that carry it, undamaged, are those that may supply it: of these the one with the most trusted source does. The posterior of dates says which year is meant;
the most complete date of that year (online and print may be one apart) is taken, the more probable one of several. Corrections in force go first.

Distribution: claims are one row a group, with one claim a source database; they are reduced to counts of
patterns (who claims, which of them agree and how the others differ), on which the rounds of the estimation work; where patterns are too many, a round is a map over all claims that returns sums per source and pair of sources.
The state of the model is one number a source database and one a pair of them that met in a group. Choices are
aggregates of smallest structs, with map-side combining, so a hot group costs no memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from evisift.llm.neardup import linked_rows, prepare
from evisift.llm.titles import unmatched
from evisift.plans.lineage import Workspace

#: Most patterns of claims that are held on the driver; beyond it each round is a map over all claims, with the same result.
PATTERNS_MOST = 200_000
#: Most databases that ``source_trust`` may list; more is an error.
TRUST_MOST = 10_000
ROUNDS = 4
COPY_RATE, COPY_PRIOR, FALSE_VALUES = 0.8, 0.1, 10
#: How a claimed value stands to the true one, and the shares of the kinds of error in titles and in dates: titles lose text but hardly gain any that
#: looks like a title's; dates lose their day, and print follows online.
SAME, PART, MORE, OTHER = range(4)
SHARES = ((0.0, 0.95, 0.0005, 0.0495), (0.0, 0.5, 0.4, 0.1))

#: Who claims (field and source), which values, and how each value stands to each.
Pattern = tuple[tuple[str, ...], tuple[int, ...], tuple[int, ...]]


def field_of(c):
    """Freely spelled field names of corrections: ``title``, ``issued`` (also year, date, published) or as they are."""
    t = F.lower(F.trim(c))
    return F.when(t.rlike(r"^(article )?title$"), "title").when(t.rlike(r"^(issued|year|date|pub(lication|lished)?[ _-]?(date|year)?|date[ _-]issued)$"), "issued").otherwise(t)


class Model:
    """Accuracies of sources and probabilities that one of a pair of sources copies from the other. A source is one for titles ("t" before its name) and another one for dates ("d")."""

    def __init__(self) -> None:
        self.accuracy: dict[str, float] = {}
        self.copies: dict[tuple[str, str], float] = {}

    def posterior(self, pattern: Pattern) -> list[float]:
        """Posterior of each claimed value of a pattern; what is missing to one is the probability of a value that nobody claims."""
        who, what, kind = pattern
        k = max(what) + 1
        error = [math.log(max(x, 1e-9) / (FALSE_VALUES if r == OTHER else 1)) for r, x in enumerate(SHARES[who[0][0] == "d"])]
        score, none, taken = [0.0] * k, 0.0, {}
        for s, v in sorted(zip(who, what), key=lambda c: (-self.accuracy.get(c[0], 0.8), c[0])):
            right, free = min(max(self.accuracy.get(s, 0.8), 0.05), 0.99), 1.0
            for t in taken.setdefault(v, []):
                free *= 1 - COPY_RATE * self.copies.get((min(s, t), max(s, t)), 0.0)
            taken[v].append(s)
            good, bad = free * math.log(right), math.log(1 - right)
            for j in range(k):
                score[j] += good if v == j else free * (bad + error[kind[v * k + j]])
            none += free * (bad + error[OTHER])
        top = max(score)
        weights = [math.exp(x - top) for x in score]
        total = sum(weights) + max(0, FALSE_VALUES + 1 - k) * math.exp(min(none - top, 50))
        return [w / total for w in weights]


def _split(words: str, other: str) -> str:
    """``words`` with those written as two where ``other`` has them so."""
    w = other.split()
    two = {x + y: f"{x} {y}" for x, y in zip(w, w[1:])}
    return " ".join(two.get(x, x) for x in words.split())


def title_kind(claim: str, true: str) -> int:
    """How a folded title stands to another one. A lost or added word in the middle, slips and joined words do not count, a lost or added end does."""
    if claim == true:
        return SAME
    added, missing, _ = unmatched(claim, true)
    if added and missing:
        claim, true = _split(claim, true), _split(true, claim)
        added, missing, _ = unmatched(claim, true)
    cut = len(missing) >= 2 or bool(missing) and true.endswith(missing[-1])
    more = len(added) >= 2 or bool(added) and claim.endswith(added[-1])
    return (OTHER if cut else MORE) if more else (PART if cut else SAME)


def title_kinds(a: str, b: str) -> tuple[int, int]:
    """How each of two folded titles stands to the other one."""
    k = title_kind(a, b)
    return k, {PART: MORE, MORE: PART}.get(k, k)


def date_kind(claim: int, true: int) -> int:
    """The same for dates as year, month and day in one number, where 99 is an unknown part. A year more or less is MORE: the other one of print and online."""
    if claim == true:
        return SAME
    a, b = ((x // 10000, x // 100 % 100, x % 100) for x in (claim, true))
    if all(x == y or x == 99 for x, y in zip(a, b)):
        return PART
    return MORE if abs(a[0] - b[0]) <= 1 else OTHER


def date_kinds(a: int, b: int) -> tuple[int, int]:
    return date_kind(a, b), date_kind(b, a)


def pattern_of(claims: list[tuple[str, object]], kinds) -> tuple[Pattern, list]:
    """The pattern of a field's claims (source, value) and its values; the first spelling of a value is the commonest, then the longest."""
    claims = sorted(claims, key=lambda c: c[0])
    who = tuple(s for s, _ in claims)
    if all(v == claims[0][1] for _, v in claims):
        return (who, (0,) * len(claims), (SAME,)), [claims[0][1]]
    times = Counter(v for _, v in claims)
    values, at, kind = [], {}, {}
    for v in sorted(times, key=lambda v: (-times[v], -len(str(v)), v)):
        new = len(values)
        for k, w in enumerate(values):
            kind[new, k], kind[k, new] = kinds(v, w)
            if kind[new, k] == SAME:
                at[v] = k
                break
        else:
            at[v] = new
            values.append(v)
    n = len(values)
    return (who, tuple(at[v] for _, v in claims), tuple(kind.get((i, j), SAME) for i in range(n) for j in range(n))), values


def _text(p: Pattern) -> str:
    return "|".join(",".join(map(str, part)) for part in p)


def _pattern(text: str) -> Pattern:
    who, *rest = text.split("|")
    return (tuple(who.split(",")), *(tuple(map(int, part.split(","))) for part in rest))  # type: ignore[return-value]


def _tally(seen: dict[Pattern, int], model: Model) -> dict[tuple[int, str, str], float]:
    """Sums over counted patterns: claims (0) and posteriors (1) per source; same and true (2), same and false (3), different (4) per pair."""
    out: dict[tuple[int, str, str], float] = {}

    def add(key: tuple[int, str, str], x: float) -> None:
        out[key] = out.get(key, 0.0) + x

    for pattern, times in seen.items():
        who, what, _ = pattern
        p = model.posterior(pattern)
        for k, (s, v) in enumerate(zip(who, what)):
            add((0, s, ""), times)
            add((1, s, ""), times * p[v])
            for t, w in zip(who[:k], what[:k]):
                if v == w:
                    add((2, t, s), times * p[v])
                    add((3, t, s), times * (1 - p[v]))
                else:
                    add((4, t, s), times)
    return out


def _patterns(claims: DataFrame) -> DataFrame:
    """Each pattern of a title's or a date's claims with its number of groups."""
    return claims.select(F.explode(F.array_compact(F.array("title_pattern", "date_pattern"))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _sums(patterns: DataFrame, model: Model) -> dict[tuple[int, str, str], float]:
    """The same sums by a map, where patterns are too many to be held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _tally(dict(zip(map(_pattern, b.column("p").to_pylist()), b.column("n").to_pylist())), model)
            cols = [*zip(*got), got.values()] if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.float64()))], names=["k", "s", "t", "x"])

    got = patterns.mapInArrow(run, "k int, s string, t string, x double").groupBy("k", "s", "t").agg(F.sum("x").alias("x"))
    return {(r["k"], r["s"], r["t"]): r["x"] for r in got.collect()}


def fuse(claims: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model estimated from ``claims`` (rows of :func:`claim_rows`)."""
    model, patterns = Model(), _patterns(claims)
    rows = patterns.limit(PATTERNS_MOST + 1).collect()
    seen = {_pattern(r["p"]): r["n"] for r in sorted(rows)} if len(rows) <= PATTERNS_MOST else None
    for _ in range(rounds):
        sums = _sums(patterns, model) if seen is None else _tally(seen, model)
        model.accuracy = {s: min(max((sums.get((1, s, ""), 0.0) + 1.6) / (n + 2), 0.05), 0.99) for (k, s, _), n in sums.items() if k == 0}
        model.copies = {}
        for s, t in {(s, t) for k, s, t in sums if k in (2, 3, 4)}:
            a, b = model.accuracy[s], model.accuracy[t]
            both, false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
            lent = math.sqrt(a * b) * COPY_RATE + both * (1 - COPY_RATE), math.sqrt((1 - a) * (1 - b)) * COPY_RATE + false * (1 - COPY_RATE)
            same, wrong, differ = (sums.get((k, s, t), 0.0) for k in (2, 3, 4))
            odds = same * math.log(lent[0] / both) + wrong * math.log(lent[1] / false) + differ * math.log(1 - COPY_RATE) + math.log(COPY_PRIOR / (1 - COPY_PRIOR))
            model.copies[s, t] = 1 / (1 + math.exp(-min(max(odds, -50), 50)))
    return model


CLAIMS = "group bigint, title_pattern string, titles array<string>, date_pattern string, dates array<int>, texts array<bigint>, value array<int>"


def _hash(text: str) -> int:
    """What ``xxhash64`` gives for the text."""
    x = xxhash.xxh64_intdigest(text, 42)
    return x - (1 << 64) if x >> 63 else x



def claim_rows(m: DataFrame) -> DataFrame:
    """Columns ``CLAIMS``: patterns and values of each group's claims, and of its claimed titles the hashes and which value each is, with one claim a source: its longest title without evident damage and its most complete date.

    A record that several databases hold is one witness, the first of them. Evidently damaged titles and implausible dates claim nothing.
    """
    title = F.when(~F.col("damaged"), F.struct(F.length("words"), F.col("words").alias("w"))).alias("t")
    each = m.where("source is not null").select("group", F.translate("source", ",|", "  ").alias("s"), title, F.when(F.col("year") > 0, F.struct("complete", F.col("date_code").alias("d"))).alias("d"))
    best = each.groupBy("group", "s").agg(F.max("t").getField("w").alias("w"), F.max("d").getField("d").alias("d"))
    rows = best.groupBy("group").agg(F.collect_list(F.struct("s", "w", "d")).alias("c")).select("group", F.col("c.s").alias("who"), F.col("c.w").alias("title"), F.col("c.d").alias("date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for who, title, date in zip(*(b.column(c).to_pylist() for c in ("who", "title", "date"))):
                row: list = []
                for at, field, kinds in (("t", title, title_kinds), ("d", date, date_kinds)):
                    claims = [(at + s, v) for s, v in zip(who, field) if v is not None]
                    pattern, values = pattern_of(claims, kinds) if claims else (None, None)
                    row += [pattern and _text(pattern), values]
                    if at == "t":
                        claims.sort(key=lambda c: c[0])
                        texts = {_hash(v): k for (_, v), k in zip(claims, pattern[1])} if pattern else {}
                out.append([*row, list(texts), list(texts.values())])
            cols = list(zip(*out)) or [[]] * 6
            types = (pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("group"), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=[x.split()[0] for x in CLAIMS.split(", ")])

    return rows.mapInArrow(run, CLAIMS)


def fused_values(claims: DataFrame, model: Model) -> DataFrame:
    """``(group, title, title_posterior, date, year, year_posterior, carried, other)``: the values of largest posterior; a tie goes to the value listed first.

    A year's posterior is the one of all its dates. carried and other: hashes of the claimed titles that are the fused one, and that are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(100_000)(lambda text: model.posterior(_pattern(text)))
        for b in batches:
            out = []
            for tp, tv, dp, dv, texts, value in zip(*(b.column(c).to_pylist() for c in ("title_pattern", "titles", "date_pattern", "dates", "texts", "value"))):
                row: list = [None] * 5 + [[], []]
                if tp:
                    p = known(tp)
                    k = max(range(len(p)), key=lambda k: (round(p[k], 9), -k))
                    row[:2] = tv[k], p[k]
                    row[5:] = [h for h, v in zip(texts, value) if v == k], [h for h, v in zip(texts, value) if v != k]
                if dp:
                    p = known(dp)
                    k = max(range(len(p)), key=lambda k: (round(p[k], 9), -k))
                    year = dv[k] // 10000
                    row[2:5] = dv[k], year, sum(x for x, d in zip(p, dv) if d // 10000 == year)
                out.append(row)
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["group", "title", "title_posterior", "date", "year", "year_posterior", "carried", "other"]
            yield pa.RecordBatch.from_arrays([b.column("group"), *[pa.array(list(c), t) for c, t in zip(cols, types)]], names=names)

    return claims.mapInArrow(run, "group bigint, title string, title_posterior double, date int, year int, year_posterior double, carried array<bigint>, other array<bigint>")


def in_force(amendments: DataFrame) -> DataFrame:
    """``(id, field, new_value, ts)``: the latest correction of each record's title and date (ties: the larger event id)."""
    a = amendments.select(F.trim("record_id").alias("id"), field_of(F.col("field")).alias("field"), F.trim("new_value").alias("new_value"), "ts", "event_id").where("field in ('title', 'issued') and id <> ''")
    return a.groupBy("id", "field").agg(F.max(F.struct("ts", "event_id", "new_value")).alias("x")).select("id", "field", "x.new_value", "x.ts")


def _prepared(records: DataFrame, trust: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Members of groups, and the claims of groups, both written."""
    ranks = dict(trust.where("db_name is not null").groupBy("db_name").agg(F.min("trust_rank").alias("r")).limit(TRUST_MOST + 1).collect())  # a list of databases, checked
    if len(ranks) > TRUST_MOST:
        raise ValueError(f"source_trust lists more than {TRUST_MOST} databases")
    last = max(ranks.values(), default=0) + 1
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]) if ranks else F.lit(None).cast("map<string,int>")
    named = F.transform("meta.sources.db_name", lambda s: F.coalesce(F.try_element_at(rank, s), F.lit(last)))
    best = F.coalesce(F.array_min(named), F.lit(last))
    prepared, rows = ws.counted(prepare(records, best), "prepared")
    groups = linked_rows(prepared, rows, ws)
    complete = F.expr("case when year < 0 then 0 when date_code div 100 % 100 = 99 then 1 when date_code % 100 = 99 then 2 else 3 end")
    wide = prepared.select("rid", "id", "words", "damaged", "date_code", "year", "source", "rank", "title_hash")
    m = wide.join(groups.hint("shuffle_hash"), "rid").select("group", "id", "words", "damaged", "date_code", "year", complete.alias("complete"), "source", "rank", "title_hash")
    m = ws.write(m, "members")
    ws.drop(prepared)
    return m, ws.write(claim_rows(m), "claims")


@F.arrow_udf(BooleanType())
def _carries(words: pa.Array, title: pa.Array) -> pa.Array:
    """Whether a folded title is the given one but for slips; null stays null."""
    return pa.array([None if w is None or t is None else title_kind(w, t) == SAME for w, t in zip(words.to_pylist(), title.to_pylist())], pa.bool_())


def _chosen(m: DataFrame, fused: DataFrame) -> DataFrame:
    """``(group, group_id, title_id, date_id)`` of groups of two or more ids, without regard to corrections."""
    f = fused.select("group", "title", "date", F.col("year").alias("fused_year"), "carried", "other")
    j = m.select("group", "id", "words", F.xxhash64("words").alias("h"), "damaged", "complete", "year", "date_code", "rank").join(f.hint("shuffle_hash"), "group", "left")
    # claimed titles were compared before; only those of further records of a source are compared here
    sure = F.when(F.col("damaged"), 2).when(F.expr("array_contains(carried, h)"), 0).when(F.expr("array_contains(other, h)"), 1)
    j = j.withColumn("sure", sure)
    j = j.withColumn("bad", F.coalesce("sure", F.when(_carries(F.when(F.col("sure").isNull(), F.col("words")), F.col("title")), 0).otherwise(1)))
    fits = (F.col("complete") > 0) & (F.col("fused_year").isNull() | (F.abs(F.col("year") - F.col("fused_year")) <= 1))
    date = F.struct((-F.col("complete")).alias("c"), (F.col("date_code") != F.col("date")).alias("o"), "rank", "id")
    return j.groupBy("group").agg(
        F.min("id").alias("group_id"), F.max("id").alias("last_id"),
        F.min(F.struct("bad", "rank", "id")).getField("id").alias("title_id"), F.min(F.when(fits, date)).getField("id").alias("date_id"),
    ).where("group_id < last_id")


def survivors(records: DataFrame, amendments: DataFrame, trust: DataFrame) -> DataFrame:
    """``(group_id, title_from, issued_from)`` of every group of two or more records.

    title_from: the member with the latest title correction in force, else of the members that carry the fused title the one with the most
    trusted source, else (none is undamaged) of all members the one with the least damage. issued_from: likewise, else the most complete date within a year of the fused one;
    null if no member has a plausible date. Ties go to the more probable date, then to the better source, then to the smaller id.
    """
    ws = Workspace(records.sparkSession, "survivor")
    m, claims = _prepared(records, trust, ws)
    with ws.tidy():
        model = fuse(claims)
    chosen = _chosen(m, fused_values(claims, model))
    # corrections are few beside records: they meet a few narrow columns of the members
    part = lambda c: F.lpad(F.nullif(c, F.lit(99)).cast("string"), 2, "0")
    date = F.when(F.col("date_code") < 0, "").otherwise(F.concat_ws("-", F.floor(F.col("date_code") / 10000).cast("string"), part(F.floor(F.col("date_code") / 100) % 100), part(F.col("date_code") % 100)))
    fix = m.select("id", "group", "title_hash", date.alias("date")).join(in_force(amendments).hint("shuffle_hash"), "id")
    fix = fix.where((F.col("field") == "title") & (F.xxhash64("new_value") != F.col("title_hash")) | (F.col("field") == "issued") & (F.coalesce("new_value", F.lit("")) != F.col("date")))
    last = fix.groupBy("group").agg(*[F.max(F.when(F.col("field") == f, F.struct("ts", "id"))).getField("id").alias(f"{f}_fix") for f in ("title", "issued")])
    return chosen.join(last, "group", "left").select("group_id", F.coalesce("title_fix", "title_id").alias("title_from"), F.coalesce("issued_fix", "date_id").alias("issued_from"))


def fused_records(records: DataFrame, trust: DataFrame) -> DataFrame:
    """``(group_id, title_words, title_posterior, year, year_posterior)``: the fused values of every group of two or more records."""
    ws = Workspace(records.sparkSession, "fused")
    m, claims = _prepared(records, trust, ws)
    with ws.tidy():
        model = fuse(claims)
    ids = m.groupBy("group").agg(F.min("id").alias("group_id"), F.max("id").alias("last_id")).where("group_id < last_id").select("group", "group_id")
    return ids.join(fused_values(claims, model), "group", "left").select("group_id", F.col("title").alias("title_words"), "title_posterior", "year", "year_posterior")
