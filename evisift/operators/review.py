"""The workflow of a review as data: queues, blinding, checks of adjudications, migrated decisions, logs put in order, identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.text import digits, normal_doi
from evisift.operators import screening
from evisift.operators.folds import last_write

# Source names that are trial registers rather than databases.
REGISTERS = (
    "clinicaltrials.gov", "clinicaltrials", "ictrp", "who ictrp", "isrctn", "anzctr", "euctr", "eu clinical trials register", "cochrane central", "central",
)


def rescreen_queue(log: DataFrame, assigned: DataFrame, changes: DataFrame, current: int, actor: str) -> DataFrame:
    """``(stage, record_id, reason, causes)``: items an actor is assigned to whose own latest opinion later changes of criteria put in doubt, whatever the others said."""
    own = screening.opinions(log.where(F.col("actor") == actor)).select("stage", "record_id", "decision", F.col("criteria").alias("cited"), F.col("criteria_version").alias("version"))
    mine = assigned.where(F.col("actor") == actor).select("stage", "record_id")
    return screening.stale(own.join(mine, ["stage", "record_id"], "left_semi"), changes, current)


def visible(items: DataFrame, log: DataFrame, assigned: DataFrame, actor: str) -> DataFrame:
    """``items`` (stage, record_id, …) without those that still wait for the actor's own opinion; an item without a stage is hidden if its record waits at any."""
    waiting = screening.queue(log, assigned, actor)
    staged = items.where("stage is not null").join(waiting, ["stage", "record_id"], "left_anti")
    plain = items.where("stage is null").join(waiting.select("record_id").distinct(), "record_id", "left_anti")
    return staged.unionByName(plain.select(*staged.columns))


def adjudication_checks(log: DataFrame) -> DataFrame:
    """Of each adjudication: ``id, supersedes`` (ids of the opinions that stood before it, sorted), ``own_conflict`` (its actor had one) and ``problems``.

    problems: 'no-conflict' (the opinions before it agreed and none was a maybe), 'full-text-exclusion-needs-reason', 'no-rationale' (a blank note).
    """
    a = log.where("ev = 'adjudicate'").dropDuplicates(["id"]).select("id", "stage", "record_id", F.col("actor").alias("judge"), F.col("decision").alias("verdict"), F.col("criteria").alias("cited"), "note", F.col("ts").alias("at"))
    o = log.where("ev = 'screen'").select("stage", "record_id", "actor", "decision", "ts", F.col("id").alias("opinion"))
    before = a.select("id", "stage", "record_id", "at").join(o, ["stage", "record_id"]).where("ts < at")
    stood = last_write(before.select("id", "actor", "decision", "ts", "opinion"), ["id", "actor"], ["ts", "opinion"])
    per = stood.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list("opinion")), ",").alias("supersedes"), F.collect_set("actor").alias("actors"), F.count_distinct("decision").alias("kinds"), F.count(F.when(F.col("decision") == "maybe", 1)).alias("maybes")
    )
    j = a.join(per, "id", "left")
    problems = F.array_compact(F.array(
        F.when((F.coalesce("kinds", F.lit(0)) < 2) & (F.coalesce("maybes", F.lit(0)) == 0), "no-conflict"),
        F.when((F.col("stage") == "full-text") & (F.col("verdict") == "exclude") & (F.coalesce(F.size("cited"), F.lit(0)) <= 0), "full-text-exclusion-needs-reason"),
        F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "no-rationale"),
    ))
    return j.select("id", F.coalesce("supersedes", F.lit("")).alias("supersedes"), F.coalesce(F.array_contains("actors", F.col("judge")), F.lit(False)).alias("own_conflict"), F.array_join(problems, ",").alias("problems"))


def migrated(decisions: DataFrame, records: DataFrame, merged: DataFrame, words: DataFrame) -> DataFrame:
    """Decisions of another tool carried over: ``tool, row_no, record_id, stage, decision, skipped``.

    decisions: tool, row_no, record_id, stage, decision. records: id. merged: (id, canonical) of records that went up in others. words: (word, decision) with words in lower case, a list
    of fixed size. skipped: 'no record', 'unknown record', 'no decision', 'unknown decision', or null if the row is carried over to the canonical record. Repeated (tool, row_no) count once, the smallest row of them.
    """
    d = decisions.groupBy("tool", "row_no").agg(F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("record_id", "stage", "decision")])).alias("x")).select("tool", "row_no", F.trim("x.record_id").alias("given"), "x.stage", F.lower(F.trim("x.decision")).alias("word"))
    d = d.join(merged.select(F.col("id").alias("given"), "canonical"), "given", "left").withColumn("record_id", F.coalesce("canonical", "given"))
    d = d.join(records.select(F.col("id").alias("record_id")).distinct().withColumn("_there", F.lit(True)), "record_id", "left").join(words, "word", "left")
    why = (
        F.when(F.coalesce("given", F.lit("")) == "", "no record").when(F.col("_there").isNull(), "unknown record")
        .when(F.coalesce("word", F.lit("")) == "", "no decision").when(F.col("decision").isNull(), "unknown decision")
    )
    return d.select("tool", "row_no", "record_id", "stage", "decision", why.alias("skipped"))


def retrieval(events: DataFrame, reports: DataFrame) -> DataFrame:
    """``(record_id, status, reason, outstanding)`` of every report: the latest status (events: record_id, status, reason, ts, id), 'sought' without one; still outstanding if sought or requested by loan."""
    last = last_write(events.select("record_id", "status", "reason", "ts", "id"), ["record_id"])
    s = F.coalesce("status", F.lit("sought"))
    return reports.select("record_id").distinct().join(last, "record_id", "left").select("record_id", s.alias("status"), "reason", s.isin("sought", "ill-requested").alias("outstanding"))


def split_suggestions(texts: DataFrame) -> DataFrame:
    """``(id, parts, evidence)`` of texts that say they tell of several experiments or studies. texts: id, text."""
    rule = r"(?i)\b(two|three|four|five|six|[2-6])\s+(?:independent\s+|separate\s+|randomi[sz]ed\s+)?(?:experiments|studies|trials|samples|cohorts)\b"
    word = F.lower(F.regexp_extract("text", rule, 1))
    names = F.create_map(*[F.lit(x) for k, w in enumerate(("two", "three", "four", "five", "six"), 2) for x in (w, k)])
    return texts.where(F.regexp_like("text", F.lit(rule))).select("id", F.coalesce(F.try_element_at(names, word), word.try_cast("int")).alias("parts"), F.regexp_extract("text", rule, 0).alias("evidence"))


def source_kind(name: Column) -> Column:
    """'register' or 'database' of a source name."""
    return F.when(F.lower(F.trim(name)).isin(*REGISTERS), "register").otherwise("database")


def derived_id(c: Column, kind: str) -> Column:
    """The id of another entity (rec, rpt, std) with the same 16 characters; null for what is no such id."""
    suffix = F.regexp_extract(c, r"^(?:rec|rpt|std)_([0-9a-z]{16})$", 1)
    return F.when(suffix != "", F.concat(F.lit(f"{kind}_"), suffix))


def effect_id(study: Column, n: Column) -> Column:
    """``eff_<16 characters of the study>_<four digits>``; null for a number outside of 1 to 9999."""
    suffix = F.regexp_extract(study, r"^std_([0-9a-z]{16})$", 1)
    return F.when((suffix != "") & n.between(1, 9999), F.concat(F.lit("eff_"), suffix, F.lit("_"), F.lpad(n.cast("string"), 4, "0")))


def pmcid(c: Column) -> Column:
    """``PMC`` and the digits, null without a digit."""
    return F.concat(F.lit("PMC"), digits(c))


def identifiers(doi: Column, pmid: Column, pmc: Column, isbn: Column) -> list[Column]:
    """DOI, PMID, PMCID and ISBN in normal form, or as given where that fails."""
    stored = lambda n, raw: F.coalesce(n, raw)
    return [stored(normal_doi(doi), doi).alias("doi"), stored(digits(pmid), pmid).alias("pmid"), stored(pmcid(pmc), pmc).alias("pmcid"), stored(digits(isbn), isbn).alias("isbn")]


def authors_text(authors: Column) -> Column:
    """``Family, Given; Family; Literal`` of an array of author structs."""
    one = lambda a: F.when(a["family"].isNotNull(), F.concat_ws(", ", F.nullif(F.trim(a["family"]), F.lit("")), F.nullif(F.trim(a["given"]), F.lit("")))).otherwise(F.trim(a["literal"]))
    return F.array_join(F.filter(F.transform(authors, one), lambda t: t.isNotNull() & (t != "")), "; ")


def parsed_authors(text: Column) -> Column:
    """The array of (family, given, literal) that :func:`authors_text` writes; a name without a comma is a literal."""
    parts = F.filter(F.transform(F.split(text, r"[;\n]"), F.trim), lambda t: t != "")
    comma = lambda t: F.contains(t, F.lit(","))
    return F.transform(parts, lambda t: F.struct(
        F.when(comma(t), F.trim(F.substring_index(t, ",", 1))).alias("family"), F.when(comma(t), F.nullif(F.trim(F.regexp_replace(t, "^[^,]*,", "")), F.lit(""))).alias("given"), F.when(~comma(t), t).alias("literal"),
    ))


def page_range(c: Column) -> tuple[Column, Column]:
    """First and last page of a range written with any dash; '' for what is missing."""
    t = F.trim(F.coalesce(c, F.lit("")))
    parts = F.split(t, r"\s*[-–—]+\s*", 2)
    return F.trim(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def tex(c: Column) -> Column:
    """Text with the characters escaped that TeX reads otherwise."""
    c = F.replace(c, F.lit("\\"), F.lit("\x00"))
    for x in "{}&%$#_":
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    for x, name in (("~", "asciitilde"), ("^", "asciicircum"), ("\x00", "backslash")):
        c = F.replace(c, F.lit(x), F.lit(f"\\text{name}{{}}"))
    return c


def bibtex(key: Column, kind: Column, fields: dict[str, Column]) -> Column:
    """A BibTeX entry; fields that are null or empty are left out."""
    kinds = {"article-journal": "article", "book": "book", "chapter": "incollection", "paper-conference": "inproceedings", "report": "techreport", "thesis": "phdthesis"}
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), kind), F.lit("misc"))
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {n} = {{"), tex(c), F.lit("}"))) for n, c in fields.items()]
    return F.concat(F.lit("@"), name, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def rounded12(c: Column) -> Column:
    """A number at twelve significant digits; NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.format_string("%.11e", c).cast("double"))


def value_and_source(c: Column) -> tuple[Column, Column]:
    """``148 @ p. 7`` as ('148', 'p. 7'); no source without the sign."""
    return F.trim(F.regexp_replace(c, r"(?s)\s@\s.*$", "")), F.nullif(F.trim(F.regexp_extract(c, r"(?s)\s@\s*(.*)$", 1)), F.lit(""))


def relink_counts(log: DataFrame) -> DataFrame:
    """``(file, kept, dropped, reordered)`` of event files (file, line, ts, id) that are put in the order of (ts, id) with each id once.

    reordered: lines at which another event stands after ordering. Positions come from two sorts of a file, joined on them.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("file")
    was = log.select("file", "id", F.row_number().over(by.orderBy("line")).alias("at"))
    now = log.select("file", F.col("id").alias("new"), F.row_number().over(by.orderBy("ts", "id", "line")).alias("at"))
    j = was.join(now, ["file", "at"])
    return j.groupBy("file").agg(F.count_distinct("id").alias("kept"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("dropped"), F.count(F.when(F.col("id") != F.col("new"), 1)).alias("reordered"))


def relinked(log: DataFrame) -> DataFrame:
    """``(file, seq, ts, id, body, prev, digest)``: files in order with a new chain of digests. A chain is sequential: rows of a file stream through one task in order, of which only the last digest is held.

    log: file, ts, id, body (text). The digest is of number, id, body and the digest before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        file, seq, prev, last = None, 0, None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.file != file:
                    file, seq, prev, last = r.file, 0, None, None
                if r.id == last:
                    continue
                seq, last = seq + 1, r.id
                digest = hashlib.sha256(f"{seq}|{r.id}|{r.body}|{prev or ''}".encode()).hexdigest()
                out.append((file, seq, r.ts, r.id, r.body, prev, digest))
                prev = digest
            yield pd.DataFrame(out, columns=["file", "seq", "ts", "id", "body", "prev", "digest"])

    rows = log.select("file", "ts", "id", "body").repartition("file").sortWithinPartitions("file", "ts", "id")
    return rows.mapInPandas(run, "file string, seq int, ts timestamp, id string, body string, prev string, digest string")


def next_number(ids: DataFrame, c: str) -> DataFrame:
    """``(prefix, next)``: one more than the largest number used with each prefix, so that none is used twice; ids without a number give no row."""
    r = r"^(.*?)(\d+)$"
    p = ids.select(F.regexp_extract(c, r, 1).alias("prefix"), F.regexp_extract(c, r, 2).try_cast("bigint").alias("n")).where("n is not null")
    return p.groupBy("prefix").agg((F.max("n") + 1).alias("next"))


#: Fields that a filter over records may name, as columns of the records table.
RECORD_FIELDS = {
    "id": "id", "doi": "doi", "pmid": "pmid", "title": "coalesce(title, '')", "abstract": "coalesce(abstract, '')", "journal": "coalesce(container_title, '')", "year": "get(get(issued.date_parts, 0), 0)",
    "authors": "filter(transform(coalesce(author, array()), a -> a.family), f -> f is not null and f <> '')", "via": "get(meta.sources, 0).via", "search": "get(meta.sources, 0).search_id",
}


def record_fields(records: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """``records`` as the fields that filters name (:data:`RECORD_FIELDS`); ``via`` and ``search`` are those of the first source. bias: (id, rob_overall, rob.<domain>…) is joined if given."""
    out = records.select(*[F.expr(e).alias(n) for n, e in RECORD_FIELDS.items()])
    return out if bias is None else out.join(bias, "id", "left")


def record_list(records: DataFrame, canonical_only: bool = True) -> DataFrame:
    """The listing of records: ``id, year, first_author, title, journal, doi``, one row an id; by default without those that went up in others."""
    r = records.where(F.coalesce("meta.canonical", F.lit(True))) if canonical_only else records
    cols = r.select("id", F.expr(RECORD_FIELDS["year"]).alias("year"), F.expr("coalesce(get(author, 0).family, get(author, 0).literal, '')").alias("first_author"), F.expr("regexp_replace(coalesce(title, ''), '[\t\r\n]', ' ')").alias("title"), F.expr("coalesce(container_title, '')").alias("journal"), F.expr("coalesce(doi, '')").alias("doi"))
    return cols.dropDuplicates(["id"])
