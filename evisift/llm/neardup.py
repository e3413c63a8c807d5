"""Problem 1: records of one publication whose titles differ by small edits.

Titles become SetSketch registers of their character grams, and register values are banded. A band of eight registers stands alone and finds
what is nearly equal; bands of fewer registers together with a locator that edits of a title do not touch (first author; page and journal; page and volume;
volume and journal) find what was cut or reworded, and keep titles made of the same stock phrases apart. Pairs that share a band are estimated
jointly by likelihood; what the estimate lets through is verified word for word and by the other fields; links are closed by the component
operator. Rows with one DOI, one id or equal fields meet the first such row besides, which adds those that have no title to sketch.

Distribution: one map over the records, written once; band keys are rows of three 8-byte values, joined with themselves on the key. Of rows equal in
all compared fields one a task is enough (see :func:`candidates`). Keys under which very many rows stand are found in a sample of the rows
and split by the fields that a pair must share to be accepted, so that no bucket is paired as a whole. Text is joined to distinct candidates only. Collected are the hot keys only, which are few by counting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.components import HOT_LEAST, connected_components, join_one
from evisift.llm.setsketch import REGISTERS, joint_estimate, mix, sketches, text_elements
from evisift.llm.titles import evident_damage, fold, marking, marks, normal, unmatched
from evisift.plans.lineage import Workspace

EARLIEST, LATEST = 1450, 2035
#: Least estimated share of the smaller title found in the larger one: with the same page, and without.
CONTAINED_SAME_PAGE, CONTAINED = 0.25, 0.6
#: Locators (a: first author, p: page, v: volume, j: journal, which may be missing; none: the title alone), the number of bands with each and of registers in a band.
LOCATORS = [("", 1, 8), ("a", 3, 2), ("pj", 1, 1), ("pv", 3, 1), ("vj", 2, 2)]
#: Distinct grams from which a title says enough to stand alone; standing headings are shorter.
LONG_TITLE = 40
#: Fields that travel with a key: lowest bit and number of bits.
KNOWN = [("page", 0, 20), ("volume", 20, 12), ("issue", 32, 12), ("year", 44, 12), ("doi", 56, 7)]
#: A key is hot beyond so many rows, or a ten-thousandth of all rows if that is more; looked for in one of ``SAMPLE`` rows.
HOT_BUCKET, SAMPLE = 4_096, 32

PREPARED = "rid bigint, id string, words string, families string, journal string, page int, volume int, issue int, year int, doi bigint, size int, registers binary, first bigint, content bigint"
#: What choosing a survivor needs of a record, beside; see survivor.
EXTRA = "date_code int, source string, rank int, title_hash bigint, damaged boolean"


def _number(c: str) -> Column:
    """The first number in a text, -1 for none; most texts begin with it and need no regular expression."""
    plain = F.substring_index(F.col(c), "-", 1).try_cast("int")
    return F.when(plain >= 0, plain).otherwise(F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(-1)))


@lru_cache(100_000)
def _journal(name: str) -> str:
    """The first two initials of a journal's name, which its short form keeps."""
    return "".join(w[:1] for w in fold(name).split() if w not in ("of", "the", "for", "and", "in"))[:2]


@lru_cache(200_000)
def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _band_keys(registers: np.ndarray, size: np.ndarray, fields: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their band keys; fields: p, v (-1 for none), a (0 for none) and j (journal, no locator of its own)."""
    here = {f: fields[f] != (0 if f == "a" else -1) for f in "pva"}
    word = {f: mix(fields[f].astype(np.int64).view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) for k, f in enumerate("pvaj", 1)}
    keys, rows, r = [], [], 0
    for locator, n, wide in LOCATORS:
        place = np.full(len(size), len(locator), np.uint64)
        for k, f in enumerate(locator, 1):
            place = mix(place ^ (word[f] * np.uint64(2 * k + 1)))
        usable = np.logical_and.reduce([size > 0, *(here[f] for f in locator if f != "j")]) if locator else size >= LONG_TITLE
        at = np.flatnonzero(usable)
        for _ in range(n):
            key = place[at]
            for _ in range(wide):
                key = mix(key + registers[at, r].astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(r))
                r += 1
            keys.append(key.view(np.int64))
            rows.append(at)
    return np.concatenate(rows), np.concatenate(keys)


def _split_hot(row: np.ndarray, key: np.ndarray, hot: np.ndarray, n: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys with each hot key replaced by keys with one more field: page, volume, issue, year (also as the year after the one before).

    A pair that is accepted (see :func:`_one_publication`) shares one of them, so none is lost.
    """
    at = np.isin(key, hot)
    rows, keys = [row[~at]], [key[~at]]
    part, base = row[at], key[at].view(np.uint64)
    for k, (f, more) in enumerate((("page", 0), ("volume", 0), ("issue", 0), ("year", 0), ("year", 1)), 1):
        value = n[f][part].astype(np.int64)
        known = value >= 0
        tag = 4 if f == "year" else k
        keys.append(mix(base[known] ^ mix((value[known] + more).view(np.uint64) * np.uint64(8) + np.uint64(tag))).view(np.int64))
        rows.append(part[known])
    return np.concatenate(rows), np.concatenate(keys)


def _registers(column: pa.Array) -> np.ndarray:
    """Registers as a matrix; the values have one length, so their bytes lie one behind the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = np.frombuffer(column.buffers()[2], np.uint8)
    start = column.offset * REGISTERS
    return data[start : start + len(column) * REGISTERS].reshape(-1, REGISTERS)


def _prepared(batch: pa.RecordBatch) -> pa.RecordBatch:
    c = {n: batch.column(n).to_pylist() for n in ("title", "names", "initial", "container_title")}
    words = [normal(t) for t in c["title"]]
    families = [("|".join(map(fold, x.split("|"))) if "|" in x else fold(x)) if x else "" for x in c["names"]]
    first = np.array([_hash(f"{x.partition('|')[0]} {i}") if x and i and "study group" not in x else 0 for x, i in zip(families, c["initial"])], dtype=np.uint64)
    journal = [_journal(x) if x else "" for x in c["container_title"]]
    reg, size = sketches(*text_elements(words), len(words))
    registers = pa.Array.from_buffers(pa.binary(REGISTERS), len(words), [None, pa.py_buffer(np.ascontiguousarray(reg))]).cast(pa.binary())
    cols = [batch.column("rid"), batch.column("id"), pa.array(words, pa.string()), pa.array(families, pa.string()), pa.array(journal, pa.string())]
    cols += [batch.column(x) for x in ("page", "volume", "issue", "year", "doi")] + [pa.array(size.astype(np.int32)), registers, pa.array(first.view(np.int64))]
    names = [x.split()[0] for x in PREPARED.split(", ")][:-1]
    if "title_hash" in batch.schema.names:
        cols += [batch.column(x) for x in ("date_code", "source", "rank", "title_hash")] + [pa.array([evident_damage(t) for t in c["title"]], pa.bool_())]
        names += [x.split()[0] for x in EXTRA.split(", ")]
    return pa.RecordBatch.from_arrays(cols, names=names)


def prepare(records: DataFrame, rank: Column | None = None) -> DataFrame:
    """One row a row of ``records``: folded fields and sketch. A null id gives no row. rank: of a record's sources; given, the columns ``EXTRA`` come too."""
    date = "get(issued.date_parts, 0)"
    # a date that is impossible in a part of it says nothing at all
    plausible = f"get({date}, 0) between {EARLIEST} and {LATEST} and coalesce(get({date}, 1) between 1 and 12, true) and coalesce(get({date}, 2) between 1 and 31, true)"
    doi = F.regexp_replace(F.regexp_extract(F.lower("doi"), r"10\.\d{4,9}/\S+", 0), r"[.,;)]+$", "")
    rows = records.where("id is not null").select(
        F.monotonically_increasing_id().alias("rid"), "id", "title", "container_title",
        F.expr("concat_ws('|', transform(author, a -> coalesce(a.family, a.literal, '')))").alias("names"),
        F.expr("coalesce(lower(substr(trim(get(author, 0).given), 1, 1)), '')").alias("initial"),
        _number("page").alias("page"), _number("volume").alias("volume"), _number("issue").alias("issue"),
        F.expr(f"if({plausible}, get({date}, 0), -1)").alias("year"),
        F.coalesce(F.xxhash64(F.nullif(doi, F.lit(""))) * F.when(doi != "", 1), F.lit(0)).alias("doi"),
        *([] if rank is None else [
            # year, month and day in one number; 99 stands for an unknown part
            F.expr(f"coalesce(get({date}, 0) * 10000 + coalesce(get({date}, 1), 99) * 100 + if(get({date}, 1) is null, 99, coalesce(get({date}, 2), 99)), -1)").alias("date_code"),
            F.expr("coalesce(get(meta.sources, 0).db_name, get(meta.sources, 1).db_name)").alias("source"), rank.alias("rank"),
            F.xxhash64(F.trim("title")).alias("title_hash"),
        ]),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_prepared(batch) for batch in batches if batch.num_rows)

    mapped = rows.mapInArrow(run, PREPARED.removesuffix(", content bigint") + (", " + EXTRA if rank is not None else ""))
    return mapped.withColumn("content", F.xxhash64("words", "families", "journal", "page", "volume", "issue", "year", "doi"))


def first_of_same(prepared: DataFrame, rows: int) -> DataFrame:
    """(a, b): every row with the first one that has its DOI, its id, or equals it in all compared fields; once for each of these."""
    keys = prepared.select("rid", F.explode(F.array("doi", "content", F.xxhash64("id"))).alias("key")).where("key <> 0")
    first = keys.groupBy("key").agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_one(keys, first, "key", "n", HOT_LEAST, 3 * rows).where("rid > a").select("a", F.col("rid").alias("b"))


#: Whether a row has fields enough that :func:`_one_publication` could accept it with anything; what it accepts with another row it accepts with a copy of itself.
TAKES_PART = f"""size > 0 and (page >= 0 and (families <> '' or volume >= 0 or issue >= 0) or families <> '' and (volume >= 0 or issue >= 0 or year > 0)
    or volume >= 0 and (issue >= 0 or year > 0) or year > 0 and journal <> '' and size >= {LONG_TITLE})"""


def candidates(prepared: DataFrame, rows: int) -> DataFrame:
    """Pairs (a < b) of row numbers, once for each band key that they share, that do not clash in a known page, volume, issue or DOI, or by more than one year.

    Rows that nothing could be accepted with stay out. Of rows equal in all compared fields a task lets the first of each batch take part, and of
    those met several times none in later batches, so that a group of copies, however large, sends few rows to its buckets. Nothing is lost by it: copies that take part are
    one publication by the same rules, and :func:`first_of_same` links them. rows: how many there are.
    """
    hot = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            content, at, times = np.unique(b.column("content").to_numpy(), return_index=True, return_counts=True)
            new = ~np.isin(content, often)
            often = np.union1d(often, content[times > 2])
            b = b.take(pa.array(np.sort(at[new])))
            n = {x: b.column(x).to_numpy() for x in ("rid", "page", "volume", "issue", "year", "size", "first", "doi")}
            journal = np.array([int.from_bytes(x.encode()) for x in b.column("journal").to_pylist()], dtype=np.int64)
            row, key = _band_keys(_registers(b.column("registers")), n["size"], {"p": n["page"], "v": n["volume"], "a": n["first"], "j": journal})
            if len(hot):
                row, key = _split_hot(row, key, hot, n)
            # what is known of the fields, in one number; a value of zero is unknown
            value = {"year": np.maximum(n["year"], 0).astype(np.int64), "doi": np.where(n["doi"] == 0, 0, 1 + (n["doi"].view(np.uint64) % np.uint64(127)).astype(np.int64))}
            known = sum(value.get(x, (n[x].astype(np.int64) + 1) % (1 << bits)) << shift for x, shift, bits in KNOWN)
            yield pa.RecordBatch.from_arrays([pa.array(n["rid"][row]), pa.array(key), pa.array(known[row])], names=["r", "key", "known"])

    part = prepared.where(TAKES_PART).select("rid", "journal", "page", "volume", "issue", "year", "doi", "size", "registers", "first", "content")
    limit = max(HOT_BUCKET, rows // 10_000)
    if rows > limit:
        sampled = part.where(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(SAMPLE)) == 0).mapInArrow(run, "r bigint, key bigint, known bigint")
        # at most bands * 10,000 keys can be hot
        hot = np.sort(np.array([r[0] for r in sampled.groupBy("key").count().where(F.col("count") > limit // SAMPLE).collect()], dtype=np.int64))
    keys = part.mapInArrow(run, "r bigint, key bigint, known bigint")
    x, y = (keys.select("key", F.col("r").alias(k), F.col("known").alias(f"k{k}")) for k in "ab")
    field = {n: [f"(shiftright(k{k}, {shift}) & {(1 << bits) - 1})" for k in "ab"] for n, shift, bits in KNOWN}
    agree = " and ".join(f"({p} = {q} or {p} = 0 or {q} = 0)" for n, (p, q) in field.items() if n != "year")
    p, q = field["year"]
    # a hash table of one partition of keys spares both sides a sort; hot keys were split above
    return x.join(y.hint("shuffle_hash"), "key").where(f"a < b and {agree} and (abs({p} - {q}) <= 1 or {p} = 0 or {q} = 0)").select("a", "b")


SIDE = ["words", "families", "journal", "page", "volume", "issue", "year", "doi", "size", "registers"]


def verified(prepared: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those ``pairs`` (a, b) that are one publication.

    Rows of one id are. Known and different DOIs, pages, volumes or issues, or (without a common DOI) plausible years more than one apart, decide against it.
    A common DOI decides for it unless the titles have nothing in common. Otherwise the titles
    must agree: by estimate, then word for word (slips, insertions, lost parts and order do not count; two or more words
    replaced do), more strictly where no page is at hand.
    """
    side = prepared.select("rid", F.struct(F.xxhash64("id").alias("idh"), *SIDE).alias("x"))
    # the sides have one row a key, so a hash table of a partition is no larger than the partition, and no wide row is sorted
    left, right = (side.select(F.col("rid").alias(k), F.col("x").alias(n)).hint("shuffle_hash") for k, n in (("a", "x"), ("b", "y")))
    both = pairs.join(left, "a").join(right, "b")
    both = both.select("a", "b", F.expr("x.idh = y.idh").alias("same_id"), *[F.col(f"{s}.{c}").alias(f"{c}_{n}") for s, n in (("x", "a"), ("y", "b")) for c in SIDE])
    both = both.withColumn("cited", (F.col("doi_a") != 0) & (F.col("doi_a") == F.col("doi_b")))
    known = " and ".join(f"({c}_a = {c}_b or {c}_a < 0 or {c}_b < 0)" for c in ("page", "volume", "issue"))
    both = both.where(f"same_id or {known} and (doi_a = doi_b or doi_a = 0 or doi_b = 0) and (cited or year_a < 0 or year_b < 0 or abs(year_a - year_b) <= 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = {x: batch.column(x).to_numpy() for x in batch.schema.names if x.rpartition("_")[0] in ("page", "volume", "issue", "year", "size")}
            same = {x: (n[f"{x}_a"] == n[f"{x}_b"]) & (n[f"{x}_a"] >= 0) for x in ("page", "volume", "issue")}
            dated = ((n["year_a"] > 0) & (n["year_b"] > 0)).astype(int) + ((n["year_a"] > 0) & (n["year_a"] == n["year_b"]))
            reg = [_registers(batch.column(f"registers_{s}")) for s in "ab"]
            common = joint_estimate(reg[0], reg[1], n["size_a"], n["size_b"])
            share = common / np.maximum(np.minimum(n["size_a"], n["size_b"]), 1)
            cited = batch.column("cited").to_numpy(zero_copy_only=False)
            # the same DOI and nothing against it is enough unless the titles have nothing in common
            sure = batch.column("same_id").to_numpy(zero_copy_only=False) | cited & ((share >= CONTAINED_SAME_PAGE) | same["page"] | (np.minimum(n["size_a"], n["size_b"]) < 8))
            maybe = np.flatnonzero(~sure & ~cited & (share >= np.where(same["page"], CONTAINED_SAME_PAGE, CONTAINED)))
            part = batch.take(pa.array(maybe))
            text = zip(*(part.column(f"{x}_{s}").to_pylist() for x in ("words", "families", "journal") for s in "ab"))
            ok = [i for i, t in zip(maybe.tolist(), text) if _one_publication(*t, same["page"][i], same["volume"][i], same["issue"][i], dated[i])]
            keep = pa.array(sorted([*ok, *np.flatnonzero(sure).tolist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _one_publication(words_a: str, words_b: str, families_a: str, families_b: str, journal_a: str, journal_b: str, page: bool, volume: bool, issue: bool, dated: int) -> bool:
    """The decision on a pair without a clash; page, volume, issue: known and the same; dated: 1 if both years are known, 2 if they are the same.

    What is accepted shares a page, a volume, an issue or a year within one, and each side would be accepted with a copy of itself: :data:`TAKES_PART` and :func:`_split_hot` rest on it.
    """
    if journal_a and journal_b and journal_a != journal_b:
        return False
    people = bool(families_a) and families_a == families_b
    if not people and families_a and families_b:
        fa, fb = set(families_a.split("|")) - {""}, set(families_b.split("|")) - {""}
        people = bool(fa & fb)
        if fa and fb and not people and not any("study group" in x for x in fa | fb):
            return False
    only_a, only_b, same = unmatched(words_a, words_b) if words_a != words_b else ([], [], sum(len(w) > 2 for w in words_a.split()))
    less, more = sorted((len(only_a), len(only_b)))
    if page:
        # title, author, volume and issue must not all be missing as evidence
        return less <= 2 and same >= 1 and (people or volume or (issue and less <= 1))
    if marks(words_a) != marks(words_b) or less > 1 or same < 3 or marking(only_a + only_b):
        return False
    if people:
        return volume or issue or (dated > 0 and more <= 1)
    if dated == 2 and more == 0 and same >= 6 and journal_a and journal_a == journal_b:
        return True  # a long title that is the same in a journal and year
    return volume and (issue or dated > 0) and journal_a == journal_b and (more <= 3 or dated > 0 and issue)


def linked_rows(prepared: DataFrame, rows: int, ws: Workspace) -> DataFrame:
    """``(rid, group)`` of every row of ``prepared`` (so many rows) that is linked to another one."""
    with ws.tidy():
        found = candidates(prepared, rows)
    pairs = ws.write(found.unionByName(first_of_same(prepared, rows)).distinct(), "pairs")
    links = ws.write(verified(prepared, pairs), "links")
    ws.drop(pairs)
    groups = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), ws)
    ws.drop(links)
    return groups.select(F.col("id").alias("rid"), F.col("group_id").alias("group"))


def publication_groups(records: DataFrame) -> DataFrame:
    """``(id, group)`` of every record that has another row of its publication; each id once.

    A group may be one id whose row is repeated. Repeated rows of an id count once. A null or empty title is no evidence; such a
    record is found by its DOI. An empty table gives no row. Other columns of ``records`` are ignored.
    """
    ws = Workspace(records.sparkSession, "neardup")
    prepared, rows = ws.counted(prepare(records), "prepared")
    # repeated rows of one id are equal in content and were linked
    return prepared.select("rid", "id").join(linked_rows(prepared, rows, ws), "rid").select("id", "group").distinct()


def near_duplicate_pairs(records: DataFrame) -> DataFrame:
    """``(record_a, record_b)``, a < b: every pair within a group of records of one publication."""
    groups = publication_groups(records)
    x, y = groups.select("group", F.col("id").alias("record_a")), groups.select("group", F.col("id").alias("record_b"))
    return x.join(y, "group").where("record_a < record_b").select("record_a", "record_b")
