"""Reading files of bibliographic records and event logs into DataFrames, and writing them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.sources import formats

FIELDS = "title string, authors array<struct<family:string,given:string,literal:string>>, journal string, year int, volume string, issue string, page string, doi string, pmid string, abstract string, keywords string, language string, best_effort boolean"
SCHEMA = "file string, format string, encoding string, n int, error string, " + FIELDS
_AUTHORS = pa.list_(pa.struct([("family", pa.string()), ("given", pa.string()), ("literal", pa.string())]))
_NAMES = [x.split(" ")[0] for x in "title, authors, journal, year, volume, issue, page, doi, pmid, abstract, keywords, language, best_effort".split(", ")]
_KINDS = {"authors": _AUTHORS, "year": pa.int32(), "n": pa.int32(), "best_effort": pa.bool_()}


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content binary, as the ``binaryFile`` source gives them) parsed: a row a record, or a rejected part with ``error``.

    A map over files: nothing is shuffled. A file of an unknown format gives one row with an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows, kind, used = [], None, None
                try:
                    if path.lower().endswith(".xlsx"):
                        text, kind, used = formats.xlsx(data), "tsv", "xlsx"
                    else:
                        text, used = formats.decode(data)
                        kind = formats.detect(path, text)
                    rows = list(formats.PARSERS[kind](text))
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file must not end the job for the others
                    rows = [*rows, (None, f"{type(e).__name__}: {e}")]
                cols: dict[str, list] = {"file": [path] * len(rows), "format": [kind] * len(rows), "encoding": [used] * len(rows), "n": list(range(len(rows))), "error": [e for _, e in rows]}
                for f in _NAMES:
                    cols[f] = [(r or {}).get(f) for r, _ in rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, _KINDS.get(k, pa.string())) for k, v in cols.items()], names=list(cols))

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("file", "n", "error")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of NDJSON files with ``file``, ``block`` and ``line`` (growing along a file, not its line number); blank lines are skipped, a torn last line of a file is dropped, any other bad line stays with ``bad`` set."""
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    # a large file is read in blocks; where a block begins and the order within it give every line a number that grows along the file
    lines = read.select("_metadata.file_path", "_metadata.file_block_start", "value").withColumn("row", F.monotonically_increasing_id())
    lines = lines.select(F.col("file_path").alias("file"), F.struct("file_block_start", "row").alias("line"), F.col("value").alias("text")).where("trim(text) <> ''")
    body = "ev string, id string, ts timestamp, actor string, seq int, stage string, record_id string, decision string, criteria array<string>, prev string, digest string, _bad string"
    e = lines.withColumn("e", F.from_json("text", body, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = lines.groupBy("file").agg(F.max("line").alias("_last"))
    j = e.join(last, "file").where("not (e._bad is not null and line = _last)")
    return j.select("file", F.col("line.file_block_start").alias("block"), F.col("line.row").alias("line"), "e.*").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def import_records(parsed: DataFrame, existing: DataFrame, key: str = "key") -> DataFrame:
    """``(key, action, sources)``: rows whose key is new are added, others append a source to the record they name; idempotent by file."""
    rows = parsed.where("error is null").select(key, "file").distinct()
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("file")).alias("sources")).join(existing.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").select(key, F.when(F.col("_there"), "append").otherwise("add").alias("action"), "sources")


def ris_text() -> Column:
    """A record (id, title, families, year, journal, volume, page, doi) as RIS lines."""
    line = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{tag}  - "), c, F.lit("\n"))).otherwise("")
    authors = F.concat_ws("", F.transform("families", lambda a: F.concat(F.lit("AU  - "), a, F.lit(",\n"))))
    return F.concat(F.lit("TY  - JOUR\n"), line("TI", F.col("title")), authors, line("PY", F.col("year").cast("string")), line("JO", F.col("journal")), line("VL", F.col("volume")), line("SP", F.col("page")), line("DO", F.col("doi")), F.lit("ER  - \n"))


def tsv_safe(c: Column) -> Column:
    """Text for a cell of a tab-separated view."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ")


def canonical_json(df: DataFrame) -> DataFrame:
    """``json`` of each row with keys in alphabetical order; NaN and infinities become null."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
