"""Folds over an event log: the total order is (ts, id); repeated ids count once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rest(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The last row of each key. An aggregate with map-side combining; repeated rows change nothing."""
    rest = _rest(df, keys)
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_write(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The first row of each key."""
    rest = _rest(df, keys)
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def once(df: DataFrame, key: str = "id", order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row an id, the first by ``order``."""
    return first_write(df, [key], [*order, *[c for c in df.columns if c not in (key, *order) and df.schema[c].dataType.typeName() not in ("map", "variant")]])


def sequenced(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Number and previous id of each event within its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("prev", F.lag("id").over(w))


def without(df: DataFrame, event_id: str) -> DataFrame:
    """The log without one event: undo."""
    return df.where(F.col("id") != event_id)


def as_of(df: DataFrame, ts: str) -> DataFrame:
    """The log before a time."""
    return df.where(F.col("ts") < F.lit(ts).cast("timestamp"))


def broken_links(chain: DataFrame) -> DataFrame:
    """Rows of (file, line, digest, prev) whose prev is no digest of an earlier line of their file.

    A self-join on (file, digest) finds the earliest line of the digest; no window over a whole file is held.
    """
    seen = chain.groupBy("file", F.col("digest").alias("prev")).agg(F.min("line").alias("_first"))
    return chain.where("prev is not null").join(seen, ["file", "prev"], "left").where("_first is null or _first >= line").select("file", "line", "digest", "prev")
