"""The folds of the event log as streams: late and repeated events change nothing but what they should."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evisift.plans.lineage import Workspace


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or a single one, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        # a stream reads folders
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def latest_state(events: DataFrame, keys: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The last write of each key so far. The maximum does not depend on the order of arrival, so late events are right without a watermark."""
    g = events.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v"))
    return g.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per tumbling window and key; windows close when the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key: events no further apart than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Each key once: of rows that arrive within the watermark of each other the first."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """``(key, before, after, *order)`` of each change of ``state`` of a key, in the order of ``order`` within a batch; what is kept between batches is the last state of each key.

    A row that arrives after later ones of its key were processed counts where it arrives. A null state is no change.
    """
    kinds = dict(events.dtypes)
    columns = [key, "before", "after", *order]
    schema = f"{key} {kinds[key]}, before string, after string, " + ", ".join(f"{c} {kinds[c]}" for c in order)

    def run(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        rows = rows[rows[state].notna()]
        if len(rows):
            last = kept.get[0] if kept.exists else None
            before = rows[state].shift(1)
            before.iloc[0] = last
            changed = rows[state] != before
            out = rows.assign(before=before, after=rows[state])[changed]
            kept.update((rows[state].iloc[-1],))
            yield out[columns]

    return events.select(key, state, *[c for c in order if c not in (key, state)]).groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, label: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return its result; offsets and state lie in the shared folder.

    complete: the table after the last batch, written anew by each. append: the closed results of all batches. update: each batch writes the rows that
    it changed, and the last row of each of ``keys`` is the result, so a small batch writes little however much has been seen.
    """
    spark = df.sparkSession
    ws = Workspace(spark, f"stream-{label}")
    out = f"{ws.root}/out"
    schema = df.schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/last" if mode == "complete" else f"{out}/batch={epoch:06d}")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{ws.root}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    if mode == "update":
        rest = [c for c in schema.names if c not in (keys or [])]
        every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
        last = every.groupBy(*(keys or [])).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
        return last.select(*[F.col(f"_v.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
    return spark.read.schema(schema).parquet(f"{out}/last")
