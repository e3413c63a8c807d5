"""Cutting lineage with tables written to the shared folder of the cluster.

A plan that loops or that is read several times is written as Parquet under
``spark.checkpoint.dir`` and read back: other executors can read it when one is
lost, the columns stay pruned, and nothing depends on a machine-local folder.
Where the setting is unset (tests, local runs) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Whether shuffle files are removed when the query that wrote them has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or a folder of our own in local mode."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="evisift-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Written tables of one call, under one folder.

    Tables dropped with :meth:`drop` go at once; what the caller's result still
    reads is removed when the Python process of the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/evisift-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._close)

    def counted(self, df: DataFrame, label: str = "t") -> tuple[DataFrame, int]:
        """Write ``df``; the written table and its number of rows, counted while it is written."""
        seen = Observation(f"rows-{self.n}")
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
        return out, seen.get["n"]

    def write(self, df: DataFrame, label: str = "t", **options: int | str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table. options: of the writer."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{label}"
        with self.tidy():
            # sketches, texts and numbers of rows hardly repeat: building dictionaries costs more than it saves
            df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._evisift_path = path  # type: ignore[attr-defined]
        return out

    def apart(self, table: DataFrame) -> DataFrame:
        """The written ``table``, read so that each file is a partition of its own; the settings of the caller's session stay as they are."""
        own = SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())
        own.conf.set("spark.sql.files.openCostInBytes", 1 << 40)
        return own.read.schema(table.schema).parquet(table._evisift_path)  # type: ignore[attr-defined]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_evisift_path", None)
            if path:
                _remove(self.spark, path)

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Queries begun in here leave no shuffle files behind once they have ended."""
        before = self.spark.conf.get(_TIDY, None)
        self.spark.conf.set(_TIDY, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_TIDY, before) if before is not None else self.spark.conf.unset(_TIDY)

    def _close(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the session has ended
            local = self.root.removeprefix("file://")
            if self.root.startswith(("file:", "/")) and os.path.isdir(local):
                shutil.rmtree(local, ignore_errors=True)
