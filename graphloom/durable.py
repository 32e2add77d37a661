"""Cutting lineage in storage that every executor shares.

The folder is the session's ``spark.checkpoint.dir``; only in local mode, and
where that is unset, a temporary folder takes its place.

Tables are Parquet rather than checkpoints: a checkpointed plan hands its
estimated size on, and in a loop of joins that estimate is a product of
products, while files have the size they have. So Spark goes on to broadcast
what is small.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete the shuffle files of a write once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_blocks = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables between steps, set up on first use."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="spark-"))
        known = sc.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later jobs don't recompute it.

    Inside a ``Scratch`` block the table lives as long as the block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    if getattr(_blocks, "open", None):
        _blocks.open[-1].tables.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` gave, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "_cut_at", None)
        if path:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """A block at whose end the tables cut inside it are deleted, whoever cut them, but for those given to ``keep``.

    What is kept belongs to the block around, if there is one. In a loop, each
    round is a block that keeps what the next one needs.
    """

    def __enter__(self) -> Scratch:
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []
        if not hasattr(_blocks, "open"):
            _blocks.open = []
        _blocks.open.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a table that ``cut`` gave, for use after the block."""
        self.kept.append(df)
        return df

    def __exit__(self, *error) -> None:
        _blocks.open.pop()
        kept = {df._cut_at for df in self.kept}
        discard(*(df for df in self.tables if df._cut_at not in kept))
        if _blocks.open:
            _blocks.open[-1].tables += self.kept
