"""Size bounds read from the session, and lineage cutting for iterative jobs."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS = ("plumbline.groupRows", 4_000_000)       # rows one window or buffer may hold
BROADCAST_ROWS = ("plumbline.broadcastRows", 200_000)  # rows of a lookup side that may be broadcast
BROADCAST_BYTES = 128 << 20                            # and its size
CHUNK_ROWS = ("plumbline.chunkRows", 65_536)          # calendar bins per window partition
SERIES_POINTS = ("plumbline.seriesPoints", 2_000_000)  # points one per-series task may hold


def bound(spark: SparkSession, setting: tuple[str, int]) -> int:
    return int(spark.conf.get(setting[0], str(setting[1])))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize through the shared checkpoint folder so that lost executors do not replay all rounds."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


_scratch: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this process has made, once no result that reads them is needed any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, inside the shared checkpoint folder of the cluster; see ``clear_scratch``."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="plumbline-")
    _scratch.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def use_all_cores(df: DataFrame) -> DataFrame:
    """Use all cores for Python work over few input splits; tables with enough splits are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


TASK_ROWS = 500_000      # rows that one task of an iterative fit reads


def spread(df: DataFrame) -> DataFrame:
    """Rows in as many tasks as their number needs, where the input's splits hold more; other tables are left alone."""
    rows = df.count()
    return df.repartition(math.ceil(rows / TASK_ROWS)) if rows > TASK_ROWS * df.rdd.getNumPartitions() else df


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Hold rows that an iterative fit reads many times; lost blocks are computed again."""
    held = df.persist()
    try:
        yield held
    finally:
        held.unpersist()
