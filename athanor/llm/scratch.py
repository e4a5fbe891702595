"""Intermediate tables in the folder that driver and executors share.

`spark.checkpoint.dir` names that folder; where it is unset and the master is local (tests, notebooks) a
temporary folder of the driver is set for the session.  A cluster without the setting is an error, since its executors
share no local folder.  A written table survives lost executors and cuts the lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the session, or a fresh temporary one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="athanor-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_open: list[Scratch] = []


def drop_scratch() -> None:
    """Remove the intermediate tables of all calls so far.  Results that were not written anywhere can't be read afterwards; a
    long session calls this when it has written what it wants to keep.  At the interpreter's end it happens anyway."""
    while _open:
        _open.pop().drop()


class Scratch:
    """Tables of one operator call, under a folder of their own in the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write `df` as Parquet and return the table read back."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, name: str = "") -> None:
        """Remove one table, or everything of this call."""
        with contextlib.suppress(Exception):  # the session may have ended
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(drop_scratch)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go now: Spark removes them once its driver has collected what refers
    to them, which on a driver with much memory may be long after."""
    for _ in range(2):  # a reference queue is emptied only after the collection that fills it
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
