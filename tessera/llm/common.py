"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a local session, whose driver and executors are one
    process, gets a folder of its own; on a cluster no folder can be assumed to be shared, and the call fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Workspace:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """The table as written. by: a column that deals the rows into folders, so that reads of one value touch its folder only."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{name}")
        self.release()
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def release(self) -> None:
        """Lets Spark remove the shuffle files of steps whose results are written; it does so once their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables that are no longer needed."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. An all-ASCII text takes the quicker built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


_kept: dict[str, Callable[[], None]] = {}


def keep_only(name: str, release: Callable[[], None] | None = None) -> None:
    """For tasks in Python: of what operators keep in a worker from task to task, only that of ``name`` stays, so that a chain of operators takes no more memory than one. ``release`` lets go of it."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()
        gc.collect()
    if release:
        _kept[name] = release


def free_name(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
