"""A table that is changed by key: only the buckets that a change touches are written again, and one manifest tells what counts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from .operators.graph_writes import upsert


class ConflictError(RuntimeError):
    """Another writer has changed the table meanwhile; nothing was changed, the change can be repeated."""


class MergeTable:
    """Rows in hash buckets of the columns ``bucket_by`` under a folder that driver and executors share.

    A change writes the buckets it touches to a folder of its own and then puts a new manifest in place by one rename; the manifest names, for each bucket, the folder that counts. Readers see the old
    state or the new one. A run that is lost before the rename leaves files that no manifest names, and is repeated. Of two writers at once the second gets a ConflictError.
    A writer that numbers its changes (a stream: its batches) has each applied once, however often it is repeated.

    The driver holds the manifest, one short entry a bucket. Choose ``buckets`` so that a bucket is some hundred megabytes; a bucket that a hot key fills is split over several files and tasks.
    The folder's file system must rename atomically. Null keys are a key like others.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_by: list[str], schema: StructType, buckets: int = 64):
        self.spark, self.path, self.bucket_by, self.schema, self.buckets = spark, path, list(bucket_by), schema, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        found = self._manifest()
        if found and (found["bucket_by"], found["buckets"]) != (self.bucket_by, buckets):
            raise ValueError(f"the table at {path} has {found['buckets']} buckets of {found['bucket_by']}")

    # reading

    def read(self) -> DataFrame:
        """The rows of the newest manifest."""
        return self._rows(self._manifest()["files"] if self._manifest() else {})

    @property
    def version(self) -> int:
        """How many changes were made."""
        found = self._manifest()
        return found["version"] if found else 0

    # changing

    def upsert(self, rows: DataFrame, key: list[str], order: str, writer: str | None = None, number: int = 0) -> bool:
        """Puts rows in by key, which includes the bucket columns: a new row wins over a stored one, of new ones the last by ``order``."""
        if not set(self.bucket_by) <= set(key):
            raise ValueError("rows of one key must lie in one bucket")
        return self.change(rows, lambda old, new: upsert(old, new, key, order), writer, number)

    def replace(self, rows: DataFrame, writer: str | None = None, number: int = 0) -> bool:
        """Puts rows in place of all stored ones that agree with any of them in the bucket columns."""
        return self.change(rows, lambda old, new: self._without(old, new).unionByName(new), writer, number)

    def delete(self, keys: DataFrame, writer: str | None = None, number: int = 0) -> bool:
        """Removes the rows that agree with any of keys in the bucket columns."""
        return self.change(keys, self._without, writer, number)

    def change(self, rows: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None, number: int = 0) -> bool:
        """Sets the buckets that ``rows`` fall into to fold(their stored rows, rows). False if this writer's change of that number, or a later one, was applied before."""
        last = self._manifest() or {"version": 0, "files": {}, "seen": {}}
        if writer is not None and last["seen"].get(writer, -1) >= number:
            return False
        name = f"c-{uuid.uuid4().hex}"
        inbox = f"{self.path}/in-{name}"
        rows.withColumn("_bucket", self._bucket()).write.parquet(inbox)  # read twice below
        new = self.spark.read.schema(StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])).parquet(inbox)
        touched = {str(r[0]) for r in new.select("_bucket").distinct().collect()}  # at most one value a bucket
        old = self._rows({b: c for b, c in last["files"].items() if b in touched})
        done = fold(old, new.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", self._bucket())
        done.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = {p.split("=")[1] for p in self._names(f"{self.path}/{name}") if p.startswith("_bucket=")}
        if not written <= touched:
            raise ValueError("the change puts rows into buckets that it didn't read")
        files = {b: c for b, c in last["files"].items() if b not in touched} | {b: name for b in written}
        seen = last["seen"] | ({writer: number} if writer is not None else {})
        self._publish({"version": last["version"] + 1, "bucket_by": self.bucket_by, "buckets": self.buckets, "files": files, "seen": seen})
        self._remove(inbox)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep`` and the folders that only they name; folders of changes under way are left alone. How many folders went."""
        names = sorted(n for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))
        gone, kept = names[:-keep], names[-keep:]
        folders = lambda ns: {c for n in ns for c in self._load(n)["files"].values()}
        dead = folders(gone) - folders(kept)
        for c in dead:
            self._remove(f"{self.path}/{c}")
        for n in gone:
            self._remove(f"{self.path}/manifest/{n}")
        return len(dead)

    # helpers

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _without(self, old: DataFrame, new: DataFrame) -> DataFrame:
        gone = new.select(*[F.col(c).alias(f"_{c}") for c in self.bucket_by]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.bucket_by]
        return old.join(gone, same, "left_anti")

    def _rows(self, files: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{c}/_bucket={b}" for b, c in sorted(files.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()[0])

    def _manifest(self) -> dict | None:
        names = sorted(n for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))
        return self._load(names[-1]) if names else None

    def _publish(self, manifest: dict) -> None:
        final = self._path(f"{self.path}/manifest/{manifest['version']:012d}.json")
        draft = self._path(f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        qualified = self._fs().makeQualified
        try:
            files.rename(qualified(draft), qualified(final), no_overwrite)
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {manifest['version']} exists") from e
            raise


def stream_into(rows: DataFrame, table: MergeTable, key: list[str], order: str, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Upserts all that a stream has, batch by batch, each once."""
    put = lambda batch, number: table.upsert(batch, key, order, writer, number)
    return rows.writeStream.foreachBatch(lambda batch, number: (put(batch, number), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
