"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is
local (tests) a temporary folder is made and set; on a cluster an unset folder is an error. A table
written there cuts lineage: a lost executor costs at most the tasks that were running, never what
was written. Results read such tables lazily, so a run's folder stays until ``sweep`` removes it.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts by bytes: ten thousand rows, Spark's other bound, may be any size.

    The setting stays with the session, as results are run after the call that made them.
    """
    told = spark.conf.get(BATCHES, "64m")
    if not told.rstrip("b").isdecimal() or int(told.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def trim() -> None:
    """Gives the driver's freed memory back: a model's arrays are large and gone after it is sent."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strataql-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def sweep(spark: SparkSession, hours: float) -> int:
    """Removes the folders of runs that wrote nothing for so many hours; how many they were."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now, gone = time.time() * 1000, 0
    for run in files.listStatus(root):
        if re.fullmatch(r"[a-z_]+-[0-9a-f]{32}", run.getPath().getName()):
            last = max([run.getModificationTime(), *(t.getModificationTime() for t in files.listStatus(run.getPath()))])
            if now - last >= hours * 3_600_000:
                gone += files.delete(run.getPath(), True)
    return gone


class Workspace:
    """A folder of its own under the shared root for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write a table and return it as read back (same schema, partition columns last)."""
        path = f"{self.path}/{name}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        schema = df.schema
        if partition_by:
            keep = [f for f in schema.fields if f.name not in partition_by]
            schema = type(schema)(keep + [schema[c] for c in partition_by])
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing returned reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
