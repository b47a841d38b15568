"""Runs of streams to their end, for queries that return a batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import winners
from ..schema import DEL, PUT
from .upsert import upsert_batches


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kvlake-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


class Generations:
    """A keyed table as a folder of generations, one a micro-batch, of which the newest finished one is the table.

    All that is known is in the folder, so a restarted stream goes on from what it has: batch n starts
    from the newest generation before n, also when it runs again after a failure. Generations that are no longer needed
    for that are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _finished(self) -> list[int]:
        if not self._fs.exists(self._at(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.folder))]
        made = [int(n.rpartition("-")[2]) for n in names if n.startswith("generation-")]
        return sorted(g for g in made if self._fs.exists(self._at(f"{self.folder}/generation-{g}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table, or what it was before a batch; None if there was none."""
        found = [g for g in self._finished() if before is None or g < before]
        return self.spark.read.parquet(f"{self.folder}/generation-{found[-1]}") if found else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/generation-{batch_id}")
        for g in [g for g in self._finished() if g < batch_id][:-1]:  # the one before stays, in case the batch runs again
            self._fs.delete(self._at(f"{self.folder}/generation-{g}"), True)


def folded_events(spark: SparkSession, sf_dir: str, rows_per_batch_files: int = 1, folder: str | None = None) -> DataFrame:
    """key, event_id, op, value: the newest row of each key after the whole stream.

    Each micro-batch is merged into a new generation of the table; the last
    generation's winners are the state. A folder that an earlier run has left is gone on with.
    """
    folder = folder or scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A file stream watches folders; the table is one file or folder beside others.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", rows_per_batch_files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    log = source.select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.col("ts").alias("version"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", DEL).otherwise(PUT).alias("op"), "value",
    )
    table = Generations(spark, f"{folder}/table")
    stream = log.writeStream.foreachBatch(upsert_batches(table.read, table.write)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = table.read()
    if rows is None:
        rows = winners(spark.createDataFrame([], "key string, version timestamp_ntz, seq long, op string, value double"))
    return rows.select("key", F.col("seq").alias("event_id"), "op", "value")
