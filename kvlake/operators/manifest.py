"""The log of table changes: fold to the live tables, check against files, change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CREATE, DELETE, TABLE_META, BadManifest

MAGIC = "KVLAKE"
VERSION = 1
#: A rewrite is due beyond this many deletions, and this many times the live tables.
REWRITE_DELETIONS = 10_000
REWRITE_RATIO = 10


def fold(changes: DataFrame, order: tuple[str, ...] = ("set_id", "change_no")) -> DataFrame:
    """table_id, level (and what else the log says of them) of tables whose newest change creates them."""
    w = Window.partitionBy("table_id").orderBy(*[F.desc(c) for c in order])
    newest = changes.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    more = [f.name for f in TABLE_META if f.name in changes.columns]
    return newest.where(F.col("op") == CREATE).select("table_id", "level", *more)


def faults(changes: DataFrame, order: tuple[str, ...] = ("set_id", "change_no")) -> DataFrame:
    """Changes that cannot be applied: creating a table that exists, deleting one that does not."""
    before = F.lag("op").over(Window.partitionBy("table_id").orderBy(*order))
    marked = changes.withColumn("before", before)
    twice = (F.col("op") == CREATE) & (F.coalesce("before", F.lit("")) == CREATE)
    unknown = (F.col("op") == DELETE) & (F.coalesce("before", F.lit(DELETE)) == DELETE)
    return marked.where(twice | unknown).withColumn("fault", F.when(twice, "exists").otherwise("unknown")).drop("before")


def checked_fold(changes: DataFrame) -> DataFrame:
    """`fold`, after all changes were found to fit."""
    if not (bad := faults(changes)).isEmpty():
        raise BadManifest(f"the manifest has changes that don't fit, such as {bad.first()}")
    return fold(changes)


def reconcile(live: DataFrame, files: DataFrame) -> DataFrame:
    """table_id, state: `missing` has no file (an error), `orphan` is a file no change knows (to be deleted)."""
    missing = live.join(files, "table_id", "left_anti").select("table_id", F.lit("missing").alias("state"))
    orphan = files.join(live, "table_id", "left_anti").select("table_id", F.lit("orphan").alias("state"))
    return missing.unionByName(orphan)


def change_set(new: DataFrame, gone: DataFrame) -> DataFrame:
    """table_id, op, level of a compaction: its new tables created, its inputs deleted."""
    return new.select("table_id", F.lit(CREATE).alias("op"), "level").unionByName(gone.select("table_id", F.lit(DELETE).alias("op"), F.lit(None).cast("int").alias("level")))


def rewrite_due(creations: int, deletions: int) -> bool:
    """The log is mostly deletions, so one set that creates the live tables would replace it."""
    return deletions > REWRITE_DELETIONS and deletions > REWRITE_RATIO * (creations - deletions)


def snapshot(changes: DataFrame) -> DataFrame:
    """One set of changes that creates the live tables."""
    live = fold(changes)
    return live.select(F.lit(0).cast("long").alias("set_id"), F.col("table_id").alias("change_no"), "table_id", F.lit(CREATE).alias("op"), *[c for c in live.columns if c != "table_id"])


def check_header(magic: str, version: int, checksum: int, actual: int) -> None:
    """Raises BadManifest unless a stored header and checksum are what they should be."""
    if magic != MAGIC:
        raise BadManifest("bad magic")
    if version != VERSION:
        raise BadManifest(f"unsupported version {version}")
    if checksum != actual:
        raise BadManifest("bad checksum")
