"""Building and checking mutation logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEL, MAX_KEY_BYTES, PUT, BatchTooBig, EmptyKey, EngineOptions, KeyTooLong

COLUMNS = ("key", "version", "seq", "op", "value", "expires_at")


def puts(rows: DataFrame, *, key: str = "key", value: str = "value", ttl_seconds: int | None = None, now: int | None = None) -> DataFrame:
    """key, op, value, expires_at of upserts; with a time to live, counted from `now` in epoch seconds."""
    expires = F.lit(None).cast("long") if ttl_seconds is None else (F.lit(now) if now is not None else F.unix_timestamp()) + ttl_seconds
    return rows.select(F.col(key).cast("binary").alias("key"), F.lit(PUT).alias("op"), F.col(value).cast("binary").alias("value"), expires.cast("long").alias("expires_at"))


def deletes(rows: DataFrame, *, key: str = "key") -> DataFrame:
    """Tombstones; an empty value is not one."""
    return rows.select(F.col(key).cast("binary").alias("key"), F.lit(DEL).alias("op"), F.lit(None).cast("binary").alias("value"), F.lit(None).cast("long").alias("expires_at"))


def check(batch: DataFrame, options: EngineOptions) -> tuple[int, int]:
    """Raises on empty or long keys and on batches over the limits; (rows, bytes).

    One aggregation over the batch.
    """
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    r = batch.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("size"),
        F.coalesce(F.max(F.octet_length("key")), F.lit(1)).alias("longest"),
        F.coalesce(F.sum(F.when(F.coalesce(F.octet_length("key"), F.lit(0)) == 0, 1).otherwise(0)), F.lit(0)).alias("empty"),
    ).first()
    if r["empty"]:
        raise EmptyKey(f"{r['empty']} rows have an empty key")
    if r["longest"] > MAX_KEY_BYTES:
        raise KeyTooLong(f"a key has {r['longest']} bytes")
    if r["n"] >= options.max_batch_count or r["size"] >= options.max_batch_size:
        raise BatchTooBig(f"{r['n']} rows of {r['size']} bytes")
    return r["n"], r["size"]


def grouped(batches: Sequence[DataFrame]) -> DataFrame:
    """Batches as one, with the batch's place and the row's place in it: later batches win."""
    tagged = [b.select("key", "op", "value", "expires_at", F.lit(i).cast("long").alias("batch"), F.monotonically_increasing_id().alias("place")) for i, b in enumerate(batches)]
    return reduce(DataFrame.unionByName, tagged)


def stamped(batch: DataFrame, version: int) -> DataFrame:
    """A batch as log rows of one version; seq is the place in the batch (partition, then row).

    Rows of `grouped` batches are numbered by batch, then place.
    """
    if "batch" in batch.columns:
        w = Window.partitionBy("key").orderBy("batch", "place")  # only rows of one key compete
        return batch.select("key", F.lit(version).cast("long").alias("version"), F.row_number().over(w).cast("long").alias("seq"), "op", "value", "expires_at")
    return batch.select("key", F.lit(version).cast("long").alias("version"), F.monotonically_increasing_id().alias("seq"), "op", "value", "expires_at")
