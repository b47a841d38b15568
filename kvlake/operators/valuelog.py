"""Large values kept apart from their keys: pointers, discard statistics, garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InvalidRequest

THRESHOLD = 1024
BAD = "checksum mismatch of value-log record "


def is_large(value: Column, threshold: int = THRESHOLD) -> Column:
    return F.octet_length(value) >= threshold


def separate(rows: DataFrame, *, fid: Column, order: tuple[str, ...] = ("key",), threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows with small values inline and pointers for large ones, value log).

    Offsets run within each value-log file; `fid` deals rows to files, so a
    file is as large as its dealing makes it.
    """
    tagged = rows.withColumn("__fid", fid.cast("long"))
    large = tagged.where(is_large(F.col("value"), threshold))
    w = Window.partitionBy("__fid").orderBy(*order)
    size = F.octet_length("value").cast("long")
    placed = large.withColumn("__len", size).withColumn("__offset", F.sum("__len").over(w) - F.col("__len"))
    vptr = F.struct(F.col("__fid").alias("fid"), F.col("__offset").alias("offset"), F.col("__len").alias("len"))
    log = placed.select(F.col("__fid").alias("fid"), F.col("__offset").alias("offset"), F.col("__len").alias("len"), "key", "value", F.crc32("value").alias("checksum"))
    none = F.lit(None).cast("struct<fid:bigint,offset:bigint,len:bigint>")
    small = tagged.where(~F.coalesce(is_large(F.col("value"), threshold), F.lit(False))).withColumn("vptr", none)
    pointers = placed.withColumn("vptr", vptr).withColumn("value", F.lit(None).cast(rows.schema["value"].dataType))
    names = [c for c in rows.columns if c != "vptr"] + ["vptr"]
    return small.select(names).unionByName(pointers.select(names)), log


def resolve(rows: DataFrame, log: DataFrame, *, verify: bool = False) -> DataFrame:
    """`rows` with the values their pointers name; with `verify` a value that does not match its checksum is an error of the query."""
    value = F.col("value")
    if verify:
        value = F.when(F.crc32("value") == F.col("checksum"), value).otherwise(F.raise_error(F.concat(F.lit(BAD), F.col("fid").cast("string"), F.lit("/"), F.col("offset").cast("string"))))
    held = log.select(F.col("fid").alias("__fid"), F.col("offset").alias("__offset"), value.alias("__value"))
    joined = rows.join(held, (F.col("vptr.fid") == F.col("__fid")) & (F.col("vptr.offset") == F.col("__offset")), "left")
    return joined.withColumn("value", F.coalesce("value", "__value")).drop("__fid", "__offset", "__value")


def bad_checksums(log: DataFrame) -> DataFrame:
    """Records whose value does not match their checksum."""
    return log.where(F.crc32("value") != F.col("checksum"))


def live_records(log: DataFrame, state: DataFrame) -> DataFrame:
    """Records that the current row of their key points at (the same place, not just the same key)."""
    held = state.where(F.col("vptr").isNotNull()).select("key", F.col("vptr.fid").alias("fid"), F.col("vptr.offset").alias("offset"))
    return log.join(held, ["key", "fid", "offset"], "left_semi")


def discard_stats(log: DataFrame, state: DataFrame) -> DataFrame:
    """fid, total, discard: bytes of each file, and those no current row points at."""
    held = state.where(F.col("vptr").isNotNull()).select("key", F.col("vptr.fid").alias("fid"), F.col("vptr.offset").alias("offset"), F.lit(1).alias("__live"))
    marked = log.join(held, ["key", "fid", "offset"], "left")
    return marked.groupBy("fid").agg(F.sum("len").alias("total"), F.sum(F.when(F.col("__live").isNull(), F.col("len")).otherwise(0)).alias("discard"))


def discard_json(stats: DataFrame) -> DataFrame:
    """One row: the discard bytes of all files as a JSON object (one entry a file)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("fid").cast("string").alias("k"), F.col("discard").alias("v"))))
    return stats.agg(F.to_json(F.map_from_entries(entries)).alias("stats"))


def read_discard_json(text: str, spark) -> DataFrame:
    """fid, discard from what `discard_json` made."""
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", "map<string,bigint>").alias("m"))
    return one.select(F.explode("m").alias("fid", "discard")).select(F.col("fid").cast("long").alias("fid"), "discard")


def gc_candidate(stats: DataFrame, ratio: float) -> DataFrame:
    """The file with most discarded bytes, if they are at least `ratio` of it; 0 < ratio < 1."""
    if not 0 < ratio < 1:
        raise InvalidRequest(f"the discard ratio must lie between 0 and 1, not {ratio}")
    return stats.where((F.col("discard") > 0) & (F.col("discard") >= F.col("total") * ratio)).orderBy(F.desc("discard"), "fid").limit(1)
