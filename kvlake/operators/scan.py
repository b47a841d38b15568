"""Point, multi-key, prefix, range and ordered reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EmptyKey
from .state import live


def _checked(key: object) -> object:
    if key is None or len(key) == 0:
        raise EmptyKey("the key is empty")
    return key


def get(log: DataFrame, key: object, as_of: object = None, now: object = None) -> DataFrame:
    """At most one row; the key is compared in the scan."""
    return live(log.where(F.col("key") == F.lit(_checked(key))), as_of, now)


def multi_get(log: DataFrame, keys: DataFrame, as_of: object = None, now: object = None) -> DataFrame:
    """A row for each of `keys` (column key), with found; the values of those not visible are null.

    The log is cut to the keys by a semi join before winners are chosen; Spark
    broadcasts the keys if they are small.
    """
    wanted = keys.select("key").distinct()
    rows = live(log.join(wanted, "key", "left_semi"), as_of, now)
    return keys.join(rows.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(log: DataFrame, *, prefix: object = None, start: object = None, end: object = None, desc: bool = False, limit: int | None = None, as_of: object = None, now: object = None, ordered: bool = True) -> DataFrame:
    """Visible rows by key: with a prefix, from `start` (the seek key, included) and before `end`; either direction; the first `limit`."""
    if prefix is not None:
        log = log.where(F.col("key").startswith(F.lit(prefix)))
    if start is not None:
        log = log.where(F.col("key") <= F.lit(start)) if desc else log.where(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("key") > F.lit(end)) if desc else log.where(F.col("key") < F.lit(end))
    rows = live(log, as_of, now)
    if ordered:
        rows = rows.orderBy(F.desc("key") if desc else F.asc("key"))
    return rows if limit is None else rows.limit(limit)


def iterate(log: DataFrame, **options: object):
    """The rows of `scan` one by one, a partition at a time on the driver."""
    return scan(log, **options).toLocalIterator(prefetchPartitions=True)
