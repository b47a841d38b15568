"""State of a mutation log: newest version, as-of, tombstones, expiry.

Conditions on keys and versions go before the choice of winners, where they
reach the scan; conditions on op, value or expiry come after it, else a hidden
winner would uncover an older row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PUT

RECENT = ("version", "seq")


def winners(log: DataFrame, as_of: object = None, key: str = "key", recent: tuple[str, ...] = RECENT) -> DataFrame:
    """The newest row of each key, among versions up to `as_of`.

    Row-number filters are planned as a group limit before the shuffle, so of a hot
    key each task sends one row.
    """
    if as_of is not None:
        log = log.where(F.col(recent[0]) <= F.lit(as_of))
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in recent])
    return log.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def winners_by_aggregate(log: DataFrame, columns: tuple[str, ...], key: str = "key", recent: tuple[str, ...] = RECENT) -> DataFrame:
    """The same by max_by: for a few columns of fixed width."""
    best = F.max_by(F.struct(*columns), F.struct(*recent)).alias("__best")
    return log.groupBy(key).agg(best).select(key, "__best.*")


def alive(now: object = None) -> Column:
    """A winner is visible: a PUT, and not expired at `now` (the bound counts as expired)."""
    live = F.col("op") == PUT
    if now is None:
        return live
    return live & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))


def live(log: DataFrame, as_of: object = None, now: object = None) -> DataFrame:
    """Visible rows, one a key."""
    return winners(log, as_of).where(alive(now))


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest row deletes them."""
    return winners(log).where(F.col("op") != PUT)


def expired(log: DataFrame, now: object) -> DataFrame:
    """Keys whose newest row is a PUT that has expired."""
    return winners(log).where((F.col("op") == PUT) & F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.lit(now)))


def history(log: DataFrame) -> DataFrame:
    """All versions with their age: 1 is the newest of the key."""
    w = Window.partitionBy("key").orderBy(*[F.desc(c) for c in RECENT])
    return log.withColumn("age", F.row_number().over(w))


def stale(log: DataFrame) -> DataFrame:
    """Versions that a newer one of their key covers."""
    return history(log).where("age > 1")


def as_of_join(asked: DataFrame, log: DataFrame, *, key: str = "key", at: str = "at", recent: tuple[str, ...] = RECENT) -> DataFrame:
    """`asked` (key, at and more) with the newest row of its key among versions up to `at`, a bound of its own for each row; null columns if there is none.

    Questions and versions of a key stand in one order, and each question takes the last version before it; that is one
    shuffle and one sort, not a join of each question with all versions of its key.
    """
    held = [c for c in log.columns if c != key]
    stream = log.select(key, F.col(recent[0]).alias("__at"), F.lit(0).alias("__kind"), F.struct(*recent).alias("__recent"), F.struct(*held).alias("__row"))
    null = lambda c: F.lit(None).cast(stream.schema[c].dataType).alias(c)
    questions = asked.select(key, F.col(at).cast(stream.schema["__at"].dataType).alias("__at"), F.lit(1).alias("__kind"), null("__recent"), null("__row"), F.struct("*").alias("__asked"))
    w = Window.partitionBy(key).orderBy("__at", "__kind", "__recent").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stream.unionByName(questions, allowMissingColumns=True).withColumn("__last", F.last("__row", ignorenulls=True).over(w)).where("__kind = 1")
    return found.select("__asked.*", *[F.col(f"__last.{c}").alias(c) for c in held])
