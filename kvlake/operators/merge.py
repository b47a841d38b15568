"""Merging of sources by precedence, concatenation, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEL
from .state import RECENT


def tiers(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows with their source's place: 0 is the newest tier."""
    tagged = [s.withColumn("tier", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def merge(sources: Sequence[DataFrame] | DataFrame) -> DataFrame:
    """One row a key: of the newest tier that has it, its newest version there."""
    rows = sources if isinstance(sources, DataFrame) else tiers(sources)
    w = Window.partitionBy("key").orderBy("tier", *[F.desc(c) for c in RECENT])
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def concat(sources: Sequence[DataFrame]) -> DataFrame:
    """Sources with disjoint key ranges: no key needs comparing."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """`base` upserted by `delta`, whose rows win; its DEL rows remove keys."""
    return merge([delta, base]).where(F.col("op") != DEL)


def delete_keys(base: DataFrame, keys: DataFrame) -> DataFrame:
    """`base` without `keys` (a batch of tombstones)."""
    return base.join(keys.select("key"), "key", "left_anti")


def replace_tables(tables: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """A level's tables after some were replaced by others."""
    return tables.join(gone.select("table_id"), "table_id", "left_anti").unionByName(new)


def drop_prefixes(log: DataFrame, prefixes: Sequence[object]) -> DataFrame:
    """`log` without the keys under any prefix."""
    for p in prefixes:
        log = log.where(~F.col("key").startswith(F.lit(p)))
    return log
