"""Key ranges of tables: union, overlap, containment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Lower ends a bucket of range joins, about; the buckets are as many as the tables need.
BUCKET = 64


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Closed ranges share a key."""
    return (lo_a <= hi_b) & (hi_a >= lo_b)


def extend(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> tuple[Column, Column]:
    """The least range that holds both; a null side is an empty range."""
    return F.least(lo_a, lo_b), F.greatest(hi_a, hi_b)


def key_range(tables: DataFrame, *by: str) -> DataFrame:
    """min_key and max_key over tables, of each group."""
    return tables.groupBy(*by).agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def _upto(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted bounds (`most` at most) are not above the key, by halving: filtering them all is what takes time.

    Never null, or joins by it would work it out a second time to drop nulls.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at)), F.lit(0))


def bucketed(tables: DataFrame, *others: tuple[DataFrame, str]) -> list[DataFrame]:
    """`tables` with a row for each bucket its range meets (home: that of min_key), and each (rows, column) with its bucket.

    Buckets lie between bounds, so joins on `bucket` compare neighbours only; any bounds give the same joins. One in BUCKET
    of the distinct min_keys, picked by hash, is a bound, so a bucket holds as much however many tables there are.
    The bounds, and nothing else, come to the driver. They are cut into runs, about the square root of their number: a key
    finds its run by the runs' first bounds (one broadcast row), then its place in it (a broadcast row a run), so that
    no row ever carries all bounds.
    """
    spark = tables.sparkSession
    lows = tables.where("min_key IS NOT NULL").select("min_key").where(F.pmod(F.xxhash64("min_key"), F.lit(BUCKET)) == 0)
    bounds = [r["min_key"] for r in lows.distinct().orderBy("min_key").collect()]
    for rows, _ in others:  # no more buckets than keys: wide tables are in most of them
        bounds = bounds[:: -(-len(bounds) // max(1, rows.limit(len(bounds)).count()))] if bounds else bounds
    long = max(1, math.isqrt(len(bounds)))
    cut = range(0, len(bounds), long)
    kind = ArrayType(lows.schema["min_key"].dataType)
    firsts = F.broadcast(spark.createDataFrame([([bounds[i] for i in cut],)], StructType([StructField("firsts", kind)])))
    # Run 0 holds the keys below all bounds.
    cuts = [(0, 0, []), *((n, i, bounds[i : i + long]) for n, i in enumerate(cut, 1))]
    runs = F.broadcast(spark.createDataFrame(cuts, StructType([StructField("run", IntegerType(), False), StructField("before", IntegerType(), False), StructField("bounds", kind)])))

    def with_bucket(rows: DataFrame, key: str, name: str) -> DataFrame:
        found = rows.crossJoin(firsts).withColumn("run", _upto(F.col("firsts"), F.col(key), len(cut))).drop("firsts")
        return found.join(runs, "run").withColumn(name, F.col("before") + _upto(F.col("bounds"), F.col(key), long)).drop("run", "before", "bounds")

    near = with_bucket(with_bucket(tables.where("min_key IS NOT NULL AND max_key IS NOT NULL"), "min_key", "home"), "max_key", "last")
    near = near.withColumn("bucket", F.explode(F.sequence(F.least("home", "last"), F.greatest("home", "last")))).drop("last")
    return [near, *(with_bucket(rows.where(F.col(c).isNotNull()), c, "bucket") for rows, c in others)]


def overlap_pairs(tables: DataFrame) -> DataFrame:
    """a, b: pairs of tables (a < b) whose ranges share a key.

    A pair meets in the bucket of the greater of its lower ends, and only there is it given.
    """
    (near,) = bucketed(tables.select("table_id", "min_key", "max_key"))
    a = near.select("bucket", F.col("home").alias("a_home"), F.col("table_id").alias("a"), F.col("min_key").alias("a_lo"), F.col("max_key").alias("a_hi"))
    b = near.select(F.col("bucket").alias("b_bucket"), F.col("home").alias("b_home"), F.col("table_id").alias("b"), F.col("min_key").alias("b_lo"), F.col("max_key").alias("b_hi"))
    meet = (F.col("bucket") == F.col("b_bucket")) & (F.col("bucket") == F.greatest("a_home", "b_home")) & (F.col("a") < F.col("b"))
    return a.join(b, meet & overlaps(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))).select("a", "b")


def overlapping(tables: DataFrame, lo: object, hi: object) -> DataFrame:
    """Tables that share a key with [lo, hi]."""
    return tables.where((F.col("min_key") <= F.lit(hi)) & (F.col("max_key") >= F.lit(lo)))


def table_for_key(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """key, table_id: the tables whose range holds each key; keys meet the tables of their bucket."""
    near, at = bucketed(tables.select("table_id", "min_key", "max_key"), (keys.select("key"), "key"))
    near = near.withColumnRenamed("bucket", "its")
    return at.join(near, (F.col("bucket") == F.col("its")) & (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))).select("key", "table_id")


def is_empty(lo: Column, hi: Column) -> Column:
    """A range without keys: no bounds, or bounds the wrong way round."""
    return lo.isNull() | hi.isNull() | (lo > hi)


def equals(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """The same keys; all empty ranges are equal."""
    both = is_empty(lo_a, hi_a) & is_empty(lo_b, hi_b)
    return F.coalesce(both | ((lo_a == lo_b) & (hi_a == hi_b) & ~is_empty(lo_a, hi_a)), F.lit(False))


def overlapped_below(tables: DataFrame, level: int) -> DataFrame:
    """Tables of a level that share a key with any table of a lower level."""
    upper = tables.where(F.col("level") == level)
    pairs = overlap_pairs(upper.unionByName(tables.where(F.col("level") > level)))
    sides = pairs.union(pairs.select("b", "a")).toDF("table_id", "other")
    lower = tables.where(F.col("level") > level).select(F.col("table_id").alias("other"))
    return upper.join(sides.join(lower, "other", "left_semi"), "table_id", "left_semi")


def split(keys: DataFrame, parts: int) -> DataFrame:
    """part, lo, hi, n: `parts` ranges of neighbouring distinct keys of equal count (the first ones hold one more if need be).

    Keys are ranked without a global window: range partitions are counted, and the counts summed up; a
    key's rank is its place in its partition after all before. One row a partition is summed in one task.
    """
    dealt = keys.where("key IS NOT NULL").select("key").distinct().repartitionByRange("key").withColumn("piece", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy("piece").orderBy("key"))
    sizes = dealt.groupBy("piece").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    w = Window.orderBy("least")
    before = sizes.select("least", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    # A piece is named by its least key, as partition numbers may differ from one evaluation to the next.
    ranked = dealt.withColumn("place", own).withColumn("least", F.min("key").over(Window.partitionBy("piece"))).join(F.broadcast(before), "least")
    at = F.col("before") + F.col("place") - 1
    size, more = F.floor(F.col("total") / parts), F.col("total") % parts
    part = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return ranked.withColumn("part", part.cast("int")).groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
