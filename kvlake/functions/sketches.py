"""Approximate structures: Bloom filters, count-min sketches; and checksums.

A Bloom filter is a table of parts, each an array of words built by a distributed aggregation; a probe joins the one part
that its key looks into. Count-min tables are aggregations over their counters. Both have a size fixed by their parameters.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MIN_HASHES, MAX_HASHES = 64, 1, 30


def bloom_bits_per_key(fpp: float) -> int:
    """Bits a key for a rate of false positives."""
    return math.ceil(-math.log(fpp) / math.log(2) ** 2)


def bloom_hashes(bits_per_key: int) -> int:
    return max(MIN_HASHES, min(MAX_HASHES, int(bits_per_key * 0.69)))


def bloom_bits(keys: int, fpp: float) -> int:
    return max(MIN_BITS, keys * bloom_bits_per_key(fpp))


#: Bits of a part of a Bloom filter; larger filters have several parts, and a key looks into one.
PART_BITS = 1 << 20


def _halves(key: Column) -> tuple[Column, Column, Column]:
    """Three numbers of 32 bits from a key's MD5, which any SQL engine can form."""
    digest = F.md5(key.cast("string"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17))


def _positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit places of a key by double hashing."""
    h1, h2, _ = _halves(key)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits).cast("long")))


def _parts(bits: int) -> tuple[int, int]:
    """(parts of a filter, bits of each)."""
    parts = -(-bits // PART_BITS)
    return parts, -(-bits // parts)


def bloom_filter(keys: DataFrame, column: str, *, bits: int, hashes: int) -> DataFrame:
    """part, words: the bits of each part in 32-bit words, PART_BITS at most."""
    parts, own = _parts(bits)
    part = F.pmod(_halves(F.col(column))[2], F.lit(parts).cast("long"))
    places = keys.select(part.alias("part"), F.explode(_positions(F.col(column), own, hashes)).alias("place"))
    set_ = places.groupBy("part", F.shiftright("place", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 32).cast("int"))).alias("v"))
    n = -(-own // 32)
    every = keys.sparkSession.range(parts * n).select(F.floor(F.col("id") / n).alias("part"), (F.col("id") % n).alias("w"))
    dense = every.join(set_, ["part", "w"], "left").select("part", F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("x"))
    return dense.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("words"))


def might_contain(probe: DataFrame, column: str, bloom: DataFrame, *, bits: int, hashes: int) -> DataFrame:
    """`probe` with might_contain; never false for a key of the filter. Each key is joined with the part it looks into."""
    parts, own = _parts(bits)
    rows = probe.withColumn("__part", F.pmod(_halves(F.col(column))[2], F.lit(parts).cast("long")))
    joined = rows.join(bloom.select(F.col("part").alias("__of"), F.col("words").alias("__words")), F.col("__part") == F.col("__of"), "left")
    word = lambda p: F.coalesce(F.get("__words", F.shiftright(p, 5).cast("int")), F.lit(0).cast("long"))
    hit = F.forall(_positions(F.col(column), own, hashes), lambda p: F.getbit(word(p), (p % 32).cast("int")) == 1)
    return joined.withColumn("might_contain", hit).drop("__part", "__of", "__words")


def count_min(rows: DataFrame, column: str, *, eps: float = 0.001, confidence: float = 0.99, seed: int = 42) -> DataFrame:
    """One row with a serialised count-min sketch of a column."""
    return rows.agg(F.count_min_sketch(column, F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def count_min_estimates(rows: DataFrame, column: str, *, width: int = 1024, depth: int = 4, most: int | None = None) -> DataFrame:
    """value, estimate: frequencies from a count-min table of depth x width counters, which stick at `most` (15: four bits); never too small below it."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    at = F.posexplode(_positions(F.col(column), width, depth)).alias("i", "at")
    placed = counted.select(column, "n", at)
    total = F.sum("n") if most is None else F.least(F.sum("n"), F.lit(most).cast("long"))
    table = placed.groupBy("i", "at").agg(total.alias("total"))
    return placed.select(column, "i", "at").join(table, ["i", "at"]).groupBy(column).agg(F.min("total").alias("estimate"))


_POLYNOMIAL = 0x82F63B78


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (_POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


_TABLE = np.array(_crc_table(), np.uint32)


def _by_length(data: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are not null, longest first; all their bytes; where each begins; lengths)."""
    at = np.flatnonzero(data.notna().to_numpy())
    size = np.fromiter((len(data.iat[i]) for i in at), np.int64, len(at))
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    return at, np.frombuffer(b"".join(data.iat[i] for i in at), np.uint8), np.cumsum(size) - size, size


def _numbers(n: int, at: np.ndarray, values: np.ndarray) -> pd.Series:
    out = pd.Series([None] * n, dtype="Int64")
    out.iloc[at] = values.astype(np.int64)
    return out


def crc32c_rows(data: pd.Series) -> pd.Series:
    """CRC-32C of each value: one array operation a byte place, over all rows that reach it."""
    at, flat, start, size = _by_length(data)
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -i, "left"))  # rows longer than i come first
        crc[:n] = crc[:n] >> np.uint32(8) ^ _TABLE[(crc[:n] ^ flat[start[:n] + i]) & np.uint32(255)]
    return _numbers(len(data), at, crc ^ np.uint32(0xFFFFFFFF))


def crc32c_bytes(data: bytes) -> int:
    """CRC-32C (Castagnoli)."""
    return int(crc32c_rows(pd.Series([data]))[0])


def crc32c(column: Column) -> Column:
    """CRC-32C of a binary column; Spark's own crc32 is another polynomial, so this is a Pandas UDF."""
    return F.pandas_udf(crc32c_rows, "long")(column.cast("binary"))


#: Fixed values of the seeded 32-bit hash.
HASH_SEED, HASH_FACTOR = 0xBC9F1D34, 0xC6A4A793


def hash32_rows(data: pd.Series) -> pd.Series:
    """A seeded 32-bit hash of each value: four bytes at a time are added, multiplied, and folded by half; what is left by its bytes."""
    at, flat, start, size = _by_length(data)
    factor, mask = np.uint64(HASH_FACTOR), np.uint64(0xFFFFFFFF)
    h = (np.uint64(HASH_SEED) ^ (size.astype(np.uint64) * factor)) & mask
    wide = flat.astype(np.uint64)
    for i in range(int(size.max(initial=0)) // 4):
        n = int(np.searchsorted(-(size // 4), -i, "left"))
        p = start[:n] + 4 * i
        word = wide[p] | wide[p + 1] << np.uint64(8) | wide[p + 2] << np.uint64(16) | wide[p + 3] << np.uint64(24)
        x = (h[:n] + word & mask) * factor & mask
        h[:n] = x ^ x >> np.uint64(16)
    rest = size % 4
    for r in range(3):
        some = np.flatnonzero(rest > r)
        h[some] += wide[start[some] + size[some] - rest[some] + r] << np.uint64(8 * r)
    some = np.flatnonzero(rest)
    x = (h[some] & mask) * factor & mask
    h[some] = x ^ x >> np.uint64(24)
    return _numbers(len(data), at, h)


def hash32(column: Column) -> Column:
    """The seeded 32-bit hash of a binary column."""
    return F.pandas_udf(hash32_rows, "long")(column.cast("binary"))


def checksum(column: Column) -> Column:
    """The checksum of stored values: Spark's crc32, inside code generation."""
    return F.crc32(column)
