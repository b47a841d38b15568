"""What a cache would see of key accesses: frequency, hot keys, admission, recency hits."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Hashable, Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sketches import bloom_bits_per_key, bloom_hashes


def key_frequency(accesses: DataFrame) -> DataFrame:
    """key, hits."""
    return accesses.groupBy("key").agg(F.count("*").alias("hits"))


def hot_keys(accesses: DataFrame, n: int) -> DataFrame:
    """The n keys read most, ties by key."""
    return key_frequency(accesses).orderBy(F.desc("hits"), "key").limit(n)


def admitted(accesses: DataFrame, resident: DataFrame) -> DataFrame:
    """key, hits of candidates that beat the least read resident key; a first sight never does.

    resident: key. The doorkeeper rule (the first access only registers) is hits > 1.
    """
    freq = key_frequency(accesses)
    floor = freq.join(resident, "key", "left_semi").agg(F.coalesce(F.min("hits"), F.lit(0)).alias("floor"))
    return freq.join(resident, "key", "left_anti").join(F.broadcast(floor), F.col("hits") > F.col("floor")).where("hits > 1").select("key", "hits")


def reaccess(accesses: DataFrame, order: str) -> DataFrame:
    """key, hits, sum and maximum of the gap (accesses in between, by `order`) since the key's last access."""
    gap = F.col(order) - F.lag(order).over(Window.partitionBy("key").orderBy(order))
    return accesses.withColumn("gap", gap).groupBy("key").agg(F.count("gap").alias("again"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))


class CountMin4:
    """Four rows of 4-bit counters that stick at 15; an estimate is the least of a key's four; all are halved as they age."""

    def __init__(self, counters: int) -> None:
        self.width = 1 << max(4, (counters - 1).bit_length())
        self.rows = np.zeros((4, self.width), np.uint8)

    def _at(self, key: Hashable) -> np.ndarray:
        h = hashlib.blake2b(repr(key).encode(), digest_size=16).digest()
        return np.frombuffer(h, np.uint32).astype(np.int64) % self.width

    def add(self, key: Hashable) -> None:
        at = self._at(key)
        held = self.rows[np.arange(4), at]
        self.rows[np.arange(4), at] = np.minimum(held + 1, 15)

    def estimate(self, key: Hashable) -> int:
        return int(self.rows[np.arange(4), self._at(key)].min())

    def halve(self) -> None:
        self.rows >>= 1

    def clear(self) -> None:
        self.rows[:] = 0


class Doorkeeper:
    """A Bloom filter that remembers who was here; `knows` records the key and tells whether it was recorded before."""

    def __init__(self, keys: int, fpp: float = 0.01) -> None:
        per_key = bloom_bits_per_key(fpp)
        self.bits, self.hashes = max(64, keys * per_key), bloom_hashes(per_key)
        self.held = bytearray(-(-self.bits // 8))

    def knows(self, key: Hashable) -> bool:
        h = hashlib.blake2b(repr(key).encode(), digest_size=16).digest()
        a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")
        seen = True
        for i in range(self.hashes):
            at = (a + i * b) % self.bits
            seen &= bool(self.held[at >> 3] >> (at & 7) & 1)
            self.held[at >> 3] |= 1 << (at & 7)
        return seen

    def clear(self) -> None:
        self.held = bytearray(len(self.held))


class TinyLfu:
    """A small driver-side cache: a recency window, then a segmented main part that admits by frequency.

    For metadata that the driver reads again and again, such as folded manifests.
    """

    def __init__(self, capacity: int, window: float = 0.01, protected: float = 0.8) -> None:
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.n_window = max(1, int(capacity * window))
        self.n_main = max(0, capacity - self.n_window)
        self.n_protected = int(self.n_main * protected)
        self.window: OrderedDict[Hashable, object] = OrderedDict()
        self.probation: OrderedDict[Hashable, object] = OrderedDict()
        self.protected: OrderedDict[Hashable, object] = OrderedDict()
        self.freq, self.door = CountMin4(capacity * 4), Doorkeeper(capacity * 10)
        self.seen = 0
        self.sample = 10 * capacity
        self.hits = self.misses = 0

    def _touch(self, key: Hashable) -> None:
        if self.door.knows(key):  # the first access only registers
            self.freq.add(key)
        self.seen += 1
        if self.seen >= self.sample:  # old counts fade
            self.freq.halve()
            self.door.clear()
            self.seen = 0

    def get(self, key: Hashable) -> object | None:
        self._touch(key)
        for part in (self.window, self.protected):
            if key in part:
                part.move_to_end(key)
                self.hits += 1
                return part[key]
        if key in self.probation:
            self.hits += 1
            value = self.probation.pop(key)
            self.protected[key] = value
            if len(self.protected) > self.n_protected:
                old, v = self.protected.popitem(last=False)
                self.probation[old] = v
            return value
        self.misses += 1
        return None

    def set(self, key: Hashable, value: object) -> None:
        for part in (self.window, self.protected, self.probation):
            if key in part:
                part[key] = value
                part.move_to_end(key)
                return
        self.window[key] = value
        if len(self.window) <= self.n_window:
            return
        candidate, held = self.window.popitem(last=False)
        if len(self.probation) + len(self.protected) < self.n_main:
            self.probation[candidate] = held
        elif self.probation:
            victim = next(iter(self.probation))
            if self.door.knows(candidate) and self.freq.estimate(candidate) > self.freq.estimate(victim):
                del self.probation[victim]
                self.probation[candidate] = held

    def delete(self, key: Hashable) -> object | None:
        for part in (self.window, self.protected, self.probation):
            if key in part:
                return part.pop(key)
        return None

    def keys(self) -> Iterable[Hashable]:
        return [*self.window, *self.probation, *self.protected]
