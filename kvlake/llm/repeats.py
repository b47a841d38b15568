"""Repeated windows of symbols across and within documents, found exactly.

A window is `k + w - 1` neighbouring symbols (bytes or words) of one text.
Its anchor is the least hash among its runs of k symbols, so equal windows have
equal anchors (winnowing), and a text falls into segments: maximal runs of windows with one anchor.

1. Of texts that occur several times one is kept; what the others lose follows from it.
2. Each text yields its segments as (anchor, place). Only anchors that occur
   in two segments, or twice within one, can belong to a repeated window.
3. Those segments fetch their symbols. Equal ones are counted with partial
   sums before anything is grouped, so a passage that a third of all documents share is
   one segment with a count from here on.
4. Different segments with one anchor meet in a task, which finds their repeated windows by the
   operator's method: sorting of suffixes, or extension of the anchor both ways. Anchors with more than GROUP segments, which
   would be too much for a task, give out their windows, and equal ones are counted with partial sums.

The outcome of a text is the list of window starts that are repeats: of an earlier
window (`mode` "earlier") or of any other ("any").
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, drop, fresh_path, write_table

#: Segments of one anchor that a task takes whole: about half a megabyte of text.
GROUP = 4096
#: Bytes of segments that are compared together, about; groups stay whole.
SHARD = 4 << 20
#: Stands for a null id: before all others.
NO_ID = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A fixed pseudo-random number for each byte.
BYTE_HASH = np.random.default_rng(42).integers(0, 2**63, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k symbols, by doubling: log2(k) passes."""
    out, size, left, power = None, 0, k, int(_ODD)
    part, width = h, 1
    while left:
        if left & 1:  # append the runs of `width` after those gathered so far
            if out is None:
                out, size = part, width
            else:
                n = len(h) - size - width + 1
                out = out[:n] * np.uint64(power) + part[size : size + n]
                size += width
        left >>= 1
        if left:
            part = part[:-width] * np.uint64(power) + part[width:]
            power, width = power * power & 0xFFFFFFFFFFFFFFFF, width * 2
    return out


def anchor_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash that makes a run of k symbols an anchor, at each place."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return _mix(rolling(h, k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def segments(h: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, whether the anchor occurs twice in it) of each segment."""
    none = np.zeros(0, np.int64)
    if len(h) < k + w - 1:
        return none, none, none.view(np.uint64), none.astype(bool)
    x = anchor_hashes(h, k)
    m = sliding_min(x, w)
    cut_ = np.flatnonzero(m[1:] != m[:-1]) + 1
    starts = np.concatenate([[0], cut_])
    ends = np.concatenate([cut_, [len(m)]])
    # The anchor at a window's first place leaves, and the next window has the same anchor.
    stays = np.concatenate([(x[: len(m) - 1] == m[:-1]) & (m[1:] == m[:-1]), [False]])
    return starts, ends - starts, m[starts], np.add.reduceat(stays, starts) > 0


class Bytes:
    """Texts as bytes."""

    def symbols(self, text: bytes) -> bytes:
        return text

    def hashes(self, text: bytes) -> np.ndarray:
        return BYTE_HASH[np.frombuffer(text, np.uint8)]

    def pack(self, part: bytes) -> bytes:
        return part

    def unpack(self, part: bytes) -> bytes:
        return part


class Words:
    """Texts as words `[^\\x20\\x09-\\x0D]+` of UTF-8."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def symbols(self, text: bytes) -> list[bytes]:
        return text.split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.seen) > 200_000:
            self.seen = {}
        for x in set(words).difference(self.seen):
            self.seen[x] = xxh64_intdigest(x)
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))

    def pack(self, part: list[bytes]) -> bytes:
        return b" ".join(part)

    def unpack(self, part: bytes) -> list[bytes]:
        return part.split(b" ")


_units: dict[type, Bytes | Words] = {}


def unit_of(kind: type) -> Bytes | Words:
    return _units.setdefault(kind, kind())


def store(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table of the shared folder; the shuffle files behind it are let go."""
    return write_table(df, fresh_path(df.sparkSession, what))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, th (they name a text of a document) and text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[pa.Table]:
    """The rows of each value of some sorted columns, across batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        differs = np.zeros(held.num_rows - 1, bool)
        for c in columns:
            v = held.column(c).to_numpy()
            differs |= v[1:] != v[:-1]
        at = [0, *(np.flatnonzero(differs) + 1).tolist()]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def _with_end(items: Iterator) -> Iterator:
    yield from items
    yield None


#: Finds the repeated windows in whole groups of segments: (anchor of each, its symbols, window) to window starts of each, ascending.
Finder = Callable[[np.ndarray, list[bytes], int], list[list[int]]]


def repeated_windows(texts: DataFrame, *, kind: type, k: int, w: int, mode: str, find: Finder) -> DataFrame:
    """did, th, whole, starts of the texts that have repeated windows.

    texts: did, th, text. find gets the segments of some anchors in the order of their texts and places. whole: all windows of the text are repeats; else the
    places in `starts` (packed int64 pairs: first window, windows) are.
    """
    window = k + w - 1
    # 1. Texts that occur several times.
    same = texts.select("did", "th", F.xxhash64(F.lit(1), "text").alias("th2"))
    classes = same.groupBy("th", "th2").agg(F.min("did").alias("first"), F.count("*").alias("times")).where("times > 1")
    copies = same.join(classes.withColumnRenamed("th", "cth").withColumnRenamed("th2", "cth2"), (F.col("th") == F.col("cth")) & (F.col("th2") == F.col("cth2")))
    spare = copies.where("did > first").select("did", "th").distinct()
    whole = spare if mode == "earlier" else copies.select("did", "th").distinct()
    one = texts.join(spare, ["did", "th"], "left_anti")
    # Rows that agree in id and text are one document, so one of them is cut up.
    twins = cut(copies.groupBy("did", "th").agg(F.count("*").alias("rows")).where("rows > 1").select("did", "th"))
    if not twins.isEmpty():
        one = one.join(twins, ["did", "th"], "left_anti").unionByName(one.join(twins, ["did", "th"], "left_semi").dropDuplicates(["did", "th"]))

    # 2. Segments, and the anchors that can belong to repeats.
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = unit_of(kind)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found, rows = [], []
                for t in part.column(2).to_pylist():
                    found.append(segments(unit.hashes(unit.symbols(t)), k, w))
                    rows.append(len(found[-1][0]))
                start, size, anchor, twice = (np.concatenate(x) for x in zip(*found, strict=True))
                at = np.repeat(np.arange(part.num_rows), rows)
                place = (start.astype(np.int64) << 32) | (size.astype(np.int64) << 1) | twice
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part.column(0).to_numpy()[at]), pa.array(part.column(1).to_numpy()[at]), pa.array(place)], ["anchor", "did", "th", "place"])

    segs = arrow_map(one.select("did", "th", "text"), cut_up, "anchor long, did long, th long, place long")
    common = segs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("common"))
    wanted = segs.join(common, F.col("anchor") == F.col("common"), "left").where(F.col("common").isNotNull() | (F.col("place").bitwiseAND(F.lit(1).cast("long")) == 1))
    by_text = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("anchor", "place")).alias("places"))

    # 3. Their symbols.
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        unit = unit_of(kind)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, rows = batch.slice(lo, 64), []
                for did, th, text, places in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    symbols = unit.symbols(text)
                    for p in places:
                        start, size = p["place"] >> 32, (p["place"] & 0xFFFFFFFF) >> 1
                        content = unit.pack(symbols[start : start + size + window - 1])
                        c = xxh3_128_intdigest(content)
                        rows.append((p["anchor"], (c >> 64) - (1 << 63), (c & ((1 << 64) - 1)) - (1 << 63), did, th, p["place"], content))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], ["anchor", "c1", "c2", "did", "th", "place", "content"])

    held = store(arrow_map(one.join(by_text, ["did", "th"]).select("did", "th", "text", "places"), fetch, "anchor long, c1 long, c2 long, did long, th long, place long, content binary"), "segments")

    # 4. Equal segments by count, different ones by extension.
    at = F.struct("did", "th", "place")
    sums = held.groupBy("c1", "c2").agg(F.count("*").alias("times"), F.min(at).alias("first")).select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "times", "first")
    leads = at == F.col("first")
    joined = held.join(sums, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")))
    # Kept once for the three uses below; symbols only where a segment stands for its equals.
    marked = store(joined.select("anchor", "did", "th", "place", F.when(leads, F.col("content")).alias("content"), "times", leads.alias("leads")), "marked")
    drop(held)
    all_of = marked.where(~F.col("leads") if mode == "earlier" else F.col("times") > 1)
    full = all_of.select("did", "th", F.shiftright("place", 32).alias("start"), F.shiftright(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 1).alias("n"))
    leaders = marked.where("leads").select("anchor", "did", "th", "place", "content", "times")
    sizes = leaders.groupBy("anchor").agg(F.count("*").alias("size"), F.max(F.col("place").bitwiseAND(F.lit(1).cast("long"))).alias("twice")).where("size > 1 OR twice = 1")
    groups = cut(sizes.select(F.col("anchor").alias("of"), (F.col("size") > GROUP).alias("hot")))
    of_group = lambda hot: leaders.join(groups.where(F.col("hot") == hot), F.col("anchor") == F.col("of")).select("anchor", "did", "th", "place", "content")
    dealt = of_group(False).repartition("anchor").sortWithinPartitions("anchor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []  # whole groups
        size = 0
        for t in _with_end(_runs(batches, (0,))):
            if t is not None:
                shard += zip(*(t.column(i).to_pylist() for i in (1, 2, 3, 0, 4)), strict=True)
                size += sum(len(x[4]) for x in shard[-t.num_rows :])
            if shard and (t is None or size >= SHARD):
                shard.sort(key=lambda x: x[:3])
                hits = find(np.array([x[3] for x in shard], np.int64).view(np.uint64), [x[4] for x in shard], window)
                rows = [(x[0], x[1], (x[2] >> 32) + a, n) for x, hit in zip(shard, hits, strict=True) for a, n in spans(hit)]
                if rows:
                    yield _rows(rows)
                shard, size = [], 0

    some = arrow_map(dealt, compare, "did long, th long, start long, n long")
    if not groups.where("hot").isEmpty():
        some = some.union(_hot(of_group(True), kind, window, mode))
    places = full.union(some).groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("starts"))
    found = places.join(whole.withColumn("whole", F.lit(True)), ["did", "th"], "full_outer") if mode == "any" else places.withColumn("whole", F.lit(False)).unionByName(whole.select("did", "th", F.lit(None).cast("array<struct<start:bigint,n:bigint>>").alias("starts"), F.lit(True).alias("whole")))
    return found.select("did", "th", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")


def _hot(segments_: DataFrame, kind: type, window: int, mode: str) -> DataFrame:
    """The repeated windows of anchors with many segments: windows meet by a hash of 128 bits, however many are equal."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        unit = unit_of(kind)
        for batch in batches:
            for did, th, place, content in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                part = unit.unpack(content)
                for lo in range(0, len(part) - window + 1, 1 << 16):
                    n = min(1 << 16, len(part) - window + 1 - lo)
                    h = np.frombuffer(b"".join(xxh3_128_digest(unit.pack(part[i : i + window])) for i in range(lo, lo + n)), np.int64).reshape(-1, 2)
                    start = np.arange((place >> 32) + lo, (place >> 32) + lo + n)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(n, did)), pa.array(np.full(n, th)), pa.array(start)], ["w1", "w2", "did", "th", "start"])

    every = store(arrow_map(segments_, windows, "w1 long, w2 long, did long, th long, start long"), "windows")
    at = F.struct("did", "th", "start")
    sums = every.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min(at).alias("first")).where("times > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "first")
    hits = every.join(sums, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")))
    return (hits.where(at != F.col("first")) if mode == "earlier" else hits).select("did", "th", "start", F.lit(1).cast("long").alias("n"))


def _rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["did", "th", "start", "n"])


def spans(places: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbouring places as (first, length)."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][0] + out[-1][1] == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def covered(n: int, window: int, whole: bool | None, starts: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs (first, end) of the n symbols that repeated windows cover."""
    if n < window:
        return []
    if whole:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] + window - 1) for x in starts or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def strip(docs: DataFrame, run: Callable, schema: str, *, id_col: str, text_col: str, kind: type, k: int, w: int, mode: str, find: Finder) -> DataFrame:
    """`run` over (id, text, whole, starts) of every document."""
    texts = keyed(docs, id_col, text_col)
    found = repeated_windows(texts, kind=kind, k=k, w=w, mode=mode, find=find)
    joined = texts.join(found, ["did", "th"], "left").select(F.when(F.col("did") != NO_ID, F.col("did")).alias("id"), "text", "whole", "starts")
    return arrow_map(joined, run, schema)
