"""SimHash near-duplicates by bit-sliced comparison (operator 3).

A document's fingerprint: over the XXH64 hashes (seed 42) of its word shingles,
repeats included, a bit is 1 if it is 1 in over half of them.
Fingerprints within `radius` bits are linked.

Only different fingerprints are compared, each represented by the least
doc_id that has it. Any two within the radius agree on at least
`bands - radius` of the bands that the 64 bits are cut into, so fingerprints meet in
blocks keyed by each choice of that many bands. In a block the bits are stored
as planes, one word of 64 fingerprints a plane; the distances of 64 fingerprints
to a given one are counted at once by carry-save counters of two bits that stick at
three, and a block is abandoned when all its counters are past the radius. A block
yields a forest of its links, not all pairs. Blocks of more than TILE
fingerprints are cut into tiles, and each pair of tiles is a task of its own, so that
a hot block is shared out and nothing is left out of the comparison.

Defined results: a null or blank text has fingerprint zero and is linked
like any other; with fewer words than a shingle the whole sequence is the only shingle;
repeated rows are linked by their fingerprints like other documents; a null doc_id gets
its fingerprint and no component, as nothing could name it; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, fresh_names, row_hash, table
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BANDS = 4
TILE = 4096
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; bytes.split() and lower() know the ASCII rules the contract asks for."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    join = b" ".join
    grams = map(join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) > shingle else [join(w)]
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * ones > len(hashes)).astype(np.uint64) @ (np.uint64(1) << _SHIFTS))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""
    head = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(head, run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """[64, words]: bit j of word i of plane b is bit b of fingerprint 64 * i + j."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.reshape(words, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, words)


def within(planes_: np.ndarray, pick: np.ndarray | None, queries: np.ndarray, radius: int) -> np.ndarray:
    """Words whose bits tell which of 64 fingerprints are within `radius` (at most 2) of each query.

    pick None: [queries, words] against all words of the planes; else query i
    meets only word pick[i] of the planes, and the result has one word a query.
    """
    shape = (len(queries), planes_.shape[1]) if pick is None else (len(queries),)
    ones, twos, past = (np.zeros(shape, np.uint64) for _ in range(3))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        mask = np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        differs = planes_[b][None, :] ^ mask[:, None] if pick is None else planes_[b][pick] ^ mask
        carry = ones & differs
        ones ^= differs
        past |= twos & carry  # four
        twos |= carry
        past |= (ones | twos, twos, twos & ones)[radius]  # more bits than the radius
        if b % 8 == 7 and (past == full).all():
            break
    return ~past


class Forest:
    """Union-find over places of a block; the least doc_id is the root."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.up = ids, list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            if self.ids[i] > self.ids[j]:
                i, j = j, i
            self.up[j] = i

    def edges(self) -> list[tuple[int, int]]:
        return [(int(self.ids[i]), int(self.ids[r])) for i in range(len(self.up)) if (r := self.root(i)) != i]


def _small(ids: np.ndarray, fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links in many blocks of at most 64 fingerprints each, all compared at once."""
    sizes = ends - starts
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
    block = np.repeat(np.arange(len(starts)), sizes)
    place = at - np.repeat(starts, sizes)
    bits = np.zeros((len(starts), 64, 64), np.uint8)
    bits[block, :, place] = np.unpackbits(np.ascontiguousarray(fps[at]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = np.packbits(bits, axis=2, bitorder="little").view(np.uint64).reshape(len(starts), 64)
    near = within(np.ascontiguousarray(words.T), block, fps[at], radius)
    out: list[tuple[int, int]] = []
    held = (np.uint64(1) << place.astype(np.uint64)) - np.uint64(1)  # only earlier places
    near = near & held
    hits = np.flatnonzero(near)
    forests: dict[int, Forest] = {}
    for h in hits.tolist():
        b = int(block[h])
        f = forests.setdefault(b, Forest(ids[starts[b] : ends[b]]))
        word, j = int(near[h]), int(place[h])
        while word:
            low = word & -word
            f.join(j, low.bit_length() - 1)
            word ^= low
    for f in forests.values():
        out += f.edges()
    return out


def _large(ids: np.ndarray, fps: np.ndarray, left: int, radius: int) -> list[tuple[int, int]]:
    """Links in one block; left > 0: only those between the first `left` and the rest."""
    held = fps[:left] if left else fps
    p, f = planes(held), Forest(ids)
    queries = np.arange(left, len(fps))
    step = max(1, (1 << 21) // max(1, p.shape[1]))
    for lo in range(0, len(queries), step):
        q = queries[lo : lo + step]
        near = within(p, None, fps[q], radius)
        bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(held)]
        rows, columns = np.nonzero(bits)
        if len(rows):
            for i, j in zip(q[rows].tolist(), columns.tolist(), strict=True):
                if i != j:
                    f.join(i, j)
    return f.edges()


def links(reps: DataFrame, *, radius: int = RADIUS, bands: int = BANDS, tile: int = TILE) -> DataFrame:
    """a, b: links that connect all fingerprints within `radius`; reps: doc_id, fp, each fp once."""
    if not 0 <= radius <= 2 or bands <= radius:
        raise ValueError("radius must be 0, 1 or 2 and bands more than that")
    edges = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for n, choice in enumerate(combinations(range(bands), bands - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        keys.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("v")))
    rows = reps.select("doc_id", "fp", F.explode(F.array(*keys)).alias("k")).select("doc_id", "fp", "k.n", "k.v")
    sizes = rows.groupBy("n", "v").agg(F.count("*").alias("size")).where("size > 1").select(F.col("n").alias("bn"), F.col("v").alias("bv"), "size")
    rows = rows.join(sizes, (F.col("n") == F.col("bn")) & (F.col("v") == F.col("bv"))).select("doc_id", "fp", "n", "v", "size")
    # Tiles of a block: 1 unless it is large; a row goes to every pair of tiles that has its own.
    tiles = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("doc_id", "fp", "n", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("own"))
    group = ["n", "v", "x", "y"]
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "own", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in _with_end(batches):
            t = None
            if batch is not None:
                t = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)])
                tail = t if tail is None else np.concatenate([tail, t], axis=1)
            if tail is None or not tail.shape[1]:
                continue
            change = np.flatnonzero((tail[2:6, 1:] != tail[2:6, :-1]).any(axis=0)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [tail.shape[1]]])
            if batch is not None:  # the last block may go on in the next batch
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                ids, fps = tail[0], tail[1].view(np.uint64)
                size, found = ends - starts, []
                small = (size > 1) & (size <= 64) & (tail[4, starts] == tail[5, starts])
                where = np.flatnonzero(small)
                for lo in range(0, len(where), 2000):
                    w = where[lo : lo + 2000]
                    found += _small(ids, fps, starts[w], ends[w], radius)
                for i in np.flatnonzero((size > 1) & ~small):
                    a, b = starts[i], ends[i]
                    pair = tail[4, a] != tail[5, a]
                    left = int((tail[6, a:b] == tail[4, a]).sum()) if pair else 0
                    if not pair or 0 < left < b - a:
                        found += _large(ids[a:b], fps[a:b], left, radius)
                if found:
                    e = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
            tail = tail[:, ends[-1] if len(ends) else 0 :]

    return arrow_map(dealt, run, "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    reps = cut(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    found = components(links(reps, radius=radius))
    classes = reps.join(found, reps.doc_id == found.node, "left").select(F.col("fp").alias("of"), F.coalesce("component", "doc_id").alias("component_id"))
    out = fps.join(classes, fps.fp == classes.of, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near-duplicates, that of least id; rows with a null id stay."""
    return leave_one(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col=id_col)


def leave_one(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose doc_id in `found` is not its component_id; rows of one id are one group."""
    gone_id, twice_id, n, r = fresh_names(docs.columns, "gone_id", "twice_id", "n_rows", "row_no")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
    # Repeated ids: their rows are one group, so one of them stays.
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(twice_id)).agg(F.count("*").alias(n)).where(f"{n} > 1").select(twice_id)
    if twice.isEmpty():
        return left
    shared = left.join(twice, F.col(id_col) == F.col(twice_id), "left")
    w = Window.partitionBy(twice_id).orderBy(row_hash(docs))
    one = shared.where(F.col(twice_id).isNotNull()).withColumn(r, F.row_number().over(w)).where(f"{r} = 1")
    return shared.where(F.col(twice_id).isNull()).select(docs.columns).union(one.select(docs.columns))
