"""Near copies by SimHash: operator 3's method with a radius wide enough for a Jaccard similarity of 0.8.

Texts whose sets of five-word shingles have a similarity of 0.8 or more are linked. A signature has WIDTH
bits; its first 64 are operator 3's fingerprint of the set, the others are voted by mixes of the same hashes.
At a similarity of 0.8 two signatures differ in 0.1515 of their bits (DIFFER: the angle of the two sets over pi).

1. Signatures meet in blocks keyed by some of their bits, in so many tables that two at 0.8 share no block with a
   probability of MISS at most. The key has one bit more whenever the table doubles, so a block keeps about BLOCK signatures.
2. A block is compared bit-sliced: its signatures are stored as planes, and carry-save adders count, for 64 of them at once, the
   bits that differ from a given one. Those within NARROW of the first 128 bits and WIDE of the first 256 are candidates.
   Two at 0.8 fail that with probability 8 in a million. A block yields a forest of its candidates, not all pairs; blocks of
   more than TILE are cut into tiles, and each pair of tiles is a task of its own.
3. In a group of candidates all pairs are compared by the true similarity of their shingles, as in `minhash`.

Sets of four to seven shingles may differ in up to 0.1875 of the bits at 0.8, so that some are missed.
Defined results: those of `minhash`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, trimmed
from .minhash import SHINGLE, SIMILARITY, shingles, verified
from .repeats import _mix, _runs
from .simhash import SEED, leave_one, planes

WIDTH = 512
DIFFER = 0.1515
MISS = 1e-5
BLOCK = 2048
TILE = 4096
NARROW, WIDE = 39, 66
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 8192  # words of a plane of counters: they stay in the processor's cache
_HITS = 512  # words whose pairs are held at once


def signature(hashes: np.ndarray) -> np.ndarray:
    """WIDTH bits, as unsigned 64-bit words, of a set of 64-bit hashes: a bit is 1 if it is 1 in over half of them."""
    ones = np.zeros(WIDTH, np.int64)
    for lo in range(0, len(hashes), 255):
        h = hashes[lo : lo + 255, None]
        words = np.concatenate([h, _mix(_mix(h + _ODD * np.arange(1, WIDTH // 64, dtype=np.uint64)))], axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), d1, d2 (digest of the set), sig (signature) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        for batch in batches:
            digests, sigs = [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), shingle)
                hashes = np.sort(np.fromiter((xxh64_intdigest(g, SEED) for g in s), np.uint64, len(s)))
                digests.append(xxh3_128_digest(hashes.tobytes()))
                sigs.append(signature(hashes).tobytes())
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.binary())], ["doc_id", "th", "d1", "d2", "sig"])

    return arrow_map(head, trimmed(run), "doc_id long, th long, d1 long, d2 long, sig binary")


@cache
def tables(bits: int) -> list[np.ndarray]:
    """The bits of each table's key: so many tables that MISS holds, from shuffled decks of all bits."""
    d = range(WIDTH - bits + 1)
    weight = np.array([comb(WIDTH, i) * DIFFER**i * (1 - DIFFER) ** (WIDTH - i) for i in d])
    apart = 1 - np.array([comb(WIDTH - i, bits) / comb(WIDTH, bits) for i in d])
    n = 1
    while weight @ apart**n > MISS:
        n += 1
    rng, decks = np.random.default_rng(SEED), []
    while len(decks) < n:
        deck = rng.permutation(WIDTH)
        decks += [deck[i : i + bits] for i in range(0, WIDTH - bits + 1, max(1, bits))]
    return decks[:n]


def count(differs: Iterator[np.ndarray]) -> list[np.ndarray]:
    """Planes, least first, of the number of 1 bits at each place of some arrays, by carry-save adders."""
    held: list[list[np.ndarray]] = []

    def add(x: np.ndarray, w: int) -> None:
        if w == len(held):
            held.append([])
        held[w].append(x)
        if len(held[w]) == 3:
            a, b, x = held[w]
            u = a ^ b
            held[w] = [u ^ x]
            u &= x
            u |= a & b
            add(u, w + 1)

    for x in differs:
        add(x, 0)
    w = 0
    while w < len(held):
        if len(held[w]) == 2:
            a, b = held[w]
            held[w] = [a ^ b]
            add(a & b, w + 1)
        w += 1
    return [x[0] for x in held]


def at_most(planes_: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits that tell where a number given as planes is at most `radius`."""
    if radius >> len(planes_):
        return ~np.zeros_like(planes_[0])
    more, same = np.zeros_like(planes_[0]), ~np.zeros_like(planes_[0])
    for b in reversed(range(len(planes_))):
        if radius >> b & 1:
            same &= planes_[b]
        else:
            more |= same & planes_[b]
            same &= ~planes_[b]
    return ~more


def near(sigs: np.ndarray, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of candidates among signatures [n, 4], j < i; left > 0: only those with j < left <= i."""
    p = np.concatenate([planes(sigs[: left or None, w]) for w in range(2)])
    lo = left
    while lo < len(sigs):
        hi = min(len(sigs), lo + max(64, _STEP // (p.shape[1] if left else lo // 64 + 8)))
        words = p.shape[1] if left else -(-hi // 64)
        bits = np.unpackbits(np.ascontiguousarray(sigs[lo:hi, :2]).view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
        masks = np.uint64(0) - bits.T
        found = at_most(count(p[b, None, :words] ^ masks[b][:, None] for b in range(128)), NARROW)
        hits = np.argwhere(found)
        for at in range(0, len(hits), _HITS):
            q, w = hits[at : at + _HITS].T
            k, bit = np.nonzero(np.unpackbits(found[q, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = q[k] + lo, 64 * w[k] + bit
            held = j < (left or i)
            i, j = i[held], j[held]
            held = np.bitwise_count(sigs[i] ^ sigs[j]).sum(axis=1, dtype=np.int64) <= WIDE
            yield i[held], j[held]
        lo = hi


def join(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; up: the root of each place, the least of its tree."""
    while True:
        a, b = up[i], up[j]
        differs = a != b
        if not differs.any():
            return
        i, j, a, b = i[differs], j[differs], a[differs], b[differs]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up[:] = up[up]


def candidates(reps: DataFrame, *, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """a, b: links that connect all candidates; reps: doc_id, sig, each doc_id once."""
    picks = tables(max(0, ceil(log2(max(1, reps.count()) / block))))

    def keys(batches: Iterator[pa.RecordBatch], whole: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WIDTH // 64)
            bits = np.unpackbits(sigs.view(np.uint8), axis=1, bitorder="little")
            rest = [batch.column(0), *(pa.array(sigs[:, w].view(np.int64)) for w in range(4))] if whole else []
            for t, pick in enumerate(picks):
                key = (t << 40) + (bits[:, pick].astype(np.int64) << np.arange(len(pick))).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *rest], ["block", "doc_id", "w0", "w1", "w2", "w3"][: 1 + len(rest)])

    head = reps.select("doc_id", "sig")
    large = arrow_map(head, trimmed(lambda x: keys(x, False)), "block long").groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > tile)
    large = cut(large.select(F.col("block").alias("of"), F.ceil(F.col("size") / F.lit(tile)).cast("int").alias("n_tiles")))
    rows = arrow_map(head, trimmed(keys), "block long, doc_id long, w0 long, w1 long, w2 long, w3 long")
    if large.isEmpty():  # as usual: the join would deal out all rows once more
        rows = rows.withColumn("tiles", F.lit(1))
    else:
        rows = rows.join(large, F.col("block") == F.col("of"), "left").withColumn("tiles", F.coalesce("n_tiles", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = rows.select("block", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "w0", "w1", "w2", "w3")
    dealt = dealt.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y", "own", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, (0, 1, 2)):
            x, y, own, ids = (t.column(i).to_numpy() for i in range(1, 5))
            left = int((own == x[0]).sum()) if x[0] != y[0] else 0
            if t.num_rows > 1 and (x[0] == y[0] or 0 < left < t.num_rows):
                up = np.arange(t.num_rows)
                for i, j in near(np.stack([t.column(c).to_numpy() for c in range(5, 9)], axis=1).view(np.uint64), left):
                    join(up, i, j)
                at = np.flatnonzero(up != np.arange(t.num_rows))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[up[at]])], ["a", "b"])

    return arrow_map(dealt, trimmed(compare), "a long, b long")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group) of each row; `similarity` is at least SIMILARITY, for which the radius is made."""
    if similarity < SIMILARITY:
        raise ValueError(f"similarity must be {SIMILARITY} or more")
    rows = cut(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    reps = cut(rows.where("doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "sig")).alias("r")).select("d1", "d2", "r.*"))
    return verified(docs, rows, reps, candidates(reps, block=block, tile=tile), id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies, that of least id; rows with a null id stay."""
    return leave_one(docs, near_copies(docs, id_col=id_col, text_col=text_col), id_col=id_col)
