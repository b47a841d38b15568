"""Near copies by the Jaccard similarity of their word shingles.

Texts whose sets of five-word shingles have a similarity of 0.8 or more are linked. At that
similarity SimHash fingerprints differ in some ten of 64 bits, too many for bands, so candidates come from
MinHash: texts that agree in all ROWS minima of any of BANDS bands are joined into candidate groups.
In a group all pairs are compared by the true similarity of their shingles, except pairs that
others have linked already. A pair of similarity s shares no band with probability
(1 - s ** ROWS) ** BANDS: 6 in a million at 0.8, less above; other members of its group may still join it.

Texts with equal sets are represented by the least doc_id. Groups of more than TILE are cut into tiles,
and each pair of tiles is a task of its own, so that a large group is shared out.

Defined results: a null or blank text has the empty set, and equals every other such text; with fewer words
than a shingle the whole sequence is the only shingle; words are those of operator 3; a null doc_id
belongs to no group; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, trimmed
from .components import components
from .repeats import _runs
from .simhash import SEED, Forest, leave_one

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
TILE = 256
_random = np.random.default_rng(SEED)
_times = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_plus = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_mix = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    """The distinct shingles of a UTF-8 text."""
    w = text.lower().split()
    if len(w) <= shingle:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))


def similar(a: set[bytes], b: set[bytes], similarity: float = SIMILARITY) -> bool:
    """Jaccard similarity of at least `similarity`; two empty sets are alike."""
    least, most = sorted((len(a), len(b)))
    if least < similarity * most - 1e-9:
        return False
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set of 64-bit hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = hashes.astype(np.uint32)
    for lo in range(0, len(low), 1024):
        least = np.minimum(least, (low[lo : lo + 1024, None] * _times + _plus).min(axis=0))
    return (least.reshape(BANDS, ROWS).astype(np.uint64) * _mix).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), d1, d2 (digest of the set), keys (of the bands) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest, xxh64_intdigest

        for batch in batches:
            digests, keys = [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), shingle)
                hashes = np.sort(np.fromiter((xxh64_intdigest(g, SEED) for g in s), np.uint64, len(s)))
                digests.append(xxh3_128_digest(hashes.tobytes()))
                keys.append(bands(hashes))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[:, 0]), pa.array(d[:, 1]), lists], ["doc_id", "th", "d1", "d2", "keys"])

    return arrow_map(head, run, "doc_id long, th long, d1 long, d2 long, keys array<long>")


def linked(ids: np.ndarray, sets: list[set[bytes]], left: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect all similar pairs of some sets; left > 0: at least those between the first `left` and the rest."""
    f, groups = Forest(ids), {}
    for i, s in enumerate(sets):
        mine = [i]
        for root, members in list(groups.items()):
            # Pairs of one side of two tiles are another task's.
            if any(similar(s, sets[j], similarity) for j in members if not left or (j < left) != (i < left)):
                f.join(i, root)
                mine += groups.pop(root)
        groups[f.root(i)] = mine
    return f.edges()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group) of each row."""
    rows = cut(signatures(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    reps = cut(rows.where("doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th", "keys")).alias("r")).select("d1", "d2", "r.*"))
    # Candidate groups: each member of a block hangs on its least.
    blocks = reps.select("doc_id", F.posexplode("keys").alias("n", "v"))
    least = blocks.groupBy("n", "v").agg(F.min("doc_id").alias("m"), F.count("*").alias("size")).where("size > 1").select(F.col("n").alias("bn"), F.col("v").alias("bv"), "m")
    edges = blocks.join(least, (F.col("n") == F.col("bn")) & (F.col("v") == F.col("bv"))).where("doc_id <> m").select(F.col("doc_id").alias("a"), F.col("m").alias("b")).distinct()
    return verified(docs, rows, reps, edges, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity, tile=tile)


def verified(docs: DataFrame, rows: DataFrame, reps: DataFrame, edges: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float, tile: int = TILE) -> DataFrame:
    """doc_id, component_id of each of `rows` (doc_id, d1, d2); edges (a, b) connect the candidates among `reps` (doc_id, th, d1, d2)."""
    groups = components(edges).select("node", F.col("component").alias("g"))
    # Their texts, dealt to pairs of tiles.
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")).withColumnRenamed("g", "of")
    want = groups.join(sizes, F.col("g") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    want = want.join(reps, F.col("node") == F.col("doc_id")).select("node", F.col("th").alias("nth"), "g", "tiles", "own")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    dealt = texts.join(want, (F.col("doc_id") == F.col("node")) & (F.col("th") == F.col("nth"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "text")
    dealt = dealt.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "own", "doc_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, (0, 1, 2)):
            _, x, y, own = (t.column(i).to_numpy() for i in range(4))
            left = int((own == x[0]).sum()) if x[0] != y[0] else 0
            if t.num_rows > 1 and (x[0] == y[0] or 0 < left < t.num_rows):
                found = linked(t.column(4).to_numpy(), [shingles(s, shingle) for s in t.column(5).to_pylist()], left, similarity)
                if found:
                    e = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    found = components(arrow_map(dealt, trimmed(verify), "a long, b long"))
    classes = reps.join(found, reps.doc_id == found.node, "left").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), F.coalesce("component", "doc_id").alias("component_id"))
    out = rows.join(classes, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies, that of least id; rows with a null id stay."""
    return leave_one(docs, near_copies(docs, id_col=id_col, text_col=text_col), id_col=id_col)
