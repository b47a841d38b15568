"""Exact top-k inner products by norm-bucketed retrieval (operator 9).

Vectors become integers, floor(1024 * x). Each partition packs its vectors into
blocks by length bucket, ordered by decreasing norm; blocks are the unit that is
shuffled. Queries are packed into large blocks, and every candidate block
meets every query block in a task that takes its share of the candidates in order of
decreasing norm. There each query has the k-th best score so far, and
for each block the cosine a vector needs to reach it. A query above the block's
largest norm skips the block. A low cosine threshold prunes by length: only the
block's vectors that are long enough are multiplied. From COORD_FROM on it prunes by
coordinate: a vector whose value at the query's leading coordinates lies
outside the feasible interval is out. Products of what is left are verified exactly.
Bounds have a margin for rounding, and ties are never pruned. A last
window merges the tasks' k best.

Defined results: vectors that are null or empty, or hold a null or non-finite
component, take no part; only vectors of equal dimension meet; rows with the query's vec_id
are its own; each repeated row of a query is a query; a null vec_id takes no part;
scores outside 64 bits are clipped to them; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, table

K = 10
SCALE = 1024.0
QUERY_STEP = 100
BLOCK = 1024
QUERY_BLOCK = 32_768
#: Candidate blocks that one task takes for one query block.
TASK_BLOCKS = 16
#: A bucket's norms lie within this ratio.
BUCKET_RATIO = 0.9
COORD_FROM = 0.9
FOCUS = 3
SUB = 2048
EXACT = 2.0**53
_MARGIN = 1e-9


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where((F.size(v) > 0) & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of one dimension and length bucket, norms decreasing."""

    def block(dim: int, bucket: int, ids: np.ndarray, m: np.ndarray, norms: np.ndarray) -> list:
        order = np.argsort(-norms, kind="stable")
        return [dim, bucket, float(norms[order[0]]), len(ids), ids[order].tobytes(), np.ascontiguousarray(m[order]).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        out: list[list] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat = np.floor(SCALE * lists.flatten().to_numpy())
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                top = np.abs(m).max(axis=1)
                norms = top * np.sqrt(((m / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))
                buckets = np.where(norms > 0, np.floor(np.log(np.maximum(norms, 1e-300)) / -np.log(BUCKET_RATIO)), -(10**6)).astype(np.int64)
                for b in np.unique(buckets):
                    pick = buckets == b
                    have = held.pop((int(dim), int(b)), None)
                    new = (ids[at[pick]], m[pick], norms[pick])
                    i, x, n = new if have is None else (np.concatenate(p) for p in zip(have, new, strict=True))
                    full = len(i) // size * size
                    out += [block(int(dim), int(b), i[lo : lo + size], x[lo : lo + size], n[lo : lo + size]) for lo in range(0, full, size)]
                    if full < len(i):
                        held[int(dim), int(b)] = (i[full:], x[full:], n[full:])
            if out:
                yield _batch(out)
                out = []
        if held:
            yield _batch([block(d, b, *rest) for (d, b), rest in held.items()])

    return arrow_map(rows, run, "dim int, bucket long, max_norm double, n int, ids binary, matrix binary")


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["dim", "bucket", "max_norm", "n", "ids", "matrix"])


class Search:
    """The best k of one block of queries over candidate blocks that come by decreasing norm."""

    def __init__(self, dim: int, ids: bytes, matrix: bytes, k: int) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.m = np.frombuffer(matrix, np.float64).reshape(-1, dim)
        self.k = k
        self.top = float(np.abs(self.m).max(initial=0))
        self.norms = np.sqrt((self.m.astype(np.longdouble) ** 2).sum(axis=1)).astype(np.float64)
        self.floor = np.full(len(self.ids), -np.inf)  # k-th best score
        self.found = np.zeros(0, np.int64), np.zeros(0, np.float64), np.zeros(0, np.int64)
        self.exact: list[tuple[int, int, int]] | None = None
        self.focus = np.argsort(-np.abs(self.m), axis=1)[:, :FOCUS]

    def meet(self, ids: bytes, matrix: bytes) -> None:
        cids = np.frombuffer(ids, np.int64)
        c = np.frombuffer(matrix, np.float64).reshape(-1, self.m.shape[1])
        if self.top * float(np.abs(c).max(initial=0)) * c.shape[1] >= EXACT:
            return self._meet_large(cids, c)
        cnorms = np.sqrt((c**2).sum(axis=1))
        longest = cnorms[0] * (1 + _MARGIN)
        reach = self.norms * longest
        live = np.flatnonzero(~(self.floor > reach + _MARGIN * np.abs(self.floor)))
        need = np.divide(self.floor[live], reach[live], out=np.full(len(live), -np.inf), where=reach[live] > 0)
        coord = live[need >= COORD_FROM]
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(coord):
            unit = c / np.maximum(cnorms, 1e-300)[:, None]
            for q, t in zip(coord.tolist(), need[need >= COORD_FROM].tolist(), strict=True):
                t = min(1.0, t * (1 - _MARGIN))
                f = self.focus[q]
                x = self.m[q, f] / self.norms[q]
                slack = np.sqrt(np.maximum(0, (1 - t * t) * (1 - x * x))) + 1e-6
                # A cosine of at least t keeps each coordinate above this line; the upper one is open if t is not the cosine itself.
                keep = np.flatnonzero((unit[:, f] * np.sign(x) >= (np.abs(x) * t - slack)).all(axis=1))
                if len(keep):
                    s = c[keep] @ self.m[q]
                    good = s >= self.floor[q]
                    hits.append((np.full(int(good.sum()), q), s[good], cids[keep[good]]))
        rest = live[need < COORD_FROM]
        for lo in range(0, len(rest), SUB):
            q = rest[lo : lo + SUB]
            least = np.divide(self.floor[q], self.norms[q], out=np.full(len(q), -np.inf), where=self.norms[q] > 0).min()
            n = len(cnorms) if least <= 0 else int((cnorms * (1 + _MARGIN) >= least * (1 - _MARGIN)).sum())
            if not n:
                continue
            s = self.m[q] @ c[:n].T
            own = self.ids[q][:, None] == cids[None, :n]
            s[own] = -np.inf
            bar = self.floor[q]
            if n > self.k and np.isneginf(bar).any():
                bar = np.maximum(bar, np.partition(s, n - self.k, axis=1)[:, n - self.k])
            i, j = np.nonzero((s >= bar[:, None]) & ~own)
            hits.append((q[i], s[i, j], cids[j]))
        if hits:
            self._add(*(np.concatenate(p) for p in zip(*hits, strict=True)))

    def _add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        own = self.ids[q] == i
        q, s, i = (np.concatenate([a, b[~own]]) for a, b in zip(self.found, (q, s, i), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
        keep = rank < self.k
        self.found = q[keep], s[keep], i[keep]
        self.floor[q[rank == self.k - 1]] = s[rank == self.k - 1]

    def _meet_large(self, cids: np.ndarray, c: np.ndarray) -> None:
        """Products that doubles cannot hold exactly, by Python's integers."""
        lo, hi = -(2**63), 2**63 - 1
        rows = [[int(x) for x in r] for r in c]
        self.exact = self.exact or []
        for n in range(len(self.ids)):
            a = [int(x) for x in self.m[n]]
            got = [(n, max(lo, min(hi, sum(x * y for x, y in zip(a, b, strict=True)))), int(i)) for i, b in zip(cids, rows, strict=True) if i != self.ids[n]]
            self.exact += sorted(got, key=lambda t: (-t[1], t[2]))[: self.k]

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(place of the query, its id, score, vec_id)."""
        q, s, i = self.found
        out = [(a, int(b), c) for a, b, c in zip(q.tolist(), s.tolist(), i.tolist(), strict=True)] + (self.exact or [])
        return [(a, int(self.ids[a]), b, c) for a, b, c in out]


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best of `vectors` for each row of `queries`."""
    blocks = cut(_pack(_vectors(vectors, id_col, vector_col), BLOCK).withColumn("block", F.monotonically_increasing_id()))
    n = blocks.count()
    asked = _vectors(queries, id_col, vector_col)
    asked_n = asked.count()
    q = cut(_pack(asked.repartition(max(1, -(-asked_n // QUERY_BLOCK)), "vec_id"), QUERY_BLOCK).withColumn("block", F.monotonically_increasing_id()))
    shares = max(1, -(-n // TASK_BLOCKS))
    # Which query blocks there are: one number for each QUERY_BLOCK queries, so a short list.
    names = [(r["block"], r["dim"]) for r in q.select("block", "dim").collect()]
    plan = q.sparkSession.createDataFrame(names, "q long, of int")
    right = blocks.withColumn("share", F.pmod(F.hash("block"), F.lit(shares))).join(F.broadcast(plan), F.col("dim") == F.col("of")).select("q", "share", F.lit(1).alias("kind"), "dim", "max_norm", "ids", "matrix")
    left = q.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "dim", "max_norm", "ids", "matrix")
    tasks = max(1, min(shares * max(1, len(names)), 20_000))
    dealt = left.unionByName(right).repartition(tasks, "q", "share").sortWithinPartitions("q", "share", "kind", F.desc("max_norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for row in range(batch.num_rows):
                kind, dim, ids, matrix = (batch.column(i)[row].as_py() for i in (2, 3, 5, 6))
                if kind == 0:
                    if search is not None:
                        yield from out(name, search)
                    name, search = batch.column(0)[row].as_py(), Search(dim, ids, matrix, k)
                elif search is not None:
                    search.meet(ids, matrix)
        if search is not None:
            yield from out(name, search)

    def out(name: int, search: Search) -> Iterator[pa.RecordBatch]:
        if rows := search.rows():
            place, ids, score, vec = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(vec, pa.int64())], ["q", "place", "query_id", "score", "vec_id"])

    found = arrow_map(dealt, run, "q long, place long, query_id long, score long, vec_id long")
    w = Window.partitionBy("q", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.where(F.col("vec_id") % QUERY_STEP == 0))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
WHERE rank <= 10
"""
