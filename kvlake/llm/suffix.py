"""Removal of long byte strings that occur earlier (operator 6).

A byte goes if a string of `length` bytes that covers it also starts earlier: in a
document of smaller id, or before in the same one. Strings are judged on the input.

Repeats are found among segments of the texts that can hold any (module repeats). The
segments of a shard are joined and their suffixes sorted by external induced sorting (module
induced), which gives each its common prefix with the one before; neighbours that share
`length` bytes form classes, of which the earliest start stays.

Defined results: a null text is empty; strings do not cross documents; texts shorter than
`length` stay; rows with a null id come before all others; rows that agree in id and text count
as one document; a text of any length is one string, sorted on disk where it exceeds memory; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import table
from .induced import suffix_array

LENGTH = 100
#: Bytes hashed together for an anchor.
ANCHOR = 32


def alike(anchors: np.ndarray, parts: list[bytes], window: int) -> list[bool]:
    """Whether a part may share a window with another or with itself: of the bytes besides the anchor, half are to one side of it,
    and so many are the same, by their hash, beside another of its places."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    part = np.repeat(np.arange(len(parts)), lengths)
    h = repeats.Bytes().hashes(b"".join(parts))
    right = (window - ANCHOR) // 2
    left = window - ANCHOR - right
    seeds = repeats.anchor_hashes(h, ANCHOR)
    at = np.flatnonzero(seeds == anchors[part[: len(seeds)]])
    at = at[at + ANCHOR <= ends[part[at]]]
    keep = np.zeros(len(parts), bool)
    for size, start in ((ANCHOR + right, at), (ANCHOR + left, at - left)):
        if size > len(h):
            continue
        ok = (start >= (ends - lengths)[part[at]]) & (start + size <= ends[part[at]])
        of = part[at[ok]]
        _, inverse, counts = np.unique(repeats.anchor_hashes(h, size)[start[ok]], return_inverse=True, return_counts=True)
        keep[of[counts[inverse] > 1]] = True
    return keep.tolist()


def later_windows(anchors: np.ndarray | None, parts: list[bytes], window: int) -> list[list[int]]:
    """The window starts of each part whose bytes also start before: in a part before it, or earlier in its own."""
    if anchors is not None and window > ANCHOR:
        keep = alike(anchors, parts, window)
        found = iter(later_windows(None, [p for p, k in zip(parts, keep, strict=True) if k], window))
        return [next(found) if k else [] for k in keep]
    if not parts:
        return []
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1)
    symbols = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int32) + 2
    symbols[ends - 1] = 1  # ends of parts; no window crosses one
    part = np.repeat(np.arange(len(parts), dtype=np.int32), lengths + 1)
    order, prefix = suffix_array(np.concatenate([symbols, [0]]), cap=window)
    order, prefix = order[1:], prefix[1:]
    # Windows that cross an end differ from all that don't, so a class has one kind only.
    starts = np.flatnonzero(prefix < window)
    many = np.diff(np.append(starts, len(order))) > 1
    in_class = np.repeat(many, np.diff(np.append(starts, len(order))))
    first = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(order)))) if len(order) else order
    # Parts stand in order, so the least place is the earliest.
    later = np.sort(order[in_class & (order != first) & ((ends - 1)[part[np.minimum(order, len(part) - 1)]] - order >= window)])
    out: list[list[int]] = [[] for _ in parts]
    for n, p in zip(part[later].tolist(), (later - (ends - lengths - 1)[part[later]]).tolist(), strict=True):
        out[n].append(p)
    return out


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, payload: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with `payload` also kept (the bytes left) and spans (start, end of what went)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for i, text, whole, starts in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    gone = repeats.covered(len(text), length, whole, starts)
                    bounds = [0, *(x for g in gone for x in g), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if gone else text
                    row = (i, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                    rows.append(row + (kept, [{"start": a, "end": b} for a, b in gone]) if payload else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * payload
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][: len(names) - 4]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * payload
    return repeats.strip(docs, run, schema, id_col=id_col, text_col=text_col, kind=repeats.Bytes, k=min(ANCHOR, length), w=length - min(ANCHOR, length) + 1, mode="earlier", find=later_windows)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS x FROM documents),
hashed AS (SELECT row, doc_id, s, md5(array_slice(x, s, s + 99)) AS h FROM (SELECT row, doc_id, x, unnest(range(1, octet_length(x) - 98)) AS s FROM d WHERE octet_length(x) >= 100)),
again AS (SELECT row, s FROM (SELECT row, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM hashed) WHERE n > 1),
bytes AS (SELECT row, s, hex(array_slice(x, s, s)) AS b FROM (SELECT row, x, unnest(range(1, octet_length(x) + 1)) AS s FROM d)),
marked AS (SELECT y.row, y.s, y.b, count(a.s) OVER (PARTITION BY y.row ORDER BY y.s ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone FROM bytes y LEFT JOIN again a ON y.row = a.row AND y.s = a.s),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY s), false) AS begins FROM marked)
SELECT any_value(d.doc_id) AS doc_id, count(r.s) AS n_bytes, count(r.s) FILTER (gone) AS n_removed, count(r.s) FILTER (begins) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY s) FILTER (NOT gone), ''))) AS kept_sha256
FROM d LEFT JOIN runs r ON d.row = r.row GROUP BY d.row
"""
