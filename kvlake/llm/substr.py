"""Removal of long word sequences that occur more than once, by seed and extend (operator 8).

Texts are joined on winnowed anchors of ANCHOR words (module repeats). The places of an anchor
are extended both ways, word by word and all at once: places that agree in so many words to the right, or to the left,
form a class, and a place that is alone in its class goes no further. Where two or more places agree in classes to both sides that make
`length` words together, these words are a repeat; neighbouring ones join to maximal repeats of at least `length` words.
All copies go, the first included. Windows are judged on the input.

Defined results: a null text has no words; windows do not cross documents; repeated rows are
repeats of each other; a text of any length is taken whole; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import table

LENGTH = 35
ANCHOR = 12


def _classes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places that agree in their class and the next word; -1: alone in it, or gone before."""
    out = np.full(len(before), -1)
    at = np.flatnonzero((before >= 0) & (words >= 0))
    _, inverse, counts = np.unique(before[at] * (int(words.max(initial=0)) + 1) + words[at], return_inverse=True, return_counts=True)
    out[at] = np.where(counts[inverse] > 1, inverse, -1)
    return out


def extended(anchors: np.ndarray, parts: list[bytes], window: int, anchor_words: int = ANCHOR) -> list[list[int]]:
    """The window starts of each part (words joined by a space) that lie in repeats; anchors: the part's anchor."""
    k = min(anchor_words, window)
    words = [p.split(b" ") for p in parts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    begins = np.concatenate([[0], ends[:-1]])
    flat = list(chain.from_iterable(words))
    symbols = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    part = np.repeat(np.arange(len(parts)), ends - begins)
    seeds = repeats.anchor_hashes(repeats.unit_of(repeats.Words).hashes(flat), k)
    at = np.flatnonzero(seeds == anchors[part[: len(seeds)]])
    at = at[at + k <= ends[part[at]]]
    low, high = begins[part[at]], ends[part[at]]
    group = np.unique(anchors[part[at]], return_inverse=True)[1]
    right, left = [group], [group]
    for n in range(1, window + 1):
        right.append(_classes(right[-1], np.where(at + n <= high, symbols[np.minimum(at + n - 1, len(symbols) - 1)], -1)))
    for n in range(1, window - k + 1):
        left.append(_classes(left[-1], np.where(at - n >= low, symbols[np.maximum(at - n, 0)], -1)))
    hits = [np.zeros(0, np.int64)]
    for n, l_ in enumerate(left):
        both = _classes(l_, right[window - n])
        hits.append(at[both >= 0] - n)
    found = np.unique(np.concatenate(hits))
    out: list[list[int]] = [[] for _ in parts]
    for i, p in zip(part[found].tolist(), (found - begins[part[found]]).tolist(), strict=True):
        out[i].append(p)
    return out


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, payload: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document; with `payload` also kept (words left, joined by a space) and spans (start, end of the words that went)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for i, text, whole, starts in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    w = text.split()
                    gone = repeats.covered(len(w), length, whole, starts)
                    bounds = [0, *(x for g in gone for x in g), len(w)]
                    left = [x for a, b in zip(bounds[::2], bounds[1::2], strict=True) for x in w[a:b]]
                    kept = b" ".join(left)
                    row = (i, len(w), len(w) - len(left), hashlib.sha256(kept).hexdigest())
                    rows.append(row + (kept.decode(), [{"start": a, "end": b} for a, b in gone]) if payload else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept", "spans"] * payload
    kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][: len(names) - 3]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<start:long,end:long>>" * payload
    return repeats.strip(docs, run, schema, id_col=id_col, text_col=text_col, kind=repeats.Words, k=min(ANCHOR, length), w=length - min(ANCHOR, length) + 1, mode="any", find=extended)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hashed AS (SELECT row, unnest(list_transform(range(1, len(w) - 33), lambda s: sha256(array_to_string(w[s:s + 34], ' ')))) AS h, generate_subscripts(list_transform(range(1, len(w) - 33), lambda s: s), 1) AS s FROM d WHERE len(w) >= 35),
again AS (SELECT row, s FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS s FROM d),
marked AS (SELECT x.row, x.s, x.word, count(a.s) OVER (PARTITION BY x.row ORDER BY x.s ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone FROM words x LEFT JOIN again a ON x.row = a.row AND x.s = a.s)
SELECT any_value(d.doc_id) AS doc_id, count(m.s) AS n_words, count(m.s) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY s) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN marked m ON d.row = m.row GROUP BY d.row
"""
