"""Byte-level BPE encoding and decoding by DuckDB recursive queries (operator 1).

Each partition runs on its own, in slices of texts. A slice's texts are cut into chunks, at
spaces that no match of the pattern runs across, and each distinct chunk into the matches of the
pattern. Distinct matches that the worker does not hold go to DuckDB as rows
(word, position, token), one for each byte. A recursive query joins
neighbouring tokens with the merge table, contracts each word's pair of least rank, the
leftmost of equals, and repeats until no pair is left. Ordered
aggregation over the positions yields each word's ids. For decoding, ids are cut into groups,
each distinct group is joined with the vocabulary and its bytes aggregated in order.
From distinct chunks and groups to whole texts it is one gather of Arrow arrays.

A recursive query keeps the rows of all its steps, so it runs in rounds: each stops
after so many steps that its rows stay under ROUND_ROWS, and unfinished words enter the
next. Memory: a slice has SLICE_BYTES of text (or one longer text), and the words that a worker
remembers take MEMO_BYTES at most; what is forgotten is encoded again, so neither changes a result.

Defined results: a null text counts as empty and has no ids; any text
round-trips; repeated rows give equal rows; other columns are not read. Matches of
LONG bytes or more contract in one step all places that one at a time would contract in turn; those of HUGE
bytes or more, whose steps and rows would be too many for a recursive query, contract by a heap of pairs, so
no text or match is too long. All give the same ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, release, table

ROUND_ROWS = 1_000_000
#: Bytes of words that one query starts from.
START_ROWS = 60_000
#: Bytes of the words that a worker remembers, with their ids.
MEMO_BYTES = 24 << 20
#: Bytes of text handled at once.
SLICE_BYTES = 4 << 20
#: Tokens of a group at most.
GROUP_TOKENS = 4096
MEMORY = "200MB"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# Steps of a round. A row's key k packs (word, position); positions stay dense, so
# the next token is at k + 1. A pair's key packs (rank, position): its minimum
# is the pair of least rank, the leftmost of equals. {p}: bits of a position, {low}: its mask,
# {b}: bits of a token in merges.pair.
_STEPS = """
WITH RECURSIVE t(step, k, tok) AS (
  SELECT 0::SMALLINT, k, tok FROM start
  UNION ALL
  SELECT (p.step + 1)::SMALLINT, CASE WHEN p.k > b.at THEN p.k - 1::{type} ELSE p.k END, CASE WHEN p.k = b.at THEN b.new ELSE p.tok END
  FROM t p
  JOIN (
    SELECT word, ((word << {p}) | (best & {low}))::{type} AS at, (best >> {p})::{type} AS new
    FROM (
      SELECT x.k >> {p} AS word, min((m.id << {p}) | (x.k & {low})) AS best
      FROM t x JOIN t y ON y.k = x.k + 1::{type} JOIN {merges} m ON m.pair = (x.tok << {b}) | y.tok
      GROUP BY x.k >> {p}
    )
  ) b ON p.k >> {p} = b.word
  WHERE p.step < $steps AND p.k <> b.at + 1::{type}
)
"""
# A word has one row at position 0 in each of its steps.
_RESULT = """
SELECT t.k >> {p} AS word, any_value(t.step) AS steps, list(t.tok ORDER BY t.k) AS ids
FROM t
JOIN (SELECT k >> {p} AS word, max(step) AS step FROM t WHERE k & {low} = 0 GROUP BY 1) last ON t.k >> {p} = last.word AND t.step = last.step
GROUP BY 1 ORDER BY 1
"""
_WIDE = {"type": "BIGINT", "p": 22, "low": (1 << 22) - 1, "b": 24, "merges": "merges"}
_NARROW = {"type": "UINTEGER", "p": 6, "low": 63, "b": 16, "merges": "narrow_merges"}  # short words, ids below 2**16

# The same for long words, many contractions a step. All places of the least rank are contracted
# in one step as far as that is what one at a time would do: of overlapping places (a run of
# one token) every second, and none after a place whose contraction forms a pair of lower rank.
_LONG_STEPS = """
WITH RECURSIVE t(step, k, tok) AS (
  SELECT 0::SMALLINT, k, tok FROM start
  UNION ALL (
    WITH pairs AS (
      SELECT x.k, m.id FROM t x JOIN t y ON y.k = x.k + 1 JOIN merges m ON m.pair = (x.tok << 24) | y.tok
    ), least AS (
      SELECT k, id FROM (SELECT k, id, min(id) OVER (PARTITION BY k >> 22) AS best FROM pairs) WHERE id = best
    ), runs AS (
      SELECT k, id, k - row_number() OVER (PARTITION BY k >> 22 ORDER BY k) AS run FROM least
    ), apart AS (
      SELECT k, id FROM (SELECT k, id, k - min(k) OVER (PARTITION BY k >> 22, run) AS spot FROM runs) WHERE spot % 2 = 0
    ), sides AS (
      SELECT a.k, a.id, CASE WHEN e.k IS NOT NULL THEN a.id ELSE b.tok END AS before, f.tok AS after
      FROM apart a LEFT JOIN apart e ON e.k = a.k - 2 LEFT JOIN t b ON b.k = a.k - 1 LEFT JOIN t f ON f.k = a.k + 2
    ), last AS (
      SELECT s.k >> 22 AS word, min(s.k) AS k
      FROM sides s
      LEFT JOIN merges m ON m.pair = (s.before << 24) | s.id
      LEFT JOIN merges n ON n.pair = (s.id << 24) | s.after
      WHERE m.id < s.id OR n.id < s.id
      GROUP BY 1
    ), chosen AS (
      SELECT a.k, a.id FROM apart a LEFT JOIN last l ON l.word = a.k >> 22 WHERE l.k IS NULL OR a.k <= l.k
    )
    SELECT (step + 1)::SMALLINT, k - gone, tok
    FROM (
      SELECT p.step, p.k, coalesce(c.id, p.tok) AS tok, d.k AS dropped,
             count(d.k) OVER (PARTITION BY p.k >> 22 ORDER BY p.k) AS gone
      FROM t p LEFT JOIN chosen c ON c.k = p.k LEFT JOIN chosen d ON d.k = p.k - 1
      WHERE p.step < $steps AND p.k >> 22 IN (SELECT k >> 22 FROM chosen)
    )
    WHERE dropped IS NULL
  )
)
"""
#: Bytes from which a word counts as long, and from which it is contracted outside DuckDB.
LONG = 64
HUGE = 1 << 13


class Codec:
    """A vocabulary of ranks in an in-memory DuckDB database, and what was encoded with it."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.by_space = pattern == default_pattern()  # the pattern for which chunks are known to be whole
        # Bounded by ROUND_ROWS and GROUP_TOKENS, so nothing needs to go to disk.
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        pairs, ids = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 24 | b), ids.append(rank)
        pair, id_ = np.array(pairs, np.int64), np.array(ids, np.int64)
        self._store("merges", pa.table({"pair": pair, "id": id_}))
        self.narrow = max(ranks.values()) < 1 << 16
        if self.narrow:
            self._store("narrow_merges", pa.table({"pair": ((pair >> 24 << 16) | (pair & 0xFFFF)).astype(np.uint32), "id": id_.astype(np.uint32)}))
        self._store("vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int64()), "bytes_hex": [t.hex() for t in ranks]}))
        self.bytes_of = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] | None = None  # for _merge_one, made when needed
        whole = {}  # matches that are one token
        for token, rank in ranks.items():
            try:
                whole[token.decode()] = rank.to_bytes(4, "little")
            except UnicodeDecodeError:
                continue
        # What the worker remembers: those first, then words met, with the slice that met them last.
        self.held, self.held_ids = pa.array(whole, pa.large_string()), pa.array(whole.values(), pa.large_binary())
        self.fixed, self.met, self.now = len(whole), np.zeros(len(whole), np.int32), 0
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[r for t, r in ranks.items() if t[:1] == b" "]] = True

    def _store(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct words, by recursive queries until fixpoint."""
        out = [self._merge_one(w) if len(w) >= HUGE else b"" for w in words]
        word = np.array([i for i, w in enumerate(words) if len(w) < HUGE], np.int64)
        lengths = np.fromiter((len(words[i]) for i in word), np.int64, len(word))
        tokens = self.bytes_of[np.frombuffer(b"".join(words[i] for i in word), np.uint8)]
        while len(word):
            short = int(lengths.max()) < LONG
            form = _NARROW if short and self.narrow else _WIDE
            kind = np.uint32 if form is _NARROW else np.int64
            steps = max(8, min(int(lengths.max()), ROUND_ROWS // len(tokens)))
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.repeat(np.arange(len(word)), lengths) << form["p"] | places
            self._store("start", pa.table({"k": at.astype(kind), "tok": tokens.astype(kind)}))
            query = ((_STEPS if short else _LONG_STEPS) + _RESULT).format(**form)
            found = self.con.sql(query, params={"steps": steps}).to_arrow_table()
            ids = pa.concat_arrays(found.column(2).chunks)
            ends, left = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            again = (found.column(1).to_numpy() >= steps) & (sizes > 1)
            raw = left.astype("<u4").tobytes()
            for n in np.flatnonzero(~again).tolist():
                out[word[n]] = raw[4 * ends[n] : 4 * ends[n + 1]]
            tokens = left[np.repeat(again, sizes)]
            word, lengths = word[again], sizes[again]
        return out

    def _merge_one(self, word: bytes) -> bytes:
        """The ids of one word by a heap of its pairs: each step costs the logarithm of the pairs, not all rows."""
        if self.pairs is None:
            self.pairs = dict(self.con.sql("SELECT pair, id FROM merges").fetchall())
        pairs, n = self.pairs, len(word)
        tokens = array("q", self.bytes_of[np.frombuffer(word, np.uint8)].tobytes())
        before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        heap = [id_ << 40 | i for i in range(n - 1) if (id_ := pairs.get(tokens[i] << 24 | tokens[i + 1])) is not None]
        heapify(heap)
        while heap:
            best = heappop(heap)
            i, id_ = best & (1 << 40) - 1, best >> 40
            if tokens[i] < 0 or (j := after[i]) == n or pairs.get(tokens[i] << 24 | tokens[j]) != id_:
                continue  # one of its tokens has been contracted since
            tokens[i], tokens[j] = id_, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pairs.get(id_ << 24 | tokens[k])) is not None:
                    heappush(heap, new << 40 | i)
            if (k := before[i]) >= 0 and (new := pairs.get(tokens[k] << 24 | id_)) is not None:
                heappush(heap, new << 40 | k)
        left = np.frombuffer(tokens, np.int64)
        return left[left >= 0].astype("<u4").tobytes()

    def word_ids(self, words: pa.Array) -> pa.Array:
        """The ids of each of some distinct matches, as little-endian 32-bit integers."""
        words = words.cast(pa.large_string())
        self.now += 1
        at = pc.index_in(words, value_set=self.held)
        known = at.is_valid()
        self.met[at.drop_null().to_numpy()] = self.now
        new = words.filter(pc.invert(known))
        if not len(new):
            return self.held_ids.take(at)
        raw = new.cast(pa.large_binary()).to_pylist()
        made: list[bytes] = [b""] * len(raw)
        order = sorted(range(len(raw)), key=lambda n: len(raw[n]))
        sizes = np.array([len(raw[n]) for n in order])
        split = int(np.searchsorted(sizes, LONG))
        for part in (order[:split], order[split:]):
            for lo, hi in slices((len(raw[n]) for n in part), START_ROWS) if part else ():
                for n, ids in zip(part[lo:hi], self.merge([raw[n] for n in part[lo:hi]]), strict=True):
                    made[n] = ids
        new_ids = pa.array(made, pa.large_binary())
        places = np.where(known.to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(), 0)
        places[~known.to_numpy(zero_copy_only=False)] = len(self.held) + np.arange(len(new))
        held, held_ids = pa.concat_arrays([self.held, new]), pa.concat_arrays([self.held_ids, new_ids])
        out = held_ids.take(pa.array(places))
        self.held, self.held_ids, self.met = held, held_ids, np.concatenate([self.met, np.full(len(new), self.now, np.int32)])
        if self.held.nbytes + self.held_ids.nbytes > MEMO_BYTES:  # half stays: what was met last
            keep = np.argsort(-self.met[self.fixed :], kind="stable")[: (len(self.met) - self.fixed) // 2] + self.fixed
            keep = pa.array(np.concatenate([np.arange(self.fixed), np.sort(keep)]))
            self.held, self.held_ids, self.met = self.held.take(keep), self.held_ids.take(keep), self.met[keep.to_numpy()]
            if self.held.nbytes + self.held_ids.nbytes > MEMO_BYTES:  # words that long are not worth it
                self.held, self.held_ids, self.met = self.held.slice(0, self.fixed), self.held_ids.slice(0, self.fixed), self.met[: self.fixed]
        return out

    def _chunk_ids(self, led: list[str], others: list[str]) -> pa.Array:
        """The ids of distinct chunks: a space and each of `led`, then `others`."""
        matches = self.find(" " + " ".join(led)) if led else []
        chunk_ends = np.cumsum(np.fromiter(map(len, led), np.int64, len(led)) + 1)
        match_ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        ends = [np.searchsorted(match_ends, chunk_ends) + 1]
        if len(matches) and not (match_ends[ends[0] - 1] == chunk_ends).all():
            raise AssertionError("a match runs across chunks")
        for c in others:
            matches += self.find(c)
            ends.append(np.array([len(matches)]))
        coded = pa.array(matches, pa.string()).dictionary_encode()
        ids = self.word_ids(coded.dictionary).take(coded.indices)
        return grouped(ids, np.concatenate([[0], *ends]))

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (large binary: little-endian unsigned 32-bit integers).

        Chunks end before each space that stands between two characters that are not white space; as the
        pattern lets no match run across such a place, each distinct chunk is matched once.
        """
        n = len(texts)
        if not n:
            return pa.array([], pa.large_binary())
        others: dict[str, int] = {}
        if not self.by_space:
            index = np.array([others.setdefault(t, len(others)) for t in texts.to_pylist()], np.int64)
            return self._chunk_ids([], list(others)).take(pa.array(index))
        pieces = pc.split_pattern(texts, " ")
        at = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.values.dictionary_encode()
        names, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # Pieces that are empty or have white space at an end: their texts are cut one by one.
        odd = pc.match_substring_regex(names, _EDGE).to_numpy(zero_copy_only=False)
        plain = ~np.logical_or.reduceat(odd[index], at[:-1])  # a text has a piece at least
        lengths = np.diff(at)
        led = np.zeros(len(names), bool)
        led[index[np.repeat(plain, lengths) & (np.arange(len(index)) != np.repeat(at[:-1], lengths))]] = True
        place = np.cumsum(led) - 1
        base = int(led.sum())
        parts, ends = [], np.zeros(n + 1, np.int64)
        for i, (a, b, whole) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), plain.tolist(), strict=True)):
            if whole:
                first = names[index[a]].as_py()
                own = place[index[a:b]]
                own[0] = base + others.setdefault(first, len(others))
            else:
                own = np.array([base + others.setdefault(c, len(others)) for c in _chunks(texts[i].as_py())], np.int64)
            parts.append(own)
            ends[i + 1] = ends[i] + len(own)
        chunks = self._chunk_ids(names.filter(pa.array(led)).to_pylist(), list(others))
        return grouped(chunks.take(pa.array(np.concatenate(parts))), ends)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes (large binary) of each sequence of ids.

        A sequence is cut before tokens that begin with a space; each distinct group
        is joined with the vocabulary, its bytes aggregated in order.
        """
        if not len(ids):
            return pa.array([], pa.large_binary())
        ends = bounds(ids) // 4
        raw = ids.buffers()[2]
        flat = np.frombuffer(raw if raw is not None else b"", "<u4", int(ends[-1]))[ends[0] :]
        ends = ends - ends[0]
        if not len(flat):
            return pa.array([b""] * len(ids), pa.large_binary())
        if int(flat.max()) >= len(self.opens):
            raise ValueError("an id is not of the vocabulary")
        starts = self.opens[flat]
        starts[::GROUP_TOKENS] = True
        starts[ends[:-1][ends[:-1] < len(flat)]] = True
        at = np.append(np.flatnonzero(starts), len(flat))
        coded = binary(flat.astype("<u4"), at * 4).dictionary_encode()
        new, found = coded.dictionary, []
        sizes = np.diff(bounds(new)) // 4
        for lo, hi in slices(sizes.tolist(), ROUND_ROWS // 4):
            tokens = np.frombuffer(b"".join(new[lo:hi].to_pylist()), "<u4").astype(np.int64)
            self.con.register("incoming", pa.table({"item": pa.array(np.repeat(np.arange(hi - lo), sizes[lo:hi])), "pos": pa.array(np.arange(len(tokens))), "id": pa.array(tokens)}))
            rows = self.con.sql("SELECT unhex(string_agg(v.bytes_hex, '' ORDER BY i.pos)) AS text FROM incoming i JOIN vocabulary v ON v.id = i.id GROUP BY i.item ORDER BY i.item").to_arrow_table()
            self.con.unregister("incoming")
            found += [c.cast(pa.large_binary()) for c in rows.column(0).chunks]
        groups = pa.concat_arrays(found)
        if len(groups) != len(new):
            raise ValueError("an id is not of the vocabulary")
        return grouped(groups.take(coded.indices), np.searchsorted(at, ends))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string())).to_pylist()

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        return self.decode(pa.array(ids, pa.large_binary())).to_pylist()


_between = re.compile(r"(?<=\S)(?= \S)")
#: Empty, or with white space (by any reading of it) at an end.
_EDGE = r"^$|^[\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}]$"


def _chunks(text: str) -> list[str]:
    """`text` cut before each space that stands between two other characters that are not white space."""
    return _between.split(text) if text else []


def bounds(items: pa.Array) -> np.ndarray:
    """Where the values of a large binary array begin and end in its data."""
    return np.frombuffer(items.buffers()[1], np.int64)[items.offset : items.offset + len(items) + 1]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A large binary array over `data`, with the bounds `ends`."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)])


def grouped(items: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbours of a large binary array joined: one value from each of `ends` to the next."""
    data = items.buffers()[2]
    return binary(np.frombuffer(data if data is not None else b"", np.uint8), bounds(items)[ends])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary; built once a Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to `most`, or of one."""
    lo = hi = held = 0
    for hi, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, hi
            lo, held = hi, 0
        held += n
    if held or hi >= lo:
        yield lo, hi + 1


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, digest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_tokens and ids (binary, little-endian 32-bit) of each document, and the columns `keep`.

    With `digest` the ids are decoded again and only SHA-256 digests
    (ids_sha256, decoded_sha256) leave the task, in place of the ids.
    """
    path, pat = ranks or default_ranks(), pattern or default_pattern()
    head = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    fields = head.schema.fields[:-1]
    n_head = len(fields)
    tail = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        release()
        for batch in batches:
            texts = batch.column(n_head)
            for lo, hi in slices(pc.binary_length(texts).to_pylist(), SLICE_BYTES) if len(texts) else ():
                ids = c.encode(texts.slice(lo, hi - lo))
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(n_head)] + [pc.divide(pc.binary_length(ids), 4).cast(pa.int64())]
                if digest:
                    columns += [_sha256(ids), _sha256(c.decode(ids))]
                else:
                    columns.append(ids.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
                ids = columns = None
                release()  # else what slices have freed piles up

    names = [f.name for f in fields] + (["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + tail
    return arrow_map(head, run, schema)


def _sha256(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """id and text_bytes (binary) of each row of ids."""
    path, pat = ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c.decode_all([x or b"" for x in batch.column(1).to_pylist()]), pa.binary())], [id_col, "text_bytes"])

    head = encoded.select(id_col, ids_col)
    return arrow_map(head, run, f"`{id_col}` {head.schema[0].dataType.simpleString()}, text_bytes binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
