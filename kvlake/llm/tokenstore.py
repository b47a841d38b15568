"""Token ids in binary shards with a minimal perfect hash index (operator 5).

Shards: documents are range-partitioned by id, and each task writes its ids in
ascending order to files of the shared folder: a header of 16 bytes (magic, bytes an id,
zeros), then the raw ids, little-endian, two bytes each if the vocabulary allows. A
task writes under names of its own attempt, and only finished tasks' names
enter the tables, so a lost executor leaves unused files but no wrong ones.

The folder is the store: beside the shards it holds `entries` (a row a document), `shards` (a row a shard), `index` (a row a
bucket, in order of buckets and in small row groups) and, written last, `STORE.json`. `Store.open` reads it in any session;
`Store.get` answers for one key from the row group that holds its bucket and one range of a shard.

Index: a key is (doc_id, occurrence), so repeated ids stay apart. Keys are dealt
to buckets of about BUCKET_KEYS by hash; each bucket has a minimal perfect hash
(hash and displace: groups of keys get the first displacement that puts all into free
slots) over a table of slots (fingerprint, shard, offset, tokens). A lookup hashes
twice and reads one slot; the stored fingerprint rejects foreign keys.

Reading back goes through the index: keys find their slots, and each shard is read
by the task that has its slots, in order.

Defined results: a null text counts as empty, so it has the end id only; rows with a null doc_id come first;
rows of one doc_id follow each other by text, and so are told apart by their occurrence; a text of any length is one
document of one shard; an empty table gives none. Strings that name special tokens are those tokens, as the library has it.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import arrow_map, fresh_path, open_store, release, table, write_table

MAGIC = b"KVTOKEN1"
HEADER = "<8sHxxxxxx"
HEADER_BYTES = struct.calcsize(HEADER)
SHARD_BYTES = 64 << 20
BUCKET_KEYS = 1024
GROUP_KEYS = 4
CACHE_WORDS = 1_500_000
#: Bytes of text (or one longer text) encoded at once.
TEXT_BYTES = 2 << 20
#: Stands between words that the tokenizer gets as one text, GROUP_WORDS at a time.
MARK = b"\x01"
GROUP_WORDS = 64
#: Bytes of a row group of the index: a lookup reads one.
INDEX_GROUP = 1 << 20
END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of texts by the tokenizers library, words remembered.

    For a tokenizer whose normalizer and splitter treat what lies between white
    space on its own (as checked for the default one), the ids of a text are those of its words in a row.
    New words go to the library in groups with MARK between them; its id, which no word without MARK has, tells them apart again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.kind = "<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {b"": b""}
        with open(path, encoding="utf-8") as f:
            self.by_word = json.load(f)["pre_tokenizer"]["pretokenizers"][0].get("behavior") == "Removed"
        self.mark = self.t.encode(MARK.decode(), add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, in this encoder's width."""
        if not self.by_word:
            return [np.array(e.ids, self.kind).tobytes() for e in self.t.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        if not texts:
            return []
        if len(self.words) > CACHE_WORDS:
            self.words = {b"": b""}
        # Arrow splits at the white space of ASCII; each distinct word is looked up once, and its ids are laid out at all its places.
        cut_ = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = cut_.values.dictionary_encode()
        _, offsets, raw = coded.dictionary.buffers()
        at, raw = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1).tolist(), raw.to_pybytes() if raw is not None else b""
        distinct = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        found = list(map(self.words.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        self.learn([distinct[i] for i in new])
        for i in new:
            found[i] = self.words[distinct[i]]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, offsets, raw = ids.buffers()
        at = np.frombuffer(offsets, np.int64, len(ids) + 1)[cut_.offsets.to_numpy()].tolist()
        raw = memoryview(raw) if raw is not None else b""
        return [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, new: list[bytes]) -> None:
        """Remembers the ids of words that are not yet known."""
        plain = [w for w in new if MARK not in w] if len(self.mark) == 1 else []
        if len(plain) < len(new):
            self._learn_singly(set(new).difference(plain))
        for lo in range(0, len(plain), 20_000):
            part = plain[lo : lo + 20_000]
            found = self.t.encode_batch_fast([(b" " + MARK + b" ").join(part[i : i + GROUP_WORDS]).decode() for i in range(0, len(part), GROUP_WORDS)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(chain(e.ids, self.mark) for e in found), self.kind)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(part):  # a tokenizer that gives the mark's id to other words
                self._learn_singly(part)
                continue
            raw, width = ids.tobytes(), ids.itemsize
            starts = (np.append(0, ends[:-1] + 1) * width).tolist()
            self.words.update(zip(part, [raw[a:b] for a, b in zip(starts, (ends * width).tolist(), strict=True)], strict=True))

    def _learn_singly(self, new: Iterable[bytes]) -> None:
        new = list(new)
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            found = self.t.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.words.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(part, found, strict=True))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, k (its occurrence), part, seq, shard, first (id) and n_tokens of each document, its ids written."""
    path = tokenizer or default_tokenizer()
    head = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # Range partitions have ascending ids; equal ids share one.
    dealt = head.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, fs, root = encoder(path), TaskContext.get().partitionId(), *open_store(folder)
        end = np.array([end_id], enc.kind).tobytes()
        width, attempt = len(end), uuid.uuid4().hex[:12]
        seq, file, name, first, last, k = -1, None, "", 0, (), 0
        try:
            for batch in batches:
                ids_, n = batch.column(0).to_pylist(), batch.num_rows
                rows: list[tuple] = []
                for lo, hi in slices(pc.binary_length(batch.column(1)).to_pylist(), TEXT_BYTES) if n else ():
                    for doc, ids in zip(ids_[lo:hi], enc.encode(batch.column(1).slice(lo, hi - lo).to_pylist()), strict=True):
                        if file is None or first * width >= SHARD_BYTES:
                            if file is not None:
                                file.close()
                            seq, first = seq + 1, 0
                            name = f"shard-{part:06d}-{seq:04d}-{attempt}.bin"
                            file = fs.open_output_stream(f"{root}/{name}")
                            file.write(struct.pack(HEADER, MAGIC, width))
                        file.write(ids + end)
                        count = len(ids) // width + 1
                        k = k + 1 if last == (doc,) else 0
                        last = (doc,)
                        rows.append((doc, k, part, seq, name, first, count))
                        first += count
                release()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)
        finally:
            if file is not None:
                file.close()

    names = ["doc_id", "k", "part", "seq", "shard", "first", "n_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    return arrow_map(dealt, run, "doc_id long, k long, part int, seq int, shard string, first long, n_tokens long")


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements that send the distinct 64-bit `keys` one to one to 0 .. len(keys) - 1."""
    n = len(keys)
    groups = -(-n // GROUP_KEYS)
    if len(np.unique(keys)) < n:
        raise ValueError("two keys share a 64-bit hash")
    group = (_mix(keys) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    free, out = np.ones(n, bool), np.zeros(groups, np.uint32)
    for g in np.argsort(-np.diff(bounds), kind="stable").tolist():
        own = keys[order[bounds[g] : bounds[g + 1]]]
        if not len(own):
            break
        d, step = 0, 64
        while True:
            tries = np.arange(d, d + step, dtype=np.uint64)
            at = (_mix(own[None, :] + (tries[:, None] + np.uint64(1)) * _GOLD) % np.uint64(n)).astype(np.int64)
            ok = free[at].all(axis=1)
            if len(own) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                i = int(ok.argmax())
                out[g] = d + i
                free[at[i]] = False
                break
            d, step = d + step, min(step * 2, 8192)
    return out


def slots(keys: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key in a table of `n`."""
    group = (_mix(keys) % np.uint64(len(displacements))).astype(np.int64)
    return (_mix(keys + (displacements[group].astype(np.uint64) + np.uint64(1)) * _GOLD) % np.uint64(n)).astype(np.int64)


_SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("first", "<i8"), ("n", "<i8")])


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds the two hashes of a key and its bucket."""
    return rows.withColumn("h1", F.xxhash64(F.lit("a"), "doc_id", "k")).withColumn("h2", F.xxhash64(F.lit("b"), "k", "doc_id")).withColumn("bucket", F.pmod("h1", F.lit(buckets).cast("long")))


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """The rows of each value of a sorted column, across batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        v = held.column(column).to_numpy()
        at = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist()]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """bucket, displacements, slots; entries: doc_id, k, shard_no, first, n_tokens."""
    dealt = _hashed(entries, buckets).select("bucket", "h1", "h2", "shard_no", "first", "n_tokens").repartitionByRange("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 0):
            h1, h2, shard, first, n = (t.column(i).to_numpy() for i in range(1, 6))
            keys = h2.astype(np.int64).view(np.uint64)
            d = perfect_hash(keys)
            held = np.zeros(len(keys), _SLOT)
            at = slots(keys, d, len(keys))
            held["print"][at], held["shard"][at], held["first"][at], held["n"][at] = (h1.view(np.uint64) >> np.uint64(32)), shard, first, n
            yield pa.RecordBatch.from_arrays([pa.array([int(t.column(0)[0].as_py())], pa.int64()), pa.array([d.tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())], ["bucket", "displacements", "slots"])

    return arrow_map(dealt, run, "bucket long, displacements binary, slots binary")


def look_up(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """doc_id, k, shard_no, first, n_tokens of each of the `keys` (doc_id, k) that the index holds."""
    a = _hashed(keys.select("doc_id", "k"), buckets).select("bucket", F.lit(1).alias("kind"), "doc_id", "k", "h1", "h2", F.lit(None).cast("binary").alias("d"), F.lit(None).cast("binary").alias("s"))
    none = F.lit(None).cast("long")
    b = index.select("bucket", F.lit(0).alias("kind"), none.alias("doc_id"), none.alias("k"), none.alias("h1"), none.alias("h2"), F.col("displacements").alias("d"), F.col("slots").alias("s"))
    dealt = b.union(a).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 0):
            if t.column(1)[0].as_py() != 0 or t.num_rows == 1:
                continue  # no such bucket, or nothing asked of it
            d, s = np.frombuffer(t.column(6)[0].as_py(), np.uint32), np.frombuffer(t.column(7)[0].as_py(), _SLOT)
            asked = t.slice(1).combine_chunks()
            h1, h2 = (asked.column(i).to_numpy().astype(np.int64).view(np.uint64) for i in (4, 5))
            got = s[slots(h2, d, len(s))]
            ok = pa.array(got["print"] == (h1 >> np.uint64(32)))
            out = pa.table([asked.column(2), asked.column(3), pa.array(got["shard"]), pa.array(got["first"]), pa.array(got["n"])], ["doc_id", "k", "shard_no", "first", "n_tokens"]).filter(ok)
            yield from out.to_batches()

    return arrow_map(dealt, run, "doc_id long, k long, shard_no int, first long, n_tokens long")


class Store:
    """A folder of shards with its index, as `write` leaves it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.index = spark.read.schema("bucket long, displacements binary, slots binary").parquet(f"{folder}/index")
        self.shards = spark.read.parquet(f"{folder}/shards").select("shard_no", "shard", "base")
        self.keys = spark.read.schema("doc_id long, k long").parquet(f"{folder}/entries")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        """The store that `write` has left in `folder`, by this session or another."""
        fs, root = open_store(folder)
        with fs.open_input_file(f"{root}/STORE.json") as f:
            about = json.loads(f.read())
        if about.get("magic") != MAGIC.decode():
            raise ValueError(f"{folder} is no store")
        return cls(spark, folder, about["buckets"])

    def get(self, doc_id: int | None, k: int = 0) -> np.ndarray | None:
        """The ids of one document; None if the store has no such key. One bucket of the index and one range of a shard are read."""
        key = self.spark.createDataFrame([(doc_id, k)], "doc_id long, k long")
        h1, h2, bucket = _hashed(key, self.buckets).select("h1", "h2", "bucket").first()
        row = self.index.where(F.col("bucket") == bucket).first()
        if row is None:
            return None
        d, s = np.frombuffer(row["displacements"], np.uint32), np.frombuffer(row["slots"], _SLOT)
        got = s[slots(np.array([h2], np.int64).view(np.uint64), d, len(s))[0]]
        if int(got["print"]) != (h1 & 0xFFFFFFFFFFFFFFFF) >> 32:
            return None
        name = self.shards.where(F.col("shard_no") == int(got["shard"])).first()["shard"]
        fs, root = open_store(self.folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            magic, width = struct.unpack(HEADER, f.read(HEADER_BYTES))
            f.seek(HEADER_BYTES + int(got["first"]) * width)
            return np.frombuffer(f.read(int(got["n"]) * width), f"<u{width}").astype(np.uint32)

    def read(self, keys: DataFrame | None = None, *, payload: bool = False) -> DataFrame:
        """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of the keys' documents, read from the shards; with `payload` also ids."""
        found = look_up(self.index, keys if keys is not None else self.keys, self.buckets).join(self.shards, "shard_no")
        dealt = found.select("doc_id", "shard", "base", "first", "n_tokens").repartition("shard").sortWithinPartitions("shard", "first")
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = open_store(folder)
            name, file, width = None, None, 0
            for batch in batches:
                crcs, held = [], []
                for shard, first, n in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
                    if shard != name:
                        if file is not None:
                            file.close()
                        name, file = shard, fs.open_input_file(f"{root}/{shard}")
                        magic, width = struct.unpack(HEADER, file.read(HEADER_BYTES))
                        if magic != MAGIC:
                            raise ValueError(f"{shard} is no shard")
                    file.seek(HEADER_BYTES + first * width)
                    ids = np.frombuffer(file.read(n * width), f"<u{width}")
                    if len(ids) != n:
                        raise ValueError(f"{shard} is cut short")
                    raw = ids.astype("<u4").tobytes()
                    crcs.append(zlib.crc32(raw))
                    if payload:
                        held.append(raw)
                start = pa.array(batch.column(2).to_numpy() + batch.column(3).to_numpy())
                columns = [batch.column(0), start, batch.column(4), pa.array(crcs, pa.int64())] + ([pa.array(held, pa.binary())] if payload else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * payload)
            if file is not None:
                file.close()

        return arrow_map(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * payload)


def write(docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> Store:
    """Writes shards and index of `docs` to `folder` (a new one of the shared folder by default)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)
    rows = write_table(write_shards(docs, folder, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id), f"{folder}/entries")
    # One row a shard of 64 MB: few enough for one ordered sum.
    sums = rows.groupBy("part", "seq", "shard").agg(F.sum("n_tokens").alias("ids"))
    w = Window.orderBy("part", "seq")
    numbered = sums.select((F.row_number().over(w) - 1).alias("shard_no"), "part", "seq", "shard", (F.sum("ids").over(w) - F.col("ids")).alias("base"))
    shards = write_table(numbered, f"{folder}/shards")
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    entries = rows.join(shards.select("part", "seq", "shard_no"), ["part", "seq"]).select("doc_id", "k", "shard_no", "first", "n_tokens")
    index = build_index(entries, buckets)
    index.write.option("parquet.block.size", INDEX_GROUP).parquet(f"{folder}/index")
    with fs.open_output_stream(f"{root}/STORE.json") as f:
        f.write(json.dumps({"magic": MAGIC.decode(), "buckets": buckets}).encode())
    return Store.open(spark, folder)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(table(spark, sf_dir, "documents")).read()
