"""Schemas of the tables, options, and errors.

A mutation log has one row a write: key, version, seq (recency within a version),
op (PUT or DEL), value, expires_at (null: never). The state of a key is its row of
greatest (version, seq); it is visible if that row is a PUT that has not expired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DEL = "PUT", "DEL"
CREATE, DELETE = "CREATE", "DELETE"
MAX_KEY_BYTES = 65_535

VPTR = T.StructType([T.StructField("fid", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("len", T.LongType())])
MUTATION_LOG = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("value", T.BinaryType()),
    T.StructField("expires_at", T.LongType()),
    T.StructField("vptr", VPTR),
])
VALUE_LOG = T.StructType([
    T.StructField("fid", T.LongType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("len", T.LongType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType()),
    T.StructField("checksum", T.LongType(), False),
])
MANIFEST_LOG = T.StructType([
    T.StructField("set_id", T.LongType(), False),
    T.StructField("change_no", T.LongType(), False),
    T.StructField("table_id", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("level", T.IntegerType()),
])


#: What the manifest knows of a table besides: its key range, rows, bytes, bytes of rows that no reader needs, newest version, time of creation.
TABLE_META = [
    T.StructField("min_key", T.BinaryType()),
    T.StructField("max_key", T.BinaryType()),
    T.StructField("key_count", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("stale_bytes", T.LongType()),
    T.StructField("max_version", T.LongType()),
    T.StructField("created_at", T.LongType()),
]
TABLE_LOG = T.StructType([*MANIFEST_LOG.fields, *TABLE_META])


class KvError(Exception):
    """Any error of the engine."""


class KeyNotFound(KvError):
    """The key has no visible value."""


class EmptyKey(KvError):
    """A key must have at least one byte."""


class KeyTooLong(KvError):
    """A key has more than MAX_KEY_BYTES bytes."""


class InvalidRequest(KvError):
    """An argument is out of range, such as a GC ratio outside (0, 1)."""


class BatchTooBig(KvError):
    """A batch reaches the limit of rows or bytes."""


class NoRewrite(KvError):
    """Value-log GC found no file worth rewriting."""


class Rejected(KvError):
    """Another maintenance job runs."""


class BadManifest(KvError):
    """The manifest is corrupt: bad magic, version or checksum, or changes that don't fit."""


class ChecksumMismatch(KvError):
    """A value log record does not match its checksum."""


class Closed(KvError):
    """The engine was closed."""


@dataclass(frozen=True)
class EngineOptions:
    """Knobs of an engine.

    value_threshold: values of so many bytes or more go to the value log.
    max_batch_count, max_batch_size: a batch that reaches either is refused.
    level0_tables: tables in level 0 that make a compaction due; level sizes
    grow by level_multiplier from base_level_size; tables of a level grow by table_multiplier.
    value_log_file_size: bytes of a value-log file, about. grace_seconds: files that nothing names any more are
    deleted so long after they were written, so that readers that have begun can end. cached_values: values that point reads keep.
    """

    value_threshold: int = 1024
    max_batch_count: int = 1_000_000_000
    max_batch_size: int = 1 << 44
    verify_checksum: bool = False
    memtable_size: int = 64 << 20
    base_level_size: int = 10 << 20
    base_table_size: int = 5 << 20
    level_multiplier: int = 10
    table_multiplier: int = 2
    level0_tables: int = 15
    max_levels: int = 7
    value_log_file_size: int = 1 << 30
    grace_seconds: int = 3600
    cached_values: int = 1024
