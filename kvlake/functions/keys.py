"""Key codecs, sizes, file names: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U64 = (1 << 64) - 1


def big_endian(x: Column, width: int = 8) -> Column:
    """A number as `width` bytes, highest first."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * width, "0"))


def from_big_endian(b: Column) -> Column:
    """Up to 8 bytes as a number (values of 2**63 and more are out of range and give null)."""
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)").cast("long")


def from_big_endian_unsigned(b: Column) -> Column:
    """Up to 8 bytes as a number of 0 to 2**64 - 1 (decimal)."""
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def uvarint(x: Column) -> Column:
    """An unsigned number of up to 63 bits in groups of 7 bits, lowest first; all but the last byte have the high bit set."""
    x = x.cast("long")
    n = uvarint_size(x)
    byte = lambda i: F.call_function("shiftrightunsigned", x, i * 7).bitwiseAND(F.lit(127).cast("long"))
    marked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(marked, ""))


def from_uvarint(b: Column) -> Column:
    """The number that `uvarint` has written."""
    at = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.substring(F.hex(b), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    low = F.transform(at, lambda v, i: F.call_function("shiftleft", v.bitwiseAND(F.lit(127).cast("long")), i * 7))
    return F.aggregate(low, F.lit(0).cast("long"), lambda a, v: a + v)


def byte_slice(b: Column) -> Column:
    """Bytes with their length before them, in four bytes."""
    return F.concat(big_endian(F.octet_length(b), 4), b.cast("binary"))


def from_byte_slice(b: Column) -> Column:
    """The bytes that `byte_slice` has written; what follows is not read."""
    return F.substring(b, F.lit(5), from_big_endian(F.substring(b, F.lit(1), F.lit(4))).cast("int"))


def internal_key(key: Column, version: Column) -> Column:
    """key, then the complement of version in 8 bytes: byte order is key, then newest first."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(version.cast("long"))), 16, "0")))


def user_key(internal: Column) -> Column:
    return F.substring(internal, F.lit(1), F.octet_length(internal) - 8)


def key_version(internal: Column) -> Column:
    return F.bitwise_not(F.conv(F.hex(F.substring(internal, F.octet_length(internal) - 7, F.lit(8))), 16, -10).cast("long"))


def same_key(a: Column, b: Column) -> Column:
    """Two internal keys of one user key."""
    return user_key(a) == user_key(b)


def uvarint_size(x: Column) -> Column:
    """Bytes of an unsigned number at 7 bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x.cast("long"))) / 7)).cast("int")


def entry_size(key: Column, value: Column, threshold: int) -> Column:
    """Estimated bytes of a row in a table: a value of `threshold` or more counts as its 12-byte pointer."""
    n = F.coalesce(F.octet_length(value), F.lit(0))
    return (F.octet_length(key) + F.when(n < threshold, n).otherwise(12) + 2).cast("long")


def encoded_size(value: Column, expires_at: Column) -> Column:
    """Bytes of a stored value: the value, its expiry as uvarint, and one for its flags."""
    return (F.coalesce(F.octet_length(value), F.lit(0)) + uvarint_size(F.coalesce(expires_at, F.lit(0))) + 1).cast("long")


def log_record_size(key: Column, value: Column) -> Column:
    """Estimated bytes of a row in a write-ahead log: 8 for the expiry, 4 for the checksum, 21 for the header."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 33).cast("long")


def request_size(key: Column, value: Column) -> Column:
    """Estimated bytes of a row in a batch to be written: 4 for the checksum, 21 for the header."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 25).cast("long")


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is at least x (x >= 1)."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(x.cast("long") - 1))).cast("long"))


def file_name(fid: Column, kind: str) -> Column:
    """Five digits at least and a suffix: sst, vlog or wal."""
    digits = fid.cast("string")
    return F.concat(F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits), F.lit(f".{kind}"))


def file_id(name: Column) -> Column:
    """The number in a file name, with or without folders; null for other names."""
    found = F.regexp_extract(name, r"(?:^|/)([0-9]+)\.(?:sst|vlog|wal)$", 1)
    return F.when(found != "", found.cast("long"))


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two strings share at their start, by halving steps over their hex forms."""
    x, y = F.hex(a), F.hex(b)
    n = F.least(F.length(x), F.length(y)) / 2
    same = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: F.substring(x, F.lit(1), i * 2) == F.substring(y, F.lit(1), i * 2))
    return F.array_max(same)
