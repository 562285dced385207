"""Hashes, byte order and fixed-width codes as column expressions; BINARY in, BINARY out unless the name says hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def script_hash(script: Column) -> Column:
    """Identity of an output script."""
    return sha256(script)


def hash256(x: Column) -> Column:
    """SHA-256 of SHA-256."""
    return sha256(sha256(x))


def reverse_bytes(x: Column) -> Column:
    """Wire order to display order and back.  reverse() on BINARY would take bytes for characters."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(x), F.lit("(..)"), F.lit(1))), ""))


def block_id(header: Column) -> Column:
    """Display-order id of header or transaction bytes."""
    return reverse_bytes(hash256(header))


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def from_hex(x: Column) -> Column:
    return F.unhex(x)


def u32(n: Column) -> Column:
    """Four big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def u64(n: Column) -> Column:
    """Eight big-endian bytes of a DECIMAL(20, 0)."""
    return F.unhex(F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0"))


def from_u64(x: Column) -> Column:
    """DECIMAL(20, 0) of eight big-endian bytes."""
    return F.conv(F.hex(x), 16, 10).cast("decimal(20,0)")


def prefix8(txid: Column) -> Column:
    """The part of a transaction id that keys hold."""
    return F.substring(txid, 1, 8)


def after_prefix(prefix: str) -> str | None:
    """The least hex key above all that start with prefix; None if there is none."""
    n = int(prefix, 16) + 1
    return None if n >> (4 * len(prefix)) else f"{n:0{len(prefix)}x}"


def has_prefix(key: Column, prefix: str) -> Column:
    """Prefix test of a BINARY key as a range, which Parquet takes as a pushed filter."""
    end = after_prefix(prefix)
    low = key >= F.unhex(F.lit(prefix))
    return low if end is None else low & (key < F.unhex(F.lit(end)))
