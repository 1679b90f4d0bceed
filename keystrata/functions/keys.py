"""Key columns: unsigned order, 16-byte keys, validation, index errors.

Keys are BIGINT, STRING or BINARY columns.  Strings and binaries compare byte by
byte, unsigned.  A 64-bit unsigned key travels as a BIGINT of the same bits and is
ordered by ``flipped``; a 128-bit key is BINARY(16), big-endian, whose byte order is
its numeric order.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rank import dealt, stored

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


class IndexError_(ValueError):
    """An index cannot be built or opened."""


class DuplicateKeyError(IndexError_):
    """A key occurs twice where keys must be unique."""


class NullKeyError(IndexError_):
    """A key is null."""


class HashCollisionError(IndexError_):
    """Two keys have one hash."""


class EmptyKeysError(IndexError_):
    """No keys where some are asked for (``strict``)."""


class CorruptDataError(IndexError_):
    """A stored index lacks its metadata or does not match it."""


def flipped(key: Column) -> Column:
    """The BIGINT whose signed order is the unsigned order of ``key``'s bits."""
    return key.bitwiseXOR(F.lit(LONG_MIN))


def unsigned(value: int) -> int:
    """The signed 64-bit number with the bits of an unsigned one."""
    if not 0 <= value < 1 << 64:
        raise ValueError(f"{value} is no unsigned 64-bit number")
    return value - (1 << 64) if value > LONG_MAX else value


def unsigned_decimal(key: Column) -> Column:
    """An unsigned key's value as DECIMAL(20, 0)."""
    value = key.cast("decimal(20,0)")
    return F.when(key < 0, value + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(value).cast("decimal(20,0)")


def wide(value: int) -> bytes:
    """A 128-bit number as a 16-byte key."""
    return value.to_bytes(16, "big")


def wide_from_hex(text: Column) -> Column:
    """A 16-byte key from 32 hexadecimal digits, with or without dashes."""
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def as_bytes(key: Column, kind: str) -> Column:
    """A key's bytes: UTF-8 of strings, eight little-endian bytes of integers."""
    if kind == "binary":
        return key
    if kind == "string":
        return F.encode(key, "UTF-8")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(key.cast("bigint"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)]))


def duplicates(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of the keys that occur more than once; nulls count as a key here."""
    return keys.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def looked_up(probes: DataFrame, table: DataFrame, key: str, value: str, name: str, by: str = "key") -> DataFrame:
    """``probes`` with ``name``: of their ``key`` the ``value`` in ``table``, null where ``by`` has no such key.

    All other columns of probes stay; one that is named like the result is replaced,
    unless it is the key itself, which is a ValueError.
    """
    if name == key:
        raise ValueError(f"{name} is the probe's own column")
    own = f"__{uuid.uuid4().hex}"
    found = table.select(F.col(by).alias(own), F.col(value).alias(name))
    probes = probes.drop(name)
    return probes.join(found, probes[key] == found[own], "left").drop(own)


def validated(keys: DataFrame, key: str = "key", strict: bool = False) -> DataFrame:
    """``keys``, stored, if every key is there once and none is null, else an error.

    Keys are counted in tasks of a bounded number of rows.
    ``strict`` refuses an empty table as well.
    """
    keys = stored(keys, "index-keys")
    rows, held = keys.agg(F.count("*"), F.count(key)).first()
    if held < rows:
        raise NullKeyError(f"null in {key}")
    found = duplicates(dealt(keys.select(key), key, rows), key).agg(F.min(F.struct(key, "n")).alias("least")).first()["least"]
    if found:
        raise DuplicateKeyError(f"{found[key]!r} occurs {found['n']} times")
    if strict and not rows:
        raise EmptyKeysError("no keys")
    return keys
