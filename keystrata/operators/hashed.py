"""Hashed index: keys to the position they had in the input, by hash segments.

A segment is a range of the hash; the table is (h, key, pos).  Lookups by key compare
the real key, so foreign keys never hit; lookups by hash can, so a build refuses
two keys of one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import HashCollisionError, as_bytes, duplicates, looked_up, validated
from ..plans.rank import dealt, stored
from ..sources import store

#: Segments of up to so many keys count as linear, then as chd, beyond as mph.
LINEAR, CHD = 64, 4096
#: Bits of each hash: Spark's own, or the first 15 hexadecimal digits of md5, which other engines have too.
HASH_BITS = {"xxhash64": 64, "md5": 60}


def hashed(key: Column, kind: str = "xxhash64", name: str = "xxhash64") -> Column:
    """The hash ``name`` of a key column of type ``kind`` (string, binary or an integer)."""
    if name == "xxhash64":
        return F.xxhash64(key)
    return F.conv(F.substring(F.md5(as_bytes(key, kind)), 1, 15), 16, 10).cast("bigint")


class HashedIndex:
    """Exact map from unique, non-null keys to given positions."""

    def __init__(self, table: DataFrame, hash: str = "xxhash64", linear: int = LINEAR, chd: int = CHD):
        self.table, self.hash, self.linear, self.chd = table, hash, linear, chd

    @classmethod
    def build(cls, keys: DataFrame, key: str = "key", pos: str = "pos", strict: bool = False, hash: str = "xxhash64", linear: int = LINEAR, chd: int = CHD) -> HashedIndex:
        """The index of rows (key, pos); positions are data, as rows have no order of their own.

        DuplicateKeyError or NullKeyError if keys are not unique, HashCollisionError if their hashes are not.
        """
        rows = keys.select(F.col(f"`{key}`").alias("key"), F.col(f"`{pos}`").cast("bigint").alias("pos"))
        rows = validated(rows, "key", strict)
        table = stored(rows.select(hashed(F.col("key"), dict(rows.dtypes)["key"], hash).alias("h"), "key", "pos"), "hashed-index")
        found = duplicates(dealt(table.select("h"), "h", table.count()), "h").agg(F.min(F.struct("h", "n")).alias("least")).first()["least"]
        if found:
            raise HashCollisionError(f"{found['n']} keys have the hash {found['h']}")
        return cls(table, hash, linear, chd)

    def lookup(self, probes: DataFrame, key: str = "key", name: str = "pos") -> DataFrame:
        """``probes`` with each key's position; null if it is not there."""
        return looked_up(probes, self.table, key, "pos", name)

    lookup_batch = lookup

    def lookup_hashes(self, probes: DataFrame, h: str = "h", name: str = "pos") -> DataFrame:
        """``probes`` of hashes (as ``hashed`` gives them) with the position; null if no key has the hash."""
        return looked_up(probes, self.table, h, "pos", name, "h")

    def hash_range(self, low: int, high: int) -> DataFrame:
        """(h, key, pos) of the keys whose hash lies in [low, high]."""
        return self.table.filter(F.col("h").between(low, high))

    def segments(self, bits: int = 8) -> DataFrame:
        """(segment, n, kind) of the hash's first ``bits`` bits."""
        kind = F.when(F.col("n") <= self.linear, "linear").when(F.col("n") <= self.chd, "chd").otherwise("mph")
        return self.table.groupBy(F.shiftrightunsigned("h", HASH_BITS[self.hash] - bits).alias("segment")).agg(F.count("*").alias("n")).withColumn("kind", kind)

    def storage_stats(self, bits: int = 8) -> DataFrame:
        """(kind, segments, keys); both sum to the totals."""
        return self.segments(bits).groupBy("kind").agg(F.count("*").alias("segments"), F.sum("n").alias("keys"))

    def __len__(self) -> int:
        return self.table.count()

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def save(self, path: str) -> None:
        store.save(self.table, path, "hashed", "h", hash=self.hash, linear=self.linear, chd=self.chd)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> HashedIndex:
        table, meta = store.opened(spark, path, "hashed")
        return cls(table, meta["hash"], meta["linear"], meta["chd"])
