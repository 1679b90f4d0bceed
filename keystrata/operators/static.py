"""Static dictionary: unique keys to dense ids.

An index is a table (key, id); a lookup is a left equi-join, membership a semi or
anti join.  Ids are the ranks of the keys, so they are dense, stable and the same
on every machine.  Probe tables keep all their columns, duplicates included; a key
that is not there, or a null probe, gets a null id.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import as_bytes, looked_up, validated
from ..plans.rank import ranked, stored
from ..sources import store


@dataclasses.dataclass(frozen=True)
class IndexConfig:
    """How an index is built: ``strict`` refuses an empty table; ``lean`` is accepted and changes nothing, as lookups compare keys."""

    key: str = "key"
    strict: bool = False
    lean: bool = False


class StaticIndex:
    """Exact dictionary of unique, non-null keys of one type (BIGINT, STRING or BINARY)."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def build(cls, keys: DataFrame, key: str = "key", strict: bool = False) -> StaticIndex:
        """The index of the keys in column ``key``; DuplicateKeyError or NullKeyError if they are not unique."""
        keys = validated(keys.select(F.col(f"`{key}`").alias("key")), "key", strict)
        return cls(stored(ranked(keys, [F.col("key")], "id"), "static-index"))

    @classmethod
    def configured(cls, keys: DataFrame, config: IndexConfig = IndexConfig()) -> StaticIndex:
        """The index that a configuration describes."""
        return cls.build(keys, config.key, config.strict)

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "bigint") -> StaticIndex:
        """An index that misses every key."""
        return cls(spark.createDataFrame([], f"key {kind}, id bigint"))

    def lookup(self, probes: DataFrame, key: str = "key", name: str = "id") -> DataFrame:
        """``probes`` with each key's id (null: not there)."""
        return looked_up(probes, self.table, key, "id", name)

    lookup_batch = get_batch = lookup

    def get(self, value) -> DataFrame:
        """One row (id) for a key that is there, none for another.  The filter reaches the scan."""
        return self.table.filter(F.col("key") == F.lit(value)).select("id")

    def contains(self, probes: DataFrame, key: str = "key", name: str = "found") -> DataFrame:
        """``probes`` with whether each key is there; false for null."""
        return self.lookup(probes, key, name).withColumn(name, F.col(name).isNotNull())

    has_batch = exists_batch = contains_batch = contains

    def semi(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes whose key is there."""
        return probes.join(self.table.select(F.col("key").alias("__key")), probes[key] == F.col("__key"), "left_semi")

    def anti(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """The probes whose key is not there, null probes included."""
        return probes.join(self.table.select(F.col("key").alias("__key")), probes[key] == F.col("__key"), "left_anti")

    def range(self, low=None, high=None) -> DataFrame:
        """No row: a dictionary has no order.  OrderedIndex answers ranges."""
        return self.table.limit(0).select("id")

    def slot_capacity(self) -> int:
        """Ids lie in [0, slot_capacity())."""
        return len(self)

    def __len__(self) -> int:
        return self.table.count()

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def stats(self) -> DataFrame:
        """One row: engine, total_keys and the bytes of all keys."""
        size = F.octet_length(as_bytes(F.col("key"), dict(self.table.dtypes)["key"]))
        return self.table.agg(F.count("*").alias("total_keys"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("key_bytes")).select(
            F.when(F.col("total_keys") > 0, "dictionary").otherwise("dictionary-empty").alias("engine"), "total_keys", "key_bytes"
        )

    def export(self, chunk: int = 100_000) -> DataFrame:
        """The index as arrays for use off the cluster: rows (chunk, ids, keys) of at most ``chunk`` keys, in id order."""
        part = F.expr(f"id div {int(chunk)}")
        pairs = F.array_sort(F.collect_list(F.struct("id", "key")))
        return self.table.groupBy(part.alias("chunk")).agg(pairs.alias("p")).select("chunk", F.col("p.id").alias("ids"), F.col("p.key").alias("keys"))

    def save(self, path: str) -> None:
        store.save(self.table, path, "static", "key")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StaticIndex:
        return cls(store.opened(spark, path, "static")[0])
