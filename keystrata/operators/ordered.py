"""Ordered index: positions, inclusive ranges and bounds over sorted unique keys.

Works on BIGINT (signed or, with ``unsigned``, the bits of unsigned 64-bit keys),
on STRING and on BINARY, which covers 128-bit keys as BINARY(16).  The table is
(key, ord, pos), where ``ord`` sorts as the keys do.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import LONG_MIN, flipped, looked_up, validated, wide_from_hex
from ..plans.rank import bounds, parts_for, ranked, stored
from ..sources import store

SEGMENTS = "first_pos long, n long, slope double, intercept double, max_error long, key_from long, key_to long"


class OrderedIndex:
    """Exact ranks of unique, non-null keys."""

    def __init__(self, table: DataFrame, unsigned: bool = False):
        self.table, self.unsigned = table, unsigned

    @classmethod
    def build(cls, keys: DataFrame, key: str = "key", unsigned: bool = False, strict: bool = False) -> OrderedIndex:
        """The index of column ``key``, sorted or not; DuplicateKeyError or NullKeyError if keys are not unique."""
        keys = validated(keys.select(F.col(f"`{key}`").alias("key")), "key", strict)
        keys = keys.withColumn("ord", flipped(F.col("key")) if unsigned else F.col("key"))
        return cls(stored(ranked(keys, [F.col("ord")], "pos"), "ordered-index"), unsigned)

    @classmethod
    def from_uuids(cls, keys: DataFrame, key: str = "key") -> OrderedIndex:
        """The index of 16-byte keys written in hexadecimal."""
        return cls.build(keys.select(wide_from_hex(F.col(key)).alias("key")))

    def _value(self, value) -> Column:
        """A literal in the order of ``ord``; unsigned keys are given as their plain values."""
        if self.unsigned:
            return F.lit(value + LONG_MIN)
        return F.lit(value)

    def index(self, probes: DataFrame, key: str = "key", name: str = "pos") -> DataFrame:
        """``probes`` with each key's position; null if it is not there."""
        return looked_up(probes, self.table, key, "pos", name)

    def range(self, low, high) -> DataFrame:
        """(pos, key) of the keys in [low, high], ascending; none if low > high.  The filter reaches the scan."""
        return self.table.filter(F.col("ord").between(self._value(low), self._value(high))).select("pos", "key").orderBy("pos")

    def _count(self, condition: Column) -> int:
        return self.table.filter(condition).count()

    def lower_bound(self, value) -> int:
        """How many keys are less than ``value``."""
        return self._count(F.col("ord") < self._value(value))

    def upper_bound(self, value) -> int:
        """How many keys are not greater than ``value``."""
        return self._count(F.col("ord") <= self._value(value))

    def _bounds(self, probes: DataFrame, upper: bool, key: str, name: str) -> DataFrame:
        return bounds(self.table.select(F.col("key").alias(key)), probes, flipped if self.unsigned else None, upper, key, name)

    def lower_bounds(self, probes: DataFrame, key: str = "key", name: str = "bound") -> DataFrame:
        """``probes`` with ``name``, all lower bounds in one pass."""
        return self._bounds(probes, False, key, name)

    def upper_bounds(self, probes: DataFrame, key: str = "key", name: str = "bound") -> DataFrame:
        """``probes`` with ``name``, all upper bounds in one pass."""
        return self._bounds(probes, True, key, name)

    def range_counts(self, ranges: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
        """``ranges`` with ``n``, how many keys lie in [low, high] of each row."""
        out = self.upper_bounds(self.lower_bounds(ranges, low, "__below"), high, "__upto")
        return out.withColumn("n", F.greatest(F.lit(0).cast("bigint"), F.col("__upto") - F.col("__below"))).drop("__below", "__upto")

    def get(self, pos: int) -> DataFrame:
        """The key at a position: one row, or none if there is no such position."""
        return self.table.filter(F.col("pos") == pos).select("key")

    def slice(self, start: int, count: int) -> DataFrame:
        """(pos, key) of positions start, ..., start + count - 1, as far as they exist."""
        return self.table.filter((F.col("pos") >= start) & (F.col("pos") < start + count)).select("pos", "key").orderBy("pos")

    def universe(self) -> DataFrame:
        """One row: the greater of the greatest key + 1 and the number of keys (integer keys; unsigned as DECIMAL)."""
        shift = F.lit(Decimal(-LONG_MIN if self.unsigned else 0)).cast("decimal(20,0)")
        top = F.max("ord").cast("decimal(20,0)") + shift + 1
        return self.table.agg(F.greatest(F.coalesce(top, F.lit(0)), F.count("*").cast("decimal(20,0)")).cast("decimal(20,0)").alias("universe"))

    def stats(self) -> DataFrame:
        """One row: keys, least and greatest key."""
        return self.table.agg(F.count("*").alias("keys"), F.min_by("key", "ord").alias("min_key"), F.max_by("key", "ord").alias("max_key"))

    def segments(self, epsilon: int = 64, outer: int = 1) -> DataFrame:
        """Piecewise linear model of pos over key (integer keys): each segment's fit is at most ``epsilon`` positions off.

        A segment that starts in the first or last tenth of the keys may be ``outer``
        times as far off.  Greedy over each range partition of the sorted keys, carried
        over its batches, so only partitions cut segments.  Errors are rounded up: every key lies
        within ``max_error`` of its predicted position, ``first_pos + intercept + slope * (key - key_from)``.
        """
        n = len(self)
        rows = self.table.select(F.col("ord").cast("bigint").alias("key"), "pos").repartitionByRange(parts_for(self.table.sparkSession, n), "key").sortWithinPartitions("key")
        return rows.mapInPandas(_segments(epsilon, outer, n if outer != 1 else 0), SEGMENTS)

    def segment_stats(self, epsilon: int = 64) -> DataFrame:
        """One row: segments, keys, mean keys in a segment, the greatest error and the bytes of the model."""
        return self.segments(epsilon).agg(
            F.count("*").alias("segments"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("keys"), F.avg("n").alias("mean_keys"), F.max("max_error").alias("max_error"),
            (F.count("*") * SEGMENT_BYTES).alias("model_bytes"),
        )

    def densest_segments(self, k: int, epsilon: int = 64) -> DataFrame:
        """The ``k`` segments with the most keys for their span of keys, ties to the smaller first position."""
        span = F.greatest(F.lit(1), F.col("key_to").cast("decimal(20,0)") - F.col("key_from")).cast("double")
        return self.segments(epsilon).withColumn("density", F.col("n") / span).orderBy(F.desc("density"), "first_pos").limit(k)

    def located(self, probes: DataFrame, key: str = "key", epsilon: int = 64) -> DataFrame:
        """``probes`` with the segment of each key (segment_pos, segment_n, max_error) and its predicted position.

        The segment is the last one that begins at or before the key; null for null
        keys and keys before all.  Found by bounds over the segments, not by a range join.
        """
        own = stored(self.segments(epsilon), "segments")
        place = flipped if self.unsigned else (lambda c: c)
        found = bounds(own.select(F.col("key_from").alias("__ord")), probes.withColumn("__ord", place(F.col(key)).cast("bigint")), None, True, "__ord", "__nth")
        numbered = ranked(own, [F.col("first_pos")], "__rank").withColumn("__rank", F.col("__rank") + 1)
        numbered = numbered.select("__rank", F.col("key_from").alias("__from"), "slope", "intercept", F.col("first_pos").alias("segment_pos"), F.col("n").alias("segment_n"), "max_error")
        out = found.join(numbered, found["__nth"] == numbered["__rank"], "left")
        away = (F.col("__ord").cast("decimal(20,0)") - F.col("__from")).cast("double")
        return out.withColumn("predicted", F.col("segment_pos") + F.col("intercept") + F.col("slope") * away).drop("__ord", "__nth", "__rank", "__from", "slope", "intercept")

    def __len__(self) -> int:
        return self.table.count()

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def save(self, path: str) -> None:
        store.save(self.table, path, "ordered", "ord", unsigned=self.unsigned)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> OrderedIndex:
        table, meta = store.opened(spark, path, "ordered")
        return cls(table, meta["unsigned"])


def _segments(epsilon: int, outer: int, keys_in_all: int):
    """Longest runs, found by doubling and halving, whose least-squares line stays within the bound."""

    def fit(keys: np.ndarray, pos: np.ndarray) -> tuple[float, float, int]:
        # differences of 64-bit keys reach 2 ** 64, so they are taken unsigned
        x, y = (keys.view(np.uint64) - keys.view(np.uint64)[0]).astype(np.float64), (pos - pos[0]).astype(np.float64)
        spread = ((x - x.mean()) ** 2).sum()
        slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread else 0.0
        intercept = y.mean() - slope * x.mean()
        return slope, intercept, int(np.ceil(np.abs(slope * x + intercept - y).max()))

    def bound(first: int) -> int:
        return epsilon * outer if not keys_in_all // 10 <= first < keys_in_all - keys_in_all // 10 else epsilon

    def longest(keys: np.ndarray, pos: np.ndarray, good: int) -> int:
        """Keys of the first segment; ``good`` are known to fit."""
        most, size = bound(int(pos[0])), 2 * good
        while good < len(keys) and fit(keys[:size], pos[:size])[2] <= most:
            good, size = min(size, len(keys)), size * 2
        bad = min(size, len(keys) + 1)
        while bad - good > 1:
            half = (good + bad) // 2
            good, bad = (half, bad) if fit(keys[:half], pos[:half])[2] <= most else (good, half)
        return good

    def row(keys: np.ndarray, pos: np.ndarray) -> tuple:
        slope, intercept, error = fit(keys, pos)
        return int(pos[0]), len(keys), slope, intercept, error, int(keys[0]), int(keys[-1])

    def run(batches):
        keys, pos, fits = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for batch in batches:
            keys, pos, out = np.concatenate([keys, batch["key"].to_numpy()]), np.concatenate([pos, batch["pos"].to_numpy()]), []
            while len(keys) and (n := longest(keys, pos, fits)) < len(keys):
                out.append(row(keys[:n], pos[:n]))
                keys, pos, fits = keys[n:], pos[n:], 1
            fits = max(1, len(keys))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])
        if len(keys):
            yield pd.DataFrame([row(keys, pos)], columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return run


#: Bytes of a segment's row.
SEGMENT_BYTES = 8 * len(SEGMENTS.split(", "))


def tuned_epsilon(index: OrderedIndex, model_bytes: int = 1 << 20, least: int = 8) -> int:
    """The least power-of-two multiple of ``least`` whose segments take ``model_bytes`` at most: what a task may hold to locate keys.

    Counted over all keys, one pass for each doubling.
    """
    epsilon = least
    while epsilon < len(index) and index.segments(epsilon).count() * SEGMENT_BYTES > model_bytes:
        epsilon *= 2
    return epsilon
