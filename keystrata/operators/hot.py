"""Hot keys: exact and approximate heavy hitters, epochs, lookups in a hot tier that rolls over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import looked_up, validated
from ..plans.rank import ranked, stored

#: A hot tier of more keys is joined as any other table.
BROADCAST_KEYS = 100_000


def _checked(k: int) -> int:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return k


def counts(observed: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of all keys but null."""
    return observed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))


def top_k(observed: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The ``k`` most frequent keys (key, n), ties to the smaller key."""
    return counts(observed, key).orderBy(F.desc("n"), "key").limit(_checked(k))


def totals(observed: DataFrame, key: str = "key") -> DataFrame:
    """One row: tracked keys and observations."""
    return counts(observed, key).agg(F.count("*").alias("tracked"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("observed"))


def approx_top_k(observed: DataFrame, k: int, capacity: int = 10_000, key: str = "key") -> DataFrame:
    """The ``k`` most frequent keys (key, n) from a sketch of ``capacity`` counters at most; memory does not grow with the keys.

    Counts are exact as long as the keys are fewer than the counters.
    """
    found = observed.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).agg(F.expr(f"approx_top_k(key, {_checked(k)}, {int(capacity)})").alias("top"))
    return found.select(F.explode("top").alias("t")).select(F.col("t.item").alias("key"), F.col("t.count").alias("n"))


def epochs(observed: DataFrame, rebuild_every: int, k: int, seq: str = "seq", key: str = "key") -> DataFrame:
    """(epoch, place, key, n): the ``k`` most frequent keys of each run of ``rebuild_every`` observations in the order of ``seq``."""
    rows = observed.filter(F.col(key).isNotNull()).select(F.col(seq).alias("seq"), F.col(key).alias("key"))
    rows = ranked(rows, [F.col("seq"), F.col("key")], "at").withColumn("epoch", F.expr(f"at div {int(rebuild_every)}"))
    best = rows.groupBy("epoch", "key").agg(F.count("*").alias("n"))
    return best.selectExpr("epoch", "row_number() over (partition by epoch order by n desc, key) as place", "key", "n").filter(F.col("place") <= _checked(k))


class HotTier:
    """A small map from hot keys to given ids."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def of(cls, keys: DataFrame, key: str = "key", id: str = "id") -> HotTier:
        """The tier of rows (key, id); DuplicateKeyError or NullKeyError if keys are not unique."""
        rows = keys.select(F.col(f"`{key}`").alias("key"), F.col(f"`{id}`").cast("bigint").alias("id"))
        return cls(validated(rows))

    @classmethod
    def hottest(cls, observed: DataFrame, k: int, key: str = "key") -> HotTier:
        """The ``k`` most frequent keys, with ids from 0 by frequency."""
        best = ranked(top_k(observed, k, key), [F.desc("n"), F.col("key").asc()], "id")
        return cls(stored(best.select("key", "id", "n"), "hot-tier"))

    def __len__(self) -> int:
        return self.table.count()

    def lookup(self, probes: DataFrame, key: str = "key", name: str = "hot_id") -> DataFrame:
        """``probes`` with the hot id of each key, null if it is not hot.  Broadcast up to BROADCAST_KEYS keys."""
        own = self.table if len(self) > BROADCAST_KEYS else F.broadcast(self.table)
        return looked_up(probes, own, key, "id", name)


class RollingHotTier:
    """Lookups that are observed, and a hot tier that is rebuilt from what they asked for.

    After ``rebuild_every`` observations ``should_rebuild`` says so; the caller takes
    the top keys, which begins a new epoch, and installs the next tier.
    """

    def __init__(self, tier: HotTier | None, rebuild_every: int):
        self.tier, self.rebuild_every = tier, _checked(rebuild_every)
        self.seen: list[DataFrame] = []
        self.observed = 0

    def lookup(self, probes: DataFrame, key: str = "key", name: str = "hot_id") -> DataFrame:
        """``probes`` with hot ids (null before the first tier); their keys, null ones left out, are observed."""
        asked = stored(counts(probes, key), "hot-observed")
        self.seen.append(asked)
        self.observed += asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if self.tier is None:
            return probes.drop(name).withColumn(name, F.lit(None).cast("bigint"))
        return self.tier.lookup(probes, key, name)

    def should_rebuild(self) -> bool:
        return self.observed >= self.rebuild_every

    def top_k(self, k: int) -> DataFrame | None:
        """(key, n) of this epoch's most frequent keys, ties to the smaller key; None if nothing was asked for."""
        if not self.seen:
            return None
        both = reduce(DataFrame.unionByName, self.seen).groupBy("key").agg(F.sum("n").alias("n"))
        return both.orderBy(F.desc("n"), "key").limit(_checked(k))

    def take_top_k(self, k: int) -> DataFrame | None:
        """The same, and the epoch begins anew."""
        best, self.seen, self.observed = self.top_k(k), [], 0
        return best

    def install(self, tier: HotTier) -> None:
        self.tier = tier

    def current_memory(self) -> int:
        """Bytes of the tier's ids and keys as far as keys are integers; strings and binaries count their bytes."""
        if self.tier is None:
            return 0
        kind = dict(self.tier.table.dtypes)["key"]
        size = F.octet_length("key") if kind in ("string", "binary") else F.lit(8)
        return self.tier.table.agg(F.coalesce(F.sum(size + 8), F.lit(0))).first()[0]
