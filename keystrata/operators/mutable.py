"""Mutable key store: a log of inserts and deletes folded into keys with stable ids.

The log is (seq, key, op), op ``I`` or ``D``.  An insert of a live key keeps its id;
an insert of any other key gets the next id, in the order of operations, counted from
0.  A delete of a live key returns its id, of any other null.  After a delete the
same key gets a new id.

Operations are in the order of seq; those of one seq by key, inserts first, and equal
ones are repeats.  Rows are numbered in that order.  A key of at most ``SLICE`` rows is
folded in one window; other keys are cut into slices of ``SLICE`` positions: windows
see one key in one slice, and what earlier slices left of a key is one row for each of
its slices, so no key is folded in one piece, however much of the log it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import as_bytes, looked_up
from ..plans.rank import ranked, stored

SLICE = 1 << 16
#: Keys of more than SLICE rows that are broadcast.
HOT_KEYS = 100_000


def with_before(rows: DataFrame, slice_rows: int = SLICE, log: DataFrame | None = None) -> DataFrame:
    """Rows (at, key, op, ...) with ``before``, the key's last operation before each, and ``born``, where its latest allocating insert up to each row stands.

    ``first_op`` and nothing else stands before a key's first operation, if there is such a column.
    ``log``: the same keys, if they are to be had without the work of ``rows``.
    """
    first = F.col("first_op") if "first_op" in rows.columns else F.lit(None).cast("string")
    hot = (rows if log is None else log).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > int(slice_rows)).select("key")
    hot = stored(hot, "mutable-hot")
    n_hot = hot.count()
    if not n_hot:
        return _before(rows, first)
    hot = F.broadcast(hot) if n_hot <= HOT_KEYS else hot
    whole = _before(rows.join(hot, "key", "left_anti"), first)
    return whole.unionByName(_sliced(rows.join(hot, "key", "left_semi"), slice_rows, first))


def _before(rows: DataFrame, first: Column) -> DataFrame:
    """``with_before`` by one window for each key."""
    own = Window.partitionBy("key").orderBy("at")
    rows = rows.withColumn("before", F.coalesce(F.lag("op").over(own), first))
    rows = rows.withColumn("alloc", (F.col("op") == "I") & (F.col("before").isNull() | (F.col("before") == "D")))
    return rows.withColumn("born", F.max(F.when(F.col("alloc"), F.col("at"))).over(own))


def _sliced(rows: DataFrame, slice_rows: int, first: Column) -> DataFrame:
    """``with_before`` by one window for each key in each slice of positions."""
    rows = rows.withColumn("__slice", F.expr(f"at div {int(slice_rows)}"))
    own, later = Window.partitionBy("key", "__slice").orderBy("at"), Window.partitionBy("key").orderBy("__slice")
    ends = rows.groupBy("key", "__slice").agg(F.max_by("op", "at").alias("__end")).withColumn("__led", F.lag("__end").over(later)).drop("__end")
    rows = rows.join(ends, ["key", "__slice"])
    rows = rows.withColumn("before", F.coalesce(F.lag("op").over(own), "__led", first)).drop("__led")
    rows = rows.withColumn("alloc", (F.col("op") == "I") & (F.col("before").isNull() | (F.col("before") == "D")))
    born = F.when(F.col("alloc"), F.col("at"))
    ends = rows.groupBy("key", "__slice").agg(F.max(born).alias("__end"))
    ends = ends.withColumn("__led", F.max("__end").over(later.rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
    rows = rows.withColumn("__born", F.max(born).over(own)).join(ends, ["key", "__slice"])
    return rows.withColumn("born", F.coalesce("__born", "__led")).drop("__born", "__led", "__slice")


def in_order(log: DataFrame, seq: str = "seq", key: str = "key", op: str = "op") -> DataFrame:
    """The log's usable rows (seq, key, op) with ``at``, their place in the order of operations."""
    rows = log.select(F.col(f"`{seq}`").alias("seq"), F.col(f"`{key}`").alias("key"), F.col(f"`{op}`").alias("op")).filter("key is not null and op in ('I', 'D')")
    # rows alike in all three are the same to every reader, so none need be told apart
    return ranked(stored(rows, "mutable-log"), [F.col("seq"), F.col("key"), F.col("op").desc()], "at")


class MutableIndex:
    """The fold of a log.  ``history`` has the log with ``at``, ``alloc``, ``id`` (allocating inserts) and ``live_id`` before each row."""

    def __init__(self, history: DataFrame, flush_every: int, max_tiers: int):
        self.history, self.flush_every, self.max_tiers = history, flush_every, max_tiers

    @classmethod
    def fold(cls, log: DataFrame, seq: str = "seq", key: str = "key", op: str = "op", flush_every: int = 65_536, max_tiers: int = 8, first_id: int = 0, slice_rows: int = SLICE) -> MutableIndex:
        """Folds a log; rows with a null key or another op are left out."""
        rows = stored(with_before(in_order(log, seq, key, op), slice_rows), "mutable-folded")
        given = ranked(rows.filter("alloc").select(F.col("at").alias("given_at")), [F.col("given_at")], "id").withColumn("id", F.col("id") + first_id)
        # an allocating insert was born where it stands, so one join gives both ids
        rows = rows.join(given, rows["born"] == given["given_at"], "left").drop("given_at", "born")
        rows = rows.withColumn("live_id", F.when(F.col("before") == "I", F.col("id"))).withColumn("id", F.when(F.col("alloc"), F.col("id")))
        # after a delete the key's id is that of the insert before it, which is not live any more
        return cls(stored(rows.drop("before"), "mutable-history"), flush_every, max_tiers)

    def results(self) -> DataFrame:
        """(seq, key, op, id): what each operation returned."""
        return self.history.select("seq", "key", "op", F.when(F.col("alloc"), F.col("id")).otherwise(F.col("live_id")).alias("id"))

    def _last(self) -> DataFrame:
        return self.history.groupBy("key").agg(F.max_by("op", "at").alias("op"), F.max("id").alias("id"))

    def state(self) -> DataFrame:
        """(key, id) of the live keys."""
        return self._last().filter("op = 'I'").select("key", "id")

    def tombstones(self) -> DataFrame:
        """(key) of the keys whose last operation is a delete."""
        return self._last().filter("op = 'D'").select("key")

    def lookup(self, probes: DataFrame, key: str = "key", name: str = "id") -> DataFrame:
        """``probes`` with the live id of each key, else null."""
        return looked_up(probes, self.state(), key, "id", name)

    def tiers(self) -> DataFrame:
        """(key, id, tier) of the inserts that allocated: tier ``id div flush_every``, the last one the write buffer."""
        rows = self.history.filter("alloc").select("key", "id")
        return rows.withColumn("tier", F.expr(f"id div {int(self.flush_every)}"))

    def tier_stats(self) -> DataFrame:
        """(tier, entries) by tier."""
        return self.tiers().groupBy("tier").agg(F.count("*").alias("entries"))

    def buffer_stats(self) -> DataFrame:
        """One row: full tiers, entries in the write buffer (the tier not yet full), bytes of all keys and ids kept."""
        size = F.octet_length(as_bytes(F.col("key"), dict(self.history.dtypes)["key"])) + 8
        tiers = self.tiers().groupBy("tier").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        full = F.col("n") >= self.flush_every
        return tiers.agg(F.count_if(full).alias("tiers"), F.coalesce(F.sum(F.when(~full, F.col("n"))), F.lit(0)).cast("long").alias("buffered"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))

    def compacted(self) -> DataFrame:
        """(key, id, tier 0): one tier of the live keys, ids unchanged."""
        return self.state().withColumn("tier", F.lit(0).cast("bigint"))

    def needs_compaction(self) -> bool:
        """Whether full tiers are more than ``max_tiers``."""
        full = self.tier_stats().filter(F.col("entries") >= self.flush_every)
        return full.count() > self.max_tiers

    def stats(self) -> DataFrame:
        """One row: live keys, tombstones, ids given."""
        return self._last().agg(
            F.count_if(F.col("op") == "I").alias("live"), F.count_if(F.col("op") == "D").alias("tombstones"), (F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("ids")
        )

    def __len__(self) -> int:
        return self.state().count()
