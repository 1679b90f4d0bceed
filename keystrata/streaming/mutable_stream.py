"""The mutable key store fed by a stream of operations.

Each micro-batch appends one tier of the keys it changed (key, op, id), sorted by key,
to a folder named by its batch id, and one small row beside it with the next id to
give, so a batch that is run again replaces its own files and nothing else.  Only
the keys of the batch are looked up in earlier tiers, between its least and its
greatest key, which row-group statistics prune.

``compact`` merges old tiers into a folder of its own and then writes one row that
names it; readers follow the greatest name, so they see the old tiers or the merged
one, whole, whenever the writer stops.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutable import in_order, with_before
from ..plans.rank import ranked, stored

TIER = "key string, op string, id bigint, batch bigint"


def _marked(place: str) -> Column:
    """A number that sorts as ``place`` and tells ``op``: an aggregate of numbers is hashed, one of strings is sorted."""
    return F.col(place) * 2 + (F.col("op") == "I").cast("int")


def _op(marked: str) -> Column:
    return F.when(F.col(marked) % 2 == 1, "I").otherwise("D")


class MutableStream:
    """State of the store in ``path``; ``start`` feeds it from a streaming log (seq, key, op)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])

    def compacted_upto(self) -> int:
        """The last batch that the merged tier holds; -1 before the first compaction."""
        found = self._read("compactions", "upto bigint").agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def tiers(self) -> DataFrame:
        """(key, op, id, batch) of the merged tier and all later ones."""
        upto = self.compacted_upto()
        later = self._read("tiers", TIER).filter(F.col("batch") > upto)
        return later if upto < 0 else self._read("merged", TIER).filter(F.col("batch") == upto).unionByName(later)

    def _latest(self, tiers: DataFrame) -> DataFrame:
        last = tiers.groupBy("key").agg(F.max(_marked("batch")).alias("__last"), F.max("id").alias("id"))
        return last.select("key", _op("__last").alias("op"), "id")

    def state(self) -> DataFrame:
        """(key, id) of the live keys."""
        return self._latest(self.tiers()).filter("op = 'I'").select("key", "id")

    def tier_stats(self) -> DataFrame:
        """(batch, entries) of the tiers that are read."""
        return self.tiers().groupBy("batch").agg(F.count("*").alias("entries"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Folds one micro-batch; the same batch id gives the same tier again."""
        log = in_order(batch.withColumn("key", F.col("key").cast("string")))
        ends = log.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
        if ends["low"] is None:
            return
        next_id = self._read("ids", "next_id bigint, batch bigint").filter(F.col("batch") < batch_id).agg(F.max("next_id")).first()[0]
        if next_id is None:  # every batch that wrote a tier wrote its next id
            next_id, rows = 0, log.withColumn("first_op", F.lit(None).cast("string")).withColumn("known_id", F.lit(None).cast("bigint"))
        else:
            earlier = self.tiers().filter((F.col("batch") < batch_id) & F.col("key").between(ends["low"], ends["high"]))
            known = self._latest(earlier.join(log.select("key").distinct(), "key", "left_semi"))
            rows = log.join(known.select("key", F.col("op").alias("first_op"), F.col("id").alias("known_id")), "key", "left")
        rows = stored(with_before(rows, log=log).select("key", "op", "at", "known_id", "alloc"), "stream-rows")
        allocs = rows.filter("alloc").select("key", "at")
        n_given = allocs.count()
        given = ranked(allocs, [F.col("at")], "id", n_given)
        last = rows.select("key", _marked("at").alias("__last"), "known_id", F.lit(None).cast("bigint").alias("id"))
        last = last.unionByName(given.select("key", F.lit(None).cast("bigint").alias("__last"), F.lit(None).cast("bigint").alias("known_id"), (F.col("id") + next_id).alias("id")))
        last = last.groupBy("key").agg(F.max("__last").alias("__last"), F.max("known_id").alias("known_id"), F.max("id").alias("id"))
        last = last.select("key", _op("__last").alias("op"), F.coalesce("id", "known_id").alias("id"))
        last.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/tiers/batch={batch_id}")
        upto = self.spark.range(1).select(F.lit(next_id + n_given).cast("bigint").alias("next_id"))
        upto.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ids/batch={batch_id}")

    def compact(self, upto: int) -> None:
        """Merges all tiers up to batch ``upto`` into one, which takes that batch's number; ids stay.

        Deleted keys keep their last id, so that it is never given again.  Nothing
        that is read is overwritten; the merged tiers' own folders go last.
        """
        done = self.compacted_upto()
        if upto <= done:
            return
        merged = self._latest(self.tiers().filter(F.col("batch") <= upto))
        merged.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/merged/batch={upto}")
        self.spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{self.path}/compactions")
        self._forget([f"tiers/batch={b}" for b in range(done + 1, upto + 1)] + [f"merged/batch={done}"])

    def _forget(self, names: list[str]) -> None:
        """Deletes folders that no reader follows any more, where they exist."""
        jvm = self.spark._jvm
        for name in names:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def start(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the stream; ``trigger`` as for ``DataStreamWriter.trigger`` (default: all that is there, then stop)."""
        writer = log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def hot_counts(observed: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of a stream of observations, for output mode complete or update; top_k ranks what it gives."""
    return observed.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
