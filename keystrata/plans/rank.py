"""Exact positions and batch bounds without one task that holds all rows, each with one shuffle.

``ranked`` deals rows by range, sorts each partition and numbers it by itself; the
sizes of the partitions before are added from a table of one row for each
partition, which is all that meets in one place.  The numbered rows are stored
before sizes are summed, as two evaluations of a range partitioning may cut at
different keys.

``bounds`` answers many lower (or upper) bounds at once: the distinct probes and
the keys are dealt by range together, and a probe's bound is how many keys come
before it.  No range join, and a probe that many rows ask for is one row here.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition that is dealt: small tables make no task for a few rows, large ones none that sorts more than it can hold.
LEAST_ROWS, MOST_ROWS = 1 << 16, 1 << 20
#: Tasks that share the rows of one value.
SALTS = 64
#: Used only by local masters where the session names no shared folder, as in tests.
LOCAL_FOLDER = "file:///tmp/checkpoints/keystrata"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; ValueError where a cluster's session names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def _dropped_at_exit(spark: SparkSession, path: str, make: bool = False) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        store.mkdirs(place)
    store.deleteOnExit(place)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _dropped_at_exit(spark, path, make=True)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; deleted when the driver ends.

    Lineage ends there: a lost executor costs no earlier stage again, and
    several readers do not repeat the work.  The folder name is unique, so
    reruns never meet.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _dropped_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number, fewer if they would hold less than ``LEAST_ROWS``, more if above ``MOST_ROWS``."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(parts, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` of so many rows dealt by ``key`` for aggregates by it, so that no task's hash table grows with the input."""
    return df.repartition(parts_for(df.sparkSession, rows), F.col(key))


def distinct_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """The different rows of ``df``, which has few rows for each ``key``."""
    return dealt(df, key, df.count()).distinct()


def _once(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The different values of ``key``, the only column.  One that many rows hold goes to ``SALTS`` tasks first, so that none reads them all."""
    parts = parts_for(df.sparkSession, rows)
    if parts == 1:
        return df.distinct()
    salted = df.withColumn("__salt", F.monotonically_increasing_id() % SALTS)
    return dealt(salted.repartition(parts, key, "__salt").distinct().drop("__salt"), key, rows).distinct()


def _starts(sizes: DataFrame) -> DataFrame:
    """(__part, __begins) of (__part, __n): the sum over all partitions before.  One row for each partition of a shuffle."""
    before = "coalesce(sum(__n) over (order by __part rows between unbounded preceding and 1 preceding), 0)"
    return sizes.groupBy("__part").agg(F.sum("__n").alias("__n")).selectExpr("__part", f"{before} as __begins")


def ranked(df: DataFrame, order: list[Column], name: str = "pos", rows: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the total order ``order``; a column of that name is replaced.  ``rows``: how many there are, if counted before."""
    parts = parts_for(df.sparkSession, df.count() if rows is None else rows)
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # partition << 33 | row of the partition
    numbered = stored(numbered.withColumn("__rank_at", F.monotonically_increasing_id()), "rank-parts")
    part, inside = F.shiftright("__rank_at", 33), F.col("__rank_at").bitwiseAND((1 << 33) - 1)
    starts = _starts(numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n")))
    out = numbered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn(name, (F.col("__begins") + inside).cast("long")).drop("__part", "__rank_at", "__begins")


def _counted(batches):
    """Of sorted (is key, probe) rows each probe with the keys before it in the partition; last the partition's keys (null probe)."""
    part, keys = TaskContext.get().partitionId(), 0
    for batch in batches:
        is_key = batch.column(0).to_numpy(zero_copy_only=False)
        upto = keys + np.cumsum(is_key)
        at = np.flatnonzero(is_key == 0)
        keys = int(upto[-1]) if len(upto) else keys
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), batch.column(1).take(pa.array(at)), pa.array(upto[at], pa.int64()), pa.nulls(len(at), pa.int64())], names=["__part", "__probe", "__upto", "__n"])
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.nulls(1, batch.schema.field(1).type), pa.nulls(1, pa.int64()), pa.array([keys], pa.int64())], names=["__part", "__probe", "__upto", "__n"])


def bounds(keys: DataFrame, probes: DataFrame, ordered=None, upper: bool = False, key: str = "key", name: str = "bound") -> DataFrame:
    """``probes`` with ``name``: how many of ``keys`` (one column, ``key``) are less than (``upper``: not greater than) the probe.

    ``ordered`` makes of a key column one that sorts as the keys do.  A null
    probe has a null bound; a column of probes named like the result is replaced.
    """
    if name == key:
        raise ValueError(f"{name} is the probe's own column")
    place = ordered or (lambda c: c)
    kind = keys.schema[key].dataType
    marks = keys.select(F.lit(1).alias("__is_key"), F.col(f"`{key}`").alias("__probe"))
    n_probes = probes.count()
    asked = _once(probes.select(F.col(f"`{key}`").cast(kind).alias("__probe")).filter("__probe is not null"), "__probe", n_probes).select(F.lit(0).alias("__is_key"), "__probe")
    order = [place(F.col("__probe")).asc(), F.col("__is_key").desc() if upper else F.col("__is_key").asc()]
    parts = parts_for(probes.sparkSession, keys.count() + n_probes)
    both = marks.unionByName(asked).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = both.schema["__probe"].dataType.simpleString()
    counted = stored(both.mapInArrow(_counted, f"__part long, __probe {kind}, __upto long, __n long"), "bounds")
    starts = _starts(counted.select("__part", F.coalesce("__n", F.lit(0)).alias("__n"))).withColumnRenamed("__part", "__own")
    found = counted.filter("__upto is not null").join(F.broadcast(starts), F.col("__part") == F.col("__own"))
    found = found.select("__probe", (F.col("__begins") + F.col("__upto")).cast("long").alias(name))
    probes = probes.drop(name)
    return probes.join(found, probes[key].cast(kind) == found["__probe"], "left").drop("__probe")
