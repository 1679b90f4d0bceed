"""What the operators share: stored intermediate tables, row keys, word patterns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rank import scratch, shared_folder, stored  # noqa: F401  operators take them from here

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes of an Arrow batch, which lies in direct memory of the executor and again in the worker.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: What a worker keeps between batches of a task and drops at its end.
_kept: list[Callable[[], None]] = []
#: What a worker keeps between tasks of one operator and drops when a task of another begins.
_lasting: list[Callable[[], None]] = []
#: The module whose task the worker ran last.
_operator = ""


def kept_for_a_task(clear: Callable[[], None]) -> None:
    """Registers what empties a module's own memory at the end of each task of ``freeing``."""
    _kept.append(clear)


def kept_for_an_operator(clear: Callable[[], None]) -> None:
    """Registers what empties a module's own memory when ``freeing`` begins a task of another operator."""
    _lasting.append(clear)


def turn_to(operator: str) -> None:
    """Drops what is kept for the operator before, if it was another one."""
    global _operator
    if operator != _operator:
        for clear in _lasting:
            clear()
    _operator = operator


def release() -> None:
    """Empties what modules keep and gives unused memory back to the system."""
    for clear in _kept:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freeing(run):
    """A function for mapInArrow whose worker gives its memory back when a task ends.

    Workers are used again by later tasks of other stages, so what one task
    gathered must not add to the next one's.  What is costly to load, as a tokenizer, stays
    for tasks of the same module.
    """
    operator = run.__module__

    def whole(batches):
        turn_to(operator)
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at most from now on; smaller settings stay.

    The session's setting is the only one there is; results do not depend on it.
    """
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{name}PerBatch"
        own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if not 0 < own <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


#: Rows of a table that is broadcast because it is counted to be small.
SMALL_ROWS = 20_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, which should be stored, to be broadcast if it has at most ``rows`` rows; beyond that joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pieces_of(batch, rows: int = 256):
    """Slices of an Arrow batch, so that long texts are not all Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
