"""Saved indexes: Parquet tables beside a table of metadata.

Both are written and read by Spark, so an index lives in any store that Spark
reaches.  A save writes rows into a folder of its own and then the metadata that
names it, so a reader finds the former index or the new one, whole.  Opening checks
the format, kind and row count before anything is used.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.keys import CorruptDataError

FORMAT = "keystrata-1"


def save(table: DataFrame, path: str, kind: str, sort: str | None = None, **more) -> None:
    """Writes ``table`` (dealt and sorted by ``sort``, so that row-group statistics prune scans) and its metadata."""
    if sort:
        table = table.repartitionByRange(sort).sortWithinPartitions(sort)
    spark, rows = table.sparkSession, f"rows-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{rows}")
    n, last = spark.read.parquet(f"{path}/{rows}").count(), _last(spark, path)
    meta = json.dumps({"format": FORMAT, "kind": kind, "rows": n, "folder": rows, **more}, sort_keys=True)
    number = last["number"] + 1 if last else 0
    spark.createDataFrame([(number, meta)], "number bigint, meta string").coalesce(1).write.mode("append").parquet(f"{path}/meta")


def _last(spark: SparkSession, path: str):
    """The metadata row of the latest save, None if there is none."""
    try:
        return spark.read.schema("number bigint, meta string").parquet(f"{path}/meta").orderBy("number", ascending=False).first()
    except AnalysisException:
        return None


def opened(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, dict]:
    """The table and metadata of a saved index; CorruptDataError if they are missing or do not fit."""
    try:
        meta = json.loads(_last(spark, path)["meta"])
        rows = spark.read.parquet(f"{path}/{meta['folder']}")
    except (AnalysisException, TypeError, ValueError, KeyError) as broken:
        raise CorruptDataError(f"no index at {path}") from broken
    if meta.get("format") != FORMAT or meta.get("kind") != kind:
        raise CorruptDataError(f"{path} is {meta.get('format')} {meta.get('kind')}, not {FORMAT} {kind}")
    if rows.count() != meta["rows"]:
        raise CorruptDataError(f"{path} has not the {meta['rows']} rows that were saved")
    return rows, meta
