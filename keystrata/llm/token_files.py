"""Token-id files: bit-plane shuffling.

Ids go in ascending key order into shards, each shard into blocks of a fixed
number of ids.  A block's ids, as little-endian 32-bit numbers, are transposed
into 4 byte planes or 32 bit planes, and each plane is compressed with zstandard
(high planes are nearly constant, so they almost vanish).  A block's row is its
entry in the chunk index too: shard, number, ids before it in the shard, and
which keys with how many ids lie in it, so any document is found and read
without the blocks before it.

The rows are kept in Parquet, written by Spark: they reach any store that Spark
reaches, a retried task leaves no half file, and blocks are read in parallel.
A shard is one partition of a range partitioning by key, streamed through a
task that holds one block.  Documents across blocks are put together from their
few pieces only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freeing, pieces_of, stored
from .tokenizing import Pieces

BLOCK_IDS = 1 << 16
LEVEL = 3
#: Bytes of a generation of a task's memory of pieces; encoding is most of the work here.
PIECES_BYTES = 80 << 20
BLOCKS = "shard int, block int, before long, n_ids int, bits boolean, planes array<binary>, keys array<long>, counts array<long>, offsets array<long>, parts array<long>"
READ = "key long, shard int, at long, part long, first long, n long, whole boolean, crc long, ids binary"


def pack(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    """The compressed planes of a block of ids."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = rows.T if not bits else np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    own = zstandard.ZstdCompressor(level=level)
    return [own.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def unpack(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ids of a block."""
    own = zstandard.ZstdDecompressor()
    raw = np.stack([np.frombuffer(own.decompress(p), np.uint8) for p in planes]) if n else np.zeros((32 if bits else 4, 0), np.uint8)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(raw).view("<u4").ravel()
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _blocks(docs: Iterator[tuple[int, int, bytes]], shard: int, block_ids: int, bits: bool) -> Iterator[dict]:
    """Block rows of a shard's (key, part, id bytes) in order."""
    held, n, before, number = [], 0, 0, 0
    keys, counts, offsets, parts = [], [], [], []

    def row() -> dict:
        ids = np.frombuffer(b"".join(held), "<u4")
        return {"shard": shard, "block": number, "before": before, "n_ids": len(ids), "bits": bits, "planes": pack(ids, bits), "keys": keys, "counts": counts, "offsets": offsets, "parts": parts}

    for key, part, data in docs:
        at, size = 0, len(data) // 4
        while at < size:
            take = min(size - at, block_ids - n)
            held.append(data[4 * at : 4 * (at + take)])
            keys.append(key), counts.append(take), offsets.append(at), parts.append(part)
            n, at = n + take, at + take
            if n == block_ids:
                yield row()
                held, n, before, number = [], 0, before + n, number + 1
                keys, counts, offsets, parts = [], [], [], []
    if n:
        yield row()


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None, block_ids: int = BLOCK_IDS, bits: bool = False) -> None:
    """Encodes ``docs`` and writes their ids, each with ``end_id`` last, in key order to ``path``.

    A null text is empty.  Null keys come first; rows of the same key follow one
    another by text.  An empty table gives no block.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    end = int(end_id).to_bytes(4, "little")
    out = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.bool_()), ("planes", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64()))])

    def encode(batches):
        pieces = Pieces(tokenizer_path, False, PIECES_BYTES)

        def docs_of():
            number = 0
            for batch in batches:
                for part in pieces_of(batch):
                    data = part.to_pydict()
                    for k, values in zip(data["key"], pieces.values(data["text"])):
                        values.append(end)
                        yield k, number, b"".join(values)
                        number += 1

        for row in _blocks(docs_of(), TaskContext.get().partitionId(), block_ids, bits):
            yield pa.RecordBatch.from_pylist([row], schema=out)

    rows.mapInArrow(freeing(encode), BLOCKS).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What lies in the files of ``path``: one row a document.

    key, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids
    as little-endian 32-bit numbers) and shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    out = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("part", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("crc", pa.int64()), ("ids", pa.binary())])

    def decode(batches):
        for batch in batches:
            for one in pieces_of(batch, 1):
                b = one.to_pylist()[0]
                data = unpack(b["planes"], b["n_ids"], b["bits"]).tobytes()
                at, rows, last = 0, [], len(b["keys"]) - 1
                for i, (k, n, offset, part) in enumerate(zip(b["keys"], b["counts"], b["offsets"], b["parts"])):
                    own = data[4 * at : 4 * (at + n)]
                    # only a block's first and last document can have a piece elsewhere
                    whole = 0 < i < last
                    rows.append({"key": k, "shard": b["shard"], "at": b["before"] + at, "part": part, "first": offset, "n": n, "whole": whole, "crc": zlib.crc32(own) if whole else None, "ids": None if whole else own})
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["first"])
        crc = 0
        for r in rows:
            crc = zlib.crc32(r["ids"], crc)
        return pa.Table.from_pylist([rows[0] | {"n": sum(r["n"] for r in rows), "crc": crc, "ids": None, "whole": True}], schema=out)

    pieces = stored(blocks.mapInArrow(freeing(decode), READ), "token-pieces")
    whole = pieces.filter("whole")
    rest = pieces.filter("not whole").groupBy("shard", "part").applyInArrow(joined, READ)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").cast("long").alias("n"))
    starts = sizes.selectExpr("shard", "sum(n) over (order by shard) - n as begins")
    out_rows = whole.unionByName(rest).join(F.broadcast(starts), "shard")
    return out_rows.select("key", (F.col("begins") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "shard")
