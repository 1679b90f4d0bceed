"""Compact sequences and prefilters: Elias-Fano blocks, Bloom filters, pair sorting."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rank import stored
from ..sources import store

BLOCK_KEYS = 65_536
BLOCKS = "block long, n long, base long, low_bits int, low binary, high binary"


def encode_block(keys: np.ndarray) -> dict:
    """Elias-Fano form of sorted numbers from their least: low bits as they are, high parts as gaps in unary."""
    base, n = int(keys[0]), len(keys)
    rest = keys.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)
    low_bits = max(0, min(56, int(math.floor(math.log2(max(1, (int(rest[-1]) + 1) / n))))))
    low = rest & np.uint64((1 << low_bits) - 1)
    high = np.zeros(int(rest[-1] >> np.uint64(low_bits)) + n, np.uint8)
    high[(rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    return {"n": n, "base": base, "low_bits": low_bits, "low": np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "high": np.packbits(high, bitorder="little").tobytes()}


def decode_block(block) -> np.ndarray:
    """The numbers of a block."""
    n, low_bits = int(block["n"]), int(block["low_bits"])
    high = np.flatnonzero(np.unpackbits(np.frombuffer(block["high"], np.uint8), bitorder="little"))[:n] - np.arange(n)
    low = np.zeros(n, np.uint64)
    if low_bits:
        bits = np.unpackbits(np.frombuffer(block["low"], np.uint8), count=n * low_bits, bitorder="little").reshape(n, low_bits)
        low = (bits.astype(np.uint64) << np.arange(low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return ((high.astype(np.uint64) << np.uint64(low_bits)) + low + np.uint64(int(block["base"]) & (1 << 64) - 1)).astype(np.int64)


class EliasFano:
    """Sorted BIGINT keys (key, pos) in compressed blocks of consecutive positions."""

    def __init__(self, blocks: DataFrame, block_keys: int):
        self.blocks, self.block_keys = blocks, block_keys

    @classmethod
    def encode(cls, ranked_keys: DataFrame, block_keys: int = BLOCK_KEYS) -> EliasFano:
        """Encodes (key, pos) rows, pos dense from 0.  A group is one block, so its size is bounded."""
        rows = ranked_keys.select(F.expr(f"pos div {int(block_keys)}").alias("block"), "pos", "key")

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            return pd.DataFrame([{"block": pdf["block"].iloc[0], **encode_block(pdf["key"].to_numpy())}])

        return cls(rows.groupBy("block").applyInPandas(pack, BLOCKS), int(block_keys))

    def decoded(self, blocks: DataFrame | None = None) -> DataFrame:
        """(pos, key) of all keys, or of the given blocks."""
        size = self.block_keys

        def unpack(batches):
            for batch in batches:
                for _, b in batch.iterrows():
                    keys = decode_block(b)
                    yield pd.DataFrame({"pos": b["block"] * size + np.arange(len(keys)), "key": keys})

        return (self.blocks if blocks is None else blocks).mapInPandas(unpack, "pos long, key long")

    def get(self, pos: int) -> DataFrame:
        """The key at a position; no row beyond the end."""
        return self.slice(pos, 1).select("key")

    def slice(self, start: int, count: int) -> DataFrame:
        """(pos, key) of positions start, ..., start + count - 1, from the blocks that hold them."""
        blocks = self.blocks.filter(F.col("block").between(start // self.block_keys, (start + count - 1) // self.block_keys))
        return self.decoded(blocks).filter((F.col("pos") >= start) & (F.col("pos") < start + count))

    def save(self, path: str) -> None:
        store.save(self.blocks, path, "elias-fano", "block", block_keys=self.block_keys)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> EliasFano:
        blocks, meta = store.opened(spark, path, "elias-fano")
        return cls(blocks, meta["block_keys"])

    def sizes(self) -> DataFrame:
        """One row: keys and bytes of the compressed parts."""
        return self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("keys"), F.coalesce(F.sum(F.octet_length("low") + F.octet_length("high")), F.lit(0)).cast("bigint").alias("bytes"))


#: Bits of a filter for each key; a filter of more blocks than this is joined and not broadcast (64 bytes a block).
BLOOM_BITS, BROADCAST_BLOCKS = 11, 1 << 18
_LANES = [f"w{i}" for i in range(8)]


class Bloom:
    """Split-block Bloom filter as a table (block, w0, ..., w7): eight words of 64 bits, one bit in each for a key.

    No key that was put in is ever missed.  Built at any size by one aggregate.
    """

    def __init__(self, table: DataFrame, n_blocks: int, kind: str):
        self.table, self.n_blocks, self.kind = table, n_blocks, kind

    @staticmethod
    def _block(key: Column, n_blocks: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(1), key), F.lit(n_blocks))

    @staticmethod
    def _bits(key: Column) -> list[Column]:
        bits = F.xxhash64(F.lit(2), key)
        return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)]

    @classmethod
    def build(cls, keys: DataFrame, key: str = "key", bits_per_key: int = BLOOM_BITS) -> Bloom:
        """The filter of a table's keys; null keys are left out."""
        own = keys.select(F.col(f"`{key}`").alias("key")).filter("key is not null")
        n = own.select(F.approx_count_distinct("key")).first()[0]
        n_blocks = max(1, math.ceil(n * bits_per_key / 512))
        words = [F.bit_or(w).alias(name) for w, name in zip(cls._bits(F.col("key")), _LANES)]
        return cls(stored(own.groupBy(cls._block(F.col("key"), n_blocks).alias("block")).agg(*words), "bloom"), n_blocks, dict(own.dtypes)["key"])

    def contains(self, probes: DataFrame, key: str = "key", name: str = "maybe") -> DataFrame:
        """``probes`` with whether each key may have been put in; false for null, a column named like the result is replaced."""
        if name == key:
            raise ValueError(f"{name} is the probe's own column")
        held = F.lit(True)
        own = F.col(f"`{key}`").cast(self.kind)
        for word, bit in zip(_LANES, self._bits(own)):
            held = held & (F.col(f"__{word}").bitwiseAND(bit) != 0)
        table = self.table.select(F.col("block").alias("__block"), *[F.col(w).alias(f"__{w}") for w in _LANES])
        table = F.broadcast(table) if self.n_blocks <= BROADCAST_BLOCKS else table
        probes = probes.drop(name).withColumn("__at", F.when(own.isNotNull(), self._block(own, self.n_blocks)))
        out = probes.join(table, F.col("__at") == F.col("__block"), "left").withColumn(name, F.coalesce(held, F.lit(False)))
        return out.drop("__at", "__block", *[f"__{w}" for w in _LANES])

    def export(self) -> DataFrame:
        """(block, words) for use elsewhere; blocks without a key are left out."""
        return self.table.select("block", F.array(*_LANES).alias("words"))

    def memory_usage(self) -> int:
        """Bytes of all words."""
        return 64 * self.n_blocks

    def save(self, path: str) -> None:
        store.save(self.table, path, "bloom", "block", n_blocks=self.n_blocks, key=self.kind)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Bloom:
        table, meta = store.opened(spark, path, "bloom")
        return cls(table, meta["n_blocks"], meta["key"])


def bloom_semi(probes: DataFrame, keys: DataFrame, key: str = "key", bits_per_key: int = BLOOM_BITS) -> DataFrame:
    """The probes whose key occurs in ``keys``: a Bloom filter drops most others before the exact semi-join's shuffle."""
    found = f"__{uuid.uuid4().hex}"
    near = Bloom.build(keys, key, bits_per_key).contains(probes, key, found).filter(found).drop(found)
    own = keys.select(F.col(f"`{key}`").alias("__key"))
    return near.join(own, near[key] == own["__key"], "left_semi")


def compact_keys(ranked_keys: DataFrame, block_keys: int = BLOCK_KEYS) -> tuple[EliasFano, DataFrame]:
    """(key, pos) rows in compressed blocks, and one row of what that saves: keys, bytes, plain_bytes, saved."""
    own = EliasFano(stored(EliasFano.encode(ranked_keys, block_keys).blocks, "elias-fano"), block_keys)
    return own, own.sizes().select("keys", "bytes", (8 * F.col("keys")).alias("plain_bytes"), (8 * F.col("keys") - F.col("bytes")).alias("saved"))


def sorted_pairs(pairs: DataFrame, key: str = "key", payload: str = "payload") -> DataFrame:
    """(key, payload) rows in the order of key, then payload."""
    return pairs.select(F.col(key).alias("key"), F.col(payload).alias("payload")).orderBy("key", "payload")
