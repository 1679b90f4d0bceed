"""BPE encoding and decoding with tree concatenation for long texts.

A byte-level tokenizer cuts a text into pre-tokens and merges bytes inside each.
Inside one pre-token, a sequence of tokens is the encoding if and only if every two
neighbours are the encoding of their own two texts.

Texts up to ``long_chars`` characters are encoded where they lie.  A longer text is cut
into leaves of ``leaf_chars`` characters, wherever that falls; leaves are rows, dealt
over the cluster and encoded in parallel.  Then neighbours are joined as a tree: at
each join a window of tokens around it is encoded anew and grows until its first
token is that of the left part and its last token that of the right part: then each
neighbouring pair is a pair of one of the three encodings, so the whole is exact.  A
window that reaches both ends is the plain encoding.

The tree has one level of tasks for each factor of ``FAN`` leaves, so that the joins of a
very long text run in parallel too; only its ids come together at the root, whose
row holds them.  Decoding goes from each document's ids back to bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freeing, pieces_of, small_batches, stored
from .tokenizing import Bytes, Pieces, byte_tokens, id_bytes, tokenizer

LONG_CHARS = 1 << 15
LEAF_CHARS = 1 << 13
#: Leaves of a text, or nodes of the level below, that one task joins.
FAN = 64
#: Tokens on each side of a join in the first window, more than a special token has bytes; doubled until both sides agree.
WINDOW = 16
LEAF = "key long, row long, leaf long, text string"
CODED = "key long, row long, leaf long, windows long, ids binary"
OUT = "key long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string, windows long"


def leaves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """The text in leaves; nothing is one empty leaf."""
    return [text[at : at + leaf_chars] for at in range(0, max(1, len(text)), leaf_chars)]


class Encoder:
    """The library's plain encoding, and joins of its results."""

    def __init__(self, path: str):
        self.own, self.bytes = tokenizer(path), byte_tokens(path)
        #: Windows encoded so far.
        self.windows = 0

    def plain(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two texts, one after the other, from theirs."""
        if not (a and b):
            return a + b
        size, of = WINDOW, self.bytes.of
        while True:
            i, j = max(0, len(a) - size), min(len(b), size)
            # a window begins and ends between characters, and not before an
            # apostrophe, whose pre-token depends on the character before it
            while i and (_inside(of[a[i]]) or of[a[i]][0] == 0x27):
                i -= 1
            while j < len(b) and _inside(of[b[j]]):
                j += 1
            w = self.plain(b"".join(map(of.__getitem__, a[i:] + b[:j])).decode())
            self.windows += 1
            if (i == 0 or w[0] == a[i]) and (j == len(b) or w[-1] == b[j - 1]) and (len(w) > 1 or i == 0 and j == len(b)):
                return a[:i] + w + b[j:]
            size *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """All parts joined as a tree of halves."""
        while len(parts) > 1:
            two = [self.join(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = two + parts[len(parts) - len(parts) % 2 :]
        return parts[0]


def _inside(token: bytes) -> bool:
    """Whether a token begins inside a character."""
    return token[0] & 0xC0 == 0x80


_OUT = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("windows", pa.int64())])
_CODED = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("leaf", pa.int64()), ("windows", pa.int64()), ("ids", pa.binary())])


def _numbers(ids: bytes) -> list[int]:
    """Ids written by id_bytes."""
    return _array(ids).tolist()


def _array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def code(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", ids: bool = True, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, fan: int = FAN) -> DataFrame:
    """Encodes and decodes whole texts: one row a row of ``docs``.

    key, n_tokens, ids (null unless asked for), ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 (of the decoded text) and windows (encoded
    anew around joins).  A null text is empty: no ids, both digests those of
    nothing.  Rows of the same key are rows of their own; an empty table gives
    none; other columns are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def finished(own: Bytes, keys: list[int | None], found: list[np.ndarray], windows: list[int]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        lists = pa.nulls(len(found), pa.list_(pa.int32()))
        if ids:
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(found).view(np.int32)))
        digests = [hashlib.sha256(own.decimal(x)).hexdigest() for x in found], [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in found]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), lists, *(pa.array(x, pa.string()) for x in digests), pa.array(windows, pa.int64())], schema=_OUT)

    def short(batches):
        own, pieces = byte_tokens(tokenizer_path), Pieces(tokenizer_path, True)
        for batch in batches:
            for part in pieces_of(batch, 64):
                data = part.to_pydict()
                found = [_array(b"".join(x)) for x in pieces.values(data["text"])]
                yield finished(own, data["key"], found, [0] * len(found))

    def cut(batches):
        for batch in batches:
            for one in pieces_of(batch, 1):
                k, row, whole = (one.column(i)[0].as_py() for i in range(3))
                found = leaves(whole, leaf_chars)
                yield pa.RecordBatch.from_pydict({"key": [k] * len(found), "row": [row] * len(found), "leaf": range(len(found)), "text": found}, schema=pa.schema([("key", pa.int64()), ("row", pa.int64()), ("leaf", pa.int64()), ("text", pa.string())]))

    def encode(batches):
        pieces = Pieces(tokenizer_path, True)
        for batch in batches:
            for part in pieces_of(batch, 16):
                rows = part.to_pylist()
                found = pieces.values([r["text"] for r in rows])
                out = [{"key": r["key"], "row": r["row"], "leaf": r["leaf"], "windows": 0, "ids": b"".join(x)} for r, x in zip(rows, found)]
                yield pa.RecordBatch.from_pylist(out, schema=_CODED)

    def joined(table: pa.Table) -> pa.Table:
        own, parts = Encoder(tokenizer_path), sorted(table.to_pylist(), key=lambda r: r["leaf"])
        whole = own.tree([_numbers(r["ids"]) for r in parts])
        out = parts[0] | {"leaf": parts[0]["leaf"] // fan, "windows": sum(r["windows"] for r in parts) + own.windows, "ids": id_bytes(whole)}
        return pa.Table.from_pylist([out], schema=_CODED)

    def root(batches):
        own = byte_tokens(tokenizer_path)
        for batch in batches:
            for part in pieces_of(batch, 1):
                r = part.to_pylist()[0]
                yield finished(own, [r["key"]], [_array(r["ids"])], [r["windows"]])

    is_long = F.length("text") > long_chars
    dealt = rows.filter(is_long).select("key", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(cut, LEAF)
    nodes = stored(dealt.repartition(F.col("row"), F.col("leaf")).mapInArrow(freeing(encode), CODED), "bpe-leaves")
    last = nodes.agg(F.max("leaf")).first()[0] or 0
    while last:
        # stored, so that no task runs the join and the root in two workers: idle workers stay as long as an executor is busy
        nodes, last = stored(nodes.groupBy("row", F.expr(f"leaf div {int(fan)}")).applyInArrow(joined, CODED), "bpe-nodes"), last // fan
    return rows.filter(~is_long).mapInArrow(freeing(short), OUT).unionByName(nodes.mapInArrow(freeing(root), OUT))
