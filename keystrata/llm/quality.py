"""Quality rules: word, line and repetition counts, then compression bands.

Zstandard ratios (bytes over compressed bytes) of the whole document and of its
fixed chunks must lie in a band that depends on the length compressed: short text
compresses little, long clean text more, repeated or templated text more again, and random or
encoded text hardly at all.  A document outside its band, or with too large a
share of its chunks outside theirs, is rejected.

Where documents are labelled clean, the bands are fitted: for each length class (half an
octave) of at least ``LEAST_CLEAN`` of them, all counted, from ``TAILS`` of their ratios, widened
by ``MARGIN``.  Classes without, and text mostly not ASCII, have the fixed bands below.

One pass over each row by itself, which stores counts and ratios, then one
aggregate by class and the verdicts: texts are not shuffled, memory is that of one document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import freeing, pieces_of, stored

_WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
_ASCII = bytes(range(128))
#: (bytes from, least ratio, greatest ratio); shorter texts than the first are not judged.  The least ratio lies above that
#: of random base64, in one run or in words, at every length of the band.
BANDS = (
    (128, 1.05, 4.0), (160, 1.08, 4.0), (192, 1.12, 4.0), (224, 1.15, 4.0), (256, 1.18, 4.0), (384, 1.24, 4.0), (512, 1.29, 4.0), (768, 1.32, 4.0),
    (1024, 1.4, 4.5), (2048, 1.42, 4.5), (4096, 1.45, 5.5), (16384, 1.5, 7.0), (131072, 1.5, 9.0),
)
#: The same for text that is for the most part not ASCII: scripts of many characters compress as little as base64, which is ASCII.
DENSE_BANDS = ((128, 0.0, 4.0), (256, 1.0, 4.0), (1024, 1.25, 4.5), (4096, 1.35, 5.5), (16384, 1.38, 7.0), (131072, 1.38, 9.0))
CHUNK = 2048
#: Share of a document's chunks that may lie outside their band.
ODD_CHUNKS = 0.25
LEVEL = 3
#: Fitting: clean documents in a class at least, quantiles of their ratios, and what these are widened by.
LEAST_CLEAN, TAILS, MARGIN = 30, (0.005, 0.995), 0.03
#: Texts of more words find repeated windows by sorting instead of hashing.
SORT_FROM = 200_000
MEASURED = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, size long, dense boolean, ratio double, chunks array<struct<size:long,dense:boolean,ratio:double>>"
OUT = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, odd_chunks long, kept boolean"


def repeat_words(words: list[str], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if len(words) > SORT_FROM:
        known: dict[str, int] = {}
        rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        one = rank
        for k in range(1, width):
            rank = np.unique(rank[: len(words) - k] * len(known) + one[k:], return_inverse=True)[1]
        twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    else:
        windows = list(zip(*(words[k:] for k in range(width))))
        if len(set(windows)) == n:
            return 0
        times = Counter(windows)
        twice = np.flatnonzero([times[w] > 1 for w in windows])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def is_dense(raw: bytes) -> bool:
    return not raw.isascii() and 2 * len(raw.translate(None, _ASCII)) > len(raw)


def chunks_of(raw: bytes, own: zstandard.ZstdCompressor, chunk: int = CHUNK, least: int = BANDS[0][0]) -> list[dict]:
    """Size, density and ratio of each chunk; the last one too, unless it is shorter than any band and not the only one."""
    out = []
    for at in range(0, len(raw), chunk):
        part = raw[at : at + chunk]
        if not at or len(part) >= min(chunk, least):
            out.append({"size": len(part), "dense": is_dense(part), "ratio": len(part) / len(own.compress(part))})
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """One row for each row of ``docs`` with its counts, base verdict and ratios.

    A null text has no words, as the empty text.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds["array<struct<size:long,dense:boolean,ratio:double>>"] = pa.list_(pa.struct([("size", pa.int64()), ("dense", pa.bool_()), ("ratio", pa.float64())]))
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MEASURED.split(", ")])

    def count(batches):
        own = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in pieces_of(batch):
                out = []
                for k, x in zip(*(c.to_pylist() for c in part.columns)):
                    words, raw = _WORD.findall(x), x.encode()
                    repeated = repeat_words(words)
                    failed = len(words) < least_words or 100 * repeated > repeat_percent * len(words)
                    ratio = len(raw) / len(own.compress(raw)) if raw else 0.0
                    out.append((k, len(words), sum(map(len, words)), sum(map(x.count, SYMBOLS)), dup_lines(x), repeated, failed, len(raw), is_dense(raw), ratio, chunks_of(raw, own, chunk)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(freeing(count), MEASURED)


def _length_class(size: Column) -> Column:
    return F.floor(2 * F.log2(size)).cast("int")


def fitted(measured: DataFrame, clean: DataFrame) -> dict[int, tuple[float, float]]:
    """Least and greatest ratio by length class, from the rows of ``measured`` whose key is in ``clean`` (key).

    At most two classes an octave, so what comes to the driver does not grow with the rows.
    """
    rows = measured.filter("size > 0 and not dense and not base_failed").join(clean.select("key"), "key", "left_semi")
    tails = F.percentile_approx("ratio", list(TAILS), 10_000)
    found = rows.groupBy(_length_class(F.col("size")).alias("c")).agg(F.count("*").alias("n"), tails.alias("t")).filter(F.col("n") >= LEAST_CLEAN)
    return {r["c"]: (r["t"][0] * (1 - MARGIN), r["t"][1] * (1 + MARGIN)) for r in found.collect()}


def _in_band(size: Column, dense: Column, ratio: Column, fits: dict[int, tuple[float, float]]) -> Column:
    """Whether a ratio lies in the band of its length; text shorter than the first band always does."""

    def fixed(bands, at: int) -> Column:
        limit = F.when(F.lit(False), F.lit(0.0))
        for b in reversed(bands):
            limit = limit.when(size >= b[0], F.lit(float(b[at])))
        return limit

    def fit(at: int) -> Column:
        limit = F.when(F.lit(False), F.lit(0.0))
        for c, limits in fits.items():
            limit = limit.when(_length_class(size) == c, F.lit(limits[at]))
        return limit

    # a fitted band never lets pass what the fixed one takes for noise; greatest skips null
    low, high = F.greatest(fixed(BANDS, 1), fit(0)), F.coalesce(fit(1), fixed(BANDS, 2))
    low, high = F.when(dense, fixed(DENSE_BANDS, 1)).otherwise(low), F.when(dense, fixed(DENSE_BANDS, 2)).otherwise(high)
    return (size < BANDS[0][0]) | ratio.between(low, high)


def judge(docs: DataFrame, clean: DataFrame | None = None, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, odd_chunks: float = ODD_CHUNKS, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """One row for each row of ``docs`` with its counts and verdict.

    ``clean`` (key) names documents known to be clean, from which bands are fitted.  A
    null text has no words, so it fails the base rules, as the empty text does.
    Texts shorter than the first band are judged by the base rules alone.  Whole texts are
    measured, however long.  Repeated rows and keys stay rows of their own, each judged alike; an
    empty table gives none; other columns are left out.
    """
    measured = stored(measure(docs, key, text, chunk, least_words, repeat_percent), "quality-measured")
    fits = fitted(measured, clean) if clean is not None else {}
    odd = F.size(F.filter("chunks", lambda x: ~_in_band(x["size"], x["dense"], x["ratio"], fits))).cast("long")
    names = [c.split()[0] for c in OUT.split(", ")]
    out = measured.withColumn("n_chunks", F.size("chunks").cast("long")).withColumn("odd_chunks", odd)
    kept = ~F.col("base_failed") & _in_band(F.col("size"), F.col("dense"), F.col("ratio"), fits) & (F.col("odd_chunks") <= odd_chunks * F.col("n_chunks"))
    return out.withColumn("kept", kept).select(*names)
