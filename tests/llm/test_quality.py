"""Counts of the quality rules against a plain version, and the bands' verdicts."""

import base64
import math
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from keystrata.llm import quality

from ..conftest import TESTDATA
from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = set()
    first = {}
    for i, w in enumerate(windows):
        if w in first:
            marked.update(range(i, i + 5), range(first[w], first[w] + 5))
        first.setdefault(w, i)
    n = len(marked)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, n, len(words) < 10 or 100 * n > 20 * len(words)


def texts():
    draw = random.Random(3)
    for _ in range(40):
        yield " ".join(draw.choice(["a", "bb", "c#", "é"]) for _ in range(draw.randint(0, 40)))
    yield "x y\nx y\n \n\nz\nx y"


def test_counts(spark, odd):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["key"]: tuple(r[f] for f in fields) for r in got} == {i: plain(t) for i, t in rows}
    got = sorted((tuple(r[f] for f in fields) for r in quality.judge(odd).collect()))
    assert got == sorted(plain(r[1]) for r in ODD)


def test_sorting_counts_as_hashing_does(monkeypatch):
    words = [random.Random(k).choice("abc") for k in range(400)]
    hashed = quality.repeat_words(words)
    monkeypatch.setattr(quality, "SORT_FROM", 10)
    assert quality.repeat_words(words) == hashed == plain(" ".join(words))[4]


def test_bands(spark):
    draw = random.Random(5)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ou", "st", "ti", "ly", "ble", "wh"]
    prose = " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(3000))
    noise = " ".join(base64.b64encode(draw.randbytes(6)).decode() for _ in range(3000))
    cycle = " ".join(draw.choice(["aa", "ab", "ba", "bb"]) + str(draw.randrange(2)) for _ in range(9000))
    rows = [(1, prose), (2, noise), (3, cycle), (4, prose[:200]), (5, prose[:1500])]
    got = {r["key"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), repeat_percent=100).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


def inside(size, dense, ratio, fits):
    """Whether a ratio lies in its band, by plain Python."""
    bands = [b for b in (quality.DENSE_BANDS if dense else quality.BANDS) if b[0] <= size]
    if size < quality.BANDS[0][0]:
        return True
    low, high = bands[-1][1:]
    if not dense and (own := math.floor(2 * math.log2(size))) in fits:
        low, high = max(low, fits[own][0]), fits[own][1]
    return low <= ratio <= high


def verdict(raw, own, fits=()):
    """(ratio, chunks, odd chunks, whether bands let the text pass), by plain Python."""
    fits, odd, n = dict(fits), 0, 0
    for at in range(0, len(raw), quality.CHUNK):
        part = raw[at : at + quality.CHUNK]
        if at and len(part) < quality.BANDS[0][0]:
            continue
        n += 1
        odd += not inside(len(part), quality.is_dense(part), len(part) / len(own.compress(part)), fits)
    ratio = len(raw) / len(own.compress(raw)) if raw else 0.0
    return ratio, n, odd, inside(len(raw), quality.is_dense(raw), ratio, fits) and odd <= quality.ODD_CHUNKS * n


def test_noise_at_every_length_and_in_part():
    """Random base64, in one run, in words or in part of a text, lies outside; prose and dense scripts lie inside."""
    draw, own = random.Random(8), zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = lambda raw: verdict(raw, own)[3]
    words = ["".join(draw.choice("etaoinshrdlucmfw") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    prose = " ".join(draw.choices(words, [1 / (i + 3) for i in range(400)], k=40000)).encode()
    one_run = lambda n: base64.b64encode(draw.randbytes(n))[:n]
    in_words = lambda n: b" ".join(base64.b64encode(draw.randbytes(6)) for _ in range(n // 9 + 1))[:n]
    for n in [b[0] + d for b in quality.BANDS for d in (0, b[0] // 8)] + [649, 974, 1819, 2729, 3899, 8099, 13499]:
        assert not kept(one_run(n)) and not kept(in_words(n)), n
        assert kept(prose[:n]), n
    assert not kept(prose[:6000] + one_run(14000)) and not kept(prose[:20000] + in_words(10000))
    assert kept(prose[:14000] + one_run(1500))
    # the last chunk counts, if short as well: 2 KB of prose and 900 bytes of base64
    assert verdict(prose[:2048] + one_run(900), own)[1:3] == (2, 1)
    assert verdict(prose[: 2048 + 100], own)[1:3] == (1, 0)
    signs = [chr(0x4E00 + 7 * i) for i in range(2500)]
    dense = "".join(draw.choices(signs, [1 / (i + 8) for i in range(2500)], k=20000)).encode()
    assert all(kept(dense[: 3 * n]) for n in (50, 100, 400, 1000, 5000))


def test_ratios_and_verdicts_on_the_table(spark):
    """Ratio, chunks, odd chunks and kept of the whole table, with fitted bands, by plain Python; junk goes, clean text stays."""
    docs, labels = (spark.read.parquet(str(TESTDATA / "sf0.1" / f"{t}.parquet")) for t in ("documents", "labels"))
    got = {r["key"]: r for r in quality.judge(docs, labels.filter("quality = 1").select(F.col("doc_id").alias("key"))).collect()}
    texts, own = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}, zstandard.ZstdCompressor(level=quality.LEVEL)
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ratios = {}
    for k, raw in texts.items():
        if good.get(k) == 1 and raw and not got[k]["base_failed"] and not quality.is_dense(raw):
            ratios.setdefault(math.floor(2 * math.log2(len(raw))), []).append(len(raw) / len(own.compress(raw)))
    fits = {}
    for c, x in ratios.items():
        if len(x) >= quality.LEAST_CLEAN:
            low, high = (sorted(x)[math.ceil(q * len(x)) - 1] for q in quality.TAILS)
            fits[c] = (low * (1 - quality.MARGIN), high * (1 + quality.MARGIN))
    assert len(fits) > 5
    for k, raw in texts.items():
        ratio, n, odd, fine = verdict(raw, own, fits)
        r = got[k]
        assert (r["ratio"], r["n_chunks"], r["odd_chunks"], r["kept"]) == (pytest.approx(ratio), n, odd, fine and not r["base_failed"])
    passed = [k for k in good if not got[k]["base_failed"]]
    gone = [k for k in passed if not got[k]["kept"]]
    assert len(gone) > 30 and sum(good[k] == 0 for k in gone) > 0.95 * len(gone)
    assert all(got[k]["kept"] for k in passed if good[k] == 1) or sum(not got[k]["kept"] for k in passed if good[k] == 1) <= 0.001 * len(passed)


def test_nothing(empty):
    assert quality.judge(empty).count() == 0
