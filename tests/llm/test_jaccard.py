"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import jaccard
from keystrata.llm.shared import stored

from .conftest import ODD


def brute(rows, width, percent):
    """component_id and set size of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr)


def joined(spark, rows, width, percent):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted(((r["key"], r["n_shingles"], r["component_id"]) for r in jaccard.Join(df, width, percent).components().collect()), key=repr)


def copies(seed, groups, each, words=60, edits=4):
    draw, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(groups):
        base = [f"w{draw.randrange(300)}" for _ in range(words)] + (passage if g % 2 else [])
        for _ in range(each):
            own = list(base)
            for _ in range(draw.randint(0, edits)):
                own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    draw.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 50)])
def test_near_copies(spark, width, percent):
    rows = copies(1, 12, 6)
    assert joined(spark, rows, width, percent) == brute(rows, width, percent)


@pytest.mark.parametrize("wide,block", [(10**6, 10**6), (10**6, 4), (8, 4)])
def test_cells_of_a_large_group(spark, monkeypatch, wide, block):
    """Regions joined as a whole, as pairs of blocks, and split again: many pairs near the threshold."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = copies(7, 2, 45, words=50, edits=5)
    assert joined(spark, rows, 3, 80) == brute(rows, 3, 80)


def test_every_link(spark, monkeypatch):
    """All linked pairs of different texts, those inside a component as well."""
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rows = copies(7, 2, 30, words=50, edits=5)
    sets = {frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)}
    want = sum(100 * len(a & b) >= 80 * len(a | b) for a in sets for b in sets if a is not b) // 2
    got = jaccard.Join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 3, 80).links().collect()
    assert len(got) == len({(bytes(r["a"]), bytes(r["b"])) for r in got}) == want > len(sets)
    assert all(bytes(r["a"]) < bytes(r["b"]) for r in got)


def test_few_sets_are_shipped_in_vain(spark, monkeypatch):
    """The bit filter before the sets' shuffle lets few of the others pass, and all that are needed."""
    masks, own = [], jaccard._classes
    monkeypatch.setattr(jaccard, "_classes", lambda width, mask: masks.append(mask) or own(width, mask))
    df = spark.createDataFrame([(i, f"a{i} b c") for i in range(6000)], "doc_id bigint, text string")
    needed = stored(jaccard.with_class(df, 3).filter("doc_id % 2 = 0").select("class"), "test-needed")
    found = jaccard.Join(df, 3, 90)._sets(needed)
    assert found.join(needed, "class").count() == found.count() == 3000
    assert np.bitwise_count(masks[0]).sum() < 0.02 * 32 * len(masks[0])


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD]
    assert joined(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_case_and_spaces(spark):
    rows = [(1, "A b\tC d"), (2, "a B c  D"), (3, "a b c É"), (4, "a b c é"), (5, "a b"), (6, "A\nB")]
    assert joined(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_nothing_and_no_links(spark, empty):
    assert jaccard.Join(empty, 3, 90).components().count() == 0
    assert jaccard.one_of_each(empty, 5, 80).count() == 0
    rows = [(i, f"a{i} b{i} c{i} d{i}") for i in range(5)]
    assert joined(spark, rows, 3, 90) == brute(rows, 3, 90)


def test_one_of_each(spark):
    rows = copies(3, 6, 5) + [(1000, None), (1001, ""), (1002, None)]
    rows.append(rows[0])
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, `class` string")
    kept = jaccard.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute(rows, 5, 80)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_one_of_each_with_null_and_repeated_keys(spark):
    """Components are kept apart where their documents share a key or have none."""
    apart = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = [t + " end" for t in apart]
    rows = [
        (None, apart[0]), (None, apart[1]), (None, near[1]), (None, apart[1]),  # null keys: two components
        (5, apart[2]), (5, apart[3]), (9, near[3]), (9, near[2]),  # one key on two components, both with near copies
        (None, apart[4]), (7, near[4]), (7, apart[5]), (7, apart[5]), (None, None), (None, ""),
    ]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 5, 80).collect()]
    one = next(t for _, t in kept if t in (apart[1], near[1]))
    want = [(None, apart[0]), (None, one), (5, apart[2]), (5, apart[3]), (7, near[4]), (7, apart[5]), (None, None), (None, "")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_links_by_label_propagation(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x1", "x2")]
    edges = spark.createDataFrame([(bytearray(a.encode()), bytearray(b.encode())) for a, b in chain], "a binary, b binary")
    got = {bytes(r["class"]).decode(): bytes(r["label"]).decode() for r in jaccard.components(edges).collect()}
    assert set(got.values()) == {"n000", "x1"} and len(got) == 63 and got["n060"] == "n000"


def test_bitmaps_never_part_close_sets():
    draw = random.Random(2)
    for _ in range(200):
        a = {draw.randrange(1 << 60) for _ in range(draw.randint(1, 300))}
        b = set(draw.sample(sorted(a), len(a) - draw.randrange(len(a)))) | {draw.randrange(1 << 60) for _ in range(draw.randint(0, 30))}
        x, y = (np.frombuffer(jaccard.bitmap(np.array(sorted(s), np.uint64)), np.uint8) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)
