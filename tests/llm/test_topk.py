"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, row string, score bigint"


def brute(rows, k, is_query):
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(held):
        if is_query(i):
            scores = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(held) if a != b and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, k=5, every=4, **more):
    df = spark.createDataFrame([(i, v, "r", 9) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.Index.build(df, F.col("vec_id") % every == 0, **more).search(k).collect()))


@pytest.mark.parametrize("spread", [0.05, 1.0, 3e6])
def test_random_vectors(spark, spread):
    draw = random.Random(1)
    centres = [[draw.gauss(0, spread) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, spread / 20) for c in draw.choice(centres)]) for i in range(300)]
    assert found(spark, rows, block=16, group_blocks=3) == brute(rows, 5, lambda i: i % 4 == 0)


def test_few_chunks_travel(spark):
    """Of clustered vectors, headers keep most chunks from most groups before anything is shuffled."""
    draw = random.Random(2)
    centres = [[draw.gauss(0, 30) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + draw.gauss(0, 0.2) for c in centres[i % 12]]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    index = topk.Index.build(df, F.col("vec_id") % 4 == 0, block=40, group_blocks=2)
    chunks = index.home(5).filter("chunk is not null")
    groups = index._grouped().select("grp").distinct().count()
    assert index.visits(chunks).count() < 0.5 * chunks.count() * (groups - 1)
    got = sorted(map(tuple, index.search(5).collect()))
    assert got == brute(rows, 5, lambda i: i % 4 == 0)


def test_ties_repeats_nulls_and_other_lengths(spark):
    rows = [(i, [0.5, 0.5]) for i in range(40)] + [(3, [0.5, 0.5]), (3, [0.5, 0.5]), (None, [1.0, 1.0]), (50, None), (51, [1.0, None]), (52, [float("nan"), 1.0]), (56, [float("inf"), 1.0]), (60, [1.0, 2.0, 3.0]), (64, []), (68, [])]
    assert found(spark, rows) == brute(rows, 5, lambda i: i % 4 == 0)


def test_few_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [-1.0])]) == [(0, 1, 1, -4096)]


def test_annuli_are_left_out(monkeypatch):
    """Clusters far apart: bounds spare most products."""
    draw = np.random.default_rng(3)
    blocks = []
    pivots = {4: np.array([[1000.0 * c, 0, 0, 0] for c in range(8)])}
    for c in range(8):
        mat = (draw.normal(0, 3, (50, 4)) + pivots[4][c]).astype(np.int64)
        dist = np.sqrt(((mat - pivots[4][c]) ** 2).sum(1))
        blocks.append({"dim": 4, "pivot": c, "dmin": dist.min(), "dmax": dist.max(), "nmax": float((mat.astype(float) ** 2).sum(1).max()), "rows": np.arange(50) + 50 * c, "ids": np.arange(50) + 50 * c, "mat": mat})
    q = {"mat": blocks[7]["mat"][:2], "rows": np.array([350, 351]), "ids": np.array([350, 351]), "least": np.full(2, np.iinfo(np.int64).min)}
    done = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: done.append(1) or real(a, b))
    rows, _, ids, scores, _ = topk._best(q, blocks, pivots, 5)
    everything = np.concatenate([b["mat"] for b in blocks])
    for r in (350, 351):
        s = everything @ everything[r]
        s[r] = s.min() - 1
        assert sorted(scores[rows == r], reverse=True) == sorted(s, reverse=True)[:5]
    assert len(done) < len(blocks)


def test_wide_numbers_are_exact():
    q = np.array([[1 << 29, -(1 << 29) + 1]])
    assert topk.products(q, q)[0, 0] == (1 << 58) + ((1 << 29) - 1) ** 2
