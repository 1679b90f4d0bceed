"""Water-filling and repetitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from keystrata.llm import mixing

from .conftest import ODD


def filled(sizes, weights, total, epochs):
    """Targets by the rule itself: clamp, deal the rest again, until none is above."""
    caps = {s: epochs * n for s, n in sizes.items()}
    clamped = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        level = max(0.0, total - sum(caps[s] for s in clamped)) / sum(weights[s] for s in free) if free else 0
        above = {s for s in free if level * weights[s] > caps[s]}
        if not above:
            return {s: caps[s] if s in clamped else level * weights[s] for s in sizes}
        clamped |= above


@pytest.mark.parametrize("seed", range(3))
def test_water_fill(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.randint(1, 1000) for i in range(12)}
    weights = {s: draw.choice([5, 2, 1]) for s in sizes}
    total = 1.5 * sum(sizes.values())
    df = spark.createDataFrame([(s, float(weights[s]), n) for s, n in sizes.items()], "source string, weight double, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, total, 2.0).collect()}
    assert got == pytest.approx(filled(sizes, weights, total, 2.0))


def test_mix_reaches_targets_and_repeats(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.randint(1, 60)), draw.choice(["big", "big", "big", "s", "t", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    weights = spark.createDataFrame([("big", 5), ("s", 2), ("t", 1), (None, 5)], "source string, weight int")
    run = lambda: sorted(map(tuple, mixing.mix(docs, weights, 1.5, 2.0, 3).collect()))
    got = sorted((r for r in run()), key=repr)
    assert got == sorted((r for r in run()), key=repr)
    sums, targets, sizes = {}, {}, {}
    for _, source, size, source_size, target, taken in got:
        sums[source] = sums.get(source, 0) + taken
        sizes[source] = sizes.get(source, 0) + size
        targets[source] = (target, source_size)
        assert taken in (0, size, 2 * size)
    assert sizes == {s: t[1] for s, t in targets.items()}
    for s, t in targets.items():
        assert abs(sums[s] - t[0]) <= 30
    assert sum(t[0] for t in targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    mixed = mixing.mixed(docs, weights, 1.5, 2.0, 3)
    assert mixed.columns == docs.columns
    again = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert again == {r[0]: r[5] // r[2] for r in got if r[5]}


def test_clashing_columns_and_equal_ids(spark):
    """All columns come through as they are, whatever their names; rows of one id with other texts are drawn apart."""
    rows = [(None, f"w{i} x y z", "a", 777.0, i, "r", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, target double, source_size int, `row` string, repeats string")
    weights = spark.createDataFrame([("a", 1)], "source string, weight int")
    got = mixing.mixed(docs, weights, 0.5, 2.0, 3)
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == 200 and {tuple(r) for r in got} <= set(rows)


def test_odd_rows_and_nothing(spark, odd, empty):
    weights = spark.createDataFrame([("a", 1), (None, 2)], "source string, weight int")
    got = mixing.mix(odd, weights, 1.5, 2.0, 3).collect()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ODD)
    assert sorted(r["size"] for r in got) == sizes
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(empty, weights, 1.5, 2.0, 3).count() == 0
