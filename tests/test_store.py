"""The mutable store, its stream, and hot keys, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keystrata.operators import hot
from keystrata.operators.mutable import MutableIndex, in_order, with_before
from keystrata.streaming.mutable_stream import MutableStream, hot_counts


def folded(ops):
    """(results, live ids) of a list of (op, key) by a dict."""
    live, results, next_id = {}, [], 0
    for op, key in ops:
        if op == "I":
            if key not in live:
                live[key], next_id = next_id, next_id + 1
            results.append(live[key])
        else:
            results.append(live.pop(key, None))
    return results, live


def log(spark, ops):
    return spark.createDataFrame([(i, k, op) for i, (op, k) in enumerate(ops)], "seq bigint, key string, op string")


def check(spark, ops, **more):
    index = MutableIndex.fold(log(spark, ops), **more)
    results, live = folded(ops)
    assert [r["id"] for r in index.results().orderBy("seq").collect()] == results
    assert {r["key"]: r["id"] for r in index.state().collect()} == live
    assert len(index) == len(live)
    return index


def test_insert_twice_delete_twice_and_again(spark):
    index = check(spark, [("I", "alpha"), ("I", "alpha"), ("D", "alpha"), ("D", "alpha"), ("I", "alpha"), ("I", "beta"), ("D", "gamma")])
    got = {r["key"]: r["id"] for r in index.lookup(spark.createDataFrame([("alpha",), ("gamma",), (None,)], "key string")).collect()}
    assert got == {"alpha": 1, "gamma": None, None: None}


def test_live_count_after_delete(spark):
    stats = check(spark, [("I", "a"), ("I", "b"), ("D", "a")]).stats().first()
    assert (stats["live"], stats["tombstones"], stats["ids"]) == (1, 1, 2)


def test_tiers_and_compaction(spark):
    index = check(spark, [("I", f"key-{i}") for i in range(200)], flush_every=8, max_tiers=16)
    assert index.tier_stats().count() == 25 and index.needs_compaction()
    before = {r["key"]: r["id"] for r in index.state().collect()}
    compact = index.compacted()
    assert compact.select("tier").distinct().count() == 1
    assert {r["key"]: r["id"] for r in compact.collect()} == before


def test_empty_and_odd_rows(spark):
    assert len(MutableIndex.fold(log(spark, []))) == 0
    odd = spark.createDataFrame([(0, None, "I"), (1, "a", "X"), (2, "a", None), (3, "a", "I")], "seq bigint, key string, op string")
    assert [tuple(r) for r in MutableIndex.fold(odd).state().collect()] == [("a", 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    draw = random.Random(seed)
    check(spark, [(draw.choice("IID"), f"k{draw.randrange(40)}") for _ in range(600)])


@pytest.mark.parametrize("slice_rows", [1, 7, 10**6])
def test_one_key_holds_most_of_the_log(spark, slice_rows):
    draw = random.Random(9)
    ops = [(draw.choice("IID"), draw.choice(["hot"] * 9 + ["a", "b"])) for _ in range(400)]
    want, live = folded(ops)
    store = MutableIndex.fold(log(spark, ops), slice_rows=slice_rows)
    assert {r["seq"]: r["id"] for r in store.results().collect()} == dict(enumerate(want))
    assert {r["key"]: r["id"] for r in store.state().collect()} == live


def test_keys_of_few_rows_are_folded_in_one_shuffle(spark):
    """Slices are for keys of more rows than a slice only, and small logs are not dealt to many tasks."""
    log = spark.createDataFrame([(i, f"k{i % 9}", "ID"[i % 2]) for i in range(90)], "seq bigint, key string, op string").repartition(3)
    ordered = in_order(log)
    assert len(ordered.inputFiles()) == 1
    plan = with_before(ordered)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") == 1
    mixed = log.withColumn("key", F.when(F.col("seq") > 40, "k1").otherwise(F.col("key")))
    got = {n: sorted(with_before(in_order(mixed), n).select("at", "key", "op", "before", "alloc", "born").collect()) for n in (7, 1000)}
    assert len(got[7]) == 90 and got[7] == got[1000]


def test_operations_of_one_seq(spark):
    """Neither lost nor multiplied: by key, inserts first, equal ones as repeats."""
    rows = [(0, "b", "I"), (0, "a", "I"), (0, "a", "I"), (1, "a", "D"), (1, "a", "I"), (2, "a", "I")]
    store = MutableIndex.fold(spark.createDataFrame(rows, "seq bigint, key string, op string"))
    got = sorted(tuple(r) for r in store.results().collect())
    assert got == [(0, "a", "I", 0), (0, "a", "I", 0), (0, "b", "I", 1), (1, "a", "D", 0), (1, "a", "I", 0), (2, "a", "I", 2)]
    assert tuple(store.buffer_stats().first()) == (0, 3, 3 * 9)


def test_rolling_hot_tier(spark):
    keys = lambda x: spark.createDataFrame([(k,) for k in x], "key bigint")
    rolling = hot.RollingHotTier(None, 6)
    assert rolling.top_k(2) is None and rolling.current_memory() == 0
    assert rolling.lookup(keys([1, 1, 2, None])).filter("hot_id is not null").count() == 0 and not rolling.should_rebuild()
    rolling.lookup(keys([2, 3, 2]))
    assert rolling.should_rebuild() and [tuple(r) for r in rolling.top_k(2).collect()] == [(2, 3), (1, 2)]
    best = rolling.take_top_k(2)
    assert not rolling.should_rebuild() and rolling.observed == 0
    rolling.install(hot.HotTier.of(best.withColumn("id", F.col("n") * 10)))
    assert {r["key"]: r["hot_id"] for r in rolling.lookup(keys([1, 2, 3])).collect()} == {1: 20, 2: 30, 3: None}
    assert rolling.current_memory() == 32 and rolling.observed == 3
    with pytest.raises(ValueError):
        hot.RollingHotTier(None, 0)


def test_compaction_is_followed_when_it_is_done(spark, tmp_path):
    """A merged tier that no pointer names is not read; afterwards its tiers are gone and ids go on."""
    store = MutableStream(spark, f"file://{tmp_path}/s")
    ops = [("I", "a"), ("D", "a"), ("I", "b")]
    for i in range(3):
        store.apply(log(spark, ops).filter(F.col("seq") == i), i)
    spark.createDataFrame([("zz", "I", 99)], "key string, op string, id bigint").write.parquet(f"file://{tmp_path}/s/merged/batch=1")
    assert {r["key"]: r["id"] for r in store.state().collect()} == {"b": 1}
    store.compact(1)
    assert store.compacted_upto() == 1 and sorted(r["batch"] for r in store.tier_stats().collect()) == [1, 2]
    store.compact(2)
    store.compact(2)
    assert [tuple(r) for r in store.tier_stats().collect()] == [(2, 2)]
    store.apply(spark.createDataFrame([(9, "a", "I")], "seq bigint, key string, op string"), 3)
    assert {r["key"]: r["id"] for r in store.state().collect()} == {"a": 2, "b": 1}


def test_stream_equals_batch_and_retries_are_harmless(spark, tmp_path):
    draw = random.Random(5)
    ops = [(draw.choice("IID"), f"k{draw.randrange(25)}") for _ in range(300)]
    store = MutableStream(spark, f"file://{tmp_path}/store")
    rows = log(spark, ops)
    parts = [rows.filter(F.col("seq").between(75 * i, 75 * i + 74)) for i in range(4)]
    for i, part in enumerate(parts):
        store.apply(part, i)
        store.apply(part, i)
    live = folded(ops)[1]
    assert {r["key"]: r["id"] for r in store.state().collect()} == live
    store.compact(2)
    assert {r["key"]: r["id"] for r in store.state().collect()} == live


def test_file_stream(spark, tmp_path):
    ops = [("I", "a"), ("I", "b"), ("D", "a"), ("I", "a"), ("I", "c")]
    rows = log(spark, ops)
    for i in range(5):
        rows.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    store = MutableStream(spark, f"file://{tmp_path}/store")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    store.start(source, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert {r["key"]: r["id"] for r in store.state().collect()} == folded(ops)[1]


def observations(spark):
    keys = [k for _ in range(50) for k in (1, 2, 3, 4, 5)] + list(range(100, 130))
    return spark.createDataFrame(list(enumerate(keys)), "seq bigint, key bigint"), Counter(keys)


def test_top_k(spark):
    df, counts = observations(spark)
    got = [tuple(r) for r in hot.top_k(df, 5).collect()]
    assert got == sorted(((k, n) for k, n in counts.items()), key=lambda x: (-x[1], x[0]))[:5]
    assert tuple(hot.totals(df).first()) == (35, 280)
    with pytest.raises(ValueError):
        hot.top_k(df, 0)


def test_approximate_top_k_never_undercounts_by_much(spark):
    df, counts = observations(spark)
    for r in hot.approx_top_k(df, 5, 8).collect():
        assert abs(r["n"] - counts[r["key"]]) <= 280 / 8
    assert {r["key"] for r in hot.approx_top_k(df, 5, 1000).collect()} == {1, 2, 3, 4, 5}


def test_epochs_and_hot_lookup(spark):
    df = spark.createDataFrame(list(enumerate([10, 20, 10, 7, 7, 7])), "seq bigint, key bigint")
    got = sorted((r["epoch"], r["place"], r["key"], r["n"]) for r in hot.epochs(df, 3, 2).collect())
    assert got == [(0, 1, 10, 2), (0, 2, 20, 1), (1, 1, 7, 3)]
    found = {r["key"]: r["hot_id"] for r in hot.HotTier.hottest(df, 2).lookup(df).collect()}
    assert found == {7: 0, 10: 1, 20: None}


def test_streamed_counts(spark, tmp_path):
    df, counts = observations(spark)
    df.write.parquet(f"file://{tmp_path}/seen")
    stream = hot_counts(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/seen"))
    query = stream.writeStream.format("memory").queryName("hot_seen").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["key"]: r["n"] for r in spark.table("hot_seen").collect()} == counts
