"""Static, ordered, hashed and compact indexes on arithmetic key sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.functions.keys import CorruptDataError, DuplicateKeyError, HashCollisionError, EmptyKeysError, NullKeyError, unsigned, wide, duplicates
from keystrata.operators import codec
from keystrata.operators.hashed import HashedIndex
from keystrata.operators.ordered import SEGMENT_BYTES, OrderedIndex, tuned_epsilon
from keystrata.operators.static import StaticIndex
from keystrata.plans import rank


def longs(spark, values, name="key"):
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


def spaced(spark, n, step=997):
    return spark.range(n).select((F.col("id") * step).alias("key"))


def test_static_hits_misses_order_and_repeats(spark):
    index = StaticIndex.build(longs(spark, [5, 3, 9]))
    probes = spark.createDataFrame([(0, 9), (1, 4), (2, 9), (3, None), (4, 3)], "ord int, key bigint")
    found = index.lookup(probes).orderBy("ord").collect()
    assert [r["id"] for r in found] == [2, None, 2, None, 0]
    assert [r["found"] for r in index.contains(probes).orderBy("ord").collect()] == [True, False, True, False, True]
    assert sorted(r["ord"] for r in index.semi(probes).collect()) == [0, 2, 4]
    assert sorted(r["ord"] for r in index.anti(probes).collect()) == [1, 3]
    assert index.slot_capacity() == 3 and index.range(0, 100).count() == 0
    assert index.get(9).collect()[0]["id"] == 2 and index.get(8).count() == 0


def test_static_refuses_duplicates_nulls_and_strictly_empty(spark):
    with pytest.raises(DuplicateKeyError):
        StaticIndex.build(longs(spark, [1, 2, 1]))
    with pytest.raises(NullKeyError):
        StaticIndex.build(longs(spark, [1, None]))
    with pytest.raises(EmptyKeysError):
        StaticIndex.build(longs(spark, []), strict=True)


def test_static_empty(spark):
    for index in (StaticIndex.build(longs(spark, [])), StaticIndex.empty(spark)):
        assert index.is_empty() and len(index) == 0
        assert index.lookup(longs(spark, [1])).first()["id"] is None
        assert index.stats().first()["engine"] == "dictionary-empty"


def test_static_short_byte_keys_differ(spark):
    keys = [b"\x00", b"\x03\x00", b"a", b"b\x00", b""]
    index = StaticIndex.build(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
    ids = {bytes(r["key"]): r["id"] for r in index.table.collect()}
    assert sorted(ids) == sorted(keys) and sorted(ids.values()) == list(range(5))
    assert [k for k, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(keys)
    assert index.stats().first()["key_bytes"] == 6


def test_static_saved_opened_and_corrupt(spark, tmp_path):
    index = StaticIndex.build(spaced(spark, 100))
    index.save(f"{tmp_path}/i")
    again = StaticIndex.open(spark, f"{tmp_path}/i")
    assert again.table.orderBy("id").collect() == index.table.orderBy("id").collect()
    with pytest.raises(CorruptDataError):
        StaticIndex.open(spark, f"{tmp_path}/nothing")
    with pytest.raises(CorruptDataError):
        OrderedIndex.open(spark, f"{tmp_path}/i")
    index.export(30).count() == 4


def test_static_export_holds_all(spark):
    rows = StaticIndex.build(spaced(spark, 100)).export(30).orderBy("chunk").collect()
    assert [i for r in rows for i in r["ids"]] == list(range(100))
    assert [k for r in rows for k in r["keys"]] == [i * 997 for i in range(100)]


def test_ordered_rank_of_every_key(spark):
    index = OrderedIndex.build(spaced(spark, 5000))
    wrong = index.index(spaced(spark, 5000)).filter(F.col("pos") != F.expr("key div 997"))
    assert wrong.count() == 0
    assert index.index(longs(spark, [42])).first()["pos"] is None


def test_ordered_ranges_and_bounds(spark):
    index = OrderedIndex.build(spark.range(100, 2000).select(F.col("id").alias("key")))
    at = lambda a, b: [r["pos"] for r in index.range(a, b).collect()]
    assert at(500, 510) == list(range(400, 411))
    assert at(510, 500) == [] and at(0, 101) == [0, 1] and at(1999, 5000) == [1899]
    assert (index.lower_bound(5), index.lower_bound(5000), index.upper_bound(100)) == (0, 1900, 1)


def test_ordered_bounds_of_absent_keys(spark):
    index = OrderedIndex.build(spaced(spark, 1000))
    assert index.lower_bound(500) == 1
    assert [r["pos"] for r in index.range(500, 5000).collect()] == [1, 2, 3, 4, 5]
    values = [-5, 0, 1, 996, 997, 998, 997 * 999, 997 * 999 + 1, 10**9]
    keys = np.arange(1000) * 997
    for name, side in (("lower_bounds", "left"), ("upper_bounds", "right")):
        got = {r["key"]: r["bound"] for r in getattr(index, name)(longs(spark, values)).collect()}
        assert got == {v: int(np.searchsorted(keys, v, side)) for v in values}


def test_ordered_bounds_keep_repeats_nulls_and_columns(spark):
    index = OrderedIndex.build(longs(spark, [10, 20]))
    probes = spark.createDataFrame([("a", 20), ("b", 20), ("c", None)], "name string, key bigint")
    got = sorted((r["name"], r["bound"]) for r in index.lower_bounds(probes).collect())
    assert got == [("a", 1), ("b", 1), ("c", None)]


def test_ordered_unsigned_limits(spark):
    values = [0, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    index = OrderedIndex.build(longs(spark, [unsigned(v) for v in reversed(values)]), unsigned=True)
    ranks = {r["key"]: r["pos"] for r in index.table.collect()}
    assert [ranks[unsigned(v)] for v in values] == [0, 1, 2, 3]
    assert index.upper_bound((1 << 64) - 1) == 4 and index.lower_bound(1 << 63) == 2
    assert [r["pos"] for r in index.range(1, (1 << 64) - 1).collect()] == [1, 2, 3]
    assert int(index.universe().first()[0]) == 1 << 64


def test_ordered_wide_keys(spark):
    keys = spark.createDataFrame([(bytearray(wide(i * 1_000_003)),) for i in range(1, 1001)], "key binary")
    index = OrderedIndex.build(keys)
    got = {int.from_bytes(r["key"], "big"): r["pos"] for r in index.table.collect()}
    assert got == {i * 1_000_003: i - 1 for i in range(1, 1001)}
    assert index.index(spark.createDataFrame([(bytearray(wide(7)),)], "key binary")).first()["pos"] is None
    assert index.lower_bound(bytearray(wide(5))) == 0
    assert index.range(bytearray(wide(100 * 1_000_003)), bytearray(wide(200 * 1_000_003))).count() == 101


def test_ordered_refuses_duplicates_and_takes_empty(spark):
    with pytest.raises(DuplicateKeyError):
        OrderedIndex.build(longs(spark, [1, 1]))
    index = OrderedIndex.build(longs(spark, []))
    assert index.range(0, 10).count() == 0 and index.lower_bound(3) == 0
    assert index.lower_bounds(longs(spark, [3])).first()["bound"] == 0
    assert index.segments().count() == 0


@pytest.mark.parametrize("epsilon", [4, 64])
def test_segments_cover_all_within_their_error(spark, epsilon):
    draw = random.Random(3)
    keys = sorted(draw.sample(range(10**9), 3000))
    index = OrderedIndex.build(longs(spark, keys))
    segments = sorted(index.segments(epsilon).collect())
    assert sum(s["n"] for s in segments) == 3000
    at = 0
    for s in segments:
        assert s["first_pos"] == at and s["max_error"] <= epsilon
        own = np.array(keys[at : at + s["n"]], dtype=float)
        off = np.abs(s["slope"] * (own - s["key_from"]) + s["intercept"] - np.arange(s["n"]))
        assert off.max() <= s["max_error"]
        at += s["n"]


def test_linear_keys_are_one_segment_a_partition(spark):
    stats = OrderedIndex.build(spaced(spark, 4000)).segment_stats(16).first()
    assert stats["keys"] == 4000 and stats["segments"] <= 4 and stats["max_error"] <= 1


def test_segments_run_over_arrow_batches(spark):
    """A line of 100,000 keys is one segment for each range partition, not one for each batch of 10,000 rows."""
    index = OrderedIndex.build(spaced(spark, 100_000))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert index.segments(16).count() <= parts


def test_tasks_of_a_build_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """However many keys: more of them make more partitions, not larger ones, and hash tables do not gather coalesced ones."""
    monkeypatch.setattr(rank, "MOST_ROWS", 100)
    most = lambda df, n=F.lit(1): df.groupBy(F.spark_partition_id()).agg(F.sum(n).alias("n")).agg(F.max("n")).first()[0]
    keys = rank.distinct_keys(spaced(spark, 1000).union(spaced(spark, 1000)))
    assert keys.count() == 1000 and most(keys) < 300
    index = OrderedIndex.build(keys)
    assert index.table.count() == 1000 and most(index.segments(16), F.col("n")) < 300
    plan = duplicates(rank.dealt(index.table.select("key"), "key", 1000))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(key" in plan


def test_probes_are_told_apart_in_bounded_tasks(spark, monkeypatch):
    """Also if most rows ask for one probe."""
    monkeypatch.setattr(rank, "MOST_ROWS", 100)
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    probes = spaced(spark, 1000, 7).union(spark.range(1000).select(F.lit(14)))
    once = rank._once(probes, "key", 2000)
    assert once.count() == 1000 and most(once) < 300
    found = rank.bounds(spaced(spark, 500, 14), probes)
    assert found.count() == 2000 and found.filter(F.col("bound") != F.least(F.lit(500), F.ceil(F.col("key") / 14))).isEmpty()


def test_segments_of_far_keys(spark):
    """Keys beyond 2 ** 53 keep their last digits, and spans beyond 2 ** 63 do not wrap."""
    keys = [-(1 << 63), -(1 << 63) + 1, (1 << 53) + 1, (1 << 63) - 2, (1 << 63) - 1]
    segments = sorted(OrderedIndex.build(longs(spark, keys)).segments(1).collect())
    assert {k for s in segments for k in (s["key_from"], s["key_to"])} <= set(keys) and sum(s["n"] for s in segments) == 5
    assert all(s["max_error"] <= 1 and s["slope"] >= 0 for s in segments)


def test_outer_keys_may_have_a_wider_bound(spark):
    draw = random.Random(4)
    index = OrderedIndex.build(longs(spark, sorted(draw.sample(range(10**9), 2000))))
    found = index.segments(4, outer=4).collect()
    assert all(s["max_error"] <= (16 if s["first_pos"] < 200 or s["first_pos"] >= 1800 else 4) for s in found)
    assert max(s["max_error"] for s in found) > 4


def test_segment_of_a_key(spark):
    draw = random.Random(8)
    keys = sorted(draw.sample(range(10**6), 500))
    index = OrderedIndex.build(longs(spark, keys))
    probes = spark.createDataFrame([(k, "x") for k in (keys[0] - 1, keys[0], keys[250], keys[250] + 1, 10**7, None)], "key bigint, predicted string")
    found = {r["key"]: r for r in index.located(probes, epsilon=4).collect()}
    segments = sorted(index.segments(4).collect())
    assert found[None]["segment_pos"] is None and found[keys[0] - 1]["segment_pos"] is None and len(found) == 6
    assert abs(found[keys[250]]["predicted"] - 250) <= found[keys[250]]["max_error"]
    assert found[10**7]["segment_pos"] == segments[-1]["first_pos"]
    best = index.densest_segments(3, 4).collect()
    density = lambda s: s["n"] / max(1, s["key_to"] - s["key_from"])
    assert [r["first_pos"] for r in best] == [s["first_pos"] for s in sorted(segments, key=lambda s: (-density(s), s["first_pos"]))[:3]]


def test_epsilon_grows_until_the_model_fits(spark):
    draw = random.Random(9)
    index = OrderedIndex.build(longs(spark, draw.sample(range(10**9), 3000)))
    epsilon = tuned_epsilon(index, 2000)
    assert index.segments(epsilon).count() * SEGMENT_BYTES <= 2000 < index.segments(epsilon // 2).count() * SEGMENT_BYTES
    assert tuned_epsilon(index) == 8


def test_one_shuffle_for_ranks(spark):
    """Ranks deal their rows once, and bounds with many equal probes are those of single ones."""
    index = OrderedIndex.build(spaced(spark, 50))
    probes = spark.createDataFrame([(500, i, 9) for i in range(300)] + [(None, 0, 9), (-1, 1, 9), (10**9, 2, 9)], "key bigint, n bigint, bound int")
    found = index.lower_bounds(probes)
    assert found.columns == ["key", "n", "bound"] and found.count() == 303
    assert {(r["key"], r["bound"]) for r in found.collect()} == {(500, index.lower_bound(500)), (None, None), (-1, 0), (10**9, 50)}


def test_a_column_named_like_the_result_is_replaced(spark):
    rows = spark.createDataFrame([(1, "x"), (5, "y"), (None, "z")], "key bigint, id string")
    keys = longs(spark, [1, 2])
    found = StaticIndex.build(keys).lookup(rows)
    assert found.columns == ["key", "id"] and {r["key"]: r["id"] for r in found.collect()} == {1: 0, 5: None, None: None}
    assert StaticIndex.build(keys).contains(rows, name="id").columns == ["key", "id"]
    assert OrderedIndex.build(keys).index(rows, name="id").columns == ["key", "id"]
    assert HashedIndex.build(keys.withColumn("pos", F.lit(1))).lookup(rows, name="id").columns == ["key", "id"]
    with pytest.raises(ValueError):
        StaticIndex.build(keys).lookup(rows, name="key")


def test_ordered_saved_and_opened(spark, tmp_path):
    OrderedIndex.build(longs(spark, [unsigned(1 << 63), 4]), unsigned=True).save(f"{tmp_path}/o")
    index = OrderedIndex.open(spark, f"{tmp_path}/o")
    assert index.unsigned and index.lower_bound(1 << 63) == 1
    assert "PushedFilters: [IsNotNull(ord), GreaterThanOrEqual" in index.range(0, 5)._jdf.queryExecution().toString()


def test_hashed_position_is_the_one_given(spark):
    keys = spark.range(1000).select(F.concat(F.lit("key-"), "id").alias("key"), F.col("id").alias("pos"))
    index = HashedIndex.build(keys)
    probes = keys.select("key").union(spark.createDataFrame([("missing-key",)], "key string"))
    got = {r["key"]: r["pos"] for r in index.lookup(probes).collect()}
    assert got.pop("missing-key") is None and got == {f"key-{i}": i for i in range(1000)}
    by_hash = index.lookup_hashes(keys.select(F.xxhash64("key").alias("h"), F.col("pos").alias("was")))
    assert by_hash.filter("pos <> was or pos is null").count() == 0


def test_hashed_foreign_keys_never_hit(spark):
    keys = spark.range(2000).select((F.col("id") * 17 + 3).alias("key"), F.col("id").alias("pos"))
    foreign = spark.range(100).select((F.col("id") + 999_999_999).alias("key"))
    assert HashedIndex.build(keys).lookup(foreign).filter("pos is not null").count() == 0


def test_hashed_segments_sum_to_totals(spark, tmp_path):
    index = HashedIndex.build(spark.range(20_000).select((F.col("id") * 13).alias("key"), F.col("id").alias("pos")))
    stats = index.storage_stats(9).collect()
    assert sum(r["keys"] for r in stats) == 20_000
    assert sum(r["segments"] for r in stats) == index.segments(9).count()
    h = index.table.orderBy("h").limit(10).agg(F.min("h"), F.max("h")).first()
    assert index.hash_range(h[0], h[1]).count() == 10
    index.save(f"{tmp_path}/h")
    assert len(HashedIndex.open(spark, f"{tmp_path}/h")) == 20_000
    with pytest.raises(DuplicateKeyError):
        HashedIndex.build(spark.createDataFrame([(1, 0), (1, 1)], "key bigint, pos bigint"))


@pytest.mark.parametrize("keys", [range(1000), [i * 1_000_003 for i in range(1000)], [i << 50 for i in range(256)], [-(1 << 63), -1, 0, (1 << 63) - 1], [7]])
def test_elias_fano_block_round_trip(keys):
    keys = np.array(list(keys), dtype=np.int64)
    assert (codec.decode_block(codec.encode_block(keys)) == keys).all()


def test_elias_fano_over_blocks(spark):
    index = OrderedIndex.build(spark.range(10, 200).select(F.col("id").alias("key")))
    packed = codec.EliasFano.encode(index.table, 64)
    assert [r["key"] for r in packed.slice(5, 8).orderBy("pos").collect()] == list(range(15, 23))
    assert packed.get(189).first()["key"] == 199 and packed.get(190).count() == 0
    assert packed.slice(180, 100).count() == 10 and packed.slice(500, 5).count() == 0
    assert packed.decoded().orderBy("pos").collect() == index.table.select("pos", "key").orderBy("pos").collect()
    assert packed.sizes().first()["bytes"] < 8 * 190


def test_hashes_must_differ(spark, monkeypatch):
    from keystrata.operators import hashed

    monkeypatch.setattr(hashed, "hashed", lambda key, *_: F.lit(7).cast("bigint") + 0 * F.length(key.cast("string")))
    with pytest.raises(HashCollisionError):
        HashedIndex.build(spark.range(2).select(F.col("id").alias("key"), F.col("id").alias("pos")))


def test_bloom_semi_is_exact(spark):
    keys, probes = longs(spark, range(0, 3000, 3)), longs(spark, [*range(3000), None, 3])
    got = sorted(r["key"] for r in codec.bloom_semi(probes, keys).collect())
    assert got == sorted([*range(0, 3000, 3), 3])
    assert codec.bloom_semi(probes, longs(spark, [])).count() == 0


def test_bloom_of_many_keys(spark, tmp_path):
    """Built at any size; no key is missed and few others pass, whatever integer type probes have."""
    keys = spark.range(100_000).select((F.col("id") * 7919).alias("key"))
    own = codec.Bloom.build(keys)
    own.save(f"file://{tmp_path}/b")
    own = codec.Bloom.open(spark, f"file://{tmp_path}/b")
    assert own.contains(keys).filter("not maybe").count() == 0
    foreign = spark.range(100_000).select((F.col("id") * 7919 + 1).alias("key"))
    assert own.contains(foreign).filter("maybe").count() < 2000
    small = spark.createDataFrame([(7919, "x"), (None, "y")], "key int, maybe string")
    assert {r["key"]: r["maybe"] for r in own.contains(small).collect()} == {7919: True, None: False}
    assert own.memory_usage() == 64 * own.n_blocks and own.export().filter("size(words) <> 8").count() == 0


def test_compact_keys_saved_and_opened(spark, tmp_path):
    index = OrderedIndex.build(spark.range(0, 50_000, 7).select(F.col("id").alias("key")))
    packed, report = codec.compact_keys(index.table, 1000)
    report = report.first()
    assert report["keys"] == len(index) and report["saved"] == 8 * len(index) - report["bytes"] > 0
    packed.save(f"file://{tmp_path}/e")
    again = codec.EliasFano.open(spark, f"file://{tmp_path}/e")
    assert again.slice(1995, 10).orderBy("pos").collect() == index.slice(1995, 10).collect()


def test_sorted_pairs(spark):
    pairs = [(i * 40503 % 101, i) for i in range(500)]
    got = [tuple(r) for r in codec.sorted_pairs(spark.createDataFrame(pairs, "key bigint, payload int")).collect()]
    assert got == sorted(pairs)
