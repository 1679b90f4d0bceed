"""Queries of the index operators over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import register
from .functions.keys import duplicates, flipped, unsigned_decimal, wide_from_hex
from .operators import codec, hot
from .operators.hashed import HashedIndex
from .operators.mutable import MutableIndex
from .operators.ordered import OrderedIndex
from .operators.static import IndexConfig, StaticIndex
from .plans.rank import distinct_keys, ranked, scratch
from .streaming.mutable_stream import MutableStream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> StaticIndex:
    return StaticIndex.build(table(spark, sf_dir, "customer"), "c_custkey")


def orders(spark: SparkSession, sf_dir: str) -> OrderedIndex:
    return OrderedIndex.build(table(spark, sf_dir, "orders"), "o_orderkey")


@register("SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT o_custkey AS key FROM orders)")
def static_build_int(spark, sf_dir):
    return StaticIndex.build(table(spark, sf_dir, "orders").select("o_custkey").distinct(), "o_custkey").table


@register("SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS id FROM customer")
def static_build_str(spark, sf_dir):
    return StaticIndex.build(table(spark, sf_dir, "customer"), "c_name").table


_IDS = "WITH i AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer) "


@register(_IDS + "SELECT o_orderkey, o_custkey, id FROM orders LEFT JOIN i ON o_custkey = key")
def static_lookup(spark, sf_dir):
    return customers(spark, sf_dir).lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@register(_IDS + "SELECT o_orderkey, o_orderkey * 3 AS probe, id FROM orders LEFT JOIN i ON o_orderkey * 3 = key")
def static_lookup_mixed(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 3).alias("probe"))
    return customers(spark, sf_dir).lookup(probes, "probe")


@register("SELECT o_orderkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_orderkey) AS found FROM orders")
def static_contains(spark, sf_dir):
    return customers(spark, sf_dir).contains(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def _buyers(spark, sf_dir) -> StaticIndex:
    return StaticIndex.build(table(spark, sf_dir, "orders").select("o_custkey").distinct(), "o_custkey")


@register("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def static_semi(spark, sf_dir):
    return _buyers(spark, sf_dir).semi(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@register("SELECT c_custkey * 3 AS probe, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey * 3)")
def static_anti(spark, sf_dir):
    return _buyers(spark, sf_dir).anti(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("probe"), "c_name"), "probe")


@register(
    "WITH i AS (SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS id FROM customer) "
    "SELECT o_orderkey, i.id FROM orders LEFT JOIN i ON key = 'Customer#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"
)
def static_lookup_str(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("probe"))
    index = StaticIndex.configured(table(spark, sf_dir, "customer"), IndexConfig(key="c_name", strict=True))
    return index.lookup(probes, "probe").select("o_orderkey", "id")


@register("SELECT count(*) AS capacity, max(c_custkey) - min(c_custkey) + 1 AS span FROM customer")
def static_capacity(spark, sf_dir):
    index = customers(spark, sf_dir)
    return index.table.agg(F.lit(index.slot_capacity()).cast("bigint").alias("capacity"), (F.max("key") - F.min("key") + 1).alias("span"))


@register("SELECT id FROM (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer) WHERE key = 17")
def static_get(spark, sf_dir):
    return customers(spark, sf_dir).get(17)


@register("SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def static_duplicates(spark, sf_dir):
    return duplicates(table(spark, sf_dir, "documents"), "text").select(F.md5(F.col("text").cast("binary")).alias("digest"), "n")


@register("SELECT 'dictionary' AS engine, count(*) AS total_keys, CAST(sum(strlen(c_name)) AS BIGINT) AS key_bytes FROM customer")
def static_stats(spark, sf_dir):
    return StaticIndex.build(table(spark, sf_dir, "customer"), "c_name").stats()


@register("SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer")
def static_roundtrip(spark, sf_dir):
    path = scratch(spark, "static")
    customers(spark, sf_dir).save(path)
    return StaticIndex.open(spark, path).table


@register("SELECT o_orderkey, CAST(NULL AS BIGINT) AS id FROM orders")
def static_empty(spark, sf_dir):
    return StaticIndex.empty(spark).lookup(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


_POS = "WITH i AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) "


@register(_POS + "SELECT l_orderkey, l_linenumber, pos FROM lineitem LEFT JOIN i ON l_orderkey = key")
def ordered_index(spark, sf_dir):
    return orders(spark, sf_dir).index(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@register(_POS + "SELECT pos, key FROM i WHERE key BETWEEN 500 AND 700")
def ordered_range(spark, sf_dir):
    return orders(spark, sf_dir).range(500, 700)


_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
_TS_RANGE = (1_704_067_200_000_000, 1_704_326_400_000_000)


@register(
    "WITH i AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT DISTINCT epoch_us(ts) AS key FROM events)) "
    f"SELECT pos, key FROM i WHERE key BETWEEN {_TS_RANGE[0]} AND {_TS_RANGE[1]}"
)
def ordered_range_ts(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.expr(_MICROS).cast("bigint").alias("key")).distinct()
    return OrderedIndex.build(keys).range(*_TS_RANGE)


def _probes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 11 - 5).alias("key"))


def _bounds_sql(less: str) -> str:
    return (
        "WITH p AS (SELECT c_custkey, c_custkey * 11 - 5 AS key FROM customer) "
        f"SELECT p.c_custkey, p.key, (SELECT count(*) FROM orders WHERE o_orderkey {less} p.key) AS bound FROM p"
    )


@register(_bounds_sql("<"))
def ordered_lower_bound(spark, sf_dir):
    return orders(spark, sf_dir).lower_bounds(_probes(spark, sf_dir))


@register(_bounds_sql("<="))
def ordered_upper_bound(spark, sf_dir):
    return orders(spark, sf_dir).upper_bounds(_probes(spark, sf_dir))


@register(
    "WITH r AS (SELECT c_custkey, c_custkey * 7 AS low, c_custkey * 7 + 40 AS high FROM customer) "
    "SELECT r.c_custkey, r.low, r.high, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN r.low AND r.high) AS n FROM r"
)
def ordered_range_count(spark, sf_dir):
    ranges = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7).alias("low"), (F.col("c_custkey") * 7 + 40).alias("high"))
    return orders(spark, sf_dir).range_counts(ranges)


@register(
    "SELECT CAST(u AS DECIMAL(20,0)) AS value, row_number() OVER (ORDER BY u) - 1 AS pos FROM "
    "(SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::HUGEINT ELSE 18446744073709551616 - o_orderkey::HUGEINT END AS u FROM orders)"
)
def ordered_unsigned(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("key"))
    return OrderedIndex.build(keys, unsigned=True).table.select(unsigned_decimal(F.col("key")).alias("value"), "pos")


@register("SELECT count(*) AS keys, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders")
def ordered_stats(spark, sf_dir):
    return orders(spark, sf_dir).stats()


def _bumpy(spark, sf_dir) -> OrderedIndex:
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("key"))
    return OrderedIndex.build(distinct_keys(keys))


@register("SELECT count(DISTINCT l_orderkey * 100000 + l_partkey) AS keys, true AS chained, true AS within FROM lineitem")
def ordered_segments(spark, sf_dir):
    """Segments cover all positions, one after the other, and none is more than the bound off."""
    found = _bumpy(spark, sf_dir).segments(64)
    upto = "sum(n) over (order by first_pos) - n"
    checked = found.selectExpr("n", f"first_pos = {upto} as follows", "max_error <= 64 as within")
    return checked.agg(F.sum("n").alias("keys"), F.every("follows").alias("chained"), F.every("within").alias("within"))


@register(
    "WITH k AS (SELECT DISTINCT l_orderkey * 100000 + l_partkey AS key FROM lineitem), i AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM k) "
    "SELECT key, pos, true AS near FROM i"
)
def ordered_segment_lookup(spark, sf_dir):
    """Each key's position beside whether its segment predicts it within that segment's error."""
    index = _bumpy(spark, sf_dir)
    found = index.located(index.table.select("key", "pos"))
    return found.select("key", "pos", (F.abs(F.col("predicted") - F.col("pos")) <= F.col("max_error") + 1e-6).alias("near"))


@register(_POS + "SELECT key, pos FROM i")
def ordered_roundtrip(spark, sf_dir):
    path = scratch(spark, "ordered")
    orders(spark, sf_dir).save(path)
    return OrderedIndex.open(spark, path).table.select("key", "pos")


_WIDE = "WITH k AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE text IS NOT NULL), i AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS pos FROM k) "


def _wide(spark, sf_dir) -> OrderedIndex:
    keys = table(spark, sf_dir, "documents").filter("text is not null").select(F.md5(F.col("text").cast("binary")).alias("key")).distinct()
    return OrderedIndex.from_uuids(keys)


@register(_WIDE + "SELECT doc_id, pos FROM documents LEFT JOIN i ON md5(text) = h")
def wide_index(spark, sf_dir):
    probes = table(spark, sf_dir, "documents").select("doc_id", wide_from_hex(F.md5(F.col("text").cast("binary"))).alias("key"))
    return _wide(spark, sf_dir).index(probes).select("doc_id", "pos")


@register(_WIDE + "SELECT pos, h AS hex FROM i WHERE h BETWEEN '40000000000000000000000000000000' AND 'bfffffffffffffffffffffffffffffff'")
def wide_range(spark, sf_dir):
    found = _wide(spark, sf_dir).range(bytearray.fromhex("40" + "00" * 15), bytearray.fromhex("bf" + "ff" * 15))
    return found.select("pos", F.lower(F.hex("key")).alias("hex"))


@register(
    _WIDE + ", p AS (SELECT c_custkey, md5(c_name) AS g FROM customer) "
    "SELECT p.c_custkey, (SELECT count(*) FROM k WHERE h < p.g) AS bound FROM p"
)
def wide_bounds(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select("c_custkey", wide_from_hex(F.md5(F.col("c_name").cast("binary"))).alias("key"))
    return _wide(spark, sf_dir).lower_bounds(probes).select("c_custkey", "bound")


@register(
    _WIDE + ", p AS (SELECT c_custkey, md5(c_name) AS g FROM customer) "
    "SELECT p.c_custkey, (SELECT count(*) FROM k WHERE h <= p.g) AS bound FROM p"
)
def wide_upper_bounds(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select("c_custkey", wide_from_hex(F.md5(F.col("c_name").cast("binary"))).alias("key"))
    return _wide(spark, sf_dir).upper_bounds(probes).select("c_custkey", "bound")


def _documents(spark, sf_dir, **more) -> HashedIndex:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"), F.col("doc_id").alias("pos"))
    return HashedIndex.build(docs, **more)


@register("SELECT l.doc_id, d.doc_id AS pos FROM labels l LEFT JOIN documents d ON 'doc-' || l.doc_id = 'doc-' || d.doc_id")
def hashed_lookup(spark, sf_dir):
    probes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"))
    return _documents(spark, sf_dir).lookup(probes).select("doc_id", "pos")


@register("SELECT l.doc_id, d.doc_id AS pos FROM labels l LEFT JOIN documents d ON md5('doc-' || l.doc_id) = md5('doc-' || d.doc_id)")
def hashed_lookup_hash(spark, sf_dir):
    probes = table(spark, sf_dir, "labels").select("doc_id", F.xxhash64(F.concat(F.lit("doc-"), F.col("doc_id"))).alias("h"))
    return _documents(spark, sf_dir).lookup_hashes(probes).select("doc_id", "pos")


@register("SELECT l_orderkey, l_linenumber, o_custkey AS pos FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def hashed_lookup_int(spark, sf_dir):
    index = HashedIndex.build(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
    return index.lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


#: The md5 hash of HashedIndex: the first 15 hexadecimal digits as a number.
_MD5 = "WITH d AS (SELECT 'doc-' || doc_id AS key, doc_id AS pos, CAST('0x' || substr(md5('doc-' || doc_id), 1, 15) AS BIGINT) AS h FROM documents) "


@register(_MD5 + f"SELECT h, key, pos FROM d WHERE h BETWEEN 0 AND {(1 << 59) - 1}")
def hashed_range(spark, sf_dir):
    return _documents(spark, sf_dir, hash="md5").hash_range(0, (1 << 59) - 1)


@register(
    _MD5 + ", s AS (SELECT h >> 52 AS segment, count(*) AS n FROM d GROUP BY 1), "
    "k AS (SELECT n, CASE WHEN n <= 4 THEN 'linear' WHEN n <= 6 THEN 'chd' ELSE 'mph' END AS kind FROM s) "
    "SELECT kind, count(*) AS segments, CAST(sum(n) AS BIGINT) AS keys FROM k GROUP BY kind"
)
def hashed_stats(spark, sf_dir):
    return _documents(spark, sf_dir, hash="md5", linear=4, chd=6).storage_stats()


def operations(events: DataFrame) -> DataFrame:
    """Operations on users: signups and purchases insert, errors delete."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "I").when(F.col("event_type") == "error", "D")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op")).filter("op is not null")


def _store(spark, sf_dir, **more) -> MutableIndex:
    return MutableIndex.fold(operations(table(spark, sf_dir, "events")), **more)


_LOG = (
    "WITH o AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type IN ('signup', 'purchase') THEN 'I' WHEN event_type = 'error' THEN 'D' END AS op FROM events), "
    "l AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS prev FROM o WHERE op IS NOT NULL AND key IS NOT NULL), "
    "a AS (SELECT *, op = 'I' AND (prev IS NULL OR prev = 'D') AS alloc FROM l), "
    "g AS (SELECT *, CASE WHEN alloc THEN CAST(sum(CASE WHEN alloc THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) - 1 END AS id FROM a), "
    "s AS (SELECT key, arg_max(op, seq) AS op, max(id) AS id FROM g GROUP BY key) "
)
_STATE = _LOG + "SELECT key, id FROM s WHERE op = 'I'"


@register(_STATE)
def dyn_state(spark, sf_dir):
    return _store(spark, sf_dir).state()


@register(_LOG + "SELECT c_custkey, s.id FROM customer LEFT JOIN s ON c_custkey = s.key AND s.op = 'I'")
def dyn_lookup(spark, sf_dir):
    return _store(spark, sf_dir).lookup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@register(_LOG + "SELECT count(*) FILTER (WHERE op = 'I') AS live, count(*) FILTER (WHERE op = 'D') AS tombstones, coalesce(max(id), -1) + 1 AS ids FROM s")
def dyn_len(spark, sf_dir):
    return _store(spark, sf_dir).stats()


@register(_LOG + "SELECT key FROM s WHERE op = 'D'")
def dyn_tombstones(spark, sf_dir):
    return _store(spark, sf_dir).tombstones()


@register(
    _LOG + "SELECT seq, key, op, CASE WHEN alloc THEN id WHEN prev = 'I' THEN max(id) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS id FROM g"
)
def dyn_results(spark, sf_dir):
    return _store(spark, sf_dir).results()


@register("SELECT tier, count(*) AS entries FROM (SELECT (row_number() OVER (ORDER BY s) - 1) // 16 AS tier FROM (SELECT user_id, min(event_id) AS s FROM events WHERE user_id IS NOT NULL GROUP BY user_id)) GROUP BY tier")
def dyn_tiers(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.lit("I").alias("op"))
    return MutableIndex.fold(log, flush_every=16).tier_stats()


@register(_LOG + "SELECT key, id, CAST(0 AS BIGINT) AS tier FROM s WHERE op = 'I'")
def dyn_compact(spark, sf_dir):
    return _store(spark, sf_dir).compacted()


@register(_LOG + "SELECT CAST(key AS VARCHAR) AS key, id FROM s WHERE op = 'I'")
def dyn_stream(spark, sf_dir):
    """The same state from a file stream, run until it has read all."""
    path = scratch(spark, "stream")
    log = operations(table(spark, sf_dir, "events")).repartitionByRange(4, "seq").sortWithinPartitions("seq")
    log.write.parquet(f"{path}/log")
    store = MutableStream(spark, f"{path}/store")
    source = spark.readStream.schema(log.schema).parquet(f"{path}/log")
    store.start(source, f"{path}/checkpoint").awaitTermination()
    return store.state()


@register(_LOG + "SELECT CAST(key AS VARCHAR) AS key, id, true AS merged FROM s WHERE op = 'I'")
def dyn_stream_compact(spark, sf_dir):
    """State after four batches, a compaction of the first three and one more batch; the merged tiers are one."""
    path = scratch(spark, "stream")
    log = operations(table(spark, sf_dir, "events"))
    quarter = log.select(F.percentile_approx("seq", [0.25, 0.5, 0.75])).first()[0]
    store = MutableStream(spark, path)
    cuts = [(None, quarter[0]), (quarter[0], quarter[1]), (quarter[1], quarter[2]), (quarter[2], None)]
    for i, (low, high) in enumerate(cuts):
        part = log.filter((F.lit(low is None) | (F.col("seq") > (low or 0))) & (F.lit(high is None) | (F.col("seq") <= (high or 0))))
        store.apply(part, i)
        if i == 2:
            store.compact(1)
            store.compact(2)
    merged = {r["batch"] for r in store.tier_stats().collect()} == {2, 3}
    return store.state().withColumn("merged", F.lit(merged))


#: The log with two thirds of all operations on one key, and with operations that share their seq.
_HOT_LOG = _LOG.replace("user_id AS key", "CASE WHEN user_id % 3 = 0 THEN user_id ELSE 1 END AS key")
_TIED_LOG = (
    _LOG.replace("event_id AS seq", "event_id // 4 AS seq, event_id AS e")
    .replace("PARTITION BY key ORDER BY seq", "PARTITION BY key ORDER BY seq, op DESC, e")
    .replace("OVER (ORDER BY seq)", "OVER (ORDER BY seq, key, op DESC, e ROWS UNBOUNDED PRECEDING)")
)


@register(_HOT_LOG + "SELECT seq, key, op, CASE WHEN alloc THEN id WHEN prev = 'I' THEN max(id) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS id FROM g")
def dyn_hot_key(spark, sf_dir):
    log = operations(table(spark, sf_dir, "events")).withColumn("key", F.when(F.col("key") % 3 == 0, F.col("key")).otherwise(1))
    return MutableIndex.fold(log.filter("key is not null"), slice_rows=500).results()


@register(_TIED_LOG + "SELECT seq, key, op, CASE WHEN alloc THEN id WHEN prev = 'I' THEN max(id) OVER (PARTITION BY key ORDER BY seq, op DESC, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS id FROM g")
def dyn_ties(spark, sf_dir):
    log = operations(table(spark, sf_dir, "events")).withColumn("seq", F.expr("seq div 4"))
    return MutableIndex.fold(log, slice_rows=500).results()


@register(
    "WITH k AS (SELECT count(DISTINCT user_id) AS n FROM events) "
    "SELECT n // 16 AS tiers, n % 16 AS buffered, n * 16 AS bytes FROM k"
)
def dyn_buffer(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.lit("I").alias("op"))
    return MutableIndex.fold(log, flush_every=16).buffer_stats()


@register("SELECT user_id AS key, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC, key LIMIT 10")
def hot_topk(spark, sf_dir):
    return hot.top_k(table(spark, sf_dir, "events"), 10, "user_id")


@register("SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, key LIMIT 10")
def hot_topk_parts(spark, sf_dir):
    return hot.top_k(table(spark, sf_dir, "lineitem"), 10, "l_partkey")


@register(
    "WITH e AS (SELECT (row_number() OVER (ORDER BY event_id, user_id) - 1) // 1000 AS epoch, user_id AS key FROM events WHERE user_id IS NOT NULL), "
    "c AS (SELECT epoch, key, count(*) AS n FROM e GROUP BY epoch, key) "
    "SELECT * FROM (SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY n DESC, key) AS INTEGER) AS place, key, n FROM c) WHERE place <= 3"
)
def hot_epochs(spark, sf_dir):
    return hot.epochs(table(spark, sf_dir, "events"), 1000, 3, "event_id", "user_id")


@register(
    "WITH t AS (SELECT user_id AS key, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS id FROM events WHERE user_id IS NOT NULL GROUP BY user_id) "
    "SELECT event_id, user_id, id AS hot_id FROM events LEFT JOIN t ON user_id = key AND id < 20"
)
def hot_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return hot.HotTier.hottest(events, 20, "user_id").lookup(events, "user_id")


@register("SELECT count(DISTINCT user_id) AS tracked, count(user_id) AS observed FROM events")
def hot_total(spark, sf_dir):
    return hot.totals(table(spark, sf_dir, "events"), "user_id")


@register("SELECT event_type AS key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def hot_approx(spark, sf_dir):
    """The sketch counts exactly while keys are fewer than its counters, as event types are."""
    return hot.approx_top_k(table(spark, sf_dir, "events"), 10, 1000, "event_type")


@register(
    "WITH e AS (SELECT user_id AS key, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS id FROM events WHERE user_id IS NOT NULL GROUP BY user_id) "
    "SELECT c_custkey, id AS hot_id, true AS rebuilt FROM customer LEFT JOIN e ON c_custkey = key AND id < 30"
)
def hot_rollover(spark, sf_dir):
    """A first epoch without a tier, whose top keys become the tier of the next."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    rolling = hot.RollingHotTier(None, 500)
    rolling.lookup(events, "user_id")
    due = rolling.should_rebuild()
    best = ranked(rolling.take_top_k(30), [F.desc("n"), F.col("key").asc()], "id")
    rolling.install(hot.HotTier.of(best))
    found = rolling.lookup(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return found.withColumn("rebuilt", F.lit(due))


def _compressed(spark, sf_dir) -> codec.EliasFano:
    return codec.EliasFano.encode(orders(spark, sf_dir).table)


@register(_POS + "SELECT key FROM i WHERE pos = 777")
def ef_get(spark, sf_dir):
    return _compressed(spark, sf_dir).get(777)


@register(_POS + "SELECT pos, key FROM i WHERE pos >= 100 AND pos < 250")
def ef_slice(spark, sf_dir):
    return _compressed(spark, sf_dir).slice(100, 150)


@register(_POS + "SELECT pos, key FROM i")
def ef_decode(spark, sf_dir):
    return _compressed(spark, sf_dir).decoded()


@register(_POS + "SELECT pos, key FROM i")
def ef_roundtrip(spark, sf_dir):
    path = scratch(spark, "elias-fano")
    codec.compact_keys(orders(spark, sf_dir).table, 1000)[0].save(path)
    return codec.EliasFano.open(spark, path).decoded()


@register("SELECT CAST(greatest(max(o_orderkey) + 1, count(*)) AS DECIMAL(20,0)) AS universe FROM orders")
def ef_universe(spark, sf_dir):
    return orders(spark, sf_dir).universe()


@register(_IDS + "SELECT id // 100 AS chunk, list(id ORDER BY id) AS ids, list(key ORDER BY id) AS keys FROM i GROUP BY chunk")
def export_snapshot(spark, sf_dir):
    return customers(spark, sf_dir).export(100)


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def bloom_probe(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return codec.bloom_semi(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), keys, "o_custkey")


@register("SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN false ELSE true END AS maybe FROM orders")
def bloom_members(spark, sf_dir):
    """No key that is in a saved filter is missed."""
    path = scratch(spark, "bloom")
    probes = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    codec.Bloom.build(probes, "o_custkey").save(path)
    return codec.Bloom.open(spark, path).contains(probes, "o_custkey").select("o_orderkey", "maybe")


@register("SELECT l_partkey AS key, l_orderkey * 10 + l_linenumber AS payload FROM lineitem ORDER BY key, payload")
def sort_pairs(spark, sf_dir):
    return codec.sorted_pairs(table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("p")), "l_partkey", "p")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey * -1 < 0")
def unsigned_tail(spark, sf_dir):
    """Keys whose unsigned value, as the bits of the negated key, lies in the upper half."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", flipped(-F.col("o_orderkey")).alias("ord"))
    return keys.filter("ord >= 0").select("o_orderkey")
