"""N-gram Jaccard join: exact metric-space join of shingle sets.

Documents become sets of hashed word n-grams; equal sets are one *class*.  Jaccard
distance obeys the triangle inequality, on which the join rests.  ``r`` is the
distance of the threshold.

1. Seeds.  A linked pair shares one of the rarest shingles of both (prefix filter:
   the ``n - ceil(t n) + 1`` rarest of each set, in one order of all shingles), and its
   sizes differ by the factor 1 / t at most, which is the triangle inequality with
   the set of all shingles as pivot.  So a region is a shingle and a band of sizes; a
   class is native to its own band and visits the next.  Without seeds pivots would part
   nothing, as unrelated documents all lie at distance 1.  The order of shingles uses
   a sketch of document frequencies of fixed size that counts every document; any
   order gives the exact result, this one keeps common passages out of the seeds.
   Regions of the same members are one region, and members that bitmaps part from all
   others by more than r leave it.
2. Every region elects pivots by salted hash, one for each ``SMALL`` classes up to
   ``PIVOTS``, whose distances up to 3 r make Voronoi cells.  A class within r of a pivot is linked
   to it.  A class is native to the cell of its nearest pivot if that is within 2 r, else
   to the void; it visits each cell whose pivot is at most 2 r farther than its nearest,
   and the void if its nearest is farther than r.  (If d(x, y) <= r and y is native to p's
   cell, then d(x, p) <= d(x, nearest) + 2 r and d(x, p) <= 3 r; if y is native to the
   void, x has no pivot within r.)  Cells of the same pivot are one region; pivots leave
   their cells, as all their links are known.
3. Cells and voids of more than ``WIDE`` classes are regions of the next round, with new
   pivots, as long as rounds shrink them by a quarter; there is no limit to the rounds.  A region whose classes are already in one component is done.
4. All others are sorted by the distance from their pivot and joined inside tasks: a
   region as a whole, or, beyond ``BLOCK`` classes, as pairs of blocks whose windows of
   distances lie within r of each other and which are not wholly in one component.
   Pairs are compared where both lie: by component, size, window and bitmap, and what
   is left by sets.  A pair becomes a row only if it is a link that joins two components,
   so rows do not grow with the square of a group.

A bitmap has the parity of a set's shingles at each of ``BITS`` places: two bitmaps
differ in at most as many bits as the sets have shingles not in common, which
bounds their distance from below.

Linked pairs are joined to components by label propagation with pointer jumping.
Nothing about documents reaches the driver but counts, the sketch (1 MB) and a
bit filter (2 MB at most).  Intermediate tables lie in the shared folder.
"""

from __future__ import annotations

import functools
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freeing, kept_for_a_task, pieces_of, small, small_batches, stored

SKETCH, CHUNKS = 1 << 20, 16
SMALL, PIVOTS, WIDE = 24, 4, 2048
#: Classes and bytes of sets in a block at most, but one class at least.
BLOCK, BLOCK_BYTES = 256, 1 << 22
BITS = 2048
#: Bits of the filter of needed classes for each of them, as long as it has 2 MB at most.
FILTER_BITS = 64
#: Classes that a task remembers so as not to send the same one again.
SEEN = 200_000
#: Distinct words whose hashes a worker keeps.
WORDS = 150_000
BLOCKS = "a binary, b binary, region long, block long, low double, high double, label binary, native boolean, rows binary"
CLASSES = "kind int, key long, n long, class binary, bits binary, chunk int, counts binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(xxhash.xxh3_64_digest(word), "big", signed=True)
        return value


_hashes = _Hashes()
kept_for_a_task(_hashes.clear)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word n-grams; of the whole word sequence if it is shorter.

    Words part at the six ASCII white-space characters and A-Z become a-z, which
    is what bytes.split and bytes.lower do.
    """
    if len(_hashes) > WORDS:
        _hashes.clear()
    words = [x.encode().lower().split() if x else [] for x in texts]
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words))).view(np.uint64)
    out, at = [], 0
    for w in words:
        n, size = max(1, len(w) - width + 1), min(width, len(w))
        own, at = h[at : at + len(w)], at + len(w)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        mix = np.full(n, size, np.uint64)
        for k in range(size):
            mix = (mix ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
            mix *= np.uint64(0xBF58476D1CE4E5B9)
            mix ^= mix >> np.uint64(32)
        out.append(np.unique(mix))
    return out


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the shingles at each of BITS places."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any set as similar as ``percent``, at least."""
    return -(-percent * n // 100)


class Join:
    """The join of one table: keys, classes and their components."""

    def __init__(self, docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text"):
        self.spark: SparkSession = docs.sparkSession
        small_batches(self.spark)
        self.width, self.percent, self.reach = width, percent, 1 - percent / 100
        self.docs = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def components(self) -> DataFrame:
        """key, n_shingles, class, component_id (the smallest key that links reach, its own included) and label.

        One row for each row of the table.  Null and wordless texts have no
        shingle and no link.  Rows of the same key are rows of their own; null
        keys count as larger than any.  The label, the smallest class of the
        component, tells components apart where keys are null or repeated; it
        is null without words.
        """
        rows, regions = self._seeded()
        labels = self._linked(regions)
        least = rows.filter("n > 0").groupBy("class").agg(F.min("key").alias("least"))
        named = least.join(labels, "class").groupBy("label").agg(F.min("least").alias("least"))
        named = labels.join(named, "label").select("class", "label", F.col("least").alias("joined"))
        least = least.join(named, "class", "left").select("class", F.coalesce("joined", "least").alias("component_id"), F.coalesce("label", "class").alias("label"))
        out = rows.join(least, "class", "left")
        return out.select("key", F.col("n").alias("n_shingles"), "class", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"), "label")

    def links(self) -> DataFrame:
        """(a, b), a < b: every two classes that are linked, without the short cuts that components allow.

        Rows of one class are linked too, which needs no pair.
        """
        return self._linked(self._seeded()[1], every=True)

    def _seeded(self) -> tuple[DataFrame, DataFrame]:
        """The rows (key, n, class) and the regions of the first round."""
        first = stored(self.docs.mapInArrow(freeing(_first(self.width)), CLASSES), "jaccard-classes")
        rows = first.filter("kind = 0").select("key", "n", "class")
        order = self.spark.sparkContext.broadcast(_order(first.filter("kind = 1").select("chunk", "counts")))
        seeds = self.docs.mapInArrow(freeing(_prefixes(self.width, self.percent, order)), "token long, class binary, n long")
        seeds = seeds.repartition(F.col("token")).groupBy("token", "class").agg(F.first("n").alias("n"))
        # slightly wider bands than the factor 1 / t, so that rounding never parts a pair by two
        band = F.floor(F.log("n") / F.lit(-math.log(self.percent / 100) * (1 + 1e-9)))
        seeds = seeds.withColumn("native", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", band + F.when(F.col("native"), 0).otherwise(1))
        here = Window.partitionBy("token", "band")
        same = [F.bit_xor(F.xxhash64(F.lit(j), "class", "native")).over(here).alias(f"same{j}") for j in range(2)]
        seeds = seeds.select("*", F.count("*").over(here).alias("size"), F.max("native").over(here).alias("any"), *same).filter("size > 1 and any")
        seeds = stored(seeds.select(F.xxhash64("token", "band").alias("region"), "class", "n", "native", "size", "same0", "same1"), "jaccard-seeds")
        order.destroy()
        one = seeds.groupBy("same0", "same1", "size").agg(F.min("region").alias("region")).select("region")
        regions = stored(seeds.drop("same0", "same1").join(one, "region", "left_semi"), "jaccard-regions")
        bits = first.filter("bits is not null").select("class", "bits", "n").join(regions.select("class").distinct(), "class", "left_semi")
        self.bits = stored(bits.groupBy("class").agg(F.first("bits").alias("bits"), F.first("n").alias("n")), "jaccard-bits")
        return rows, regions

    def _linked(self, regions: DataFrame, every: bool = False) -> DataFrame:
        """(class, label) of all classes with a link to another, or with ``every`` all links (a, b)."""
        regions = self._near(regions)
        sets = self._sets(stored(regions.select("class").distinct(), "jaccard-needed"))
        links, leaves, round_, before = None, [], 0, regions.count()
        while True:
            wide = stored(self._elected(regions, round_), "jaccard-pivots")
            pairs = wide.filter("class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
            pivots = stored(wide.select(F.col("pivot").alias("class")).distinct(), "jaccard-elected")
            known = stored(self._distances(self._close(pairs, pivots), sets, pivots), "jaccard-distances")
            new = known.filter("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            links = new if links is None else links.unionByName(new)
            labels = None if every else components(links)
            parts = self._open(self._cells(wide, known), labels)
            leaves.append(parts.filter(f"size <= {WIDE}"))
            regions = parts.filter(f"size > {WIDE}")
            left = regions.count()
            if not left:
                break
            if 4 * left > 3 * before:
                leaves.append(regions)
                break
            round_, before = round_ + 1, left
        if len(leaves) > 1:  # a cell can come out of several rounds
            leaves = functools.reduce(DataFrame.unionByName, leaves).groupBy("region", "class").agg(F.first("n").alias("n"), F.max("native").alias("native"), F.first("d").alias("d"))
            leaves = [self._open(leaves, labels)]
        inner = stored(self._inside(leaves[0], labels, sets).distinct(), "jaccard-links")
        if every:
            return links.unionByName(inner).distinct()
        return labels if inner.isEmpty() else components(links.unionByName(inner))

    def _near(self, regions: DataFrame) -> DataFrame:
        """The regions without the members that bitmaps part from all others; those beyond WIDE classes as they are."""
        found = self._inside(regions.filter(f"size <= {WIDE}").withColumn("d", F.lit(0.0)), None).distinct()
        held = regions.join(found, ["region", "class"], "left_semi").unionByName(regions.filter(f"size > {WIDE}"))
        return stored(held.select("region", "class", "n", "native"), "jaccard-near")

    @staticmethod
    def _elected(regions: DataFrame, round_: int) -> DataFrame:
        """Each class of each region with each of the region's pivots."""
        chosen = [F.min_by("class", F.xxhash64(F.lit(round_ * PIVOTS + j), "class")).alias(f"p{j}") for j in range(PIVOTS)]
        pivots = regions.groupBy("region").agg(F.count("*").alias("size"), *chosen)
        some = F.slice(F.array(*[f"p{j}" for j in range(PIVOTS)]), F.lit(1), F.least(F.lit(PIVOTS), F.ceil(F.col("size") / SMALL)).cast("int"))
        pivots = pivots.select("region", F.array_distinct(some).alias("pivots"))
        return regions.join(pivots, "region").select("region", "class", "n", "native", F.explode("pivots").alias("pivot"))

    @staticmethod
    def _open(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The regions with a native and with classes of two components at least, and their sizes."""
        own = regions.withColumn("label", F.col("class")) if labels is None else regions.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        own = stored(own, "jaccard-labelled")
        kinds = own.groupBy("region").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("native").alias("any"))
        kinds = kinds.filter("low <> high and any").select("region", "size")
        return stored(own.join(kinds, "region").select("region", "class", "n", "native", "d", "size"), "jaccard-regions")

    def _inside(self, leaves: DataFrame, labels: DataFrame | None, sets: DataFrame | None = None) -> DataFrame:
        """The links (a, b) inside regions that are split no further; without ``sets`` the members (region, class) that bitmaps leave near another."""
        own = leaves.withColumn("label", F.col("class")) if labels is None else leaves.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        data = self.bits.select("class", F.col("bits").alias("data")) if sets is None else sets.select("class", F.col("shingles").alias("data"))
        rows = own.join(data, "class").select("region", "size", "class", "n", "native", "d", "label", "data")
        rows = rows.repartitionByRange(parts, "region", "d", "class").sortWithinPartitions("region", "d", "class")
        how, out = (self.percent, labels is None, sets is not None), "a binary, b binary, region long"
        found = stored(rows.mapInArrow(freeing(_cut(*how, BLOCK, BLOCK_BYTES)), BLOCKS), "jaccard-blocks")
        links, blocks = found.filter("block is null").select("a", "b", "region"), found.filter("block is not null")
        x, y = (blocks.select("region", *[F.col(c).alias(f"{c}_{i}") for c in ("block", "low", "high", "label", "native")]) for i in "xy")
        reach = F.lit(self.reach + 1e-9)
        met = x.join(y, "region").filter("block_x <= block_y and (native_x or native_y) and not (label_x <=> label_y and label_x is not null)")
        # the screen has looked inside each block already
        met = met if sets is not None else met.filter("block_x < block_y")
        met = met.filter((F.col("low_y") - F.col("high_x") <= reach) & (F.col("low_x") - F.col("high_y") <= reach))
        met = met.select("region", "block_x", "block_y")
        for i in "xy":
            met = met.join(blocks.select(F.col("block").alias(f"block_{i}"), F.col("rows").alias(f"rows_{i}")), f"block_{i}")
        met = met.repartition(F.col("block_x"), F.col("block_y")).select("region", "block_x", "block_y", "rows_x", "rows_y")
        links = links.unionByName(met.mapInArrow(freeing(_meet(*how)), out))
        return links.select("a", "b") if sets is not None else links.select("region", F.col("a").alias("class"))

    def _close(self, pairs: DataFrame, pivots: DataFrame) -> DataFrame:
        """The pairs (a class, b pivot) that bitmaps cannot part by 3 r."""
        one = self.bits.select(F.col("class").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m"))
        two = self.bits.join(small(pivots), "class", "left_semi").select(F.col("class").alias("b"), F.col("bits").alias("y"), F.col("n"))
        held = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "m", "n")
        return held.mapInArrow(freeing(_apart(3 * self.reach)), "a binary, b binary")

    def _sets(self, needed: DataFrame) -> DataFrame:
        """(class, shingles) of all needed classes: texts pass a bit filter, then an exact semi-join.

        What the filter lets pass is shuffled with its shingles where the semi-join is no
        broadcast, so it has ``FILTER_BITS`` bits a class: one set in 64 passes in vain.
        """
        bits = 1 << min(24, max(16, math.ceil(math.log2(FILTER_BITS * needed.count() + 1))))
        at = F.conv(F.hex(F.substring("class", 1, 3)), 16, 10).cast("int") % bits
        words = needed.select(at.alias("at")).groupBy(F.expr("at div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, at % 32))").alias("set")).collect()
        mask = np.zeros(bits // 32, np.uint32)
        for r in words:
            mask[r["word"]] = r["set"]
        held = self.docs.mapInArrow(freeing(_classes(self.width, mask)), "class binary, shingles binary")
        return stored(held.join(small(needed), "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles")), "jaccard-sets")

    def _distances(self, pairs: DataFrame, sets: DataFrame, pivots: DataFrame) -> DataFrame:
        """a, b (a pivot), d (Jaccard distance) and whether they are linked, decided in whole numbers."""
        one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
        two = sets.join(small(pivots), "class", "left_semi").select(F.col("class").alias("b"), F.col("shingles").alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(freeing(_compare(self.percent)), "a binary, b binary, d double, linked boolean")

    def _cells(self, wide: DataFrame, known: DataFrame) -> DataFrame:
        """The Voronoi cells and the voids of all regions, with their visitors and without pivots."""
        both = known.select(F.col("a").alias("class"), F.col("b").alias("pivot"), "d")
        far = wide.join(both, ["class", "pivot"], "left").withColumn("d", F.when(F.col("class") == F.col("pivot"), 0.0).otherwise(F.col("d")))
        far = far.withColumn("near", F.min(F.when(F.col("d").isNotNull(), F.struct("d", "pivot"))).over(Window.partitionBy("region", "class")))
        far = far.withColumn("inside", F.coalesce(F.col("near.d") <= 2 * self.reach - 1e-9, F.lit(False)))
        at_home = F.col("native") & F.col("inside") & (F.col("pivot") == F.col("near.pivot"))
        cells = far.filter(F.col("d") <= F.col("near.d") + 2 * self.reach + 1e-9).filter("class <> pivot")
        cells = cells.select(F.xxhash64(F.lit("cell"), "pivot").alias("region"), "class", "n", at_home.alias("native"), "d")
        void = far.filter(F.coalesce(F.col("near.d") > self.reach - 1e-9, F.lit(True)))
        void = void.groupBy("region", "class").agg(F.first("n").alias("n"), F.first(F.col("native") & ~F.col("inside")).alias("native"), F.xxhash64(F.lit("void"), F.array_sort(F.collect_list("pivot"))).alias("void"))
        void = void.select(F.col("void").alias("region"), "class", "n", "native", F.lit(0.0).alias("d"))
        # regions with the same pivot share its cell, and those with the same pivots their void
        both = cells.unionByName(void).groupBy("region", "class")
        return both.agg(F.first("n").alias("n"), F.max("native").alias("native"), F.first("d").alias("d"))


def components(links: DataFrame) -> DataFrame:
    """(class, label) of all classes in links (a, b): label is the smallest class of the component."""
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "jaccard-graph")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "class"), "jaccard-labels")
    while True:
        near = both.join(labels, both["b"] == labels["class"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["class"] == near["a"]).select("class", F.least("label", "near").alias("next"), "label")
        over = labels.select(F.col("class").alias("next"), F.col("label").alias("jump"))
        step = step.join(over, "next", "left").select("class", F.least("next", "jump").alias("next"), "label")
        step = stored(step, "jaccard-labels")
        done = step.filter("next <> label").isEmpty()
        labels = step.select("class", F.col("next").alias("label"))
        if done:
            return labels


def with_class(docs: DataFrame, width: int, text: str = "text", name: str = "class") -> DataFrame:
    """``docs`` with the class of each text (null without words)."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch):
                found = pa.array([_class(s) for s in shingle_sets(part.column(at).to_pylist(), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, name])

    return docs.mapInArrow(freeing(run), T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def one_of_each(docs: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: of the smallest key (null last), the smallest class and the least row.

    Components are told apart by their labels, as keys may be null or repeated.
    Texts without words have no link, so all their rows stay.
    """
    groups = Join(docs, width, percent, key, text).components().filter("class is not null")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "class")).alias("first")
    kept = stored(groups.groupBy("label").agg(first).select(F.col("first.class").alias("__kept"), F.col("first.key").alias("__id")), "jaccard-kept")
    df = with_class(docs, width, text, "__class")
    held = df.join(kept, (df["__class"] == kept["__kept"]) & df[key].eqNullSafe(kept["__id"]), "left_semi")
    whole = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")
    held = held.groupBy("__class", F.col(f"`{key}`").alias("__key")).agg(whole).select("__row.*")
    return held.unionByName(df.filter("__class is null").drop("__class"))


def _texts(batches):
    for batch in batches:
        for part in pieces_of(batch):
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _class(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _first(width: int):
    """Each row's class and, once for each task, its bitmap; then the task's part of the sketch."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("bits", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts, seen = np.zeros(SKETCH, np.uint32), set()
        for keys, texts in _texts(batches):
            sets = shingle_sets(texts, width)
            classes, bits = [_class(s) for s in sets], []
            for c, s in zip(classes, sets):
                if c is None or c in seen:
                    bits.append(None)
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(c)
                bits.append(bitmap(s))
                counts[s & np.uint64(SKETCH - 1)] += 1
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        small = np.minimum(counts, 65535).astype("<u2").reshape(CHUNKS, -1)
        for i in range(CHUNKS):
            if small[i].any():
                yield pa.RecordBatch.from_pylist([{"kind": 1, "chunk": i, "counts": small[i].tobytes()}], schema=schema)

    return run


def _order(parts: DataFrame) -> np.ndarray:
    """Rank of each sketch counter: the logarithm of its count, in eighths."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, "<u2").astype(np.int64)
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((CHUNKS, SKETCH // CHUNKS), np.int64)
    for r in parts.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(255, 8 * np.log2(out.ravel() + 1)).astype(np.uint8)


def _prefixes(width: int, percent: int, order):
    """The rarest shingles of each class, once for each task and class."""

    def run(batches):
        rank, seen = order.value, set()
        for _, texts in _texts(batches):
            tokens, classes, sizes = [], [], []
            for s in shingle_sets(texts, width):
                c = _class(s)
                if c is None or c in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(c)
                n = len(s) - least_common(len(s), percent) + 1
                where = np.lexsort((s, rank[s & np.uint64(SKETCH - 1)]))[:n]
                tokens.append(s[where].view(np.int64))
                classes += [c] * n
                sizes.append(np.full(n, len(s)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(classes, pa.binary()), pa.array(np.concatenate(sizes))], names=["token", "class", "n"])

    return run


def _classes(width: int, mask: np.ndarray):
    """Classes that the bit filter lets pass, with their shingles, once for each task."""

    def run(batches):
        bits, seen = len(mask) * 32, set()
        for _, texts in _texts(batches):
            out = {}
            for s in shingle_sets(texts, width):
                c = _class(s)
                if c is None or c in seen:
                    continue
                at = int.from_bytes(c[:3], "big") % bits
                if mask[at >> 5] >> np.uint32(at & 31) & np.uint32(1):
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(c)
                    out[c] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["class", "shingles"])

    return run


def _apart(most: float):
    """The pairs whose bitmaps allow a distance up to ``most``: h different bits mean a distance of 2 h / (m + n + h) at least."""

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 4096):
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint64).reshape(part.num_rows, -1) for i in (2, 3))
                h = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
                m, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                held = pa.array(np.flatnonzero(2 * h <= (most + 1e-9) * (m + n + h)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(held), part.column(1).take(held)], names=["a", "b"])

    return run


def _common(p: np.ndarray, q: np.ndarray) -> int:
    return len(np.intersect1d(p, q, assume_unique=True))


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch):
                d, linked = [], []
                for x, y in zip(part.column(2), part.column(3)):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = _common(p, q)
                    union = len(p) + len(q) - both
                    d.append(1 - both / union)
                    linked.append(100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])

    return run


class Block:
    """Members of a region in memory, with their bitmaps and perhaps their sets."""

    def __init__(self, rows: list[dict], with_sets: bool):
        self.classes, self.labels = [r["class"] for r in rows], [r["label"] for r in rows]
        self.n, self.d, self.native = (np.array([r[c] for r in rows]) for c in ("n", "d", "native"))
        self.sets = [np.frombuffer(r["data"], np.uint64) for r in rows] if with_sets else None
        bits = map(bitmap, self.sets) if with_sets else [r["data"] for r in rows]
        self.bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(rows), -1)


def near_pairs(x: Block, y: Block, percent: int, p: np.ndarray | None, q: np.ndarray | None, rows: int = 32):
    """Pairs of places (of a native of one block and any member of the other, or of the same one) that sizes, windows and bitmaps do not part.

    Members with equal ``p`` and ``q`` are left out; some rows of x at a time.
    """
    reach = 1 - percent / 100 + 1e-9
    for at in range(0, len(x.classes), rows):
        i = slice(at, at + rows)
        met = (x.native[i, None] | y.native) & (np.abs(x.d[i, None] - y.d) <= reach)
        met &= 100 * np.minimum(x.n[i, None], y.n) >= percent * np.maximum(x.n[i, None], y.n)
        if x is y:
            met &= np.arange(len(y.classes)) > np.arange(at, at + len(met))[:, None]
        if p is not None:
            met &= p[i, None] != q
        a, b = np.nonzero(met)
        a += at
        h = np.bitwise_count(x.bits[a] ^ y.bits[b]).sum(1).astype(np.int64)
        held = 2 * h <= reach * (x.n[a] + y.n[b] + h)
        yield a[held].tolist(), b[held].tolist()


def near(x: Block, y: Block, percent: int) -> list[bytes]:
    """Members with another one near; those marked by a null label are known to have one and are left out."""
    p, q = (np.array([z is None for z in b.labels]) for b in (x, y))
    # places with p and q equal are left out: 1 and 1 where both are marked, never 0 and 2 or 1 and 2 or 0 and 1
    found = set()
    for a, b in near_pairs(x, y, percent, np.where(p, 1, 0), np.where(q, 1, 2)):
        found.update(x.classes[k] for k in a if not p[k])
        found.update(y.classes[k] for k in b if not q[k])
    return list(found)


def joined(x: Block, y: Block, percent: int, every: bool = False) -> list[tuple[bytes, bytes]]:
    """Links (a, b), a < b.

    Pairs already in one component are left out, also those that links found here have joined,
    unless ``every`` asks for all links.
    """
    names: dict[bytes, int] = {}
    p, q = (np.array([names.setdefault(z, len(names)) for z in b.labels]) for b in (x, y))
    out = []
    for a, b in near_pairs(x, y, percent, None if every else p, None if every else q):
        for k, l in zip(a, b):
            if not every and p[k] == q[l]:
                continue
            both = _common(x.sets[k], y.sets[l])
            if 100 * both >= percent * (len(x.sets[k]) + len(y.sets[l]) - both):
                out.append((min(x.classes[k], y.classes[l]), max(x.classes[k], y.classes[l])))
                if not every:
                    new, old = p[k], q[l]
                    p[p == old] = new
                    q[q == old] = new
    return out


_PACKED = pa.schema([("class", pa.binary()), ("n", pa.int64()), ("native", pa.bool_()), ("d", pa.float64()), ("label", pa.binary()), ("data", pa.binary())])
_BLOCKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("region", pa.int64()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("label", pa.binary()), ("native", pa.bool_()), ("rows", pa.binary())])


def _packed(rows: list[dict]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PACKED) as to:
        to.write_batch(pa.RecordBatch.from_pylist(rows, schema=_PACKED))
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes, with_sets: bool) -> Block:
    return Block(pa.ipc.open_stream(rows).read_all().to_pylist(), with_sets)


def _cut(percent: int, every: bool, with_sets: bool, block: int, block_bytes: int):
    """Joins each region that lies in one block; of all others gives blocks, with what their headers say."""

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def over():
            nonlocal number, held, size
            rows, held, size = held, [], 0
            if len(rows) == rows[0]["size"]:
                own, region = Block(rows, with_sets), rows[0]["region"]
                if with_sets:
                    return [{"a": a, "b": b, "region": region} for a, b in joined(own, own, percent, every)]
                return [{"a": c, "region": region} for c in near(own, own, percent)]
            out = []
            if not with_sets:
                own = Block(rows, with_sets)
                known = set(near(own, own, percent))
                out = [{"a": c, "region": rows[0]["region"]} for c in known]
                rows = [r | {"label": None if r["class"] in known else r["class"]} for r in rows]
            number += 1
            one = rows[0]["label"] if len({r["label"] for r in rows}) == 1 else None
            if not with_sets:
                one = b"" if all(r["label"] is None for r in rows) else None
            return out + [{"region": rows[0]["region"], "block": (part << 32) + number, "low": rows[0]["d"], "high": rows[-1]["d"], "label": one, "native": any(r["native"] for r in rows), "rows": _packed(rows)}]

        for batch in batches:
            for piece in pieces_of(batch):
                out = []
                for r in piece.to_pylist():
                    if held and (r["region"] != held[0]["region"] or len(held) == block or size > block_bytes):
                        out += over()
                    held.append(r)
                    size += len(r["data"])
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)
        if held and (out := over()):
            yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)

    return run


def _meet(percent: int, every: bool, with_sets: bool):
    """Joins pairs of blocks."""

    def run(batches):
        for batch in batches:
            for piece in pieces_of(batch, 1):
                r = piece.to_pylist()[0]
                x = _unpacked(r["rows_x"], with_sets)
                y = x if r["block_x"] == r["block_y"] else _unpacked(r["rows_y"], with_sets)
                found = joined(x, y, percent, every) if with_sets else [(c, None) for c in near(x, y, percent)]
                yield pa.RecordBatch.from_arrays([*(pa.array([z[k] for z in found], pa.binary()) for k in range(2)), pa.array([r["region"]] * len(found), pa.int64())], names=["a", "b", "region"])

    return run
