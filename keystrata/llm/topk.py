"""Exact top-k search by inner product: pivot-distance index.

Vectors become integers, floor(64 * x).  Every vector is keyed by its nearest
pivot and its distance from it; a range partitioning by that key, sorted, is cut
into annuli: blocks of at most ``BLOCK`` vectors of one pivot, each with its least
and greatest distance and its greatest norm.  Blocks are cut by count, so many
equal vectors or one crowded pivot only make more blocks.

For a query q and an annulus of pivot p, every vector x in it has
``|q - x| >= gap = max(0, d(q,p) - dmax, dmin - d(q,p))`` (triangle inequality),
hence ``q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2 <= (|q|^2 + nmax - gap^2) / 2``.  A
query starts with the k-th best score in its own annulus, visits annuli in the
order of their gaps, and leaves out all whose bound lies below the k-th best
score so far.  Bounds are relaxed by more than rounding can amount to and scores
are whole numbers, so the result is exact.

``GROUP_BLOCKS`` neighbouring blocks are a group, one task's memory.  Queries visit in
two waves.  First those of each block search their own group, where they lie, which gives
a k-th best score to beat.  Then headers alone (of chunks of queries: their range of distances from
each pivot, greatest norm and least score to beat; of blocks: as above) tell which other groups a
chunk must see, and only those chunks travel to them.  The best of all visits are merged by
a ranked window.  Nothing is broadcast but the pivots (``SAMPLE`` vectors at most
are read to choose them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import freeing, stored

SCALE = 64
PIVOTS, SAMPLE = 16, 1024
BLOCK, GROUP_BLOCKS = 2048, 16
#: Squared norms stay below this, so that scores are longs.
NORM_LIMIT = 2.0**62
KEYED = "dim int, pivot int, dist double, row long, vec_id long, query boolean, vec binary"
BLOCKS = "block long, dim int, pivot int, dmin double, dmax double, nmax double, n int, rows binary, ids binary, queries binary, mat binary"
HEAD = "chunk long, home long, dim int, low array<double>, high array<double>, norm double, beat long"
CHUNK = HEAD + ", rows binary, ids binary, least binary, mat binary"
PAIRED = "grp long, kind int, block long, dim int, pivot int, dmin double, dmax double, nmax double, rows binary, ids binary, least binary, mat binary"
FOUND = "row long, query_id long, vec_id long, score long, cand long"
HOME = FOUND + ", " + CHUNK


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where it is exact."""
    most = np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0) * (x.astype(float) ** 2).sum(1).max(initial=0))
    if most < 2.0**23:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2.0**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: beginning with the first vector, each next the one farthest from those chosen."""
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Index:
    """Blocks of annuli, written to the shared folder, and their pivots."""

    def __init__(self, pivots: dict[int, np.ndarray], blocks: DataFrame, group_blocks: int = GROUP_BLOCKS):
        self.pivots, self.blocks, self.group_blocks = pivots, blocks, group_blocks

    @staticmethod
    def distances(pivots: dict[int, np.ndarray], mat: np.ndarray) -> np.ndarray:
        """(vectors, pivots) distances; a dimension without a pivot has the origin as its only one."""
        p = pivots.get(mat.shape[1], np.zeros((1, mat.shape[1])))
        m = mat.astype(float)
        return np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (p * p).sum(1) - 2 * (m @ p.T)))

    @classmethod
    def build(cls, vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", seed: int = 11, block: int = BLOCK, group_blocks: int = GROUP_BLOCKS) -> Index:
        """Indexes all vectors that take part.

        Rows take no part if the key or vector is null, if a component is null
        or not finite, or if the squared norm reaches 2 ** 62.  Vectors are only
        compared with those of their own dimension.
        """
        ok = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
        rows = rows.filter(ok).withColumn("vec", F.transform("vec", lambda x: F.floor(x * SCALE).cast("double")))
        rows = rows.filter(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) < NORM_LIMIT)
        sample: dict[int, list] = {}
        for r in rows.select("vec", F.xxhash64(F.lit(seed), "row").alias("draw")).orderBy("draw").limit(SAMPLE).collect():
            sample.setdefault(len(r["vec"]), []).append(r["vec"])
        pivots = {d: far_apart(np.array(x, dtype=float).reshape(len(x), d), PIVOTS) for d, x in sample.items()}
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keyed = rows.mapInArrow(freeing(cls._keyed(pivots)), KEYED)
        keyed = keyed.repartitionByRange(parts, "dim", "pivot", "dist", "row").sortWithinPartitions("dim", "pivot", "dist", "row")
        return cls(pivots, stored(keyed.mapInArrow(freeing(cls._cut(block)), BLOCKS), "topk-index"), group_blocks)

    @staticmethod
    def _keyed(pivots):
        names = [c.split()[0] for c in KEYED.split(", ")]

        def run(batches):
            for batch in batches:
                row, ids, vec, query = batch.columns
                sizes = np.diff(vec.offsets.to_numpy())
                flat = vec.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                for d in np.unique(sizes):
                    at = np.flatnonzero(sizes == d)
                    mat = flat[starts[at][:, None] + np.arange(d)].astype(np.int64)
                    dist = Index.distances(pivots, mat)
                    near = dist.argmin(1)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), d, np.int32)), pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(at)), near]),
                        row.take(take), ids.take(take), query.take(take), pa.array([m.tobytes() for m in mat], pa.binary()),
                    ], names=names)

        return run

    @staticmethod
    def _cut(most: int):
        """Annuli of a sorted partition: runs of one dimension and pivot, ``most`` rows at most."""

        def block(held: list[dict], number: int):
            first, last = held[0], held[-1]
            mat = np.frombuffer(b"".join(r["vec"] for r in held), np.int64).reshape(len(held), first["dim"])
            out = {
                "block": number, "dim": first["dim"], "pivot": first["pivot"], "dmin": first["dist"], "dmax": last["dist"],
                "nmax": float((mat.astype(float) ** 2).sum(1).max()), "n": len(held), "rows": np.array([r["row"] for r in held], np.int64).tobytes(),
                "ids": np.array([r["vec_id"] for r in held], np.int64).tobytes(), "queries": np.array([r["query"] for r in held], bool).tobytes(), "mat": mat.tobytes(),
            }
            return pa.RecordBatch.from_pylist([out], schema=_arrow(BLOCKS))

        def run(batches):
            number, held = TaskContext.get().partitionId() << 32, []
            for batch in batches:
                for r in batch.to_pylist():
                    if held and ((held[0]["dim"], held[0]["pivot"]) != (r["dim"], r["pivot"]) or len(held) == most):
                        yield block(held, number)
                        number, held = number + 1, []
                    held.append(r)
            if held:
                yield block(held, number)

        return run

    def _grouped(self) -> DataFrame:
        """The blocks with ``grp``: blocks of one group are neighbours of one task that cut them."""
        return self.blocks.withColumn("grp", F.col("block") - F.pmod(F.col("block").bitwiseAND((1 << 32) - 1), F.lit(self.group_blocks)))

    def home(self, k: int) -> DataFrame:
        """The first wave: what each query finds in its own group, and the chunks (column chunk not null) with what they have to beat."""
        own = self._grouped().repartition(F.col("grp")).sortWithinPartitions("grp", "block")
        return stored(own.mapInArrow(freeing(_home(self.pivots, k)), HOME), "topk-home")

    def visits(self, chunks: DataFrame) -> DataFrame:
        """(chunk, grp) of the groups, other than its own, that may hold something better for a chunk."""
        slices = int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        heads = self._grouped().select("grp", "dim", "pivot", "dmin", "dmax", "nmax", F.pmod(F.xxhash64("grp"), F.lit(slices)).cast("int").alias("slice"))
        asked = chunks.select("chunk", "home", "dim", "low", "high", "norm", "beat", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        gap = F.greatest(F.lit(0.0), F.get("low", F.col("pivot")) - F.col("dmax"), F.col("dmin") - F.get("high", F.col("pivot")))
        gap = F.greatest(F.lit(0.0), gap * (1 - 1e-9) - 1e-6 * (1 + F.array_max("high")))
        bound = (F.col("norm") + F.col("nmax") - gap * gap) / 2
        met = asked.join(heads, ["slice", "dim"]).filter(F.col("grp") != F.col("home")).filter(bound + 1e-9 * F.abs(bound) + 1 >= F.col("beat"))
        return met.select("chunk", "grp").distinct()

    def search(self, k: int) -> DataFrame:
        """query_id, rank (from 1), vec_id, score of each query's ``k`` best others, ties to the smaller vec_id.

        Queries with the same key and repeated vectors are rows of their own; a query without another
        vector of its dimension gives no row.
        """
        home = self.home(k)
        chunks = home.filter("chunk is not null")
        none = lambda kind: F.lit(None).cast(kind)
        left = self._grouped().select("grp", F.lit(0).alias("kind"), "block", "dim", "pivot", "dmin", "dmax", "nmax", "rows", "ids", none("binary").alias("least"), "mat")
        right = self.visits(chunks).join(chunks.select("chunk", "dim", "rows", "ids", "least", "mat"), "chunk")
        right = right.select("grp", F.lit(1).alias("kind"), F.col("chunk").alias("block"), "dim", none("int").alias("pivot"), *[none("double").alias(c) for c in ("dmin", "dmax", "nmax")], "rows", "ids", "least", "mat")
        met = left.unionByName(right).repartition(F.col("grp")).sortWithinPartitions("grp", "kind", "block")
        names = [c.split()[0] for c in FOUND.split(", ")]
        found = home.filter("chunk is null").select(*names).unionByName(met.mapInArrow(freeing(_visit(self.pivots, k)), FOUND))
        best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "cand")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _home(pivots, k: int):
    """Each group searched by its own queries."""
    schema = _arrow(HOME)

    def searched(blocks: list[dict]):
        for b in blocks:
            own = np.flatnonzero(np.frombuffer(b["queries"], bool))
            if not len(own):
                continue
            q = {"dim": b["dim"], "rows": b["rows"][own], "ids": b["ids"][own], "mat": b["mat"][own], "least": np.full(len(own), np.iinfo(np.int64).min)}
            found = _best(q, [x for x in blocks if x["dim"] == b["dim"]], pivots, k)
            n = len(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found] + [pa.nulls(n, f.type) for f in list(schema)[5:]], schema=schema)
            far = Index.distances(pivots, q["mat"])
            yield pa.RecordBatch.from_pylist([{
                "chunk": b["block"], "home": b["grp"], "dim": b["dim"], "low": far.min(0).tolist(), "high": far.max(0).tolist(), "norm": float((q["mat"].astype(float) ** 2).sum(1).max()),
                "beat": int(q["least"].min()), **{c: q[c].tobytes() for c in ("rows", "ids", "least", "mat")},
            }], schema=schema)

    def run(batches):
        blocks = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = _opened(batch.slice(i, 1).to_pylist()[0])
                if blocks and blocks[0]["grp"] != r["grp"]:
                    yield from searched(blocks)
                    blocks = []
                blocks.append(r)
        yield from searched(blocks)

    return run


def _opened(r: dict) -> dict:
    r["rows"], r["ids"] = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
    r["mat"] = np.frombuffer(r["mat"], np.int64).reshape(len(r["rows"]), r["dim"])
    return r


def _visit(pivots, k: int):
    """Streams query chunks past the blocks of a group, which come first."""

    def run(batches):
        group, blocks = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = _opened(batch.slice(i, 1).to_pylist()[0])
                if r["grp"] != group:
                    group, blocks = r["grp"], []
                if r["kind"] == 0:
                    blocks.append(r)
                    continue
                r["least"] = np.frombuffer(r["least"], np.int64).copy()
                own = [b for b in blocks if b["dim"] == r["dim"]]
                if own:
                    found = _best(r, own, pivots, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_arrow(FOUND))

    return run


def _best(q: dict, blocks: list[dict], pivots, k: int) -> list[np.ndarray]:
    """The best candidates of a query chunk in a group's annuli, visited from the nearest outwards."""
    to_pivots = Index.distances(pivots, q["mat"])
    norms = (q["mat"].astype(float) ** 2).sum(1)
    gaps = np.stack([np.maximum(0, np.maximum(to_pivots[:, b["pivot"]] - b["dmax"], b["dmin"] - to_pivots[:, b["pivot"]])) for b in blocks])
    gaps = np.maximum(0, gaps * (1 - 1e-9) - 1e-6 * (1 + to_pivots.max(initial=0)))
    least, best = q["least"], [np.zeros(0, np.int64)] * 4  # query, -score, id, row
    for i in np.argsort(gaps.min(1), kind="stable"):
        b = blocks[i]
        bound = (norms + b["nmax"] - gaps[i] ** 2) / 2
        open_ = np.flatnonzero(bound + 1e-9 * np.abs(bound) + 1 >= least)
        if not len(open_):
            continue
        s = products(q["mat"][open_], b["mat"])
        at, col = np.nonzero(s >= least[open_][:, None])
        other = q["rows"][open_[at]] != b["rows"][col]
        at, col = at[other], col[other]
        if not len(at):
            continue
        new = [open_[at], -s[at, col], b["ids"][col], b["rows"][col]]
        best = [np.concatenate(x) for x in zip(best, new)]
        order = np.lexsort(best[::-1])
        best = [x[order] for x in best]
        place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [x[place < k] for x in best]
        last = place[place < k] == k - 1
        least[best[0][last]] = np.maximum(least[best[0][last]], -best[1][last])
    return [q["rows"][best[0]], q["ids"][best[0]], best[2], -best[1], best[3]]
