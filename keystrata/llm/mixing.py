"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Native: DataFrame expressions only.

Every source may give at most ``max_epochs`` times its size.  A source whose
share by weight lies above that is clamped there, and what is over is dealt to
the others in proportion to their weights, until none is above.  One level
(target = level * weight) holds for all sources not clamped, so each round needs
two sums over the table of sources and the driver only holds the level.  That table is
broadcast only if counted to be small.

A document gives ``floor(target / size of source)`` whole repetitions.  The
fractional rest goes to whole documents drawn by a seeded hash: the cut in the
hash order at which the drawn words reach the rest of the target is found from
two histograms (4,096 bins each, the second inside the bin that holds the cut), so no source is
sorted or gathered, however large it is.  Where one document lies at the cut, it is taken if
that leaves the smaller miss.  The hash is of key, source and text, so only rows
equal in all three are drawn together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, small, stored

BINS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """(source, weight, source_size, ...) with ``target``.

    ``total`` is what all targets share; if all sources together cannot give it,
    each is clamped.  Sources of size or weight 0 get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        above = (cap < F.lit(level) * F.col("weight")) if clamped >= 0 else F.lit(False)
        row = sources.filter("weight > 0").agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("weights")
        ).first()
        if row["n"] == clamped or not row["weights"]:
            break
        clamped, level = row["n"], max(0.0, total - (row["fixed"] or 0.0)) / row["weights"]
    share = F.lit(level) * F.col("weight") if row["weights"] else cap
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(cap, share)).otherwise(0.0))


def _draw(seed: int, key: Column, source: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(seed), key, source, text)


def plan_mix(docs: DataFrame, weights: DataFrame, share: float, max_epochs: float, seed: int, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The sized rows (key, source, size, draw) and the plan: one row for each source.

    ``weights`` has (source, weight), one row a source, null included; sources
    without one weigh 0.  The targets share ``share`` times all words.
    """
    sized = stored(
        docs.select(
            F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
            _draw(seed, F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`")).alias("draw"),
        ),
        "mix-sizes",
    )
    first = sized.groupBy("source", F.shiftrightunsigned("draw", 52).cast("int").alias("bin1")).agg(F.sum("size").alias("n"), F.count_if(F.col("size") > 0).alias("docs"))
    first = stored(first, "mix-bins")
    weights = stored(weights.select("source", "weight"), "mix-weights")
    sizes = first.groupBy("source").agg(F.sum("n").alias("source_size"))
    same = sizes["source"].eqNullSafe(weights["source"])
    sizes = sizes.join(small(weights), same, "left").select(sizes["source"], "source_size", F.coalesce(weights["weight"], F.lit(0)).cast("double").alias("weight"))
    sizes = stored(sizes, "mix-sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sizes, share * total, max_epochs)
    plan = plan.withColumn("__ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("__ratio")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan.select("source", "source_size", "target", "whole", "rest"), "mix-plan")

    def cut(bins: DataFrame, bin: str, plan: DataFrame) -> DataFrame:
        """The bin in which the drawn words reach ``rest``, and what is then left of it."""
        upto = bins.selectExpr("source", bin, "n", "docs", f"sum(n) over (partition by source order by {bin}) - n as before")
        same = upto["source"].eqNullSafe(plan["source"])
        held = upto.join(small(plan.select("source", "rest")), same).filter("before <= rest and rest < before + n")
        return held.select(upto["source"], F.col(bin), (F.col("rest") - F.col("before")).alias("rest"), "n", "docs")

    cut1 = stored(cut(first, "bin1", plan), "mix-cut")
    edge = cut1.select(F.col("source").alias("s"), F.col("bin1").alias("b"))
    inside = sized.join(small(edge), F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("draw", 52) == F.col("b")))
    second = inside.groupBy("source", (F.shiftrightunsigned("draw", 40) % BINS).cast("int").alias("bin2")).agg(F.sum("size").alias("n"), F.count_if(F.col("size") > 0).alias("docs"))
    cut2 = cut(second, "bin2", cut1.select("source", "rest"))
    cuts = cut1.select("source", "bin1").join(cut2.select(F.col("source").alias("s"), "bin2", "rest", "n", "docs"), F.col("source").eqNullSafe(F.col("s")), "left")
    # the last 40 bits go on from there as if the words of the cell were spread evenly, but one document is taken or not
    share = F.coalesce(F.col("rest") / F.col("n"), F.lit(0.0))
    last = F.when(F.col("docs") == 1, F.when(share >= 0.5, 1.0).otherwise(0.0)).otherwise(share) * float(1 << 40)
    edge = cuts.select(F.col("source").alias("s"), ((F.col("bin1") * BINS + F.coalesce("bin2", F.lit(0))).cast("long")).alias("cell"), last.alias("last"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "cell", "last")
    return sized, stored(plan, "mix-cuts")


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (row, source, draw) with source_size, target and repeats: how often the mix takes each."""
    plan = plan.select(F.col("source").alias("planned"), "source_size", "target", "whole", "cell", "last")
    df = rows.join(small(plan), F.col("source").eqNullSafe(F.col("planned")), "left")
    cell, low = F.shiftrightunsigned("draw", 40), F.col("draw").bitwiseAND((1 << 40) - 1)
    drawn = (cell < F.col("cell")) | ((cell == F.col("cell")) & (low < F.col("last")))
    repeats = (F.coalesce("whole", F.lit(0)) + F.when(drawn, 1).otherwise(0)).cast("int")
    return df.select("row", "source", "source_size", "target", repeats.alias("repeats"))


def mix(docs: DataFrame, weights: DataFrame, share: float, max_epochs: float, seed: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: key, source, size, source_size, target, taken.

    Null and empty texts have size 0 and give nothing.  Equal rows are drawn
    together.  Texts are counted whole, however long.  An empty table gives an
    empty result; other columns are left out.
    """
    sized, plan = plan_mix(docs, weights, share, max_epochs, seed, key, text, source)
    out = with_repeats(sized.select(F.struct("key", "size").alias("row"), "source", "draw"), plan)
    return out.select("row.key", "source", "row.size", "source_size", "target", (F.col("row.size") * F.col("repeats")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: DataFrame, share: float, max_epochs: float, seed: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` themselves, with all their columns, each as often as the mix takes it."""
    _, plan = plan_mix(docs, weights, share, max_epochs, seed, key, text, source)
    draw = _draw(seed, F.col(f"`{key}`"), F.col(f"`{source}`"), F.col(f"`{text}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{source}`").alias("source"), draw.alias("draw"))
    out = with_repeats(rows, plan).filter("repeats > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("row.*")
