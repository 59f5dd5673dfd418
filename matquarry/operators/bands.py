"""Band tables (dataset, band, k, energy)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_filter(df: DataFrame, low: float, high: float, datasets: list[str]) -> DataFrame:
    return df.where(F.col("energy").between(low, high) & F.col("dataset").isin(*datasets))


def order_band(df: DataFrame, near: float = 1e-12) -> DataFrame:
    """Points in order: leading invalid ones dropped, gaps kept as null, repeats collapsed; two points at least."""
    w = Window.partitionBy("dataset", "band")
    o = w.orderBy("seq")
    started = F.max(F.col("energy").isNotNull()).over(o.rowsBetween(Window.unboundedPreceding, 0))
    same = (F.abs(F.lag("k").over(o) - F.col("k")) <= near) & (F.lag("energy").over(o).eqNullSafe(F.col("energy")))
    kept = df.withColumns({"started": started, "same": F.coalesce(same, F.lit(False))}).where("started and not same")
    return kept.withColumn("n", F.count("energy").over(w)).where("n >= 2").drop("started", "same", "n")


def extents(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset").agg(F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.min("energy").alias("e_min"), F.max("energy").alias("e_max"), F.count("*").alias("points"))


def interpolate(df: DataFrame, grid: DataFrame, width: float) -> DataFrame:
    """Linear interpolation at each k of ``grid``; null where a segment ends in a gap.

    Segments and grid meet on k cells of ``width``: a segment is listed in each cell that it crosses, so the range
    join is an equi join with a check.
    """
    o = Window.partitionBy("dataset", "band").orderBy("k")
    seg = df.withColumns({"k1": F.lead("k").over(o), "e1": F.lead("energy").over(o)}).where("k1 is not null")
    cell = lambda c: F.floor(c / width)
    seg = seg.select("dataset", "band", F.col("k").alias("k0"), F.col("energy").alias("e0"), "k1", "e1", F.explode(F.sequence(cell(F.least("k", "k1")), cell(F.greatest("k", "k1")))).alias("cell"))
    hit = seg.join(grid.select("k", cell(F.col("k")).alias("cell")), "cell").where(F.col("k").between(F.least("k0", "k1"), F.greatest("k0", "k1")))
    energy = F.col("e0") + (F.col("e1") - F.col("e0")) * (F.col("k") - F.col("k0")) / F.nullif(F.col("k1") - F.col("k0"), F.lit(0.0))
    return hit.groupBy("dataset", "band", "k").agg(F.min_by(energy, "k0").alias("energy"))


def merge_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """Union with names prefixed by the set's name if there are several."""
    name = lambda s: F.concat(F.lit(f"{s}:"), F.col("band").cast("string")) if len(sets) > 1 else F.col("band").cast("string")
    return reduce(DataFrame.unionByName, [df.withColumn("name", name(s)) for s, df in sets.items()])


def map_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """k of each dataset mapped linearly to [low, high]."""
    edge = df.groupBy("dataset").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    return df.join(edge, "dataset").withColumn("mapped", low + (high - low) * (F.col("k") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))).drop("a", "b")


def map_scale(df: DataFrame, scale: float, offset: float) -> DataFrame:
    return df.withColumn("mapped", F.col("k") * scale + offset)
