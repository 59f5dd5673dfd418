"""Ranks and exact quantiles of the values of many keys, any of which may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut


def running(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` (one row for each key and value, ``n`` rows each) and ``below``: rows of the key with smaller values.

    Keys and values are dealt out by ranges, so a large key is spread over many tasks; what stands before a range in its
    key is the sum of the ranges before, of which there are as many as partitions.  Rows with a null key are left out.
    """
    parts = cut(counts.dropna(subset=keys).repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()))
    earlier = (Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part", *keys).agg(F.sum(n).alias("__rows"))
    before = totals.select("__part", *keys, F.coalesce(F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(*earlier)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("__part", *keys).orderBy(value).rowsBetween(*earlier)), F.lit(0))
    ranked = parts.withColumn("__inside", inside).join(before, ["__part", *keys])
    return ranked.withColumn("below", F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``shares``: the quantile of the key's values, between neighbours by proportion.

    The same numbers as ``percentile`` gives, but no key is held by one task.  Null values and keys are left out; a key
    without values has no row.
    """
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    ranked = running(counts, keys, value).join(total, keys)
    picks, out = [], []
    for name, share in shares.items():
        place = (F.col("__total") - 1) * F.lit(float(share))
        for side, k in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value))).alias(f"{name}__{side}"))
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append(F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    return ranked.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks).select(*keys, *out)
