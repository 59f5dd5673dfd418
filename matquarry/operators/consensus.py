"""Reconciling numeric claims of many models: weights, weighted medians, conflicts, evidence components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem
from ..functions.text import stage_weight

#: Tolerance, lowest and highest value of each property (fixed values).
PROPERTIES = {"tc": (1.0, 0.0, 1000.0), "gap": (0.25, 0.0, 100.0), "formation": (0.08, -100.0, 100.0), "hull": (0.04, 0.0, 100.0), "moment": (0.25, -1000.0, 1000.0)}
NUMERIC_STAGES = ["reproduction", "experiment", "literature", "database", "dft", "validated_ml", "ml"]
FAMILY_CAP = 1.5


def tolerance(prop: Column, which: int = 0) -> Column:
    out = F.lit(None).cast("double")
    for name, values in PROPERTIES.items():
        out = F.when(prop == name, values[which]).otherwise(out)
    return out


def in_range(prop: Column, value: Column) -> Column:
    return value.between(tolerance(prop, 1), tolerance(prop, 2))


#: Factors to GPa, and unit synonyms (fixed values).
PRESSURE = {"gpa": 1.0, "mpa": 1e-3, "kpa": 1e-6, "pa": 1e-9, "kbar": 0.1, "bar": 1e-4}
ENERGY = {"ev": 1.0, "mev": 1e-3, "ry": 13.605693122994}


def to_unit(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, k in factors.items():
        out = F.when(F.lower(F.trim(unit)) == name, value * k).otherwise(out)
    return out


def to_kelvin(value: Column, unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    return F.when(u.isin("c", "°c", "celsius"), value + 273.15).when(u.isin("k", "kelvin"), value)


def eligible(stage: Column, trusted: Column) -> Column:
    return trusted & stage.isin(*NUMERIC_STAGES)


def identity_key(df: DataFrame) -> DataFrame:
    """identity: reduced composition (or the text) and structure."""
    parsed = chem.per_formula(df, "formula", composition_key=chem.composition_key)
    return parsed.withColumn("identity", F.concat_ws("~", F.coalesce(F.nullif("composition_key", F.lit("")), F.concat(F.lit("text:"), F.lower("formula"))), F.col("structure").cast("string")))


def entry_weight(df: DataFrame) -> DataFrame:
    """weight: by stage; calibrated entries by applicability and q90; untrusted ones little; 0.01 at least."""
    base = stage_weight(F.col("stage"))
    calibrated = (F.col("q90") > 0) & (F.col("applicability") > 0)
    w = F.when(eligible(F.col("stage"), F.col("trusted")) & calibrated, base * F.least(F.lit(4.0), F.col("applicability") / (F.col("q90") * F.col("q90") + 1e-6))).when(eligible(F.col("stage"), F.col("trusted")), base).otherwise(0.35)
    return df.withColumns({"weight": F.greatest(F.lit(0.01), w), "eligible": eligible(F.col("stage"), F.col("trusted"))})


def best_per_model(df: DataFrame, keys: list[str]) -> DataFrame:
    """One entry for each model and key: eligible first, then weight, then record id; a struct aggregate."""
    order = F.struct(F.col("eligible"), F.col("weight"), -F.col("record_id"))
    return df.groupBy(*keys, "model").agg(F.max_by(F.struct(*[c for c in df.columns if c not in (*keys, "model")]), order).alias("r")).select(*keys, "model", "r.*")


def cap_families(df: DataFrame, keys: list[str], cap: float = FAMILY_CAP) -> DataFrame:
    """capped: weights scaled so that a family totals ``cap`` at most."""
    total = F.sum("weight").over(Window.partitionBy(*keys, "family"))
    return df.withColumn("capped", F.col("weight") * F.least(F.lit(1.0), cap / total))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """The lower weighted median of each key: the smallest value whose running weight reaches half.

    Equal values are added up first, so a key meets one row for each distinct value.
    """
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    run = F.sum("__w").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__w").over(Window.partitionBy(*keys))
    ranked = sums.withColumns({"__run": F.round(run, 9), "__half": F.round(total / 2, 9)})
    return ranked.where("__run >= __half").groupBy(*keys).agg(F.min(value).alias(out))
