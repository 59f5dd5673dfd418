"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder (tests); a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once, as Parquet in the shared folder, and reads it back.

    Lost executors can't lose it, the plan starts anew from a scan of known size, so small tables are broadcast by
    Spark's own limit, and no constraints pile up in loops.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly if its scan has fewer splits than the session has cores, for work that is heavy a row.

    A table of many files or row groups is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def per_value(df: DataFrame, columns: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``compute(df)`` for a function of ``columns`` alone, worked out once for each distinct combination of them.

    Nulls are values like others.  The combinations are written first, so Spark knows their size when it joins them
    back: few are broadcast, many are joined by shuffling.
    """
    raw = {c: f"__raw_{c}" for c in columns}
    known = cut(compute(df.select(*columns).distinct().withColumns({r: F.col(c) for c, r in raw.items()})))
    new = [c for c in known.columns if c not in raw.values() and (c in df.columns or c not in columns)]
    known = known.select(*[F.col(r).alias(f"__of_{c}") for c, r in raw.items()], *[F.col(c).alias(f"__new_{c}") for c in new])
    # Columns are compared one by one: a struct of them would be built again for each of its fields.
    same = [F.col(r).eqNullSafe(F.col(f"__of_{c}")) for c, r in raw.items()]
    kept = [c for c in df.columns if c not in new]
    return df.withColumnsRenamed(raw).join(known, same, "left").select(*[F.col(raw.get(c, c)).alias(c) for c in kept], *[F.col(f"__new_{c}").alias(c) for c in new])
