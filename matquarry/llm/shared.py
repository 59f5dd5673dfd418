"""What the operators of this subpackage share: the shared folder, cuts, skew-safe joins, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import cut, fresh_path, shared_dir  # noqa: F401

#: Rows of an Arrow batch.  Texts are long, so a batch stays small; tasks work through one at a time.
BATCH_ROWS = 512
#: A key is heavy if it holds a thousandth of all rows, so at most so many keys are.
HEAVY = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches at ``rows`` rows at most for the plans made from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(big: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``table``, which holds one row for each key at most; heavy keys are dealt to many tasks.

    ``big`` should be cheap to read again (a cut).  The rows of a heavy key go to as many parts as there are
    shuffle partitions, and its row of ``table`` to each of them; the list of heavy keys (``HEAVY`` at most) is
    part of the plan.  Null keys match nothing.
    """
    spark = big.sparkSession
    parts, least = tasks(spark), max(big.count() / HEAVY, HEAVY)
    counts = big.groupBy(on).agg(F.count("*").alias("__n"))
    heavy = [x[0] for x in counts.where((F.col("__n") >= least) & F.col(on).isNotNull()).select(on).limit(HEAVY).collect()]
    if not heavy:
        return big.join(table, on, how)
    is_heavy = F.col(on).isin(heavy)
    left = big.withColumn("__part", F.when(is_heavy, F.pmod(F.xxhash64(*big.columns), F.lit(parts)).cast("int")).otherwise(0))
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("__part", F.explode(copies)), [on, "__part"], how).drop("__part")


def by_shard(dealt: DataFrame, shards: int, build: Callable[[pa.Table], Any], answer: Callable[[Any, pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """What shards of rows answer to the questions put to them.

    ``dealt`` has ``shard`` and ``asks`` (false for rows, true for questions).  A task holds what ``build`` makes of
    one shard's rows and gives it the shard's questions batch by batch; a shard without rows isn't asked.
    """
    spark = dealt.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], None
        for b in batches:
            where, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
                if lo == hi:
                    continue
                if where[lo] != at:
                    at, held, built = where[lo], [], None
                if not asks[lo]:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if held:
                    built, held = build(pa.Table.from_batches(held)), []
                if built is not None:
                    yield from answer(built, pa.Table.from_batches([b.slice(lo, hi - lo)]))

    rows = dealt.repartition(max(tasks(spark), shards), "shard").sortWithinPartitions("shard", "asks")
    return rows.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int, evenly: bool = False) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents, chosen by a hash of doc_id.

    With ``evenly`` each label has about the same share of the bound (95 % of it, as a hash doesn't hit it exactly; all of
    a rarer label), so that rare labels are seen often, and no label is gathered in one task.  The bound makes
    the label side small enough to broadcast, so texts aren't shuffled.  Rows with a null id or label are left out; of
    repeated ids, one label (the largest) counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column)).cast("int").alias("y"))
    if evenly:
        # Hashes are spread evenly over all 64-bit numbers, so those below a bound are a known share of a label.
        counts = cut(known.groupBy("y").agg(F.count("*").alias("n")))
        each = bound / max(1, counts.count())
        share = F.least(F.lit(1.0), F.lit(0.95 * each) / F.col("n"))
        pick = known.join(F.broadcast(counts), "y").where(F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5 <= share).select("doc_id", "y")
    else:
        pick = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")


def text_sha(text: Column) -> Column:
    """SHA-256 of a text (null: empty) as bytes."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def one_row_each(docs: DataFrame, chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """For each (sha, id) of ``chosen`` one of the rows of ``docs`` with that text and doc_id (null equals null).

    ``rows`` (doc_id, sha) tells which of them repeat; only these are numbered, the others are found by a semi-join.
    Columns of ``docs`` travel in a struct, so their names can't clash.
    """
    wanted = chosen.select(F.col("sha").alias("of"), "id")
    same = rows.join(wanted, (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    times = cut(same.groupBy("of", "id").agg(F.count("*").alias("times")))
    named = docs.select(F.struct(*docs.columns).alias("row"), text_sha(F.col("text")).alias("own"), F.col("doc_id").cast("long").alias("own_id"))
    on = (F.col("own") == F.col("of")) & F.col("own_id").eqNullSafe(F.col("id"))
    once = named.join(times.where("times = 1"), on, "left_semi").select("row.*")
    if times.where("times > 1").isEmpty():
        return once
    order = Window.partitionBy("of", "id").orderBy("own")
    more = named.join(times.where("times > 1"), on).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return once.unionByName(more.select("row.*"))
