"""Keyed state as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import fresh_path


def stream_upsert(spark: SparkSession, path: str) -> DataFrame:
    """The newest event type of each user, from the events files read as a stream.

    Each micro-batch is folded to one row for each key and appended under its batch id, so a batch that is run
    again replaces its own rows; the table is the newest row over all batches.
    """
    base = fresh_path(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path if not path.endswith(".parquet") else path.rsplit("/", 1)[0], pathGlobFilter=path.rsplit("/", 1)[-1])

    def fold(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r"))
        newest.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = source.writeStream.foreachBatch(fold).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.max("r").alias("r")).select("user_id", "r.event_type")


def flag_bursts(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Each event with its place in its window and whether it is over the limit.

    A window opens at a key's first event and closes ``seconds`` later; the next event opens another.  Windows
    depend on all earlier events of the key, so a key's events are walked in order, one batch in memory.
    """
    rows = events.select(F.col(key).alias("key"), F.col("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, n, begun = None, 0, 0, False
        for b in batches:
            nth = []
            for k, at in zip(b.column("key").to_pylist(), b.column("at").to_pylist(), strict=True):
                if not begun or k != now or at >= opened + seconds * 1_000_000:
                    now, opened, n, begun = k, at, 0, True
                n += 1
                nth.append(n)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("event_id"), pa.array(nth, pa.int64()), pa.array([x > limit for x in nth], pa.bool_())], names=["key", "event_id", "nth", "burst"])

    return rows.where("at is not null").repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(walk, "key long, event_id long, nth long, burst boolean")


def stream_bursts(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """``flag_bursts`` on a stream: a key's open window and its count are state, so windows run on over micro-batches.

    Events of one key in a micro-batch are ordered by time; an event older than the open window counts in it.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("key is not null and at is not null")

    def update(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        new = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event_id, at in new[["event_id", "at"]].itertuples(index=False):
            if opened is None or at >= opened + seconds * 1_000_000:
                opened, n = at, 0
            n += 1
            out.append((of[0], event_id, n, n > limit))
        state.update((int(opened), n))
        yield pd.DataFrame(out, columns=["key", "event_id", "nth", "burst"])

    return rows.groupBy("key").applyInPandasWithState(update, "key long, event_id long, nth long, burst boolean", "opened long, n long", "append", GroupStateTimeout.NoTimeout)
