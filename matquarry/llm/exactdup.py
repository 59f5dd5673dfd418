"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty.  Each map task folds its
own copies first and sends one content for each group of them.  These are combined in groups of a short digest,
salted where a digest is hot, and the winners of the salts are combined last.  A digest only decides where texts
meet: every stage compares the full content, so texts whose digests collide stay apart.  Of equal texts the row
with the largest doc_id stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, textkit

SALTS, DIGEST_BYTES = 16, 8
#: Bytes of content that a task remembers to fold its own copies; beyond it, it starts anew (later stages combine).
REMEMBERED = 64 << 20


def _local(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """doc_id, sha, written, part, digest, content of every row; ``part`` numbers the groups of equal texts of a task.

    ``sha`` is of the normalised text, ``written`` of the text as it is.  Only the first row of a part carries its
    digest and content (the normalised text as bytes).
    """
    names = ["doc_id", "sha", "written", "part", "digest", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following, known, held = pyspark.TaskContext.get().partitionId() << 33, {}, 0
        for b in batches:
            raw, off = textkit.flat(b.column("text"))
            low, raw = textkit.LOWER[raw].tobytes(), raw.tobytes()
            sha, written, part, digest, content = [], [], [], [], []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = low[i:j]
                sha.append(hashlib.sha256(text).digest())
                written.append(hashlib.sha256(raw[i:j]).digest())
                if (group := known.get(text)) is None:
                    if held > REMEMBERED:
                        known, held = {}, 0
                    group = known[text] = following
                    following, held = following + 1, held + len(text) + 100
                    digest.append(sha[-1][:digest_bytes])
                    content.append(text)
                else:
                    digest.append(None)
                    content.append(None)
                part.append(group)
            cols = [b.column("doc_id"), pa.array(sha, pa.binary()), pa.array(written, pa.binary()), pa.array(part, pa.int64()), pa.array(digest, pa.binary()), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sha binary, written binary, part long, digest binary, content binary")


def _groups(docs: DataFrame, salts: int, digest_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, sha, written, part of every row; part, group, keep_id, group_size of every part.

    A digest is hot if it holds a thousandth of all parts or more, so ``shared.HEAVY`` of them at most are broadcast.
    Contents are shuffled once, the salt winners of hot digests once more.
    """
    local = shared.cut(_local(docs, digest_bytes))
    rows = local.select("doc_id", "sha", "written", "part")
    parts = local.where("content is not null").select("part", "digest", "content")
    least = max(parts.count() / shared.HEAVY, 2)
    hot = parts.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= least).limit(shared.HEAVY)
    hot = F.broadcast(shared.cut(hot.select("digest", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("part"), F.lit(salts))).otherwise(0)
    salted = parts.join(hot, "digest", "left").withColumn("salt", salt)
    share = F.min("part").over(Window.partitionBy("digest", "salt", "content"))
    shares = shared.cut(salted.withColumn("share", share).select("part", "share", F.when(F.col("hot") & (F.col("part") == F.col("share")), F.struct("digest", "content")).alias("winner")))
    # Winners of the salts of hot digests are combined over all salts.
    whole = F.min("share").over(Window.partitionBy("winner.digest", "winner.content"))
    combined = shares.where("winner is not null").select("winner", "share").select("share", whole.alias("whole"))
    group = shares.select("part", "share").join(combined, "share", "left").select("part", F.coalesce("whole", "share").alias("group"))
    own = rows.groupBy("part").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    member = shared.cut(own.join(group, "part"))
    total = member.groupBy("group").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    return rows, shared.cut(shared.spread_join(member.select("part", "group"), total, "group"))


def report(docs: DataFrame, salts: int = SALTS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat the keeper's doc_id are all reported as kept.  A null doc_id loses against any other; a
    group of null ids alone has a null keep_id and its rows are kept.  An empty table gives no rows.
    """
    rows, groups = _groups(docs, salts, digest_bytes)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return rows.join(groups, "part").select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame, salts: int = SALTS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row of each group of equal texts, with its columns: that of the largest doc_id.

    Where an id repeats, a group keeps one of its rows with that id: the one whose text as written has the smallest
    digest.  Different texts that share an id all keep a row.
    """
    rows, groups = _groups(docs, salts, digest_bytes)
    found = rows.join(groups, "part").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    chosen = found.groupBy("group").agg(F.min("written").alias("sha"), F.max("keep_id").alias("id"))
    return shared.one_row_each(docs, chosen, rows.select("doc_id", F.col("written").alias("sha")))
