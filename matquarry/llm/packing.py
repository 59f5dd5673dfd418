"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bulk-synchronous best-fit, longest pieces first.  Range-sorted documents and gaps are kept as runs of equal size:
(length, ranks) and (gap, sequences), a few thousand whatever the corpus is.  In a superstep every run of
documents looks up its successor, the smallest gap that holds it.  Runs with one successor form a group with that
gap and the idle gaps up to the next successor; each group is swept in a task of its own, where conflicts are
resolved by rank: the longest documents take the tightest gaps first, and a gap that shrinks within the group's
range can be taken again.  Gaps are updated, documents that found none go to the next superstep.  Documents longer
than every gap get empty sequences, as many as their lengths need, for the longest half of lengths at a time.

The ranks of single documents are distributed: each task numbers its own, and prefix sums over the tasks' counts
give the place in the run.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import pieces, shared

CAPACITY, END = 2048, 0
#: The split pattern of the byte-level tokenizer (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _alphabet() -> dict[int, int]:
    """Bytes to the characters that stand for them in byte-level vocabularies: printable ones for themselves,
    the rest for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in own)}


class Ids:
    """Packed ids (little-endian unsigned 32-bit) as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Pieces go straight to the tokenizer's model and are remembered, where the file describes a plain byte-level
    tokenizer; texts that hold one of its added tokens, and files of any other kind, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.added = [x["content"] for x in described["added_tokens"]]
        split = described["pre_tokenizer"] or {}
        self.plain = described["normalizer"] is None and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
        model, table = self.library.model, _alphabet()
        self.packed = pieces.Packer(PATTERN, lambda x: [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(table))]).packed

    def __call__(self, text: str) -> bytes:
        if self.plain and not any(x in text for x in self.added):
            return self.packed(text)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ids: dict[str, Ids] = {}


def _ids_of(path: str) -> Ids:
    """One for each worker process."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth: each document's ids and ``end``, cut into pieces.

    Only documents of more than ``capacity`` ids are cut; all their pieces but the first are full.  ``nth``
    numbers the pieces of one length within the task; both hold for one computation, so cut before use.
    """
    last = np.array([end], "<u4").tobytes()
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in _PIECE.split(", ")] + ["task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen = _ids_of(path), [0] * (capacity + 1)
        task = pyspark.TaskContext.get().partitionId()
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in types)
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = memoryview(ids_of(text.as_py() or "") + last)
                total = len(ids) // 4
                first = total % capacity or capacity
                for k, stop in enumerate(range(first, total + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    n = stop - start
                    for column, x in zip(out, (doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * stop]), task, seen[n]), strict=True):
                        column.append(x)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE + ", task long, nth long")


#: Rows of a superstep: runs of documents (size, first rank, n) and of gaps (size, first sequence, n) that are
#: left, and placements (length, first rank, n, first sequence, offset).
_RUN = "kind string, size long, first long, n long, sequence long, offset long"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]


def sweep_group(runs: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best-fit of a group's runs of documents, longest first, into its runs of gaps.

    A run of documents fills each gap it takes with as many of its documents as fit.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    for size, first, n in runs.loc[runs["kind"] == "gap", ["size", "first", "n"]].sort_values(["size", "first"]).itertuples(index=False):
        gaps.setdefault(size, []).append((first, n))
    sizes, out = sorted(gaps), []

    def add(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length, rank, left in runs.loc[runs["kind"] == "doc", ["size", "first", "n"]].sort_values(["size", "first"], ascending=[False, True]).itertuples(index=False):
        while left and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            size = sizes[at]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[at]
            # ``layers`` documents in each of ``taken`` gaps.
            layers = min(size // length, left)
            taken = min(n, left // layers)
            for k in range(layers):
                out.append(("placed", length, rank, taken, first, capacity - size + k * length))
                rank += taken
            left -= layers * taken
            add(size - layers * length, first, taken)
            add(size, first + taken, n - taken)
        if left:
            out.append(("doc", length, rank, left, None, None))
    out += [("gap", size, first, n, None, None) for size, some in gaps.items() for first, n in some]
    frame = pd.DataFrame(out, columns=_RUN_NAMES)
    return frame.astype({"sequence": "Int64", "offset": "Int64"})


def superstep(state: DataFrame, capacity: int) -> DataFrame:
    """One matching of all runs of documents with their successors; groups are swept in parallel tasks.

    The distinct sizes of gaps and successors that travel to all tasks are ``capacity`` numbers at most.
    """
    docs, gaps = state.where("kind = 'doc'"), state.where("kind = 'gap'")
    sizes = F.broadcast(gaps.agg(F.collect_set("size").alias("sizes")))
    aimed = docs.join(sizes, F.lit(True)).withColumn("successor", F.expr("array_min(filter(sizes, s -> s >= size))")).drop("sizes")
    aims = F.broadcast(aimed.agg(F.collect_set("successor").alias("aims")))
    held = gaps.join(aims, F.lit(True)).withColumn("successor", F.expr("array_max(filter(aims, s -> s <= size))")).drop("aims")
    both = aimed.unionByName(held)
    swept = both.where("successor is not null").groupBy("successor").applyInPandas(lambda pdf: sweep_group(pdf, capacity), _RUN)
    return swept.unionByName(both.where("successor is null").drop("successor"))


def match(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Placements of runs of documents: length, rank, n, sequence, offset.

    ``counts`` holds length and n.  The driver sees three numbers of each superstep: the longest document left, the
    largest gap, and how many empty sequences the documents beyond it need.
    """
    spark = counts.sparkSession
    null = F.lit(None).cast("long")
    state = shared.cut(counts.select(F.lit("doc").alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), null.alias("sequence"), null.alias("offset")))
    placed: list[DataFrame] = []
    opened = 0
    while True:
        doc, gap = F.col("kind") == "doc", F.col("kind") == "gap"
        top = state.agg(F.max(F.when(doc, F.col("size"))), F.max(F.when(gap, F.col("size")))).first()
        if top[0] is None:
            break
        beyond = state.where(doc & (F.col("size") > max(top[1] or 0, top[0] // 2)))
        half = F.col("size") > capacity // 2
        need = beyond.agg(F.sum(F.when(half, F.col("n")).otherwise(0)), F.sum(F.when(half, 0).otherwise(F.col("n") * F.col("size")))).first()
        fresh = int(need[0] or 0) + -(-int(need[1] or 0) // capacity)
        empty = spark.range(1 if fresh else 0).select(F.lit("gap").alias("kind"), F.lit(capacity).cast("long").alias("size"), F.lit(opened).cast("long").alias("first"), F.lit(fresh).cast("long").alias("n"), null.alias("sequence"), null.alias("offset"))
        opened += fresh
        result = shared.cut(superstep(state.unionByName(empty), capacity))
        placed.append(result.where("kind = 'placed'"))
        state = result.where("kind <> 'placed'")
    if not placed:
        return spark.createDataFrame([], "length long, rank long, n long, sequence long, offset long")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "sequence", "offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece with its sequence_id and offset; sequences are filled without gaps from 0.

    A null or empty text is the end id alone.  Null and repeated ids are packed like any others; an empty table
    gives no rows.  Texts aren't shuffled; the pieces (60 bytes each) are, once.  The placements of runs, a few
    thousand rows whatever the corpus is, are broadcast.
    """
    spark: SparkSession = docs.sparkSession
    cut = shared.cut(tokenise(docs, path, capacity, end))
    counts = shared.cut(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    plan = match(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity).toPandas().sort_values(["length", "rank"])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank"))
    sent = spark.sparkContext.broadcast((plan["length"].to_numpy(np.int64) << 40 | plan["rank"].to_numpy(np.int64), *(plan[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = sent.value
        for b in batches:
            rank = b.column("rank").to_numpy() + b.column("nth").to_numpy()
            at = np.searchsorted(keys, b.column("length").to_numpy() << 40 | rank, "right") - 1
            names = [x.split()[0] for x in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    shared.bounded_batches(spark, 10_000)
    return cut.join(ranks, ["task", "length"]).mapInArrow(assign, _PIECE + ", sequence_id long, offset long")
