"""Hard-negative mining with a multiway hyperplane tree of split points and distance ranges.

A node of the tree has split points; each row belongs to the subtree of its nearest split point (so hyperplanes
between the points part the subtrees).  For each split point and each sibling subtree the node stores the least and
greatest distance between them, and for each subtree the range of norms.  A search asks for the rows whose inner
product with an anchor lies in a window.  With the norms of a subtree the window is an annulus of distances around the
anchor, and by the triangle inequality a subtree can be left out if, seen from any split point, its range of
distances doesn't meet the annulus.  What is left is decided in leaves by exact inner products of integers.  Once a
search has as many rows as it needs, the least of them narrows its window.

The root of the tree deals the rows to shards, and its ranges decide which shards a search is sent to; a shard's task
builds the lower part of the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Subtrees of the root and of other nodes, rows of a leaf, depth beyond which any node is a leaf.
ROOT, WAYS, LEAF, DEPTH = 16, 16, 64, 32
#: Rows that the root's split points are chosen from, rows of a shard at most (on average of its subtree's shards).
SAMPLE, SHARD_ROWS = 2048, 1 << 16
#: Distances are rounded; ranges are widened by this much in proportion.
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of whole numbers; but for the square root they are exact."""
    return np.sqrt((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T))


def split_points(x: np.ndarray, ways: int) -> np.ndarray:
    """Rows far apart from each other: each is the one farthest from those before it, of a few evenly spaced rows."""
    x = x[np.linspace(0, len(x) - 1, min(len(x), 3 * ways)).astype(np.int64)]
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < ways and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Node:
    """Split points with their subtrees, ranges of distances (point x subtree) and norms, and labels of each subtree."""

    def __init__(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, norms: np.ndarray, labels: list | None = None) -> None:
        self.points, self.low, self.high, self.norms, self.labels = points, low, high, norms, labels

    def may_hold(self, child: int, to_points: np.ndarray, anchor_norms: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which searches (distances to the points, squared norm, window) a subtree may have rows for."""
        least, most = self.norms[child]
        inner = np.sqrt(np.maximum(anchor_norms + least - 2 * hi, 0)) * (1 - SLACK)
        outer = anchor_norms + most - 2 * lo
        reached = outer >= 0
        outer = np.sqrt(np.maximum(outer, 0)) * (1 + SLACK)
        d, slack = to_points, SLACK * (1 + to_points)
        nearest = np.maximum(d - outer[:, None], inner[:, None] - d) - slack
        meets = (self.high[:, child] >= nearest) & (self.low[:, child] <= d + outer[:, None] + slack)
        return reached & meets.all(1)


class Tree:
    """The part of the tree over one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.square = (self.x**2).sum(1)
        self.top = self._node(np.arange(len(ids)), 0)

    def _node(self, rows: np.ndarray, depth: int) -> np.ndarray | tuple[Node, list]:
        if len(rows) <= LEAF or depth > DEPTH:
            return rows
        points = split_points(self.x[rows], WAYS)
        if len(points) < 2:
            return rows
        d = _distances(self.x[rows], points)
        own = d.argmin(1)
        parts = [np.flatnonzero(own == j) for j in range(len(points))]  # each point is in its own
        low, high = (np.stack([f(d[p], axis=0) for p in parts], 1) for f in (np.min, np.max))
        norms = np.array([(self.square[rows[p]].min(), self.square[rows[p]].max()) for p in parts])
        labels = [np.unique(self.labels[rows[p]]) for p in parts]
        return Node(points, low, high, norms, labels), [self._node(rows[p], depth + 1) for p in parts]

    def search(self, anchors: np.ndarray, of: np.ndarray, own: np.ndarray, label: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (-inf: none) of the first ``k`` rows of each search, by score and id.

        Search ``i`` is for anchor ``of[i]``, whose id and label are ``own[i]`` and ``label[i]``, and takes rows of the
        same label or of others, with scores from ``lo[i]`` to ``hi[i]``.
        """
        best_ids, best = np.zeros((len(of), k), np.int64), np.full((len(of), k), -np.inf)
        norms = (anchors**2).sum(1)

        def leaf(rows: np.ndarray, some: np.ndarray) -> None:
            who, back = np.unique(of[some], return_inverse=True)
            score = (anchors[who] @ self.x[rows].T)[back]
            fits = ((self.labels[rows] == label[some, None]) == same) & (self.ids[rows] != own[some, None])
            fits &= (score >= np.maximum(lo[some], best[some, -1])[:, None]) & (score <= hi[some, None])
            hit = fits.any(1)
            some = some[hit]
            scores = np.concatenate([best[some], np.where(fits[hit], score[hit], -np.inf)], 1)
            ids = np.concatenate([best_ids[some], np.broadcast_to(self.ids[rows], (len(some), len(rows)))], 1)
            order = np.lexsort((ids, -scores), axis=1)[:, :k]
            best[some], best_ids[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

        todo = [(self.top, np.arange(len(of)), None)]
        while todo:
            at, some, check = todo.pop()
            if check is not None:
                node, child, d = check
                known = node.labels[child]
                wanted = np.isin(label[some], known) if same else (len(known) > 1) | (label[some] != known[0])
                # By now the searches may have rows that narrow their windows.
                keep = wanted & node.may_hold(child, d, norms[of[some]], np.maximum(lo[some], best[some, -1]), hi[some])
                some = some[keep]
            if not len(some):
                continue
            if isinstance(at, np.ndarray):
                leaf(at, some)
                continue
            node, children = at
            who, back = np.unique(of[some], return_inverse=True)
            d = _distances(anchors[who], node.points)[back]
            for j in np.argsort(-d.mean(0), kind="stable").tolist():  # the last, nearest to most, is next
                todo.append((children[j], some, (node, j, d)))
        return best_ids, best


_FOUND = "anchor_id long, key long, vec_id long, score long"
_SEARCHES = "array<struct<key: long, lo: double, hi: double>>"


class Mine:
    """The root of the tree over all rows, and searches through it."""

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        self.spark = rows.sparkSession
        rows = shared.cut(rows)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
        widest = rows.agg(F.max(F.size("vec")).alias("d"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") ** 2)).alias("square")).first()
        if widest.square is not None and widest.square >= 2.0**51:
            raise ValueError("inner products of these vectors aren't exact: their squared norms reach 2**51")
        self.width = width = widest.d or 0
        self.empty = not sample
        if self.empty:
            return
        points = split_points(_padded(pa.array([r.vec for r in sample], pa.list_(pa.int64())), width), ROOT)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _padded(b.column("vec"), width)
                d = _distances(x, points)
                columns = [b.column(c) for c in ("vec_id", "label", "vec")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(d.argmin(1), pa.int32()), pa.array((x * x).sum(1)), pa.array(list(d), pa.list_(pa.float64()))], names=["vec_id", "label", "vec", "tree", "square", "d"])

        shared.bounded_batches(self.spark)
        placed = shared.cut(rows.mapInArrow(place, "vec_id long, label long, vec array<long>, tree int, square double, d array<double>"))
        n = len(points)
        ranges = [f(F.get("d", F.lit(i))).alias(f"{k}{i}") for k, f in (("low", F.min), ("high", F.max)) for i in range(n)]
        of = sorted(placed.groupBy("tree").agg(F.count("*").alias("n"), F.min("square").alias("least"), F.max("square").alias("most"), *ranges).collect())
        low, high = (np.array([[r[f"{k}{i}"] for r in of] for i in range(n)]) for k in ("low", "high"))
        self.root = Node(points, low, high, np.array([(r.least, r.most) for r in of]))
        #: The trees that have rows, in order, and their shards: the first and how many.
        self.trees = [r.tree for r in of]
        self.parts = [-(-r.n // shard_rows) for r in of]
        self.first = np.append(0, np.cumsum(self.parts)).tolist()
        base = F.create_map(*(F.lit(v) for t, f in zip(self.trees, self.first, strict=False) for v in (t, f)))
        many = F.create_map(*(F.lit(v) for t, m in zip(self.trees, self.parts, strict=True) for v in (t, m)))
        self.rows = placed.select("vec_id", "label", "vec", "tree", (base[F.col("tree")] + F.pmod(F.xxhash64("vec_id"), many[F.col("tree")])).cast("int").alias("shard"))

    def search(self, asks: DataFrame, k: int, same: bool, where: str = "all") -> DataFrame:
        """anchor_id, key, vec_id, score: of each search the first ``k`` rows of each shard that may have some.

        ``asks`` has anchor_id, label, vec, tree and ``searches`` (key, lo, hi); ``where`` tells whether they are sent
        to the anchor's own subtree of the root, to the others, or to all.
        """
        root, width, first, trees = self.root, self.width, self.first, self.trees

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, searches = _padded(b.column("vec"), width), b.column("searches")
                of, _, lo, hi = _flat(searches)
                d, norms = _distances(x, root.points)[of], (x * x).sum(1)[of]
                home = b.column("tree").to_numpy()
                for j, tree in enumerate(trees):
                    sent = np.bincount(of[root.may_hold(j, d, norms, lo, hi)], minlength=len(x)) > 0
                    sent &= (where == "all") | ((home == tree) == (where == "home"))
                    to = np.flatnonzero(sent)
                    for shard in range(first[j], first[j + 1]):
                        if len(to):
                            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(to)) for c in ("anchor_id", "label", "vec", "searches")), pa.array(np.full(len(to), shard), pa.int32())], names=["vec_id", "label", "vec", "searches", "shard"])

        def build(held: pa.Table) -> Tree:
            return Tree(held.column("vec_id").to_numpy(), held.column("label").to_numpy(), _padded(held.column("vec"), width))

        def answer(tree: Tree, asked: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, labels = asked.column("vec_id").to_numpy(), asked.column("label").to_numpy()
            of, key, lo, hi = _flat(asked.column("searches"))
            found, score = tree.search(_padded(asked.column("vec"), width), of, ids[of], labels[of], lo, hi, k, same)
            search, nth = np.nonzero(score > -np.inf)
            columns = [ids[of[search]], key[search], found[search, nth], score[search, nth].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "key", "vec_id", "score"])

        shared.bounded_batches(self.spark)
        sent = asks.mapInArrow(route, f"vec_id long, label long, vec array<long>, searches {_SEARCHES}, shard int")
        held = self.rows.select("vec_id", "label", "vec", F.lit(None).cast(_SEARCHES).alias("searches"), "shard", F.lit(False).alias("asks"))
        return shared.by_shard(held.unionByName(sent.withColumn("asks", F.lit(True))), self.first[-1], build, answer, _FOUND)


def _padded(vec: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers, the missing ones 0."""
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    size = np.asarray(vec.value_lengths())
    out = np.zeros((len(vec), width))
    out[np.arange(width)[None] < size[:, None]] = vec.flatten().to_numpy()
    return out


def _flat(searches: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Searches of all anchors one after another: whose, key, lo, hi."""
    searches = searches.combine_chunks() if isinstance(searches, pa.ChunkedArray) else searches
    of = np.repeat(np.arange(len(searches)), np.asarray(searches.value_lengths()))
    return of, *(c.to_numpy() for c in searches.flatten().flatten())


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The first ``k`` of each search, by score and id, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each positive.

    ``rows`` has vec_id, label and ``vec``, an array of whole numbers; ``is_anchor`` tells the anchors by vec_id.  Scores
    are inner products, higher ones come first, ties go to the smaller vec_id.  An anchor's positives are its first
    ``positives`` other rows of its label; a positive's negatives are the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` per cent of the positive's.  Fewer are all there are; a negative positive
    score has none.

    Rows with a null vec_id, label or vector or a null component take no part; of rows that share a vec_id the one
    with the least label and vector counts.  A shorter vector counts as followed by zeros.  An empty table gives no
    rows.  Squared norms of 2**51 or more raise, as scores wouldn't be exact.

    An anchor first looks for positives in its own subtree of the root; the last of those bounds the search of the
    others.  Every shard of a subtree has ``shard_rows`` rows at most on average, dealt by a hash of vec_id.
    """
    spark = rows.sparkSession
    good = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vec").cast("array<long>"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull()), F.lit(False)))
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("row")).select("vec_id", "row.*")
    tree = Mine(one, shard_rows)
    if tree.empty:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = tree.rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vec", "tree")
    every = float("inf")

    def search(lo: Column | float, hi: Column | float, key: Column) -> Column:
        return F.struct(key.cast("long").alias("key"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))

    own = shared.cut(_first(tree.search(anchors.withColumn("searches", F.array(search(-every, every, F.lit(0)))), positives, True, "home"), positives, "anchor_id"))
    least = own.where(F.col("rank") == positives).select("anchor_id", F.col("score").alias("least"))
    bounded = anchors.join(least, "anchor_id", "left").withColumn("searches", F.array(search(F.coalesce("least", F.lit(-every)), every, F.lit(0)))).drop("least")
    others = tree.search(bounded, positives, True, "others")
    best = shared.cut(_first(own.drop("rank").unionByName(others), positives, "anchor_id"))
    # Bounds of whole numbers: 100 * score lies in low * positive .. high * positive.
    windows = best.groupBy("anchor_id").agg(F.collect_list(search(F.ceil(low * F.col("score") / 100), F.floor(high * F.col("score") / 100), F.col("vec_id"))).alias("searches"))
    found = _first(tree.search(anchors.join(windows, "anchor_id"), negatives, False), negatives, "anchor_id", "key")
    scored = best.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
    return found.join(scored, ["anchor_id", "key"]).select(
        "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
