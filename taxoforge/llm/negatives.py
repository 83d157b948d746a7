"""Operator 11: hard negatives for contrastive training, by branch and bound over ball trees.

Vectors are dealt into partitions by the upper splits of a tree that is fitted on a bounded sample, large partitions into
several by hash. Each partition becomes a ball tree: below one root for each label, halves along the direction between two far
points, every node with its centre c, radius r and smallest id. For an anchor a, the inner products of a node's vectors
lie between a.c - |a| r and a.c + |a| r. A node is left out where that range misses the anchor's score windows, or where
its upper end is strictly beneath the anchor's current kth score; what reaches a leaf is scored in integers.

Anchors meet the trees in tiles: a group of anchors and a group of trees make a task, so neither side is sent out whole.
The first pass finds each anchor's positives in trees of its label, the second the negatives in trees of all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.llm.common import stash

SCALE = 256
#: Vectors that the upper splits are fitted on, at most: the smallest by hash of the id. All vectors are indexed.
SAMPLE = 4096
#: Upper splits give at most 2**MAX_DEPTH cells.
MAX_DEPTH = 10
#: Rows of a tree, about; rows of a leaf; trees and anchors of a tile, about.
TREE_ROWS, LEAF, TILE_TREES, TILE_ANCHORS = 2048, 64, 32, 4096
#: Squared norms stay below this, so 100 times a score fits a long.
MAX_NORM2 = 2.0**56
#: Below this, sums of products are exact in double precision.
EXACT = 2.0**53
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def scaled(vectors: DataFrame, *, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, q (floor of each component times SCALE), one row for each id."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & sound)
    v = v.withColumn("q", F.transform("v", lambda x: F.floor(x * F.lit(float(SCALE)))))
    norm2 = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = v.filter(norm2 < MAX_NORM2).withColumn("q", F.col("q").cast("array<int>"))
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("low")).select("vec_id", "low.*")


def far_direction(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """From the point farthest from the point farthest from the centre, to the latter."""
    a = x[((x - centre) ** 2).sum(1).argmax()]
    return a - x[((x - a) ** 2).sum(1).argmax()]


@dataclass
class Splits:
    """Upper splits: node i has children 2i + 1 and 2i + 2, told apart by projection and threshold."""

    depth: int
    direction: np.ndarray
    threshold: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, depth: int) -> Splits:
        n = (1 << depth) - 1
        out = cls(depth, np.zeros((n, x.shape[1])), np.zeros(n))
        held = {0: np.arange(len(x))}
        for i in range(n):
            own = held.pop(i)
            along = np.zeros(0)
            if len(own):
                out.direction[i] = far_direction(x[own], x[own].mean(0))
                along = x[own] @ out.direction[i]
                out.threshold[i] = np.median(along)
            held[2 * i + 1], held[2 * i + 2] = own[along <= out.threshold[i]], own[along > out.threshold[i]]
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((x * self.direction[node]).sum(1) > self.threshold[node])
        return node - ((1 << self.depth) - 1)


@dataclass
class BallTree:
    """Rows in the order of the leaves; nodes by number, a root for each label."""

    ids: np.ndarray
    q: np.ndarray
    roots: list[tuple[int, int]] = field(default_factory=list)
    span: list[tuple[int, int]] = field(default_factory=list)
    kids: list[tuple[int, int] | None] = field(default_factory=list)
    centre: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    least: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> BallTree:
        order = np.lexsort((ids, labels))
        tree = cls(ids[order], q[order].astype(np.float64))
        names, first = np.unique(labels[order], return_index=True)
        for label, lo, hi in zip(names, first, [*first[1:], len(ids)]):
            tree.roots.append((int(label), tree.grow(int(lo), int(hi))))
        return tree

    def grow(self, lo: int, hi: int) -> int:
        """The number of a new node over the rows from lo to hi, which it puts in order."""
        x = self.q[lo:hi]
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        if (x == x[0]).all():
            centre, radius = x[0].copy(), 0.0
        me = len(self.span)
        self.span.append((lo, hi))
        self.centre.append(centre)
        self.radius.append(radius)
        self.least.append(int(self.ids[lo:hi].min()))
        self.kids.append(None)
        order = np.argsort(self.ids[lo:hi], kind="stable")
        if radius > 0 and hi - lo > LEAF:
            along = x @ far_direction(x, centre)
            order = np.argsort(along, kind="stable")
        self.ids[lo:hi], self.q[lo:hi] = self.ids[lo:hi][order], x[order]
        if radius > 0 and hi - lo > LEAF:
            mid = (lo + hi) // 2
            self.kids[me] = (self.grow(lo, mid), self.grow(mid, hi))
        return me


@dataclass
class Search:
    """Anchors, each with some windows of scores, and the k best rows found in each window so far."""

    ids: np.ndarray
    a: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.norm = np.sqrt((self.a * self.a).sum(1))
        self.score = np.full((*self.low.shape, self.k), LEAST)
        self.found = np.full((*self.low.shape, self.k), MOST)
        self.open = self.low <= self.high
        self.scored = 0

    def visit(self, tree: BallTree, node: int, at: np.ndarray) -> None:
        """Search the node for the anchors ``at``."""
        mid = self.a[at] @ tree.centre[node]
        slack = 1e-9 * self.norm[at] * (np.sqrt((tree.centre[node] ** 2).sum()) + tree.radius[node]) + 1e-6
        spread = self.norm[at] * tree.radius[node] + slack
        up, down = (mid + spread)[:, None], (mid - spread)[:, None]
        kth, name = self.score[at, :, -1], self.found[at, :, -1]
        some = self.open[at] & (up >= self.low[at]) & (down <= self.high[at]) & (up >= kth)
        if tree.radius[node] == 0 and np.abs(mid).max(initial=0) < EXACT:
            some &= (mid[:, None] > kth) | (mid[:, None] == kth) & (tree.least[node] < name)
        at = at[some.any(1)]
        if not len(at):
            return
        kids = tree.kids[node]
        if kids is None:
            self.scan(tree, node, at)
            return
        near = float((self.a[at] @ (tree.centre[kids[0]] - tree.centre[kids[1]])).mean()) >= 0
        for kid in kids if near else kids[::-1]:
            self.visit(tree, kid, at)

    def scan(self, tree: BallTree, node: int, at: np.ndarray) -> None:
        """Score a leaf's rows, ids ascending. Of equal vectors only the first k, and one for the anchor itself, can count."""
        lo, hi = tree.span[node]
        if tree.radius[node] == 0:
            hi = min(hi, lo + self.k + 1)
        x, ids = tree.q[lo:hi], tree.ids[lo:hi]
        if float(np.sqrt((x * x).sum(1).max()) * self.norm[at].max()) < EXACT:
            s = (self.a[at] @ x.T).astype(np.int64)
        else:
            s = self.a[at].astype(np.int64) @ x.astype(np.int64).T
        self.scored += s.size
        s[self.ids[at][:, None] == ids[None]] = LEAST
        r = np.arange(len(at))
        for w in range(self.low.shape[1]):
            v = np.where((s >= self.low[at, w, None]) & (s <= self.high[at, w, None]), s, LEAST)
            better = np.flatnonzero((v.max(1) > LEAST) & (v.max(1) >= self.score[at, w, -1]))
            if not len(better):
                continue
            v, own, r = v[better], at[better], np.arange(len(better))
            score, found = [self.score[own, w]], [self.found[own, w]]
            for _ in range(min(self.k, v.shape[1])):
                j = v.argmax(1)  # of equal scores the smallest id
                top = v[r, j]
                score.append(top[:, None])
                found.append(np.where(top > LEAST, ids[j], MOST)[:, None])
                v[r, j] = LEAST
            score, found = np.concatenate(score, 1), np.concatenate(found, 1)
            # Scores are above LEAST, so their negatives are longs too; LEAST itself stays the last.
            order = np.lexsort((found, np.where(score > LEAST, -score, MOST)), axis=1)[:, : self.k]
            self.score[own, w], self.found[own, w] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)

    def run(self, tree: BallTree, labels: np.ndarray, same: bool) -> None:
        for label, root in tree.roots:
            at = np.flatnonzero(labels == label if same else labels != label)
            if len(at):
                self.visit(tree, root, at)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def build_trees(rows: DataFrame, n: int) -> DataFrame:
    """tree, ids, labels, vectors (binary): the rows of each partition, in about n / TREE_ROWS partitions."""
    spark = rows.sparkSession
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / TREE_ROWS))))))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").collect()
    splits = spark.sparkContext.broadcast(Splits.fit(np.array([r["q"] for r in sample], np.float64), depth))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.value.cells(x))], ["vec_id", "label", "q", "cell"])

    dealt = stash(rows.mapInArrow(route, "vec_id long, label long, q array<int>, cell long"), "mining-cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / TREE_ROWS).alias("parts"))  # at most 2**MAX_DEPTH rows
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    dealt = dealt.join(F.broadcast(sizes), "cell").select("vec_id", "label", "q", (F.col("cell") * F.lit(1 << 40) + part).alias("tree"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        parts = (table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["q"]).astype(np.int32))
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["tree", "ids", "labels", "vectors"])

    return stash(dealt.groupBy("tree").applyInArrow(pack, "tree long, ids binary, labels binary, vectors binary"), "mining-trees")


def tiles(anchors: DataFrame, trees: DataFrame, n_anchors: int, n_trees: int, same: bool, k: int) -> DataFrame:
    """anchor_id, window (its place in the anchor's lists), vec_id, score: the k best of each tile in each window."""
    wide = max(-(-n_trees // TILE_TREES), min(n_trees, anchors.sparkSession.sparkContext.defaultParallelism))
    high = -(-n_anchors // TILE_ANCHORS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = anchors.withColumns({"row": of("anchor_id", high)}).withColumn("col", each(wide))
    right = trees.withColumns({"col": of("tree", wide)}).withColumn("row", each(high))

    def run(a: pa.Table, t: pa.Table) -> pa.Table:
        names = ["anchor_id", "window", "vec_id", "score"]
        if not a.num_rows or not t.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names)
        ids, labels, q = a["anchor_id"].to_numpy(), a["label"].to_numpy(), matrix(a["q"]).astype(np.float64)
        search = Search(ids, q, matrix(a["low"]), matrix(a["high"]), k)
        for i in np.argsort(t["tree"].to_numpy(), kind="stable"):
            own = [np.frombuffer(t[c][int(i)].as_py(), d) for c, d in (("ids", np.int64), ("labels", np.int64), ("vectors", np.int32))]
            search.run(BallTree.build(own[0], own[1], own[2].reshape(len(own[0]), -1)), labels, same)
        r, w, c = np.nonzero(search.found < MOST)
        return pa.table([pa.array(ids[r]), pa.array(w.astype(np.int32)), pa.array(search.found[r, w, c]), pa.array(search.score[r, w, c])], names)

    left = left.select("row", "col", "anchor_id", "label", "q", "low", "high").groupBy("row", "col")
    right = right.select("row", "col", "tree", "ids", "labels", "vectors").groupBy("row", "col")
    return left.cogroup(right).applyInArrow(run, "anchor_id long, window int, vec_id long, score long")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, *, every: int = 50, relabel: int | None = None, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``, positives an anchor's best rows of its own label, negatives
    of each positive the best rows of another label whose score is from ``low_percent`` to ``high_percent`` of the
    positive's. Scores are integer inner products of the components' floors times SCALE; higher first, ties by the smaller
    id. With ``relabel`` = n, rows whose id is divisible by n get the next of ten labels first.

    Null ids, labels and vectors, null and non-finite components and empty vectors take no part, nor do vectors of another
    length than the commonest (the longer on ties) or with a squared scaled norm from 2**56, whose scores need not fit a
    long; of rows that share an id one counts, the least by label and vector; zero vectors count, but a window at 0
    holds zeros only, and below 0 none; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col=id_col, vec_col=vec_col, label_col=label_col)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = stash(rows, "mining-rows")
    sizes = rows.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    rows = rows.filter(F.size("q") == sizes["d"])
    trees = build_trees(rows, sizes["count"])
    asked = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "anchor_id")
    n_anchors, n_trees = asked.count(), trees.count()
    if not n_anchors:
        return spark.createDataFrame([], OUT)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    bounds = lambda x: F.array(F.lit(x).cast("long"))
    near = tiles(asked.withColumns({"low": bounds(LEAST), "high": bounds(MOST)}), trees, n_anchors, n_trees, True, positives)
    near = best(near, positives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own"))
    near = stash(near, "mining-positives")  # lists of at most ``positives``

    def edge(percent: int, up: bool) -> Column:
        whole = F.transform("own", lambda x: x["score"] * percent)
        return F.transform(whole, lambda x: (F.ceil if up else F.floor)(x.cast("decimal(20,0)") / 100).cast("long"))

    pad = lambda c, x: F.slice(F.concat(c, F.array_repeat(F.lit(x).cast("long"), positives)), 1, positives)
    windows = asked.join(near, "anchor_id").withColumns({"low": pad(edge(low_percent, True), 1), "high": pad(edge(high_percent, False), 0)})
    far = best(tiles(windows, trees, n_anchors, n_trees, False, negatives), negatives)
    named = near.select("anchor_id", F.posexplode("own").alias("window", "positive"))
    return far.join(named, ["anchor_id", "window"]).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
