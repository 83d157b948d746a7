"""Measures of a class graph: concept similarity, group robustness, edit distances between graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxoforge.operators.graph import ancestor_subgraph, edge_difference
from taxoforge.scratch import heavy_join, stash


def wu_palmer(members: DataFrame, strict: DataFrame, depth: DataFrame) -> DataFrame:
    """a, b, sim for a < b of members (node): twice the depth, from 1, of the deepest common proper ancestor over the
    sum of both depths, from 1; 0 without a common one."""
    d = depth.select("node", (F.col("depth") + 1).alias("d"))
    own = members.select("node").distinct().join(d, "node")
    up = own.join(strict.filter("node <> anc"), "node").join(d.select(F.col("node").alias("anc"), F.col("d").alias("da")), "anc").select("node", "anc", "da")
    best = up.select(F.col("node").alias("a"), "anc", "da").join(up.select(F.col("node").alias("b"), "anc"), "anc").filter("a < b").groupBy("a", "b").agg(F.max("da").alias("da"))
    left, right = own.select(F.col("node").alias("a"), F.col("d").alias("d1")), own.select(F.col("node").alias("b"), F.col("d").alias("d2"))
    pairs = left.join(right, F.col("a") < F.col("b"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", F.coalesce(2 * F.col("da") / (F.col("d1") + F.col("d2")), F.lit(0.0)).alias("sim"))


#: Classes of a block; two blocks meet in one task, as matrices.
BLOCK_NODES = 1000
#: Pairs that a task takes when they are counted in order.
PART_PAIRS = 1 << 20


def node_blocks(nodes: DataFrame, strict: DataFrame, depth: DataFrame, vectors: DataFrame, block_nodes: int = BLOCK_NODES) -> tuple[DataFrame, int]:
    """block, items (d: depth from 1, vec, up: proper ancestors with their depths) of the nodes (node) that have vectors."""
    d = depth.select("node", (F.col("depth") + 1).alias("d"))
    own = stash(nodes.select("node").distinct().join(d, "node").join(vectors.select("node", F.col("vec").cast("array<double>").alias("vec")), "node"), "sim-nodes")
    n = max(1, -(-own.count() // block_nodes))
    above = strict.filter("node <> anc").select("node", "anc").join(d.select(F.col("node").alias("anc"), F.col("d").alias("da")), "anc")
    up = own.select("node").join(above, "node").groupBy("node").agg(F.collect_list(F.struct(F.xxhash64("anc").alias("anc"), "da")).alias("up"))
    rows = own.join(up, "node", "left").select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("block"), F.struct("d", "vec", "up").alias("item"))
    return stash(rows.groupBy("block").agg(F.collect_list("item").alias("items")), "sim-blocks"), n


def deepest_common(a: list[list[dict]], b: list[list[dict]]) -> np.ndarray:
    """Depth of the deepest ancestor that two nodes share, 0 without any, for the ancestors of two blocks of nodes."""
    best = np.zeros((len(a), len(b)))
    levels: dict[int, dict[int, int]] = {}
    for one in (*a, *b):
        for u in one:
            own = levels.setdefault(u["da"], {})
            own.setdefault(u["anc"], len(own))
    for level, ids in sorted(levels.items()):  # deeper ones last, over what is there
        sides = []
        for block in (a, b):
            m = np.zeros((len(block), len(ids)), np.float32)
            for i, one in enumerate(block):
                for u in one:
                    if u["da"] == level:
                        m[i, ids[u["anc"]]] = 1
            sides.append(m)
        best[sides[0] @ sides[1].T > 0] = level
    return best


def similarity_pairs(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """x, y for all pairs of nodes: cosine similarity of their vectors, Wu-Palmer similarity in the graph, to nine places.
    Two blocks at a time, as matrices; a pair is two numbers, without its names."""
    left = blocks.withColumn("with", F.explode(F.sequence("block", F.lit(n_blocks - 1))))
    right = blocks.select(F.col("block").alias("with"), F.col("items").alias("others"))
    both = left.join(right, "with").select((F.col("block") == F.col("with")).alias("same"), "items", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, a, b in zip(*(batch.column(i) for i in range(3))):
                a, b = a.as_py(), b.as_py()
                va, vb = (np.array([r["vec"] for r in z]) for z in (a, b))
                da, db = (np.array([r["d"] for r in z], float) for z in (a, b))
                x = va @ vb.T
                y = 2 * deepest_common([r["up"] or [] for r in a], [r["up"] or [] for r in b]) / (da[:, None] + db[None, :])
                at = np.triu_indices(len(a), 1) if same.as_py() else (slice(None), slice(None))
                x, y = np.round(x[at].ravel(), 9), np.round(y[at].ravel(), 9)
                for lo in range(0, len(x), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]), pa.array(y[lo : lo + 100_000])], ["x", "y"])

    return both.mapInArrow(run, "x double, y double")


def similarity_histogram(nodes: DataFrame, strict: DataFrame, depth: DataFrame) -> DataFrame:
    """sim, pairs: how many pairs of nodes have which Wu-Palmer similarity, to six places."""
    flat = nodes.select("node", F.array(F.lit(0.0)).alias("vec"))
    pairs = similarity_pairs(*node_blocks(nodes, strict, depth, flat))
    return pairs.groupBy(F.round("y", 6).alias("sim")).agg(F.count("*").alias("pairs"))


def kendall_score(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Concordant less discordant pairs, pairs equal in x, pairs equal in y, in n log n: discordant pairs are the exchanges
    of a merge sort by y of what is sorted by x."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]

    def ties(*cols: np.ndarray) -> int:
        if not n:
            return 0
        new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        sizes = np.diff(np.concatenate([[0], np.flatnonzero(new) + 1, [n]]))
        return int((sizes * (sizes - 1) // 2).sum())

    width = 64  # small blocks at once
    rows = np.concatenate([y, np.full(-n % width, np.inf)]).reshape(-1, width)
    swaps = sum(int((rows[:, :-i] > rows[:, i:]).sum()) for i in range(1, width))
    cur = np.sort(rows, axis=1).ravel()[:n]
    while width < n:
        for lo in range(0, n, 2 * width):
            a, b = cur[lo : lo + width], cur[lo + width : lo + 2 * width]
            if len(b):
                swaps += int((len(a) - np.searchsorted(a, b, side="right")).sum())
                cur[lo : lo + 2 * width] = np.sort(cur[lo : lo + 2 * width], kind="stable")
        width *= 2
    total, tx, txy = n * (n - 1) // 2, ties(x), ties(x, y)
    ty = ties(np.sort(y))
    return total - tx - ty + txy - 2 * swaps, tx, ty


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b of two columns of one machine."""
    score, tx, ty = kendall_score(x, y)
    return tau_of(len(x), score, tx, ty)


def tau_of(n: int, score: int, tx: int, ty: int) -> float:
    total = n * (n - 1) // 2
    denominator = np.sqrt(float(total - tx)) * np.sqrt(float(total - ty))
    return float(score / denominator) if denominator else float("nan")


def tau_b(pairs: DataFrame, part_pairs: int = PART_PAIRS) -> tuple[int, float]:
    """Number of rows and tau-b of the columns x and y.

    Rows are cut into ranges of x, equal ones together. Inside a range they are compared by a merge sort; rows of two
    ranges compare as their ranges do, so the counts of each y by range are enough. The driver gets those counts:
    y must take few values, as Wu-Palmer similarities do, which are quotients of depths.
    """
    pairs = stash(pairs.select("x", "y"), "tau-pairs")
    n = pairs.count()
    parts = max(1, -(-n // part_pairs))
    rows = stash(pairs.repartitionByRange(parts, "x").select("x", "y", F.spark_partition_id().alias("part")), "tau-ranges")
    counts = rows.groupBy("part", "y").agg(F.count("*").alias("c")).toPandas()

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *kendall_score(pdf["x"].to_numpy(), pdf["y"].to_numpy())[:2])], columns=["part", "score", "tx"])

    inside = rows.groupBy("part").applyInPandas(kernel, "part int, score long, tx long").agg(F.coalesce(F.sum("score"), F.lit(0)), F.coalesce(F.sum("tx"), F.lit(0))).first()
    ys = np.unique(counts["y"].to_numpy(float)) if n else np.zeros(0)
    below, score = np.zeros(len(ys), object), int(inside[0])
    for _, own in sorted(counts.groupby("part"), key=lambda x: x[0]):
        here = np.zeros(len(ys), object)
        here[np.searchsorted(ys, own["y"].to_numpy(float))] = [int(c) for c in own["c"]]
        less = np.cumsum(below) - below
        score += int((here * (less - (below.sum() - below - less))).sum()) if len(ys) else 0
        below = below + here
    ty = int(sum(c * (c - 1) // 2 for c in below))
    return n, tau_of(n, score, int(inside[1]), ty)


def concept_correlation(nodes: DataFrame, vectors: DataFrame, strict: DataFrame, depth: DataFrame) -> DataFrame:
    """One row, n and tau: Kendall's tau-b between the similarities of vectors and of places in the graph, over all pairs
    of the nodes (node) that have a vector."""
    n, tau = tau_b(similarity_pairs(*node_blocks(nodes, strict, depth, vectors)))
    return nodes.sparkSession.createDataFrame([(n, tau)], "n long, tau double")


def sample_rounds(nodes: DataFrame, rounds: int, size: int, seed: int = 42) -> DataFrame:
    """round, node: for each round the ``size`` nodes of least hash with that round's seed."""
    out = None
    for r in range(rounds):
        one = nodes.select(F.lit(r).alias("round"), "node").orderBy(F.xxhash64(F.col("node"), F.lit(seed + r)), "node").limit(size)
        out = one if out is None else out.unionByName(one)
    return out


def sampled_correlation(vectors: DataFrame, strict: DataFrame, depth: DataFrame, rounds: int = 50, size: int = 20_000, seed: int = 42) -> DataFrame:
    """One row: rounds, mean_tau, std_tau (population) over rounds of sampled nodes; one exact round if a sample holds all."""
    if size >= vectors.select("node").distinct().count():
        rounds = 1
    picks = stash(sample_rounds(vectors.select("node"), rounds, size, seed), "rounds")
    taus = None
    for r in range(rounds):
        one = concept_correlation(picks.filter(F.col("round") == r), vectors, strict, depth)
        taus = one if taus is None else taus.unionByName(one)
    return taus.agg(F.count("*").alias("rounds"), F.avg("tau").alias("mean_tau"), F.stddev_pop("tau").alias("std_tau"))


def leaf_groups(edges: DataFrame) -> DataFrame:
    """grp, node: each class with its childless children."""
    inner = edges.select(F.col("parent").alias("child")).distinct()
    return edges.join(inner, "child", "left_anti").select(F.col("parent").alias("grp"), F.col("child").alias("node")).distinct()


#: Vectors of least hash around which others gather, so that blocks are compact; each block's ball bounds its products.
PIVOTS = 32
#: Room for rounding in bounds of products.
ROUNDING = 1e-9


def _near_pivots(given: DataFrame, keys: list[str], block_rows: int, total: int) -> DataFrame:
    """given with block: its nearest pivot, and a part by hash where that has too many rows of a group."""
    pivots = [r["vec"] for r in given.select("vec", F.xxhash64("vec").alias("h")).distinct().orderBy("h").limit(PIVOTS).collect()]
    cells = lambda n: F.least(F.lit(PIVOTS), F.ceil(n / block_rows)).cast("int")  # noqa: E731  a small group needs few
    counts = given.groupBy(*keys).agg(F.count("*").alias("group_n"))
    kinds = ", ".join(f"{c} {t}" for c, t in given.dtypes)
    given = (heavy_join(given, counts, keys, "group_n", total) if keys else given.withColumn("group_n", F.lit(total))).withColumn("cells", cells(F.col("group_n"))).drop("group_n")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = np.array(pivots)
        for pdf in batches:
            if len(pdf):
                far = (p * p).sum(1)[None] - 2 * np.stack(pdf["vec"]) @ p.T
                far[np.arange(len(p))[None] >= pdf["cells"].to_numpy()[:, None]] = np.inf
                yield pdf.drop(columns="cells").assign(cell=far.argmin(1))

    near = stash(given.mapInPandas(gather, kinds + ", cell int"), "ball-cells")
    sizes = near.groupBy(*keys, "cell").agg(F.count("*").alias("weight"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("weight") / block_rows))
    cut = heavy_join(near, sizes, [*keys, "cell"], "weight", total)
    return cut.withColumn("block", F.col("cell") * F.lit(1 << 40) + F.pmod(F.xxhash64("node"), F.col("parts")))


def ball_blocks(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """keys, block, n, dim, vecs (binary), centre, radius, far (length of the centre): the vectors
    of rows (keys, node, vec) in blocks of about ``block_rows``, by nearest pivot and hash, so that none grows with its
    group."""
    given = rows.select(*keys, "node", F.col("vec").cast("array<double>").alias("vec"))
    total = given.count()
    if total <= block_rows:  # every group is one block
        cut = given.withColumn("block", F.lit(0).cast("long"))
    else:
        cut = _near_pivots(given, keys, block_rows, total)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf["vec"])
        c = v.mean(0)
        ball = {"n": len(v), "dim": v.shape[1], "vecs": v.tobytes(), "centre": c, "radius": float(np.sqrt(((v - c) ** 2).sum(1).max())), "far": float(np.sqrt((c * c).sum()))}
        return pd.DataFrame([dict(zip([*keys, "block"], key)) | ball])

    own = ", ".join(f"{c} {t}" for c, t in given.dtypes if c in keys)
    return cut.groupBy(*keys, "block").applyInPandas(pack, f"{own}{', ' if own else ''}block long, n long, dim int, vecs binary, centre array<double>, radius double, far double")


#: Bytes of vectors of a tile's side, and sides that a grid is cut into at least: up to GRID * TILE_BYTES of vectors each block
#: is sent to GRID tiles, so what is shuffled grows with the vectors, not with their pairs.
TILE_BYTES, GRID = 32 << 20, 8
BALL = ["block", "n", "dim", "vecs", "centre", "radius", "far"]


def _sides(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sides, blocks: into how many sides of tiles the blocks of a key are cut."""
    size = blocks.groupBy(*keys).agg(F.sum(F.col("n") * F.col("dim") * 8).alias("size"), F.count("*").alias("blocks"))
    return size.select(*keys, F.greatest(F.least("blocks", F.lit(GRID)), F.ceil(F.col("size") / TILE_BYTES), F.lit(1)).cast("int").alias("sides"), "blocks")


def _tiles(a: DataFrame, b: DataFrame, keys: list[str], half: bool, kernel: Callable[[pa.Table, pa.Table, bool], list[tuple]], schema: str) -> DataFrame:
    """What ``kernel`` makes of (blocks of a, blocks of b, whether both are the same) for the tiles of a grid for each key;
    with ``half``, a and b are one table and a tile is not mirrored. A tile is a row of two tasks' inputs, never of pairs."""
    names = [c.split()[0] for c in schema.split(", ")]
    if keys:
        total = a.count()
        sides = stash(_sides(a, keys), "grid").select(*keys, F.col("sides").alias("a_sides"), "blocks")
        own = sides if half else stash(_sides(b, keys), "grid").select(*keys, F.col("sides").alias("b_sides"), F.col("blocks").alias("b_blocks")).join(sides, keys)
        own = own.withColumn("b_sides", F.col("a_sides")) if half else own
        a = heavy_join(a, own.select(*keys, "a_sides", "b_sides", "blocks"), keys, "blocks", total)
        b = a if half else heavy_join(b, own.select(*keys, "a_sides", "b_sides", F.col("b_blocks").alias("blocks")), keys, "blocks", b.count())
    else:
        wide = [_sides(x, []).first()["sides"] for x in (a, b)]
        a, b = (x.withColumns({"a_sides": F.lit(wide[0]), "b_sides": F.lit(wide[1])}) for x in (a, b))
    rest = [c for c in ("grp", "bar") if c in a.columns and c not in keys]
    at = lambda x, n: F.pmod(F.xxhash64(*[c for c in ("grp", "block") if c in x.columns]), F.col(n)).cast("int")
    left = a.withColumn("ta", at(a, "a_sides")).withColumn("tb", F.explode(F.sequence(F.col("ta") if half else F.lit(0), F.col("b_sides") - 1)))
    right = b.withColumn("tb", at(b, "b_sides")).withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("tb") if half else F.col("a_sides") - 1)))
    left, right = left.select(*keys, "ta", "tb", *rest, *BALL), right.select(*[F.col(c).alias(c) for c in (*keys, "ta", "tb", *BALL)])

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        got = kernel(x, y, half and key[-2].as_py() == key[-1].as_py()) if len(x) and len(y) else []
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [[]] * len(names), types)], names)

    types = [x.type for x in _arrow(a.sparkSession, schema)]
    return left.groupBy(*keys, "ta", "tb").cogroup(right.groupBy(*keys, "ta", "tb")).applyInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


class Balls:
    """The blocks of a tile's side; vectors are looked at where they lie."""

    def __init__(self, t: pa.Table) -> None:
        self.n, self.radius, self.far, self.block = (np.array(t.column(c).to_pylist()) for c in ("n", "radius", "far", "block"))
        self.centre = np.array(t.column("centre").to_pylist())
        self.vecs = [np.frombuffer(v.as_buffer()).reshape(-1, d.as_py()) for v, d in zip(t.column("vecs"), t.column("dim"))]

    def bounds(self, other: Balls, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Between what all products of block i with each of the other side's blocks lie."""
        mid = other.centre @ self.centre[i]
        reach = self.far[i] * other.radius + other.far * self.radius[i] + self.radius[i] * other.radius + ROUNDING
        return mid - reach, mid + reach


def _group_blocks(groups: DataFrame, vectors: DataFrame, block_rows: int) -> DataFrame:
    g = groups.select("grp", "node").distinct().join(vectors.select("node", "vec"), "node")
    return stash(ball_blocks(g, ["grp"], block_rows), "grp-blocks")


def _least_inside(blocks: DataFrame) -> DataFrame:
    def least(x: pa.Table, y: pa.Table, same: bool) -> list[tuple]:
        """Pairs of blocks by their lower bounds, until these lie above what is found: first of all by single vectors."""
        a, b = Balls(x), Balls(y)
        low = np.stack([a.bounds(b, i)[0] for i in range(len(a.n))])
        keep = a.block[:, None] <= b.block[None] if same else np.ones_like(low, bool)
        apart = keep & (a.block[:, None] != b.block[None])
        seen = np.array([v[0] for v in a.vecs]) @ np.array([v[0] for v in b.vecs]).T
        bar, found = seen[apart].min() if apart.any() else np.inf, np.inf
        for at in np.argsort(low, axis=None):
            i, j = divmod(int(at), low.shape[1])
            if not keep[i, j]:
                continue
            if low[i, j] > min(bar, found):
                break
            sim = a.vecs[i] @ b.vecs[j].T
            sim = sim[np.triu_indices(len(sim), 1)] if a.block[i] == b.block[j] else sim
            found = min(found, float(sim.min()) if sim.size else np.inf)
        return [(x.column("grp")[0].as_py(), found)]

    kind = dict(blocks.dtypes)["grp"]
    low = _tiles(blocks, blocks, ["grp"], True, least, f"grp {kind}, low double").groupBy("grp").agg(F.min("low").alias("cohesion"))
    n = blocks.groupBy("grp").agg(F.sum("n").alias("n"))
    return n.join(low, "grp").filter("n >= 2").select("grp", "n", "cohesion")


def cohesion(groups: DataFrame, vectors: DataFrame, block_rows: int = 2048) -> DataFrame:
    """grp, n, cohesion: least similarity inside each group of two or more (groups: grp, node), block by block."""
    return _least_inside(_group_blocks(groups, vectors, block_rows))


def intruder_counts(members: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """grp, h, pairs, multiplied: how many products of members' vectors with others are above their group's bar. Blocks whose
    balls lie above it altogether are counted, those below left out, and only the rest is multiplied."""

    def above(x: pa.Table, y: pa.Table, _: bool) -> list[tuple]:
        a, b, out = Balls(x), Balls(y), {}
        for i, (grp, bar) in enumerate(zip(x.column("grp").to_pylist(), x.column("bar").to_pylist())):
            low, high = a.bounds(b, i)
            sure = low > bar + ROUNDING
            some = ~sure & ~(high < bar)
            h = int(a.n[i] * b.n[sure].sum()) + sum(int(np.count_nonzero(a.vecs[i] @ b.vecs[j].T > bar + 1e-12)) for j in np.flatnonzero(some))
            had = out.get(grp, (0, 0, 0))
            out[grp] = (had[0] + h, had[1] + int(a.n[i] * b.n.sum()), had[2] + int(a.n[i] * b.n[some].sum()))
        return [(g, *v) for g, v in out.items()]

    return _tiles(members, others, keys, False, above, f"grp {dict(members.dtypes)['grp']}, h long, pairs long, multiplied long")


def robustness(groups: DataFrame, vectors: DataFrame, block_rows: int = 2048, sample: int | None = None, seed: int = 42) -> DataFrame:
    """grp, n, cohesion, intruders, robustness per group of two or more.

    Intruders are pairs of a member and an outside vector more similar than the group's cohesion. Vectors are cut into
    blocks of ``block_rows`` with a ball around each; only blocks whose balls leave it open are multiplied, two at a time, so
    no pair becomes a row. Groups' own members are counted with the outsiders at first, and taken off again. With ``sample``
    only the outsiders of least hash are looked at and the count is scaled up.
    """
    return _robustness(groups, vectors, block_rows, sample, seed)[0]


def robustness_work(groups: DataFrame, vectors: DataFrame, block_rows: int = 2048) -> DataFrame:
    """One row: pairs of vectors, and how many of them robustness multiplies."""
    looked = _robustness(groups, vectors, block_rows, None, 0)[1]
    return looked.agg(F.sum("pairs").alias("pairs"), F.sum("multiplied").alias("multiplied"))


def _robustness(groups: DataFrame, vectors: DataFrame, block_rows: int, sample: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    g = stash(groups.select("grp", "node").join(vectors.select("node"), "node", "left_semi").distinct(), "groups")
    blocks = _group_blocks(g, vectors, block_rows)
    coh = stash(_least_inside(blocks), "cohesion")
    chars = stash(g.select("node").distinct().join(vectors.select("node", "vec"), "node"), "characters")
    n_all = chars.count()
    outside = chars if sample is None else chars.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(sample)
    outside = stash(outside, "outside")
    n_out = outside.count()
    members = stash(blocks.join(coh.select("grp", F.col("cohesion").alias("bar")), "grp"), "members")
    others = stash(ball_blocks(outside, [], block_rows), "others")
    seen = g.join(outside.select("node"), "node", "left_semi").join(coh.select("grp"), "grp", "left_semi")
    own = blocks if sample is None else _group_blocks(seen, vectors, block_rows)

    def hits(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("grp").agg(F.sum("h").alias(name))

    open_counts = stash(intruder_counts(members, others, []), "intruders")
    inner = intruder_counts(members, own, ["grp"])
    own_out = seen.groupBy("grp").agg(F.count("*").alias("own_out"))
    j = coh.join(hits(open_counts, "hits"), "grp", "left").join(hits(inner, "inner"), "grp", "left").join(own_out, "grp", "left").fillna(0, ["hits", "inner", "own_out"])
    scale = (F.lit(n_all) - F.col("n")) / (F.lit(n_out) - F.col("own_out"))
    raw = F.col("hits") - F.col("inner")
    intruders = raw if sample is None else F.when(F.lit(n_out) > F.col("own_out"), raw * scale).otherwise(F.lit(0.0))
    room = F.col("n") * (F.lit(n_all) - F.col("n"))
    return j.select("grp", "n", "cohesion", intruders.alias("intruders"), F.when(room > 0, 1 - intruders / room).alias("robustness")), open_counts


def sampled_robustness(groups: DataFrame, vectors: DataFrame, rounds: int = 10, sample: int | None = 10_000, seed: int = 42) -> DataFrame:
    """grp, n, cohesion, intruders, robustness of the last round, with rounds, mean and std (population) of the rounds' overall
    robustness; one exact round if the sample holds all outsiders, or is None."""
    if sample is None or sample >= groups.join(vectors.select("node"), "node", "left_semi").select("node").distinct().count():
        rounds = 1
    scores, last = None, None
    for r in range(rounds):
        last = stash(robustness(groups, vectors, sample=sample, seed=seed + r), "robust")
        one = overall_robustness(last).select("robustness")
        scores = one if scores is None else scores.unionByName(one)
    over = scores.agg(F.count("*").alias("rounds"), F.avg("robustness").alias("mean"), F.stddev_pop("robustness").alias("std"))
    return last.crossJoin(F.broadcast(over))


def overall_robustness(per_group: DataFrame) -> DataFrame:
    """One row: groups, robustness (mean, 0 without any), std (population)."""
    return per_group.filter("robustness is not null").agg(F.count("*").alias("groups"), F.coalesce(F.avg("robustness"), F.lit(0.0)).alias("robustness"), F.stddev_pop("robustness").alias("std"))


def extremes(per_group: DataFrame, n: int = 3) -> DataFrame:
    """The n least and n most robust groups with their places."""
    scored = per_group.filter("robustness is not null")
    worst = scored.orderBy("robustness", "grp").limit(n).withColumn("kind", F.lit("worst"))
    best = scored.orderBy(F.desc("robustness"), "grp").limit(n).withColumn("kind", F.lit("best"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "worst", F.col("robustness")).otherwise(-F.col("robustness")), "grp"))
    return worst.unionByName(best).withColumn("place", place)


def pairwise_edit_distance(models: dict[str, DataFrame], tops: list[str]) -> DataFrame:
    """top, model_a, model_b, ged: distances between the models' descendant graphs of each top class."""
    from taxoforge.operators.graph import reachable_part

    out = None
    names = sorted(models)
    for top in tops:
        parts = {m: stash(reachable_part(models[m], top), "ged") for m in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                one = edge_difference(parts[a], parts[b]).select(F.lit(top).alias("top"), F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "ged")
                out = one if out is None else out.unionByName(one)
    return out


def ancestor_edit_distance(models: dict[str, DataFrame], cls: str) -> DataFrame:
    """model_a, model_b, ged between the models' ancestor graphs of a class."""
    out, names = None, sorted(models)
    parts = {m: stash(ancestor_subgraph(models[m], cls), "ged") for m in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one = edge_difference(parts[a], parts[b]).select(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "ged")
            out = one if out is None else out.unionByName(one)
    return out
