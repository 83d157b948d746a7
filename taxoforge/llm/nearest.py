"""Operator 2: approximate nearest neighbours by score-aware quantisation.

Vectors are product-quantised with four bits per subspace. The code books minimise an anisotropic loss, in which the
part of the residual that is parallel to the vector weighs more than the rest, as it moves inner products more. With a
vector's exact norm beside its code, inner products rank squared distances: |x|^2 - 2 q.x. A query scans the codes of a
block of vectors through tables of its inner products with the code words, two codes at a time, and reranks the best
exactly, in double precision, against the original vectors that lie in the same block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.llm.common import stash

#: Vectors that the code books are fitted on, at most: the smallest by hash of the id. All vectors are indexed.
SAMPLE = 20_000
CODES = 16
WIDTH = 2
#: Weight of parallel error comes from this share of the norm as score threshold.
THRESHOLD = 0.2
SWEEPS, ROUNDS = 2, 8
BLOCK = 4096
#: Distinct vectors of a block reranked per query.
RERANK = 96
#: Queries sent to the executors at a time.
QUERY_BLOCK = 4096
SEED = 3


@dataclass
class Books:
    """Code words, by subspace; eta weighs the parallel part of the residual."""

    words: np.ndarray
    eta: float

    @property
    def dim(self) -> int:
        return len(self.words) * WIDTH

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on ||r||^2 + (eta - 1) (r . u)^2, u being x over its norm."""
        n, s = len(x), len(self.words)
        parts = x.reshape(n, s, WIDTH)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = np.zeros((n, s), np.uint8)
        along = np.zeros((n, s))
        for j in range(s):
            r = parts[:, j, None, :] - self.words[j][None]
            codes[:, j] = (r * r).sum(2).argmin(1)
            along[:, j] = (r[np.arange(n), codes[:, j]] * unit[:, j]).sum(1)
        total = along.sum(1)
        for _ in range(SWEEPS):
            for j in range(s):
                r = parts[:, j, None, :] - self.words[j][None]
                a = (r * unit[:, j, None, :]).sum(2)
                rest = total - along[:, j]
                cost = (r * r).sum(2) + (self.eta - 1) * (rest[:, None] + a) ** 2
                codes[:, j] = cost.argmin(1)
                along[:, j] = a[np.arange(n), codes[:, j]]
                total = rest + along[:, j]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Code words that minimise the loss at the given codes, one subspace after the other."""
        n, s = codes.shape
        parts = x.reshape(n, s, WIDTH)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        along = np.stack([((parts[:, j] - self.words[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(s)], 1)
        for j in range(s):
            rest = along.sum(1) - along[:, j]
            outer = np.eye(WIDTH)[None] + (self.eta - 1) * unit[:, j, :, None] * unit[:, j, None, :]
            goal = np.einsum("nab,nb->na", outer, parts[:, j]) + (self.eta - 1) * rest[:, None] * unit[:, j]
            for c in range(CODES):
                at = codes[:, j] == c
                if at.any():
                    self.words[j, c] = np.linalg.lstsq(outer[at].sum(0), goal[at].sum(0), rcond=None)[0]
            along[:, j] = ((parts[:, j] - self.words[j][codes[:, j]]) * unit[:, j]).sum(1)


def fit_books(sample: np.ndarray) -> Books:
    """Code books of the sample's vectors, padded to an even number of subspaces."""
    n, d = sample.shape
    s = -(-d // WIDTH)
    s += s % 2
    x = np.zeros((n, s * WIDTH))
    x[:, :d] = sample
    rng = np.random.default_rng(SEED)
    words = np.stack([x[rng.integers(0, n, CODES), j * WIDTH : (j + 1) * WIDTH] for j in range(s)])
    words += rng.normal(0, 1e-6, words.shape)
    books = Books(words, max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)))
    for _ in range(ROUNDS):
        books.refit(x, books.encode(x))
    return books


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (double): not null, not zero, no null or non-finite component."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    return v.filter(sound & F.exists("v", lambda e: e != 0))


INDEX = "n int, ids binary, codes binary, norms binary, vectors binary"


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Books | None, int]:
    """Blocks of at most BLOCK vectors with ids, packed four-bit codes, squared norms and the vectors themselves; the
    code books; the dimension. Vectors of another length than the commonest one (the longer on ties) take no part."""
    good = usable(vectors, id_col, vec_col)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], INDEX), None, 0
    d = sizes["d"]
    good = good.filter(F.size("v") == d)
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    books = fit_books(np.array([r["v"] for r in rows]))
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d)
                order = np.argsort(ids, kind="stable")
                ids, v = ids[order], v[order]
                x = np.zeros((len(ids), sent.value.dim))
                x[:, :d] = v
                c = sent.value.encode(x)
                packed = c[:, 0::2] << 4 | c[:, 1::2]
                norms = (v * v).sum(1)
                row = [pa.array([len(ids)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, packed, norms, v))]
                yield pa.RecordBatch.from_arrays(row, ["n", "ids", "codes", "norms", "vectors"])

    return stash(good.mapInArrow(run, INDEX), "nn-index"), books, d


def scan(books: Books, q: np.ndarray, ids: np.ndarray, packed: np.ndarray, norms: np.ndarray, v: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: the ids and exact distances of a block's k nearest, ties to smaller ids.

    Equal vectors are scanned and reranked once, so that copies can't crowd out what is nearer; ids ascend.
    """
    _, first, same = np.unique(v.view(f"V{v.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    by_value = np.argsort(same, kind="stable")
    bound = np.concatenate([[0], np.cumsum(np.bincount(same))])
    codes, size = np.ascontiguousarray(packed[first].T).astype(np.intp), norms[first]
    wide = np.zeros((len(q), books.dim))
    wide[:, : q.shape[1]] = q
    parts = wide.reshape(len(q), len(books.words), WIDTH)
    tables = np.einsum("qsw,scw->qsc", parts, books.words)
    pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES).astype(np.float32)
    keep = min(max(RERANK, 2 * k), len(first))
    for i in range(len(q)):
        got = np.zeros(len(first), np.float32)
        for j in range(len(codes)):
            got += pairs[i, j][codes[j]]
        rank = size - 2 * got
        best = np.argpartition(rank, keep - 1)[:keep] if keep < len(first) else np.arange(len(first))
        diff = v[first[best]] - q[i]
        dist = np.sqrt((diff * diff).sum(1))
        order = np.argsort(dist, kind="stable")
        out_ids, out_dist, found, edge = [], [], 0, -1.0
        for b in order:
            if found >= k and dist[b] > edge:
                break
            own = ids[by_value[bound[best[b]] : bound[best[b] + 1]]]
            own = own[own != query_ids[i]][:k]
            out_ids.append(own)
            out_dist.append(np.full(len(own), dist[b]))
            found, edge = found + len(own), dist[b]
        a, e = np.concatenate(out_ids), np.concatenate(out_dist)
        top = np.lexsort((a, e))[:k]
        yield int(query_ids[i]), a[top], e[top]


def nearest(vectors: DataFrame, *, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    Score is the Euclidean distance in double precision; nearest first, ties to the smaller id; a query's own id is no
    candidate; queries with fewer candidates get all. Null, zero, empty and non-finite vectors take no part, nor do null
    ids or vectors of an odd length; repeated rows count once per row, of a query's the least vector asks; an empty table gives no rows; other columns are
    not read. Queries go out in blocks of bounded size, each against all blocks of the index.
    """
    index, books, d = build_index(vectors, id_col=id_col, vec_col=vec_col)
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = stash(usable(vectors, id_col, vec_col).filter((F.size("v") == d) & (F.pmod("vec_id", F.lit(every)) == 0)).groupBy("vec_id").agg(F.min("v").alias("v")), "nn-queries")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = []
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((books, np.array([r["v"] for r in rows]), np.array([r["vec_id"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books, q, query_ids = sent.value
            for batch in batches:
                for n, ids, codes, norms, v in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    block = (np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint8).reshape(n, -1), np.frombuffer(norms), np.frombuffer(v).reshape(n, d))
                    got = list(scan(books, q, *block, query_ids, k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(a), i) for i, a, _ in got])), pa.array(np.concatenate([a for _, a, _ in got])), pa.array(np.concatenate([e for _, _, e in got]))],
                        ["query_id", "vec_id", "score"],
                    )

        part = index.mapInArrow(run, schema)
        found.append(stash(part, "nn-found") if n_blocks > 1 else part)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every_one = found[0]
    for part in found[1:]:
        every_one = every_one.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every_one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
