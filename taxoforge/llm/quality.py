"""Operator 1: quality classifier.

Words get random-indexing vectors: a word's context vector is the sum of the fixed sparse ternary index vectors of its
neighbours in the training sample. Units are hashed words and, so that unseen words have vectors too, word shapes (kinds
of characters and length). A document pools them: the mean of both, the mean product of adjacent index vectors, which
tells repetition, and the spread. A two-layer numpy network scores the pool; a temperature fitted on a part of the
sample held back from training calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, small_batches, stash, trim_worker
from taxoforge.llm.textnum import BATCH_BYTES, LOWER, join_texts, prefix_hash, span_hash, text_batches, word_spans

#: Labelled documents that the vectors and the network learn from, at most: a documented bound, the smallest by hash.
SAMPLE_DOCS = 6000
CUT = 0.3
DIM = 48
WORDS, SHAPES = 1 << 14, 1 << 11
WINDOW = 2
HIDDEN = 24
SEED = 11

_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
_KIND = np.full(256, 1 << 5, np.uint8)  # other signs
_KIND[0x61:0x7B] = 1 << 0
_KIND[0x41:0x5B] = 1 << 1
_KIND[0x30:0x3A] = 1 << 2
_KIND[0x80:] = 1 << 3
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 1 << 4
_KIND[[ord(c) for c in "!*#$%&@^~"]] = 1 << 6
_KIND[[ord(c) for c in "|<>{}[]=/\\"]] = 1 << 7


def index_vectors(seed: int = SEED) -> np.ndarray:
    """A sparse ternary vector per unit: the same for all, made from the seed."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    rows = np.arange(len(out))
    for sign in (1, -1, 1, -1):
        out[rows, rng.integers(0, DIM, len(out))] += sign
    return out


@dataclass
class Units:
    """Words of a batch of texts: hashed word, shape, and the first word of each text."""

    word: np.ndarray
    shape: np.ndarray
    first: np.ndarray


def units_of(texts: list[bytes]) -> Units:
    buf, starts = join_texts(texts)
    a, b = word_spans(buf)
    if not len(a):
        return Units(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    word = (span_hash(prefix_hash(LOWER[buf]), a, b) % np.uint64(WORDS)).astype(np.int64)
    kinds = np.bitwise_or.reduceat(_KIND[buf] * ~np.isin(buf, (0x20, 0x0A)), a).astype(np.int64)
    size = np.minimum(np.log2(b - a).astype(np.int64), 7)
    return Units(word, WORDS + kinds * 8 + size, np.searchsorted(a, starts))


def context_sums(u: Units, index: np.ndarray, out: np.ndarray) -> None:
    """Add each unit's neighbours' index vectors, within a text and WINDOW words, to its row of out."""
    n = len(u.word)
    if not n:
        return
    text = np.repeat(np.arange(len(u.first) - 1), np.diff(u.first))
    both = index[u.word] + index[u.shape]
    near = np.zeros_like(both)
    for step in range(1, WINDOW + 1):
        same = (text[step:] == text[: n - step])[:, None]
        near[: n - step] += both[step:] * same
        near[step:] += both[: n - step] * same
    for units in (u.word, u.shape):
        order = np.argsort(units, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(units[order]) != 0]))
        out[units[order[first]]] += np.add.reduceat(near[order], first)


def normalize(sums: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(size, 1e-6)).astype(np.float32)


def pieces(text: bytes, size: int = BATCH_BYTES) -> Iterator[bytes]:
    """A text cut at white space into pieces of ``size`` bytes or, where a word is longer, one word more."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = _BLANK.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def pool_sums(u: Units, vectors: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row per text: words; sums of word vectors, shape vectors, products of adjacent index vectors, index vectors and
    adjacent equal words. Memory goes with the words of the batch."""
    n_texts = len(u.first) - 1
    count = np.diff(u.first)
    full = np.flatnonzero(count)
    out = np.zeros((n_texts, 4 * DIM + 1), np.float64)
    if len(full):
        at = u.first[full]
        ends = u.first[full + 1] - 1
        out[full, :DIM] = np.add.reduceat(vectors[u.word], at)
        out[full, DIM : 2 * DIM] = np.add.reduceat(vectors[u.shape], at)
        own = index[u.word]
        out[full, 3 * DIM : 4 * DIM] = np.add.reduceat(own, at)
        own[:-1] *= own[1:]
        own[ends] = 0
        out[full, 2 * DIM : 3 * DIM] = np.add.reduceat(own, at)
        same = np.zeros(len(u.word), np.float32)
        same[:-1] = u.word[1:] == u.word[:-1]
        same[ends] = 0
        out[full, -1] = np.add.reduceat(same, at)
    return count, out


def pool_of(count: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, mean shape vector, mean product of adjacent words' index vectors, spread."""
    out = np.zeros((len(count), 4 * DIM + 2), np.float32)
    full = np.flatnonzero(count)
    mean = sums[full] / count[full, None]
    out[full, : 3 * DIM] = mean[:, : 3 * DIM]
    out[full, 3 * DIM : 4 * DIM] = mean[:, 3 * DIM : 4 * DIM] ** 2
    out[full, -2] = np.log1p(count[full])
    out[full, -1] = mean[:, -1]
    return out


def pooled_texts(texts: list[bytes], vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The pools of texts: short ones together, long ones piece by piece, so that memory is that of a piece."""
    counts, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), 4 * DIM + 1))
    short = [i for i, t in enumerate(texts) if len(t) <= 2 * BATCH_BYTES]
    counts[short], sums[short] = pool_sums(units_of([texts[i] for i in short]), vectors, index)
    for i, t in enumerate(texts):
        if len(t) > 2 * BATCH_BYTES:
            last = None
            for part in pieces(t):
                u = units_of([part])
                if not len(u.word):
                    continue
                n, one = pool_sums(u, vectors, index)
                counts[i] += n[0]
                sums[i] += one[0]
                if last is not None:  # the two words on both sides of the cut
                    sums[i, 2 * DIM : 3 * DIM] += index[last] * index[u.word[0]]
                    sums[i, -1] += last == u.word[0]
                last = u.word[-1]
    return pool_of(counts, sums)


@dataclass
class Network:
    """Standardized inputs, tanh layer, logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Each row is a product of its own, so that equal rows give equal logits whatever stands beside them in a batch."""
        w1, b1, w2, b2 = self.weights
        z = (((x - self.mean) / self.scale).astype(w1.dtype)[:, None, :] @ w1)[:, 0, :]
        return (np.tanh(z + b1)[:, None, :] @ w2[:, None])[:, 0, 0] + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = SEED) -> Network:
    """Fit by Adam on four fifths of the rows; the epoch of least loss and the temperature come from the last fifth."""
    net = Network(x.mean(0) if len(x) else np.zeros(0), x.std(0) + 1e-3 if len(x) else np.ones(0))
    if len(x) < 20 or y.min() == y.max():
        net.prior = float(y.mean()) if len(y) else 1.0
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net.weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    z = ((x - net.mean) / net.scale).astype(np.float64)
    m, v, t = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    best = (np.inf, net.weights)
    for _ in range(epochs):
        rng.shuffle(used)
        for lo in range(0, len(used), 64):
            at = used[lo : lo + 64]
            w1, b1, w2, b2 = net.weights
            h = np.tanh(z[at] @ w1 + b1)
            g = (1 / (1 + np.exp(-(h @ w2 + b2))) - y[at]) / len(at)
            back = np.outer(g, w2) * (1 - h * h)
            grads = [z[at].T @ back + decay * w1, back.sum(0), h.T @ g + decay * w2, g.sum()]
            t += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                net.weights[i] = net.weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        now = loss(net.logits(x[held]), y[held])
        if now < best[0]:
            best = (now, list(net.weights))
    net.weights = best[1]
    logits = net.logits(x[held])
    net.temperature = float(min(np.exp(np.linspace(np.log(0.3), np.log(6), 120)), key=lambda s: loss(logits / s, y[held])))
    return net


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text"), *more)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that no label is learned from: crc32 of the id as text divides by 5; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[bytes], index: np.ndarray) -> np.ndarray:
        return self.network.score(pooled_texts(texts, self.vectors, index))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from at most ``sample_docs`` labelled documents that aren't held out, the smallest by hash of the id.

    Of rows that repeat an id one text is learned from, the least by hash. Two passes over the sample, both on the executors: context vectors, summed as one matrix of fixed size per task,
    then the pools of the labelled documents. The driver gets those matrices and pools, whose sizes are bounded.
    """
    chosen = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_docs)
    sample = _texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    one = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))  # one row an id
    sample = stash(one.select("doc_id", "text", "label"), "quality-sample")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((WORDS + SHAPES, DIM), np.float32)
        seen = False
        for _, texts in text_batches(batches):
            seen = True
            context_sums(units_of([t for t in texts if len(t) <= 2 * BATCH_BYTES]), index, sums)
            for t in texts:
                if len(t) > 2 * BATCH_BYTES:  # neighbours are looked for within a piece
                    for part in pieces(t):
                        context_sums(units_of([part]), index, sums)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])
        trim_worker()

    total = np.zeros((WORDS + SHAPES, DIM), np.float32)
    for row in sample.select("doc_id", "text").coalesce(4).mapInArrow(contexts, "sums binary").toLocalIterator():
        total += np.frombuffer(row["sums"], np.float32).reshape(total.shape)
    vectors = normalize(total)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for (ids, labels_), texts in text_batches(batches, (0, 2)):
            x = pooled_texts(texts, sent.value, index)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels_, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    rows = sorted(sample.mapInArrow(pools, "doc_id long, label int, x binary").collect())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 4 * DIM + 2)
    return Model(vectors, train(x, np.array([r["label"] for r in rows], np.float64)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier of good quality), predicted (1 if score >= ``cut``).

    Whole texts are read, however long, those of over 2 * BATCH_BYTES piece by piece. Null and wordless texts get the score of an empty pool; repeated rows stay,
    each with the same score; a null id counts as held out; without labels of both kinds every score is the labels'
    mean, or 1 without any; an empty table gives no rows. Only the text is an input.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for (ids,), texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sent.value.score(texts, index), pa.float64())], ["doc_id", "score"])
        trim_worker()

    out = _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` scored at or above ``cut``, with their columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts, size = [], 0
                while lo + len(texts) < batch.num_rows and size < BATCH_BYTES:
                    texts.append((batch.column(at)[lo + len(texts)].as_py() or "").encode("utf-8"))
                    size += len(texts[-1])
                keep = sent.value.score(texts, index) >= cut
                yield batch.slice(lo, len(texts)).filter(pa.array(keep))
                lo += len(texts)
        trim_worker()

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
