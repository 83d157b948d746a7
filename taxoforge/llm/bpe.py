"""Operator 13: byte-level BPE encoding and decoding.

A text is cut into the matches of a pattern, and each match is encoded by itself: starting from its bytes, the leftmost
pair of neighbours whose joined bytes have the least rank becomes one token, until no neighbours have a rank. Distinct
matches of a batch lie in numpy matrices, one for each range of lengths, padded at the right. In each round every row
merges its leftmost pair of least rank; the row then is one token shorter, so the matrix stays a matrix with one column
less, and rows without a pair to merge leave. Ranks of pairs come from a hash table with open addressing; after a merge only
the two pairs around it are looked up again. Nothing is shuffled; a lost executor repeats its texts.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, small_batches, trim_worker
from taxoforge.llm.textnum import mix

#: No rank: sorts behind every rank.
NONE = np.iinfo(np.int32).max
#: Widths of the matrices; longer matches are merged one by one through a heap.
WIDTHS = [2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256]
#: Tokens of a matrix at most.
CELLS = 1 << 19
#: Distinct matches that a Python worker remembers; then it starts anew.
CACHE_PIECES = 500_000
#: Bytes of text encoded at a time.
CHUNK_BYTES = 1 << 20


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] of all places ``at``, one after the other."""
    n = length[at].astype(np.int64)
    return flat[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class PairTable:
    """Rank of the token that two tokens make together, in a hash table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = self.key(left, right)
        size = 1 << max(4, int(4 * len(keys) - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.ranks = np.zeros(size, np.uint64), np.full(size, NONE, np.int32)
        slot = mix(keys) & self.mask
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            _, first = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Never 0, so that 0 marks a free slot."""
        return (left.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | right.astype(np.uint64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of all pairs, NONE for those that make no token and for padding (-1)."""
        out = np.full(left.shape, NONE, np.int32).ravel()
        at = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = self.key(left.ravel()[at], right.ravel()[at])
        slot = mix(keys) & self.mask
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != 0)
            at, keys, slot = at[on], keys[on], (slot[on] + np.uint64(1)) & self.mask
        return out.reshape(left.shape)


class Vocabulary:
    """Tokens by id (which is their rank), the ids of single bytes and the table of pairs.

    The file has a line for each token: its bytes in base 64, a space and its rank. Every split of a token into two tokens
    is a pair, as ranks are looked up by joined bytes.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        self.known = np.zeros(size, bool)
        for t, r in ranks.items():
            tokens[r], self.known[r] = t, True
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(splits, np.int64).reshape(-1, 3).T)
        self.ranks, self.tokens = ranks, tokens

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """The final tokens of each row; rows are padded with -1 at the right."""
        out = np.full_like(rows, -1)
        at = np.arange(len(rows))
        ranks = self.pairs(rows[:, :-1], rows[:, 1:])
        while rows.shape[1] > 1 and len(at):
            j = ranks.argmin(1)  # of equal ranks the leftmost
            best = ranks[np.arange(len(at)), j]
            over = best == NONE
            if over.any():
                out[at[over], : rows.shape[1]] = rows[over]
                at, rows, ranks, j, best = at[~over], rows[~over], ranks[~over], j[~over], best[~over]
                if not len(at):
                    break
            r = np.arange(len(at))
            rows[r, j] = best
            keep = np.ones(rows.shape, bool)
            keep[r, j + 1] = False
            rows = rows[keep].reshape(len(at), -1)
            keep = np.ones(ranks.shape, bool)
            keep[r, j] = False
            ranks = ranks[keep].reshape(len(at), -1)
            x = np.flatnonzero(j > 0)
            ranks[x, j[x] - 1] = self.pairs(rows[x, j[x] - 1], rows[x, j[x]])
            x = np.flatnonzero(j < ranks.shape[1])
            ranks[x, j[x]] = self.pairs(rows[x, j[x]], rows[x, j[x] + 1])
        out[at, : rows.shape[1]] = rows
        return out

    def merge_long(self, row: np.ndarray) -> np.ndarray:
        """The final tokens of one long row. Rounds would cost the square of its length, so its pairs wait in a heap, by rank
        and place, and places of merged tokens are skipped by links."""
        ids, ranks = row.tolist(), self.pairs(row[:-1], row[1:])
        n = len(ids)
        left, right, dead = list(range(-1, n - 1)), list(range(1, n + 1)), len(self.tokens)
        at = np.flatnonzero(ranks != NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), row[at].tolist(), row[at + 1].tolist()))
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (rank := self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j == n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = rank, dead, right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return np.array([x for x in ids if x != dead], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in ``pieces``, their tokens one piece after the other, and each piece's number of tokens."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        start = np.cumsum(size) - size
        bucket = np.searchsorted(WIDTHS, size)
        for b in np.unique(bucket):
            at = np.flatnonzero(bucket == b)
            if b == len(WIDTHS):
                for i in at:
                    ids = self.merge_long(flat[start[i] : start[i] + size[i]].copy())
                    yield np.array([i]), ids, np.array([len(ids)])
                continue
            width = WIDTHS[b]
            for lo in range(0, len(at), CELLS // width):
                some = at[lo : lo + CELLS // width]
                rows = np.full((len(some), width), -1, np.int32)
                rows[np.arange(width) < size[some, None]] = gather(flat, start, size, some)
                rows = self.merge_rows(rows)
                yield some, rows[rows >= 0], (rows >= 0).sum(1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes; an id that the vocabulary lacks raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.flat, self.start, self.length, ids).tobytes()


class Encoder:
    """Ids of whole texts; each distinct match is merged once as long as it is remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.reset()

    def reset(self) -> None:
        pending: list[str] = []

        class Index(dict):
            def __missing__(self, piece: str) -> int:
                self[piece] = i = len(self)
                pending.append(piece)
                return i

        self.index, self.pending = Index(), pending
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Merge what was met for the first time."""
        known = len(self.start)
        self.start, self.length = (np.concatenate([x, np.zeros(len(self.pending), np.int64)]) for x in (self.start, self.length))
        for at, ids, n in self.vocabulary.encode_pieces([p.encode("utf-8") for p in self.pending]):
            end = self.used + len(ids)
            while len(self.flat) < end:
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : end] = ids
            self.start[known + at], self.length[known + at] = self.used + np.cumsum(n) - n, n
            self.used = end
        self.pending.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE_PIECES:
            self.reset()
        at = []
        for t in texts:
            pieces = self.pattern.findall(t)
            at.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
        self._learn()
        return [gather(self.flat, self.start, self.length, a) for a in at]


_encoders: dict[tuple[str, str], Encoder] = {}
_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Loaded once in a Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(vocabulary(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the tokens of each whole text, without special tokens.

    Null and empty texts have no tokens; a null id stays null; repeated rows are encoded each for itself; an empty table
    gives no rows; other columns of ``docs`` are not read. ``ranks_path`` must name the same file on all executors.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)

        def chunks() -> Iterator[tuple[list[int | None], list[str]]]:
            doc_ids, texts, size = [], [], 0
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    doc_ids.append(doc.as_py())
                    texts.append(text.as_py())
                    size += len(texts[-1])
                    if size >= CHUNK_BYTES:
                        yield doc_ids, texts
                        doc_ids, texts, size = [], [], 0
            if doc_ids:
                yield doc_ids, texts

        for doc_ids, texts in chunks():
            ids = enc.encode(texts)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], ["doc_id", "ids"])
        trim_worker()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, decoded (binary): the bytes that the ids stand for. A null list gives null, an empty one no bytes; an id
    that the vocabulary lacks, or a null one in a list, raises. Rows are decoded each for itself."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                lists = part.column(1)
                if lists.flatten().null_count:
                    raise ValueError("a list holds a null id")
                out = [vocab.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])
        trim_worker()

    given = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
