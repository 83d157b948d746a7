"""Vectorized words and hashes over batches of texts: numpy passes over bytes in place of loops over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums whose differences are the polynomial hashes of all substrings."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end): equal bytes, equal values, wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of bytes."""
    word = np.concatenate([[False], ~IS_SPACE[buf], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def text_batches(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...] = (0,), text: int = 1) -> Iterator[tuple[list[list], list[bytes]]]:
    """Rows regrouped by size: the values of ``columns``, and the texts as UTF-8."""
    held: list[list] = [[] for _ in columns]
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for row in range(batch.num_rows):
            for h, c in zip(held, columns):
                h.append(batch.column(c)[row].as_py())
            texts.append(batch.column(text)[row].as_py().encode("utf-8"))
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield held, texts
                held, texts, size = [[] for _ in columns], [], 0
    if texts:
        yield held, texts


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a new line after each text, and where each text starts, with the buffer's end."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return buf, starts
