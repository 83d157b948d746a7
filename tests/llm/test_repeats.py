"""Operator 9 on 5,000 documents with planted passages around its 400 bytes, against windows hashed one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from taxoforge.llm import suffixes

WIDTH = 400
PLANTED = (350, 399, 400, 401, 900)


def windows(data, base):
    """Hashes of all windows of WIDTH bytes, modulo the prime 2**31 - 1, in one pass over the window's places."""
    out = np.zeros(max(0, len(data) - WIDTH + 1), np.int64)
    for i in range(WIDTH):
        out = (out * base + data[i : i + len(out)]) % 2147483647
    return out


def brute(texts):
    """doc: (n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [np.frombuffer(t.encode(), np.uint8).astype(np.int64) for t in texts]
    hashes = [np.stack([windows(d, b) for b in (1_000_003, 777_767_777, 99_990_001)], 1) for d in raw]
    _, at, n = np.unique(np.concatenate(hashes), axis=0, return_inverse=True, return_counts=True)
    often, lo, out = n[at.ravel()] > 1, 0, []
    for d, h in zip(raw, hashes):
        edge = np.zeros(len(d) + 1, np.int64)
        start = np.flatnonzero(often[lo : lo + len(h)])
        lo += len(h)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + WIDTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(d[~gone].astype(np.uint8).tobytes()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def planted():
    """Texts, and which of the passages each holds: of every length across two and three documents, twice inside one, some at
    the beginning or the end, some with letters of several bytes."""
    rnd = random.Random(400)
    letters = "abcdefghijklmnopqrstuvwxyz      éßñ日"

    def noise(n):
        return "".join(rnd.choices(letters, k=n))

    def passage(size):
        text = noise(size)
        while len(text.encode()) > size:
            text = text[:-1]
        return text + "x" * (size - len(text.encode()))

    texts = [noise(rnd.randrange(0, 700)) for _ in range(5000)]
    held = [[] for _ in texts]
    free = rnd.sample(range(5000), 5000)
    for size in PLANTED:
        for copies in (2, 2, 2, 3):
            p = passage(size)
            for c in range(copies):
                i = free.pop()
                at = (0, len(texts[i]), rnd.randrange(len(texts[i]) + 1))[c]
                texts[i] = texts[i][:at] + "<{|"[c] + p + ">}~"[c] + texts[i][at:]  # no two have a neighbour in common
                held[i].append(size)
        for _ in range(3):
            i, p = free.pop(), passage(size)
            texts[i] = f"{texts[i]}[{p}]{noise(30)}({p})"
            held[i].append(size)
    return texts, held


def test_planted_passages(spark, planted):
    texts, held = planted
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.cut_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    long = [sum(s >= WIDTH for s in h) for h in held]
    assert all((got[i][1] > 0) == (n > 0) for i, n in enumerate(long))
    assert Counter(got[i][1] for i, h in enumerate(held) if h == [400]) == {400: 9, 800: 3}
    assert Counter(got[i][1] for i, h in enumerate(held) if h == [900]) == {900: 9, 1800: 3}
