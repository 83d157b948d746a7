"""Operator 9: exact substring dedup by a depth-limited radix sort of suffixes.

Suffixes matter only through their first DEPTH bytes, their windows; equal windows are what is repeated. Sorting all
windows byte by byte would move every window through every pass, so windows travel in groups: the least hash of a
DIGIT-byte string in a window picks its anchor, equal windows pick equal anchors at equal places, and neighbouring
windows share one. The passes go from the most significant digit on, each comparing more bytes, and each sends on only
what is still together with something else:

1. by the DIGIT bytes at the anchor: anchors alone there have no repeated windows;
2. by all the bytes of an anchor's windows (its context): equal contexts repeat in all their windows, and one of each
   kind goes on for those that differ;
3. by what the windows of BLOCK neighbouring places have in common, and by all their bytes: as in 1 and 2;
4. by the windows themselves, DEPTH bytes: equal groups are exactly the repeated windows.

Digits are compared by two 64-bit hashes, one of them of the anchor's string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, drop_stash, heavy_join, release_shuffles, small_batches, stash
from taxoforge.llm.textnum import prefix_hash, span_hash

DEPTH = 400
DIGIT = 128
BLOCK = 16
#: Windows of a text anchored at a time; its bits in a key hold the place.
PIECE_BITS = 22
#: Lists are sent to all executors up to this many bytes, at ENTRY_BYTES an entry; beyond, texts are shuffled to them.
SENT_BYTES, ENTRY_BYTES = 32 << 20, 64


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of the least, by its upper bits; the leftmost on ties."""
    n = len(h)
    mask = np.uint64((1 << (PIECE_BITS + 2)) - 1)
    key = np.full(n + -n % width, np.uint64(2**64 - 1))
    key[:n] = (h & ~mask) | np.arange(n, dtype=np.uint64)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & mask).astype(np.int64)


def anchors(data: bytes, depth: int = DEPTH, digit: int = DIGIT) -> Iterator[tuple[int, int, int, int, int]]:
    """(first window, windows, place of the anchor in the first window, hash of its string, hash of the context)."""
    piece = 1 << PIECE_BITS
    for begin in range(0, len(data) - depth + 1, piece):
        part = data[begin : begin + piece + depth - 1]
        buf = np.frombuffer(part, np.uint8)
        at = np.arange(len(buf) - digit + 1)
        best = least_places(span_hash(prefix_hash(buf), at, at + digit), depth - digit + 1)
        cut = np.flatnonzero(best[1:] != best[:-1]) + 1
        first = np.concatenate([[0], cut])
        count = np.diff(np.concatenate([first, [len(best)]]))
        for lo, n, a in zip(first.tolist(), count.tolist(), best[first].tolist()):
            yield begin + lo, n, a - lo, xxhash.xxh3_64_intdigest(part[a : a + digit], 1), xxhash.xxh3_64_intdigest(part[lo : lo + n - 1 + depth], a - lo)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def find_anchors(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """doc_id, th, lo, n, off, kh, fh for docs (doc_id, text, th: hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, hashes, rows = [], [], []
                for doc, text, th in zip(*(batch.slice(lo, 256).column(i) for i in range(3))):
                    own = list(anchors(text.as_py().encode("utf-8"), depth, digit))
                    rows += own
                    ids += [doc.as_py()] * len(own)
                    hashes += [th.as_py()] * len(own)
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), *(pa.array(x, pa.int32()) for x in c[:3]), _signed(c[3]), _signed(c[4])], ["doc_id", "th", "lo", "n", "off", "kh", "fh"])

    return docs.mapInArrow(run, "doc_id long, th long, lo int, n int, off int, kh long, fh long")


def gather_contexts(docs: DataFrame, wanted: DataFrame, n_wanted: int, depth: int = DEPTH) -> DataFrame:
    """kh, fh, off, n, context for the classes ``wanted`` (kh, fh, doc_id, th, lo, n, off): bytes of their windows."""
    lists = wanted.groupBy(F.col("doc_id").alias("list_id"), F.col("th").alias("list_th")).agg(F.collect_list(F.struct("kh", "fh", "lo", "n", "off")).alias("own"))
    both = docs.join(F.broadcast(lists) if n_wanted * ENTRY_BYTES <= SENT_BYTES else lists, F.col("doc_id").eqNullSafe(F.col("list_id")) & (F.col("th") == F.col("list_th"))).select("text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for text, own in zip(*(batch.slice(lo, 64).column(i) for i in range(2))):
                    data = text.as_py().encode("utf-8")
                    rows += [(x["kh"], x["fh"], x["off"], x["n"], data[x["lo"] : x["lo"] + x["n"] - 1 + depth]) for x in own.as_py()]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["kh", "fh", "off", "n", "context"])

    return both.mapInArrow(run, "kh long, fh long, off int, n int, context binary")


def block_rows(contexts: DataFrame, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """kh, fh, r1, r2, core, span: hashes of what the windows at places r1 to r2 before the anchor share and span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for kh, fh, off, n, context in zip(*(batch.column(i).to_pylist() for i in range(5))):
                least = off - n + 1
                for r in range(least - least % block, off + 1, block):
                    r1, r2 = max(r, least), min(r + block - 1, off)
                    rows.append((kh, fh, r1, r2, h(context[off - r : off - r - block + 1 + depth], r), h(context[off - r2 : off - r1 + depth], r1 << 32 | r2)))
            c = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), _signed(c[4]), _signed(c[5])], ["kh", "fh", "r1", "r2", "core", "span"])

    return contexts.mapInArrow(run, "kh long, fh long, r1 int, r2 int, core long, span long")


def window_rows(contexts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kh, fh, r, wh for contexts with r1 and r2: hashes of the single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kh, fh, off, context, r1, r2 in zip(*(batch.column(i).to_pylist() for i in range(6))):
                rows += [(kh, fh, r, xxhash.xxh3_64_intdigest(context[off - r : off - r + depth], r)) for r in range(r1, r2 + 1)]
            c = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), _signed(c[3])], ["kh", "fh", "r", "wh"])

    return contexts.select("kh", "fh", "off", "context", "r1", "r2").mapInArrow(run, "kh long, fh long, r int, wh long")


def repeated_places(docs: DataFrame, found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kh, fh, copies, places (null: all; else ranges r1 to r2): the classes of anchors with repeated windows."""
    classes = stash(found.groupBy("kh", "fh").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "lo", "n", "off")).alias("rep")), "sfx-classes")
    release_shuffles(docs.sparkSession)
    groups = classes.groupBy("kh").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    mixed = heavy_join(classes, groups, ["kh"], "kinds", classes.count())
    mixed = stash(mixed.select("kh", "fh", "rep.*"), "sfx-mixed")
    n_mixed = mixed.count()
    contexts = stash(gather_contexts(docs, mixed, n_mixed, depth).dropDuplicates(["kh", "fh"]), "sfx-contexts")
    blocks = stash(block_rows(contexts, depth), "sfx-blocks")
    release_shuffles(docs.sparkSession)
    spans = blocks.groupBy("kh", "core", "span").agg(F.count("*").alias("m"), F.min(F.struct("fh", "r1", "r2")).alias("rep"))
    spans = stash(spans, "sfx-spans")
    n_blocks = blocks.count()
    same = heavy_join(blocks.select("kh", "core", "span", "fh", "r1", "r2"), spans.filter("m > 1").select("kh", "core", "span", "m"), ["kh", "core", "span"], "m", n_blocks).select("kh", "fh", "r1", "r2")
    cores = spans.groupBy("kh", "core").agg(F.count("*").alias("s")).filter("s > 1")
    split = heavy_join(spans, cores, ["kh", "core"], "s", spans.count()).select("kh", "rep.*", "m")
    split = stash(split, "sfx-split")
    release_shuffles(docs.sparkSession)
    windows = window_rows(contexts.join(split.select("kh", "fh", "r1", "r2"), ["kh", "fh"]), depth)
    windows = stash(windows, "sfx-windows")
    equal = windows.groupBy("kh", "wh").agg(F.count("*").alias("w")).filter("w > 1")
    alike = heavy_join(windows, equal, ["kh", "wh"], "w", windows.count()).select("kh", "fh", F.col("r").alias("r1"), F.col("r").alias("r2"))
    ranges = same.unionByName(alike).groupBy("kh", "fh").agg(F.collect_set(F.struct("r1", "r2")).alias("places"))
    whole = classes.filter("copies > 1").select("kh", "fh", "copies", F.lit(None).cast("array<struct<r1: int, r2: int>>").alias("places"))
    single = ranges.join(classes.filter("copies = 1").select("kh", "fh", "copies"), ["kh", "fh"]).select("kh", "fh", "copies", "places")
    out = stash(whole.unionByName(single), "sfx-places")
    for t in (contexts, blocks, spans, split, windows, mixed, classes):
        drop_stash(t)
    release_shuffles(docs.sparkSession)
    return out


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, digit: int = DIGIT, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, on demand, kept.

    Removed is each byte of a ``depth``-byte string that starts anywhere else too, in the same document or another, as
    the input stands. Texts are UTF-8; null or empty: no bytes. Repeated rows are repeats of one another. Rows are told
    apart by doc_id and a 64-bit hash of the text, so no list grows with the rows of one id; null ids are ids like others. Very long texts are anchored piece by piece and come out
    whole; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    found = stash(find_anchors(texts, depth, digit), "sfx-anchors")
    places = repeated_places(texts, found, depth)
    hits = heavy_join(found, places, ["kh", "fh"], "copies", found.count())
    # windows at r before the anchor begin at lo + off - r
    ranges = F.transform("places", lambda p: F.struct((F.col("lo") + F.col("off") - p["r2"]).alias("s"), (F.col("lo") + F.col("off") - p["r1"] + depth).alias("e")))
    one = F.array(F.struct(F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + depth).alias("e")))
    spans = hits.select("doc_id", "th", F.explode(F.when(F.col("places").isNull(), one).otherwise(ranges)).alias("x"))
    lists = stash(spans.groupBy(F.col("doc_id").alias("list_id"), F.col("th").alias("list_th")).agg(F.collect_set("x").alias("cuts")), "sfx-cuts")
    for t in (found, places):
        drop_stash(t)
    release_shuffles(docs.sparkSession)
    n_lists = lists.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    both = texts.join(F.broadcast(lists) if n_lists * ENTRY_BYTES <= SENT_BYTES else lists, F.col("doc_id").eqNullSafe(F.col("list_id")) & (F.col("th") == F.col("list_th")), "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for doc, text, cuts in zip(*(batch.slice(lo, 256).column(i) for i in range(3))):
                    data = text.as_py().encode("utf-8")
                    kept, n_spans = data, 0
                    if cuts.is_valid:
                        parts, at = [], 0
                        for s, e in sorted((x["s"], x["e"]) for x in cuts.as_py()):
                            if s > at or not n_spans:
                                parts.append(data[at:s])
                                n_spans += 1
                            at = max(at, e)
                        if n_spans:
                            kept = b"".join(parts) + data[at:]
                    rows.append((doc.as_py(), len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
                c = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + with_bytes]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else ""))
