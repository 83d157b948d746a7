"""Operator 8: SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits the variants within half the radius; fingerprints that emit the same variant are
candidates. Half of the radius 3 is 1.5: balls of radius 1 meet for distances up to 2, and the odd bit is covered by
leaving one of three blocks of bits out of the ball. So a fingerprint emits, for each block, the other bits and their
variants by one flip: 131 keys rather than the 2081 that balls of radius 2 need.

Two fingerprints that share a key and the left-out block differ in 2 bits at most; with left-out blocks one bit apart,
in 3 at most. Every pair within distance 3 is found in one of these two ways, or has all its 3 bits in one block, and
then shares that block's flipless key. So a key's members are linked along their distinct left-out values, never pair
by pair, and each link is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, heavy_join, release_shuffles, small_batches, stash, trim_worker
from taxoforge.llm.components import components

RADIUS = 3
#: First bit and width of the blocks that are left out in turn.
BLOCKS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 3
#: Shingles hashed at a time in one document.
CHUNK = 1 << 16


def shingle_hashes(text: str, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64, seed 42, of the word shingles of a text, in chunks; A-Z lower-cased, words joined by one space."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - width + 1)
    tail = ends[min(width, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    for lo in range(0, last, CHUNK):
        spans = zip(starts[lo : min(last, lo + CHUNK)].tolist(), tail[lo : lo + CHUNK].tolist())
        yield np.array([h(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    bits = counts * 2 > n
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, th (hash of the text) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, batch.column(2)], ["doc_id", "fp", "th"])
        trim_worker()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text"))
    return texts.withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, th long")


def squeeze(fp: np.ndarray, start: int, width: int) -> np.ndarray:
    """The bits outside the block, moved together."""
    low = fp & np.uint64((1 << start) - 1)
    return low | (fp >> np.uint64(start + width) << np.uint64(start)) if start + width < 64 else low


def variants(nodes: DataFrame) -> DataFrame:
    """block, key, fp: all variants within half the radius of the distinct fingerprints fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 4096):
                fp = every[lo : lo + 4096]
                for b, (start, width) in enumerate(BLOCKS):
                    flips = np.concatenate([[0], np.uint64(1) << np.arange(64 - width, dtype=np.uint64)]).astype(np.uint64)
                    key = squeeze(fp, start, width)[:, None] ^ flips[None, :]
                    tagged = (key | np.uint64(b << 62)).ravel()  # 42 or 43 bits, so the block's number fits above
                    yield pa.RecordBatch.from_arrays([pa.array(tagged.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links_of_key(key: int, members: np.ndarray) -> list[tuple[int, int]]:
    """Verified links among the distinct fingerprints that emit a key, as many as members times a block's width."""
    block = key >> 62 & 3
    start, width = BLOCKS[block]
    own = squeeze(members, start, width)
    bare = own == np.uint64(key & ((1 << 62) - 1))
    left = (members >> np.uint64(start) & np.uint64((1 << width) - 1)).tolist()
    first: dict[int, int] = {}
    found = []
    fps = members.tolist()
    for m, fp in zip(left, fps):
        if m in first:
            found.append((first[m], fp))
        else:
            first[m] = fp
    if len(first) > 1:
        for m, fp in first.items():
            for i in range(width):
                n = m ^ (1 << i)
                if n > m and n in first:
                    found.append((fp, first[n]))
        exact = {m: fp for m, fp, x in zip(left, fps, bare.tolist()) if x}
        if len(exact) > 1:
            found.extend(within(exact, width))
    return [(a, b) for a, b in found if (a ^ b).bit_count() <= RADIUS]


def within(exact: dict[int, int], width: int) -> list[tuple[int, int]]:
    """Pairs whose left-out values are up to 3 bits apart: by flips, or against one another where they are few."""
    values = list(exact)
    if len(values) <= 64:
        return [(exact[a], exact[b]) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= RADIUS]
    one = [1 << i for i in range(width)]
    flips = [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[: i + 1]) for c in one[: j + 1]]
    return [(exact[m], exact[m ^ f]) for m in values for f in flips if m ^ f > m and m ^ f in exact]


def ball_links(nodes: DataFrame) -> DataFrame:
    """a, b: verified links between distinct fingerprints that connect all pairs within the radius.

    Keys come sorted, so a task reads them one after the other; a key's members number at most one for each flip and
    left-out value, and links are thinned per task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(k):
                continue
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            lo = np.concatenate([[0], cuts])
            hi = np.concatenate([cuts, [len(k)]])
            found: list[tuple[int, int]] = []
            for a, b in ((a, b) for a, b in zip(lo.tolist(), hi.tolist()) if a == 0 or b == len(k) or b - a > 1):
                if held and int(k[a]) != key:
                    if sum(map(len, held)) > 1:
                        found += links_of_key(key, np.concatenate(held).view(np.uint64))
                    held = []
                key = int(k[a])
                held.append(fp[a:b])
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
        if held and sum(map(len, held)) > 1 and (found := links_of_key(key, np.concatenate(held).view(np.uint64))):
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return variants(nodes).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links; th
    (hash of the text) and root (of the component's fingerprints one) tell rows and components with one id apart.

    Fingerprints link at RADIUS or fewer differing bits. Texts without words, null texts too, have fingerprint zero and
    link like others; texts of fewer than ``width`` words hash as one shingle. Equal fingerprints are one node, so
    copies cost nothing; repeated rows stay; a null doc_id stays null and names no component unless its group has no
    other. Very long texts are hashed whole, in chunks; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    marked = stash(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    found = components(stash(ball_links(nodes), "simhash-links"))
    release_shuffles(docs.sparkSession)
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = named.join(lowest, "root").select("fp", "component_id", "root")
    n_docs = marked.count()
    sizes = marked.groupBy("fp").agg(F.count("*").alias("copies"))
    out = heavy_join(marked, labels.join(sizes, "fp"), ["fp"], "copies", n_docs)
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "th", "root")
