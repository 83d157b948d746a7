"""Operator 5: media columns with content-defined chunking.

A payload of 8-bit samples is stored as a WAVE file. Its bytes are cut where a rolling gear hash says so; chunks are
named by digest, and a Spark join over the digests decides which medium stores a chunk that several hold. A medium is
its header and the ordered list of its chunks' digests; reading puts the chunks together again and verifies the whole
against the digest taken when it was made.

Only narrow rows (digests, ids) are shuffled to decide who stores what. Payload bytes are written once, in the second
scan, by the document that owns them; reading shuffles the bytes of shared chunks and of the media that borrow them, and
no others.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, heavy_join, release_shuffles, small_batches, stash

ALIGN = 64
RATE = 8000
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 256, 1024, 8192
GEAR_WINDOW = 32
GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
#: The list of exceptions to "store everything" is sent to all executors up to this size, beyond it is joined.
ORDERS_BYTES = 32 << 20


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 with zeros up to a positive multiple of ALIGN, and the bytes before the padding."""
    raw = text.encode("utf-8")
    return raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN)), len(raw)


def wave_header(n: int) -> bytes:
    """Header of a mono 8-bit PCM file of n samples."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def samples_of(media: bytes) -> bytes:
    """The samples of a file that ``wave_header`` begins."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or media[36:40] != b"data":
        raise ValueError("not a WAVE file of this store")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def gear_cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash at a byte sums the GEAR_WINDOW bytes up to it, each shifted by its distance;
    it is built by doubling, and a chunk ends where its top bits are zero, within MIN_CHUNK and MAX_CHUNK."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < GEAR_WINDOW:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    bits = MEAN_CHUNK.bit_length() - 1
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, at, i, n = [], 0, 0, len(data)
    while n - at > MIN_CHUNK:
        i = int(np.searchsorted(marks, at + MIN_CHUNK))
        end = min(int(marks[i]) if i < len(marks) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    return ends + [n] if at < n else ends


@dataclass
class Medium:
    header: bytes
    chunks: list[bytes]
    digests: list[bytes]
    sha: bytes
    n_bytes: int


def medium_of(text: str) -> Medium:
    payload, n = payload_of(text)
    ends = gear_cuts(payload)
    chunks = [payload[a:b] for a, b in zip([0, *ends], ends)]
    header = wave_header(len(payload))
    return Medium(header, chunks, [hashlib.blake2b(c, digest_size=16).digest() for c in chunks], hashlib.sha256(header + payload).digest(), n)


def catalogue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First scan: doc_id, th (hash of the text), n_bytes, media_sha, header, digests (the ordered list, 16 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [medium_of(t.as_py()) for t in batch.column(1)]
            cols = [batch.column(0), batch.column(2), pa.array([x.n_bytes for x in m], pa.int64()), pa.array([x.sha for x in m], pa.binary()), pa.array([x.digests for x in m], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n_bytes", "media_sha", "digests"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, th long, n_bytes long, media_sha binary, digests array<binary>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text")).withColumn("th", F.xxhash64("text"))


def storing_orders(listed: DataFrame) -> DataFrame:
    """Exceptions to "store all your chunks", one row per document's text that has any: doc_id, th, orders (store
    it or not, chunks to lend, chunks to borrow). A medium belongs to the smallest (doc_id, text) holding it, as unlike texts
    may have one payload where zeros end them; a shared chunk belongs to the smallest medium."""
    own = F.min(F.struct("doc_id", "th")).alias("owner")
    media = listed.groupBy("media_sha").agg(own, F.first("digests").alias("digests"))
    refs = media.select("media_sha", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = refs.groupBy("digest").agg(F.count("*").alias("holders"), F.min("media_sha").alias("keeper")).filter("holders > 1")
    n_refs = refs.count()
    known = heavy_join(refs, shared, ["digest"], "holders", n_refs)
    lends = known.groupBy("media_sha").agg(
        F.collect_list(F.when(F.col("media_sha") == F.col("keeper"), F.col("digest"))).alias("lend"),
        F.collect_list(F.when(F.col("media_sha") != F.col("keeper"), F.col("digest"))).alias("borrow"),
    )
    owned = media.select("media_sha", "owner").join(lends, "media_sha").select("owner.doc_id", "owner.th", "media_sha", F.lit(True).alias("store"), "lend", "borrow")
    copies = listed.groupBy("media_sha").agg(F.count("*").alias("copies"), own).filter("copies > 1")
    others = heavy_join(listed.select("doc_id", "th", "media_sha"), copies, ["media_sha"], "copies", listed.count()).filter(~F.struct("doc_id", "th").eqNullSafe(F.col("owner")))
    empty = F.array().cast("array<binary>")
    others = others.select("doc_id", "th", "media_sha", F.lit(False).alias("store"), empty.alias("lend"), empty.alias("borrow"))
    return owned.unionByName(others).groupBy("doc_id", "th").agg(F.collect_set(F.struct("media_sha", "store", "lend", "borrow")).alias("orders"))


STORE = "media_sha binary, header binary, digests array<binary>, own array<struct<digest: binary, data: binary>>, lend array<struct<digest: binary, data: binary>>, borrow array<binary>"


def store(docs: DataFrame, orders: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Second scan: the rows of the chunk store, a medium's own chunks beside its list, shared ones in ``lend``."""
    left = _texts(docs, id_col, text_col)
    size = orders.agg(F.coalesce(F.sum(F.lit(64) + F.size("orders") * 64 + F.expr("aggregate(orders, 0, (n, o) -> n + size(o.lend) + size(o.borrow))") * 20), F.lit(0))).first()[0]
    right = orders.select(F.col("doc_id").alias("order_id"), F.col("th").alias("order_th"), "orders")
    both = left.join(F.broadcast(right) if size <= ORDERS_BYTES else right, F.col("doc_id").eqNullSafe(F.col("order_id")) & (F.col("th") == F.col("order_th")), "left").select("text", "orders")
    pair = pa.struct([("digest", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = []
                for text, given in zip(*(batch.slice(lo, 128).column(i) for i in range(2))):
                    m = medium_of(text.as_py())
                    o = next((x for x in given.as_py() or () if x["media_sha"] == m.sha), None)
                    if o and not o["store"]:
                        continue
                    lend, borrow = set(o["lend"] if o else ()), set(o["borrow"] if o else ())
                    data = dict(zip(m.digests, m.chunks))
                    own = [{"digest": d, "data": c} for d, c in data.items() if d not in lend and d not in borrow]
                    rows.append((m.sha, m.header, m.digests, own, [{"digest": d, "data": data[d]} for d in lend], sorted(borrow)))
                if rows:
                    kinds = (pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pair), pa.list_(pair), pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["media_sha", "header", "digests", "own", "lend", "borrow"])

    return both.mapInArrow(run, STORE)


def features(media: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of a file as read back."""
    payload = samples_of(media)
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    text = f"mean={x.sum() / len(x):.6f};rms={np.sqrt((x * x).sum() / len(x)):.6f};crossings={crossings}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), text


FEATURES = "media_sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(stored: DataFrame) -> DataFrame:
    """A row per medium: reads its chunks back in order, verifies the digest (ValueError if it differs or a chunk is
    missing), computes features.

    Media that borrow nothing are read where they lie. The rest gather borrowed chunks by a join on the digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, header, digests, chunks in zip(*(batch.column(i) for i in range(4))):
                data = {x["digest"]: x["data"] for x in chunks.as_py()}
                if missing := [d for d in digests.as_py() if d not in data]:
                    raise ValueError(f"medium {sha.as_py().hex()} misses {len(missing)} chunks")
                media = header.as_py() + b"".join(data[d] for d in digests.as_py())
                if hashlib.sha256(media).digest() != sha.as_py():
                    raise ValueError(f"medium {sha.as_py().hex()} reads back changed")
                rows.append((sha.as_py(), *features(media)))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in FEATURES.split(", ")])

    here = stored.select("media_sha", "header", "digests", F.concat("own", "lend").alias("chunks"), "borrow")
    whole = here.filter(F.size("borrow") == 0).select("media_sha", "header", "digests", "chunks")
    partly = here.filter(F.size("borrow") > 0)
    asked = partly.select("media_sha", F.explode("borrow").alias("digest"))
    lent = stored.select(F.inline("lend")).groupBy("digest").agg(F.first("data").alias("data"))
    counts = asked.groupBy("digest").agg(F.count("*").alias("askers"))
    found = heavy_join(asked, lent.join(counts, "digest"), ["digest"], "askers", asked.count())
    got = found.groupBy("media_sha").agg(F.collect_list(F.struct("digest", "data")).alias("more"))
    patched = partly.dropDuplicates(["media_sha"]).join(got, "media_sha", "left").select("media_sha", "header", "digests", F.concat("chunks", F.coalesce("more", F.array().cast(got.schema["more"].dataType))).alias("chunks"))
    return whole.mapInArrow(run, FEATURES).unionByName(patched.mapInArrow(run, FEATURES)).dropDuplicates(["media_sha"])


def media_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a medium and read all back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, n_chunks.

    Null texts are empty and hold ALIGN zeros; equal texts share one medium and have equal values, and so do unlike texts of
    one payload, which differ in zeros at their ends only, but for n_bytes; a medium that is not read back raises; repeated
    rows and null ids stay rows; very long texts are many chunks; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    listed = stash(catalogue(docs, id_col, text_col), "media-lists")
    orders = stash(storing_orders(listed), "media-orders")
    release_shuffles(docs.sparkSession)
    stored = stash(store(docs, orders, id_col, text_col), "media-store")
    release_shuffles(docs.sparkSession)
    read = read_media(stored)
    copies = listed.groupBy("media_sha").agg(F.count("*").alias("copies"))
    read = copies.join(read, "media_sha", "left").withColumn("payload_sha256", F.coalesce("payload_sha256", F.raise_error(F.lit("a medium was not read back"))))
    out = heavy_join(listed.select("doc_id", "n_bytes", "media_sha", F.size("digests").alias("n_chunks")), stash(read, "media-read"), ["media_sha"], "copies", listed.count())
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
