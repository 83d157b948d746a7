"""Operator 3: incremental, reversible line dedup.

State is three tables. ``postings`` holds one row per document, text and distinct line key (128-bit digest); ``refs``, the
exact reference-count table, holds per key its number of documents and its largest document; ``filters`` holds one
cuckoo filter per shard of the digest space, with a fingerprint of every key that is at or above the threshold.
Inserting or deleting documents counts only the keys anew that their postings touch, and puts into or takes out of the
filters of their shards only the keys that cross the threshold, so a removed line comes back when deletions bring its key
under it. A filter only ever says "no" safely: what it lets through is looked up in the exact table, so results never
depend on its false positives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from taxoforge.llm.common import SPACE, as_text, heavy_join, small_batches, stash, trim_worker

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys for each shard of the cuckoo filters; the number of shards grows with the table.
SHARD_KEYS = 1 << 16
#: Filters are sent to all executors up to this many bytes; beyond, postings are shuffled to the filter of their shard.
FILTER_BYTES = 32 << 20
#: Postings of a shard that meet a copy of its filter in one task, about.
PROBE_ROWS = 1 << 20

KEY = ["k1", "k2"]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints with two candidate buckets each; supports insertion, deletion and lookup."""

    SLOTS, KICKS = 4, 500

    def __init__(self, n: int, table: np.ndarray | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, n) / self.SLOTS / 0.85))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16) if table is None else table.reshape(-1, self.SLOTS).copy()
        self.buckets = len(self.table)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, never 0, and both buckets of 64-bit keys."""
        h = self._mix(keys.astype(np.uint64))
        fp = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        mask = np.uint64(self.buckets - 1)
        a = h & mask
        return fp.astype(np.uint16), a.astype(np.int64), ((a ^ self._mix(fp)) & mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        for f, a, b in zip(*self.places(keys)):
            self._put(int(f), int(a), int(b))

    def _put(self, f: int, a: int, b: int) -> None:
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = f
                return
        at = b
        for kick in range(self.KICKS):
            slot = (f + kick) % self.SLOTS
            f, self.table[at, slot] = int(self.table[at, slot]), f
            at = (at ^ int(self._mix(np.array([f], np.uint64))[0])) & (self.buckets - 1)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return
        self._grow(f, at)

    def _grow(self, f: int, at: int) -> None:
        """Too full: give every bucket a second row of slots, which keeps every fingerprint in its place."""
        self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.SLOTS = self.table.shape[1]
        self.table[at, np.flatnonzero(self.table[at] == 0)[0]] = f

    def delete(self, keys: np.ndarray) -> None:
        for f, a, b in zip(*self.places(keys)):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == f)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)


def line_key(line: str) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).encode("utf-8").lower()


def keys_of(text: str, min_chars: int) -> list[bytes | None]:
    """128-bit digests of the lines; None for lines whose key is shorter than ``min_chars`` code points."""
    return [xxhash.xxh3_128_digest(s.encode("utf-8").lower()) if len(s := line.strip(SPACE)) >= min_chars else None for line in text.split("\n")]


def make_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc_id, th (hash of the text): the distinct long line keys of each document's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, digests = [], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                own = {k for k in keys_of(text.as_py(), min_chars) if k}
                digests.extend(own)
                ids.extend([doc.as_py()] * len(own))
                hashes.extend([text_hash(text.as_py())] * len(own) if own else [])
            k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], [*KEY, "doc_id", "th"])
        trim_worker()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text")).mapInArrow(run, "k1 long, k2 long, doc_id long, th long").distinct()


def text_hash(text: str) -> int:
    """Tells the texts of one document apart."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8")) - (1 << 63)


def count_refs(postings: DataFrame) -> DataFrame:
    """The exact reference-count table: k1, k2, n_docs, keep_doc (the largest document), n_rows (postings)."""
    by_doc = postings.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"), F.sum("n").alias("n_rows"))


@dataclass
class State:
    """The tables of a corpus, as files; ``n_shards`` is fixed when the filters are first made."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int


def shard_of(n_shards: int) -> Column:
    """Shards are cut by digest, so they stay even."""
    return F.pmod("k2", F.lit(n_shards)).cast("int").alias("shard")


FILTERS = "shard int, slots int, filter binary"


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """One cuckoo filter per shard: shard, slots, filter."""

    def build(table: pa.Table) -> pa.Table:
        f = CuckooFilter(max(len(table), 1))
        f.insert(table.column("k1").to_numpy().view(np.uint64))
        return pa.table({"shard": table.column("shard").slice(0, 1), "slots": pa.array([f.SLOTS], pa.int32()), "filter": pa.array([f.table.tobytes()], pa.binary())})

    return keys.select("k1", shard_of(n_shards)).groupBy("shard").applyInArrow(build, FILTERS)


def change_filters(filters: DataFrame, come: DataFrame, go: DataFrame, n_shards: int) -> DataFrame:
    """The filters with keys put in and taken out, in the shards that have any; the others stay as they are."""
    both = come.select("k1", shard_of(n_shards), F.lit(True).alias("come")).unionByName(go.select("k1", shard_of(n_shards), F.lit(False).alias("come")))

    def change(old: pa.Table, keys: pa.Table) -> pa.Table:
        if not len(keys):
            return old
        k, new = keys.column("k1").to_numpy().view(np.uint64), keys.column("come").to_numpy(zero_copy_only=False)
        f = loaded(old.column("filter")[0].as_py(), old.column("slots")[0].as_py()) if len(old) else CuckooFilter(max(len(keys), 1))
        f.delete(k[~new])
        f.insert(k[new])
        return pa.table({"shard": keys.column("shard").slice(0, 1), "slots": pa.array([f.SLOTS], pa.int32()), "filter": pa.array([f.table.tobytes()], pa.binary())})

    return filters.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(change, FILTERS)


def loaded(data: bytes, slots: int) -> CuckooFilter:
    f = CuckooFilter(1)
    f.table = np.frombuffer(data, np.uint16).reshape(-1, slots).copy()
    f.buckets, f.SLOTS = len(f.table), slots
    return f


def build_state(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> State:
    """The state of a corpus from nothing."""
    postings = stash(make_postings(docs, id_col, text_col, min_chars), "line-postings")
    refs = stash(count_refs(postings), "line-refs")
    hot = refs.filter(F.col("n_docs") >= min_docs)
    n_shards = max(1, -(-hot.count() // SHARD_KEYS))
    return State(postings, refs, stash(build_filters(hot, n_shards), "line-filters"), n_shards, min_docs)


def _recount(state: State, postings: DataFrame, touched: DataFrame) -> State:
    """The state with new postings, whose keys differ from before in those of ``touched`` only."""
    keys = stash(touched.select(*KEY).distinct(), "line-touched")
    now = stash(count_refs(postings.join(keys, KEY, "left_semi")), "line-recount")
    before = state.refs.join(keys, KEY, "left_semi")
    hot, was = now.filter(F.col("n_docs") >= state.min_docs), before.filter(F.col("n_docs") >= state.min_docs)
    come, go = hot.join(was, KEY, "left_anti"), was.join(hot, KEY, "left_anti")
    filters = stash(change_filters(state.filters, come, go, state.n_shards), "line-filters")
    refs = stash(state.refs.join(keys, KEY, "left_anti").unionByName(now), "line-refs")
    return State(postings, refs, filters, state.n_shards, state.min_docs)


def insert_docs(state: State, docs: DataFrame, **columns: str) -> State:
    """The state with documents added; those already there with the same text count once."""
    new = stash(make_postings(docs, **columns), "line-new")
    return _recount(state, stash(state.postings.unionByName(new).distinct(), "line-postings"), new)


def delete_docs(state: State, doc_ids: DataFrame) -> State:
    """The state without the documents listed in the column doc_id; a null there is the document without an id."""
    ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone"))
    kept = stash(state.postings.join(ids, same, "left_anti"), "line-postings")
    return _recount(state, kept, state.postings.join(ids, same, "left_semi"))


def probe(state: State) -> DataFrame:
    """The postings whose keys the filters let through: k1, k2, doc_id, th."""
    postings, n_shards = state.postings, state.n_shards
    size = state.filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        copies = max(1, -(-postings.count() // (n_shards * PROBE_ROWS)))
        left = postings.withColumn("shard", shard_of(n_shards)).withColumn("copy", F.pmod(F.xxhash64("doc_id", "th"), F.lit(copies)).cast("int"))
        right = state.filters.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

        def meet(own: pa.Table, one: pa.Table) -> pa.Table:
            own = own.select([*KEY, "doc_id", "th"])
            if not len(own) or not len(one):
                return own.slice(0, 0)
            f = loaded(one.column("filter")[0].as_py(), one.column("slots")[0].as_py())
            return own.filter(pa.array(f.contains(own.column("k1").to_numpy().view(np.uint64))))

        return left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInArrow(meet, "k1 long, k2 long, doc_id long, th long")
    made = {r["shard"]: loaded(r["filter"], r["slots"]) for r in state.filters.collect()}
    sent = postings.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            shard = np.mod(k2, n_shards)
            keep = np.zeros(len(k1), bool)
            for s in np.unique(shard):
                if int(s) in sent.value:
                    at = np.flatnonzero(shard == s)
                    keep[at] = sent.value[int(s)].contains(k1[at].view(np.uint64))
            yield batch.filter(pa.array(keep))

    return postings.select(*KEY, "doc_id", "th").mapInArrow(run, "k1 long, k2 long, doc_id long, th long")


def drop_lists(state: State) -> DataFrame:
    """doc_id, th and the digests of the keys that lose their lines in that text of that document.

    Keys of one text come together in one row: as many as its long lines. Keys shared by many documents go by
    ``heavy_join``.
    """
    hot = stash(state.refs.filter(F.col("n_docs") >= state.min_docs), "line-hot")
    total = hot.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    dropped = heavy_join(probe(state), hot, KEY, "n_rows", total).filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    return dropped.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*KEY)).alias("keys"))


def with_lists(docs: DataFrame, lists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the column ``dropped_keys``, null where a text loses nothing."""
    lists = lists.select(F.col("doc_id").alias("dropped_id"), F.col("th").alias("dropped_th"), F.col("keys").alias("dropped_keys"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            th = pa.array([text_hash(t.as_py() or "") for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, th], [*names, "own_th"])

    schema = StructType([*docs.schema.fields, StructField("own_th", LongType())])
    hashed = docs.mapInArrow(run, schema)
    return hashed.join(lists, F.col(id_col).cast("long").eqNullSafe(F.col("dropped_id")) & (F.col("own_th") == F.col("dropped_th")), "left").drop("dropped_id", "dropped_th", "own_th")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, state: State | None = None, with_text: bool = True) -> DataFrame:
    """Per document: n_lines, n_dropped, kept_sha256 and, with ``with_text``, kept_text.

    A key of ``min_chars`` code points or more that ``min_docs`` documents or more hold loses all its lines except in
    the largest doc_id holding it. Null and empty texts are one empty line, which stays; rows with the same doc_id are
    one document when holders are counted, and each row loses its own lines; null ids are a document of their own,
    smaller than any. Very long texts stay whole; an empty table gives no rows; other columns are not read. ``state``: of
    the corpus that decides, by default the documents themselves.
    """
    state = state or build_state(docs, id_col, text_col, min_chars, min_docs)
    left = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text"))
    both = with_lists(left, drop_lists(state), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for doc, text, keys in zip(*(batch.slice(lo, 256).column(i) for i in range(3))):
                    lines, kept = kept_lines(text.as_py(), keys, min_chars)
                    text = "\n".join(kept)
                    out.append((doc.as_py(), lines, lines - len(kept), hashlib.sha256(text.encode("utf-8")).hexdigest(), text))
                cols = list(zip(*out))
                arrays = [pa.array(cols[i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(cols[4], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def kept_lines(text: str, keys: pa.Scalar, min_chars: int) -> tuple[int, list[str]]:
    """Number of lines, and the lines that stay when those with the listed keys go."""
    lines = text.split("\n")
    if not keys.is_valid:
        return len(lines), lines
    gone = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys.as_py()}
    return len(lines), [x for x, k in zip(lines, keys_of(text, min_chars)) if k is None or k not in gone]


def replace_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its columns, its texts without the lines that ``dedup_lines`` drops; null texts come out empty."""
    lists = drop_lists(build_state(docs, id_col, text_col, min_chars, min_docs))
    whole = docs.withColumn(text_col, as_text(text_col))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = ["\n".join(kept_lines(t.as_py(), k, min_chars)[1]) for t, k in zip(part.column(at), part.column(len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))], names)
        trim_worker()

    return with_lists(whole, lists, id_col, text_col).mapInArrow(run, whole.schema)
