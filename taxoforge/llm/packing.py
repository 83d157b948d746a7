"""Operator 10: cost-balanced packing of token sequences.

Documents are tokenized, cut and packed inside blocks of documents. In a block of T tokens there are T // capacity
sequences of full capacity, and the rest of T is split into sequences whose lengths are its powers of two, so that no
sequence needs padding. The documents of a block, in descending order of cost, each go to the sequence of lowest cost
that has token capacity left; what does not fit goes on to the next one. The cost of a piece of n tokens is
linear * n + quadratic * n * n, as attention makes it.

Blocks are consecutive documents of one input partition, so packing needs no shuffle, a block's size bounds memory,
and a lost executor repeats the same blocks with the same sequence ids.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, small_batches, trim_worker

CAPACITY = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_TOKENS = 1 << 20
#: Entries of the word cache; when full it keeps the words met most, at most half of them.
CACHE_WORDS = 700_000
#: Texts tokenized at a time, in bytes.
CHUNK_BYTES = 1 << 20


#: Texts on which words one by one must give what whole texts give.
PROBES = [
    "The quick Brown FOX jumped, over 13 lazy dogs.  It's\tnot far\n\nfrom THE end...",
    " leading and trailing  ", "A", "iPhone McDonald's e.g. U.S.A., etc.; (brackets) [x]{y} a-b c_d x=1,5.", "Ünïcode ÀÉ straße 日本語 😀😀 \u00a0 end", "",
]


class WordTokenizer:
    """Ids of whole texts, each distinct space-separated word being tokenized once.

    Exact for tokenizers that drop white space and never match across it: texts are cut at ASCII white space only,
    A-Z are lower-cased first where the tokenizer itself lower-cases, and full stops and commas after an ASCII letter
    are looked up apart, as the tokenizer's pattern splits there anyway. Whether a tokenizer is of this kind is tried on
    PROBES when it is loaded; others, and such as keep case, get their texts as they are or whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        want = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES]
        for self.lower, self.by_word in ((True, True), (False, True), (False, False)):
            self.reset()
            if [list(x) for x in self.encode(PROBES)] == want:
                break
        self.reset()

    def reset(self) -> None:
        pending: list[bytes] = []

        class Index(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = i = len(self)
                pending.append(word)
                return i

        self.index, self.pending = Index(), pending
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0
        self.met = np.zeros(0, np.int64)

    def shrink(self, most: int) -> None:
        """Keep the words met most, ``most`` of them at the utmost."""
        bar = 2
        while (keep := np.flatnonzero(self.met >= bar)).size > most:
            bar *= 2
        words = list(self.index)
        kept, ids, lengths = [words[i] for i in keep], self._gather(keep), self.length[keep]
        self.reset()
        self.index.update(zip(kept, range(len(kept))))
        self._append(np.arange(len(kept)), ids, lengths)

    def _append(self, at: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        end = self.used + len(ids)
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < len(self.index):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : end] = ids
        self.length[at] = lengths
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.used = end

    def _learn(self) -> None:
        """Tokenize what was met for the first time."""
        plain, joined = [], []
        for w in self.pending:  # grows by the cores that are new themselves
            core = w.rstrip(b".,")
            if len(core) < len(w) and core[-1:].isalpha():
                joined.append((self.index[w], self.index[core], self.index[w[len(core) :]]))
            else:
                plain.append(w)
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            enc = self.tokenizer.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True, add_special_tokens=False)
            of = np.array(enc.word_ids, np.int64)
            self._append(np.fromiter(map(self.index.__getitem__, part), np.int64, len(part)), np.array(enc.ids, np.uint32), np.bincount(of, minlength=len(part)))
        if joined:
            j = np.array(joined, np.int64)
            self._append(j[:, 0], self._gather(j[:, 1:].ravel()), self.length[j[:, 1]] + self.length[j[:, 2]])
        self.pending.clear()

    def _gather(self, at: np.ndarray) -> np.ndarray:
        n = self.length[at].astype(np.int64)
        return self.flat[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.shrink(CACHE_WORDS // 2)
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        words = [(t.encode("utf-8").lower() if self.lower else t.encode("utf-8")).split() for t in texts]
        at = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in words]
        self._learn()
        met = np.bincount(np.concatenate(at), minlength=len(self.index)) if at else self.met
        met[: len(self.met)] += self.met
        self.met = met
        return [self._gather(a) for a in at]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack_block(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one block.

    Sequences number total // capacity of full capacity, then one for each power of two in the remainder. Documents in
    descending length, ties in order, go to the sequence of least cost with room; cut where the room ends.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    heap = [(0.0, s) for s in range(len(rooms))]
    used = [0] * len(rooms)
    pieces = []
    for d in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = 0
        while at < lengths[d]:
            cost, s = heapq.heappop(heap)
            n = min(lengths[d] - at, rooms[s] - used[s])
            pieces.append((d, at, n, s, used[s]))
            at += n
            used[s] += n
            if used[s] < rooms[s]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, s))
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seq_length long"


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens, without padding.

    Returns a row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens (with the
    end id), sequence_id, offset (place in the sequence, gapless from 0), seq_length and, with ``with_ids``, ids.
    Null and empty texts hold the end id alone; a null id stays null; repeated rows are packed each for itself; an
    empty table gives no rows; other columns of ``docs`` are not read. Very long texts are cut over many sequences
    and blocks, a document ending a block once that holds ``block_tokens``.
    """

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path)
        part, made = TaskContext.get().partitionId(), 0
        ids_of: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            pieces = pack_block([len(x) for x in ids_of], capacity, linear, quadratic)
            lengths: dict[int, int] = {}
            for _, _, n, s, _ in pieces:
                lengths[s] = lengths.get(s, 0) + n
            cuts = [ids_of[d][a : a + n] for d, a, n, _, _ in pieces]
            cols = [
                pa.array([doc_ids[p[0]] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cuts], pa.int64()),
                pa.array([len(ids_of[p[0]]) for p in pieces], pa.int64()),
                pa.array([(part << 32) + made + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([lengths[p[3]] for p in pieces], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seq_length"]
            if with_ids:
                cols.append(pa.array([x.astype(np.int64) for x in cuts], pa.list_(pa.int64())))
                names.append("ids")
            made += len(lengths)
            held = 0
            ids_of.clear()
            doc_ids.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        def chunks() -> Iterator[tuple[list[int | None], list[str]]]:
            ids, texts, size = [], [], 0
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids.append(doc.as_py())
                    texts.append(text.as_py())
                    size += len(texts[-1])
                    if size >= CHUNK_BYTES:
                        yield ids, texts
                        ids, texts, size = [], [], 0
            if ids:
                yield ids, texts

        for some, texts in chunks():
            for doc, ids in zip(some, tok.encode(texts)):
                ids_of.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc)
                held += len(ids) + 1
                if held >= block_tokens:
                    yield flush()
        if ids_of:
            yield flush()
        trim_worker()

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(text_col).alias("text")).mapInArrow(run, schema)
