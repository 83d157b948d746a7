"""N-Triples as a data source of its own, for batches and streams.

``spark.read.format("ntriples").load(folder)`` gives a row per line: p, the predicate in prefixed form, and value, the line.
Filters on p (=, IN) are pushed into the reader, which looks at the predicate's bytes alone, so lines of other predicates are
neither decoded nor sent to the JVM. Plain files are read in byte ranges that begin at the next line; compressed ones whole.
Lines that are no triples have a null p; comments and empty lines have no row. ``triples`` parses what is left.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from taxoforge.functions.terms import PREFIXES
from taxoforge.sources.readers import parse_ntriples

SCHEMA = "p string, value string"
#: Bytes of a split, of a batch of lines; splits of less than SPLIT_BYTES are read several in a row, one task some PARTS-th of all.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
PARTS = 128
#: Read at once beyond a split, for the end of its last line.
LINE_BYTES = 4096
_PREDICATE = re.compile(rb"[ \t]*(?:<[^>\n]*>|_:[^\s<>\"]+)[ \t]*<([^>\n]*)>[ \t]*[<_\"]")
_SPACES: dict[str, str] = {}
for _name, _space in PREFIXES:
    _SPACES.setdefault(_space, _name)
_NAMESPACE = re.compile("|".join(map(re.escape, _SPACES)))


def prefixed(iri: str) -> str:
    """An IRI with its namespace's prefix, in angle brackets where there is none."""
    m = _NAMESPACE.match(iri)
    return f"{_SPACES[m[0]]}:{iri[m.end() :]}" if m else f"<{iri}>"


@dataclass
class Split(InputPartition):
    """Lines of a file that begin in [start, end); end below 0: all, decompressed."""

    path: str
    start: int
    end: int


def _files(path: str) -> list[tuple[int, str, int]]:
    """Time of change, path and size of the files in a folder, or of one file; hidden ones don't count."""
    system, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(place, recursive=True))
    root = path[: len(path) - len(place)] if path.endswith(place) else ""
    names = [(f.mtime_ns or 0, root + f.path, f.size) for f in found if f.is_file and not posixpath.basename(f.path).startswith(("_", "."))]
    return sorted(names)


def _splits(files: Iterable[tuple[int, str, int]], size: int) -> list[Split]:
    """Splits of ``size`` bytes, or of as many times that as keep the tasks few where the files are large for it."""
    files, out = list(files), []
    size *= max(1, min(SPLIT_BYTES, sum(n for _, _, n in files) // PARTS) // size)
    for _, path, n in files:
        if path.endswith((".gz", ".bz2", ".zst")):
            out.append(Split(path, 0, -1))
        else:
            out += [Split(path, lo, min(n, lo + size)) for lo in range(0, n, size)]
    return out


def _lines(split: Split) -> Iterator[list[bytes]]:
    """Batches of whole lines. A line belongs to the split in which it begins."""
    system, place = pafs.FileSystem.from_uri(split.path) if "://" in split.path or split.path.startswith("file:") else (pafs.LocalFileSystem(), split.path)
    if split.end < 0:
        with system.open_input_stream(place, compression="detect") as f:
            rest = b""
            while block := f.read(BATCH_BYTES):
                *lines, rest = (rest + block).split(b"\n")
                yield lines
            yield [rest]
        return
    with system.open_input_file(place) as f:
        at = split.start
        skip = at > 0
        f.seek(at - skip)  # from the byte before, to see whether a line begins at ``start``
        at, rest = at - skip, b""
        while at < split.end or rest:
            block = f.read(min(BATCH_BYTES, max(split.end - at, LINE_BYTES)))
            if not block:
                if rest and not skip:
                    yield [rest]
                return
            at += len(block)
            text = rest + block
            first = at - len(text)  # place of text in the file
            if skip:
                cut = text.find(b"\n")
                if cut < 0:
                    rest = text[-1:] if at < split.end else b""
                    continue
                text, first, skip = text[cut + 1 :], first + cut + 1, False
            if first >= split.end:
                return
            # Up to the end of the line that holds the split's last byte.
            last = text.find(b"\n", max(0, split.end - 1 - first)) if at >= split.end else -1
            if last >= 0:
                yield text[:last].split(b"\n")
                return
            *lines, rest = text.split(b"\n")
            yield lines


class _Reading:
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("ntriples needs a path")
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("p",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, str] = {}
        for lines in _lines(split):
            found: list[tuple[str | None, bytes]] = []
            for line in lines:
                line = line.removesuffix(b"\r")
                m = _PREDICATE.match(line)
                if m:
                    p = names.get(m[1])
                    if p is None:
                        p = names[m[1]] = prefixed(m[1].decode("utf-8", "replace"))
                elif not line.strip(b" ") or line.lstrip(b" ").startswith(b"#"):
                    continue
                else:
                    p = None
                if self.wanted is None or p in self.wanted:
                    found.append((p, line))
            if found:
                p, value = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array([v.decode("utf-8", "replace") for v in value], pa.string())], ["p", "value"])


class TripleReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Split]:
        return _splits(_files(self.path), self.size) or [Split(self.path, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        return _Reading.read(self, split) if split.end else iter(())


class TripleStream(_Reading, DataSourceStreamReader):
    """New files of a folder, by time of change and name; a file must not change once it is there."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        low, high = ((o["time"], o["path"]) for o in (start, end))
        return _splits((f for f in _files(self.path) if low < f[:2] <= high), self.size)

    def commit(self, end: dict) -> None:
        pass


class TripleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ntriples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TripleReader:
        return TripleReader(self.options)

    def streamReader(self, schema: object) -> TripleStream:  # noqa: N802
        return TripleStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TripleSource)


def triples(lines: DataFrame) -> DataFrame:
    """s, p, o of the source's lines; those that only look like triples go. Lines of a compressed file come from one task, and
    are dealt out before they are parsed."""
    return parse_ntriples(lines if lines.isStreaming else lines.repartition("value")).filter("s is not null").select("s", "p", "o")
