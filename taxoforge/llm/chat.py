"""Operator 4: chat formatting by prefix-target expansion.

A conversation is rendered turn by turn; every assistant turn becomes an example of its own, with all preceding turns
as context and only that reply trainable. ``format_turns`` renders the turns, each row holding what an example adds to the
one before; ``expand`` writes every example out with its whole prefix, and ``read_examples`` reads these back. Examples
grow with the square of a conversation's replies, as the method has it; they are written in pieces, so no row does. What
comes after the last reply is no example's and stands in rows without one. ``example_texts`` gives context and target.

A turn reads ``<turn> role``, a new line, the text and ``</turn>`` with a new line. In texts and roles a backslash comes
before every backslash and every control string, and in roles before a new line, so that nothing in them can end a turn.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxoforge.llm.common import small_batches

OPEN, CLOSE, HEAD = "<turn> ", "</turn>", "### "
_CONTROL = re.compile(r"\\|<turn>|</turn>|### ")
_IN_ROLE = re.compile(r"\\|\n|<turn>|</turn>|### ")
_STOP = re.compile(r"\\.|</turn>", re.S)
_LINE = re.compile(r"\\.|\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its text."""
    head = OPEN + _IN_ROLE.sub(lambda m: "\\" + m[0], role) + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a rendering; raises ValueError where it is none."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        line = next((m for m in _LINE.finditer(rendered, at + len(OPEN)) if m[0] == "\n"), None)
        stop = line and next((m for m in _STOP.finditer(rendered, line.end()) if m[0] == CLOSE), None)
        if not stop:
            raise ValueError(f"the turn at {at} doesn't end")
        turns.append((unescape(rendered[at + len(OPEN) : line.start()]), unescape(rendered[line.end() : stop.start()])))
        at = stop.end() + 1
    return turns


#: Code points of context after which a row ends before the next reply, so that no row grows without bound.
MOST_CONTEXT = 1 << 20
SEGMENTS = "conv_id long, position long, segment string, seg_start long, example long, loss_start long, loss_end long"


def format_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """The examples: conv_id, position, segment (rendered turns), seg_start (code points before it), and with an assistant
    turn at the segment's end example (from 0), loss_start and loss_end in the conversation's rendering.

    An example's context is the rendering up to loss_start, its loss mask [loss_start, loss_end); its text ends with its
    segment. Segments without an example hold turns that no reply follows, or context of over MOST_CONTEXT code points.
    Rows go by turn, then role and text, so ties have one order and repeated rows stay. Null text or role: empty; null
    conv_id: one conversation; null turns come first; an empty table gives no rows; other columns are not read. Tasks read
    turn by turn, however long a conversation is.
    """
    cols = [F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn")]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, at, example = object(), 0, 0, 0
        held: list[str] = []
        size = 0
        names = [x.split()[0] for x in SEGMENTS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 2 else pa.int64()) for i, x in enumerate(zip(*rows))], names)

        def close(target: tuple[int, int] | None) -> tuple:
            """What is held, as a row; a reply's span is counted from its end."""
            nonlocal position, at, example, held, size
            end = at + size
            row = (conv, position, "".join(held), at, example if target else None, *((end - x for x in target) if target else (None, None)))
            position, at, example, held, size = position + 1, end, example + bool(target), [], 0
            return row

        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if c != conv:
                    if held:
                        out.append(close(None))
                    conv, position, at, example = c, 0, 0, 0
                turn, a, b = render(role.as_py(), text.as_py())
                held.append(turn)
                size += len(turn)
                if role.as_py() == trained:
                    out.append(close((len(turn) - a, len(turn) - b)))
                elif size > MOST_CONTEXT:
                    out.append(close(None))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([close(None)])

    small_batches(turns.sparkSession)
    return turns.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def examples(segments: DataFrame) -> DataFrame:
    """A row per example: conv_id, example, prefix_chars, loss_start, loss_end."""
    return segments.filter(F.col("example").isNotNull()).select("conv_id", "example", (F.col("seg_start") + F.length("segment")).alias("prefix_chars"), "loss_start", "loss_end")


def example_texts(segments: DataFrame) -> DataFrame:
    """The examples written out: conv_id, example, context, target. Each repeats its prefix, as the trainer asks for it."""
    own = segments.filter(F.col("example").isNotNull()).select(F.col("conv_id").alias("c"), "example", F.col("position").alias("last"), "seg_start", "loss_start", "loss_end")
    parts = own.join(segments.select("conv_id", "position", "segment"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("position") <= F.col("last")))
    whole = parts.groupBy(F.col("c").alias("conv_id"), "example", "loss_start", "loss_end").agg(F.sort_array(F.collect_list(F.struct("position", "segment"))).alias("p"))
    text = whole.withColumn("text", F.concat_ws("", F.col("p.segment")))
    return text.select("conv_id", "example", F.expr("substring(text, 1, int(loss_start))").alias("context"), F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))").alias("target"))


def read_back(segments: DataFrame) -> DataFrame:
    """Digests per conversation, read back from its examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_examples. Segments must come as ``format_turns`` leaves them; ValueError where an example's span
    doesn't end its text or its turns don't parse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, n, chars, loss, examples_n = None, False, 0, 0, 0, 0
        turns, trained = hashlib.sha256(), hashlib.sha256()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

        def row() -> tuple:
            return conv, n, turns.hexdigest(), loss, trained.hexdigest(), chars, examples_n

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i in (2, 4) else pa.int64()) for i, x in enumerate(zip(*rows))], names)

        for batch in batches:
            out = []
            for c, segment, start, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 5, 6))):
                if seen and c != conv:
                    out.append(row())
                if not seen or c != conv:
                    conv, seen, n, chars, loss, examples_n = c, True, 0, 0, 0, 0
                    turns, trained = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(segment):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if a is not None:
                    if start != chars or segment[b - start :] != CLOSE + "\n":
                        raise ValueError(f"the loss span of an example of conversation {c} doesn't end it")
                    reply = unescape(segment[a - start : b - start])
                    loss += len(reply)
                    trained.update(reply.encode())
                    examples_n += 1
                chars += len(segment)
            if out:
                yield batch_of(out)
        if seen:
            yield batch_of([row()])

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


EXAMPLES = "conv_id long, example long, piece long, text string, start long, loss_start long, loss_end long"


def expand(segments: DataFrame, *, most: int = MOST_CONTEXT) -> DataFrame:
    """The examples written out: conv_id, example, piece (from 0), text, start (code points of the example before it), and
    in an example's last piece loss_start and loss_end, counted from the example's beginning.

    An example's pieces are all of the conversation's rendering up to its reply's end; a piece ends behind the segment with
    which it has over ``most`` code points. What follows the last reply comes once, without example. Segments must come as
    ``format_turns`` leaves them. Whole pieces of a conversation wait in a temporary file, so memory doesn't grow with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EXAMPLES.split(", ")]
        out: list[tuple] = []
        size = 0
        with tempfile.TemporaryFile() as file:
            whole: list[tuple[int, int, int]] = []  # whole pieces: place and bytes in the file, code points before
            tail, start, told = "", 0, 0  # the piece that grows, code points before it and up to the last reply

            def flushed() -> pa.RecordBatch:
                nonlocal out, size
                rows, out, size = out, [], 0
                return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(zip(*rows))], names)

            def pieces() -> Iterator[tuple[int, str, int]]:
                for i, (place, n, before) in enumerate(whole):
                    file.seek(place)
                    yield i, file.read(n).decode(), before
                if tail:
                    yield len(whole), tail, start

            def rest(conv: int | None) -> Iterator[pa.RecordBatch]:
                nonlocal size
                for i, text, before in pieces():
                    if before + len(text) > told:
                        text, before = text[max(0, told - before) :], max(told, before)
                        out.append((conv, None, i, text, before, None, None))
                        size += len(text)
                        if size > most:
                            yield flushed()

            conv: int | None | object = object()
            for batch in batches:
                for c, segment, example, a, b in zip(batch.column(0).to_pylist(), batch.column(2), *(batch.column(i).to_pylist() for i in (4, 5, 6))):
                    if c != conv:
                        yield from rest(conv)
                        conv, whole, tail, start, told = c, [], "", 0, 0
                        file.seek(0)
                        file.truncate()
                    if len(tail) > most:
                        place, raw = file.seek(0, 2), tail.encode()
                        file.write(raw)
                        whole.append((place, len(raw), start))
                        tail, start = "", start + len(tail)
                    tail += segment.as_py()
                    if example is not None:
                        for i, text, before in pieces():
                            last = before == start
                            out.append((c, example, i, text, before, a if last else None, b if last else None))
                            size += len(text)
                            if size > most or len(out) >= 1000:
                                yield flushed()
                        told = start + len(tail)
            yield from rest(conv)
            if out:
                yield flushed()

    return segments.mapInArrow(run, EXAMPLES)


def read_examples(written: DataFrame) -> DataFrame:
    """Digests per conversation, read back from its examples as ``expand`` writes them: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_examples. Each example's context is held against the example before; what
    it adds is parsed, and only its loss span is trained. ValueError where the examples don't agree, a span doesn't end its
    example or turns don't parse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        conv, seen, n, chars, loss, examples_n = None, False, 0, 0, 0, 0
        turns, trained = hashlib.sha256(), hashlib.sha256()
        whole: list[bytes] = []  # digests of the pieces that have been read to their ends
        tail = ""  # what has been read of the piece after them

        def row() -> tuple:
            return conv, n, turns.hexdigest(), loss, trained.hexdigest(), chars, examples_n

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i in (2, 4) else pa.int64()) for i, x in enumerate(zip(*rows))], names)

        def add(text: str) -> None:
            nonlocal n, chars
            for role, own in parse(text):
                n += 1
                turns.update(f"{role}\n{own}\n".encode())
            chars += len(text)

        for batch in batches:
            out = []
            for c, example, piece, text, start, a, b in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if seen and c != conv:
                    out.append(row())
                if not seen or c != conv:
                    conv, seen, n, chars, loss, examples_n = c, True, 0, 0, 0, 0
                    turns, trained, whole, tail = hashlib.sha256(), hashlib.sha256(), [], ""
                if example is None:
                    if start != chars:
                        raise ValueError(f"what follows the last example of conversation {c} is not whole")
                    add(text)
                    continue
                if piece == len(whole) + 1 and tail:
                    whole.append(hashlib.sha256(tail.encode()).digest())
                    tail = ""
                if example != examples_n or piece > len(whole):
                    raise ValueError(f"an example of conversation {c} is missing or has a gap")
                if piece < len(whole):
                    if hashlib.sha256(text.encode()).digest() != whole[piece]:
                        raise ValueError(f"the contexts of conversation {c} differ")
                else:
                    if not text.startswith(tail) or start + len(tail) != chars:
                        raise ValueError(f"the contexts of conversation {c} differ")
                    add(text[len(tail) :])
                    tail = text
                if a is not None:
                    if text[b - start :] != CLOSE + "\n":
                        raise ValueError(f"the loss span of an example of conversation {c} doesn't end it")
                    reply = unescape(text[a - start : b - start])
                    loss += len(reply)
                    trained.update(reply.encode())
                    examples_n += 1
            if out:
                yield batch_of(out)
        if seen:
            yield batch_of([row()])

    return written.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
