"""Facts that come before their types: a stream of types and facts in any order, where facts wait.

What an instance's types allow it so far, and the facts that wait for it, is state. A fact is settled on a side as soon as
a type fits; otherwise when the time it waits has passed on the stream's clock, by the types that came until then. The
subject is settled first; facts that fit there go on to a second state, where objects are settled. Only facts that don't fit
yet enter a state. Instances share keys by their hash, BUCKETS of them, so that a micro-batch calls Python once for many
instances: what they may is kept by SLOTS of a bucket, the facts that wait in packs of PACKED rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from taxoforge.functions.terms import is_literal

EVENT = "kind string, inst string, cls string, s string, p string, o string, ts timestamp"
SETTLED = "s string, p string, o string, later boolean, verdict string, typed boolean, fits boolean, ms bigint"
COLUMNS = [c.split()[0] for c in SETTLED.split(", ")]
#: Keys of a state. A stream that has begun must keep the number.
BUCKETS = 512
#: Records that a bucket's instances are dealt out to. A stream that has begun must keep the number.
SLOTS = 256
#: Waiting facts in a record of the state, at most.
PACKED = 5000
WAITING = pa.schema([("s", pa.string()), ("p", pa.string()), ("o", pa.string()), ("later", pa.bool_()), ("due", pa.int64())])


def _pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, WAITING, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(pa.RecordBatch.from_pandas(rows[WAITING.names], WAITING, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class _Known:
    """The properties that each instance of a bucket may have on a side, read by slots where they are asked for."""

    def __init__(self, state) -> None:  # noqa: ANN001
        self.state, self.slots, self.grown = state, {}, set()

    def _slot(self, inst: str) -> tuple[int, dict[str, list[str]]]:
        n = zlib.crc32(inst.encode()) % SLOTS
        if n not in self.slots:
            had = self.state.getValue((n,))
            self.slots[n] = json.loads(had[0]) if had else {}
        return n, self.slots[n]

    def get(self, inst: str) -> list[str] | None:
        """None where no type is known."""
        return self._slot(inst)[1].get(inst)

    def add(self, inst: str, more: list[str]) -> None:
        n, slot = self._slot(inst)
        had = slot.get(inst)
        now = sorted({*(had or ()), *more})
        if now != had:
            slot[inst] = now
            self.grown.add(n)

    def save(self) -> None:
        for n in self.grown:
            self.state.updateValue((n,), (json.dumps(self.slots[n]),))


class WaitForTypes(StatefulProcessor):
    """Rows of one bucket of instances: types (allowed: the properties whose side the class fits) and facts (s, p, o, later,
    verdict, ms), whose ``later`` is carried along; ``at`` is the column that names the instance. Facts leave with what the
    side came to; those that have a verdict pass by."""

    def __init__(self, wait_ms: int, at: str) -> None:
        self.wait_ms, self.at = wait_ms, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "slot int", "allowed string")
        self.waiting = handle.getMapState("waiting", "pack int", "facts binary")
        self.index = handle.getValueState("index", "packs string")  # number, rows and earliest due of each pack

    def _packs(self) -> list[list[int]]:
        had = self.index.get()
        return json.loads(had[0]) if had else []

    def _keep(self, packs: list[list[int]]) -> None:
        self.index.update((json.dumps(packs),)) if packs else self.index.clear()

    def _fits(self, rows: pd.DataFrame, known: _Known) -> pd.Series:
        return pd.Series([p in (known.get(i) or ()) for i, p in zip(rows[self.at], rows["p"])], index=rows.index, dtype=bool)

    def _settled(self, rows: pd.DataFrame, known: _Known) -> pd.DataFrame:
        typed = [known.get(i) is not None for i in rows[self.at]]
        return rows.assign(verdict=None, typed=typed, fits=self._fits(rows, known), ms=rows["due"] - self.wait_ms)[COLUMNS]

    def _append(self, rows: pd.DataFrame, packs: list[list[int]]) -> None:
        """Rows go to the state: the last pack is filled up before others begin."""
        if packs and packs[-1][1] + len(rows) <= PACKED:
            rows = pd.concat([_unpack(bytes(self.waiting.getValue((packs[-1][0],))[0])), rows])
            packs[-1][1:] = [len(rows), int(rows["due"].min())]
            self.waiting.updateValue((packs[-1][0],), (_pack(rows),))
            return
        for at in range(0, len(rows), PACKED):
            some = rows.iloc[at : at + PACKED]
            packs.append([packs[-1][0] + 1 if packs else 0, len(some), int(some["due"].min())])
            self.waiting.updateValue((packs[-1][0],), (_pack(some),))

    def _leave(self, pack: list[int], go, known: _Known) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        """The rows of a pack for which ``go`` holds, settled; the others stay."""
        rows = _unpack(bytes(self.waiting.getValue((pack[0],))[0]))
        out = go(rows)
        if out.any():
            left = rows[~out]
            pack[1:] = [len(left), int(left["due"].min()) if len(left) else 0]
            self.waiting.updateValue((pack[0],), (_pack(left),)) if len(left) else self.waiting.removeKey((pack[0],))
            yield self._settled(rows[out], known)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        known, packs, held = _Known(self.known), self._packs(), []
        first = min((due for *_, due in packs), default=None)
        old = len(packs)
        for pdf in rows:
            types = pdf[pdf["kind"] == "type"]
            for inst, more in zip(types[self.at], types["allowed"]):
                known.add(inst, list(more) if more is not None else [])
            done = pdf[pdf["verdict"].notna()]
            if len(done):
                yield done.assign(typed=True, fits=True)[COLUMNS]
            asks = pdf[(pdf["kind"] == "fact") & pdf["verdict"].isna()]
            if len(asks):
                asks = asks.assign(due=asks["ms"] + self.wait_ms, later=asks["later"].astype(bool))[WAITING.names]
                fits = self._fits(asks, known)
                if fits.any():
                    yield self._settled(asks[fits], known)
                held.append(asks[~fits])
            if sum(map(len, held)) >= 2 * PACKED:
                self._append(pd.concat(held), packs)
                held = []
        known.save()
        if known.grown:
            for pack in packs:
                yield from self._leave(pack, lambda some: self._fits(some, known), known)
            packs = [p for p in packs if p[1]]
        wait = pd.concat(held) if held else None
        if wait is not None and known.grown:
            fits = self._fits(wait, known)
            if fits.any():
                yield self._settled(wait[fits], known)
            wait = wait[~fits]
        if wait is not None and len(wait):
            self._append(wait, packs)
        if known.grown or len(packs) != old or (wait is not None and len(wait)):
            self._keep(packs)
        soon = min((due for *_, due in packs), default=None)
        if soon is not None and (first is None or soon < first):
            self.handle.registerTimer(soon)  # the earliest; when it is over, the next

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        known, packs = _Known(self.known), self._packs()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for pack in packs:
            if pack[2] <= now:
                yield from self._leave(pack, lambda some: some["due"] <= now, known)
        packs = [p for p in packs if p[1]]
        self._keep(packs)
        if packs:
            self.handle.registerTimer(min(due for *_, due in packs))

    def close(self) -> None:
        pass


def waiting_verdicts(events: DataFrame, full: DataFrame, constraints: DataFrame, wait: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """s, p, o, verdict, ts of the facts in a stream of events (kind, inst, cls, s, p, o, ts): rows of kind "type" say inst
    and cls, rows of kind "fact" s, p and o.

    The verdicts are those of ``check_facts`` with all types seen up to the micro-batch that finds the watermark
    ``wait`` past the fact. Rows with a null
    in what they say, or without a time, are left out; a fact that is said twice has two verdicts; events later than
    ``lateness`` are dropped. The closure and the constraints are tables.
    """
    spark = events.sparkSession
    wait_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + interval {wait})").first()[0])
    timed = events.filter("ts is not null").withWatermark("ts", lateness)
    types = timed.filter("kind = 'type' and inst is not null and cls is not null").select("inst", "cls", "ts")
    facts = timed.filter("kind = 'fact' and s is not null and p is not null and o is not null").select("s", "p", "o", "ts", F.unix_millis("ts").alias("ms"))
    has = constraints.groupBy(F.col("property").alias("has_p")).agg(F.bool_or(F.col("side") == "subject").alias("domain"), F.bool_or(F.col("side") == "object").alias("range"))
    facts = facts.join(has, F.col("p") == F.col("has_p"), "left").fillna(False, ["domain", "range"]).withColumn("later", F.col("range") & ~is_literal(F.col("o")))

    def settle(side: str, at: str, some: DataFrame) -> DataFrame:
        """Facts (s, p, o, later, ms) with typed and fits of their instance in the column ``at``."""
        allowed = full.select("node", "anc").join(constraints.filter(F.col("side") == side).select("property", F.col("type").alias("anc")), "anc")
        allowed = allowed.groupBy(F.col("node").alias("fit_cls")).agg(F.sort_array(F.collect_set("property")).alias("allowed"))
        no = F.lit(None).cast("string")
        who = [(F.col("inst") if c == at else no).alias(c) for c in ("s", "p", "o")]
        said = types.join(allowed, F.col("cls") == F.col("fit_cls"), "left").select(F.lit("type").alias("kind"), *who, F.lit(False).alias("later"), no.alias("verdict"), "allowed", F.lit(0).cast("long").alias("ms"))
        asked = some.select(F.lit("fact").alias("kind"), "s", "p", "o", "later", "verdict", F.lit(None).cast("array<string>").alias("allowed"), "ms")
        # A fact that is settled has no instance to meet, so it is spread.
        met = F.when(F.col("verdict").isNull(), F.xxhash64(at)).otherwise(F.xxhash64("s", "p", "o"))
        rows = said.unionByName(asked).withColumn("bucket", F.pmod(met, F.lit(BUCKETS)).cast("int"))
        return rows.groupBy("bucket").transformWithStateInPandas(WaitForTypes(wait_ms, at), StructType.fromDDL(SETTLED), "Append", "EventTime")

    def judged(some: DataFrame, side: str, name: str) -> DataFrame:
        what = F.when(~F.col("typed"), f"no_types_for_{side}").when(~F.col("fits"), f"{name}_constraint_not_satisfied").otherwise("ok")
        return some.withColumn("verdict", F.coalesce("verdict", what))

    columns = ["s", "p", "o", "later", "verdict", "ms"]
    open_facts = facts.withColumn("verdict", F.lit(None).cast("string"))
    # One state for subjects, read once: what is final after it passes the second state by.
    subjects = judged(settle("subject", "s", open_facts.filter("domain").select(columns)), "subject", "domain")
    subjects = subjects.withColumn("verdict", F.when(F.col("later") & (F.col("verdict") == "ok"), None).otherwise(F.col("verdict"))).select(columns)
    rest = open_facts.filter("not domain").withColumn("verdict", F.when(~F.col("later"), "ok")).select(columns)
    objects = judged(settle("object", "o", subjects.unionByName(rest)), "object", "range")
    return objects.select("s", "p", "o", "verdict", F.timestamp_millis("ms").alias("ts"))


def start_waiting(events: DataFrame, full: DataFrame, constraints: DataFrame, path: str, checkpoint: str, wait: str = "1 hour", lateness: str = "10 minutes") -> StreamingQuery:
    """waiting_verdicts of all events that are there now, appended to a folder of Parquet files. Timers need the RocksDB
    state store, which is set for this query alone."""
    conf = events.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    had = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = waiting_verdicts(events, full, constraints, wait, lateness)
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, had)
