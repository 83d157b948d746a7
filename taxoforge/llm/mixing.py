"""Operator 7: mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets: the total size of all documents is shared out by weight; no source gets over ``max_repeat`` times its own size,
and what it cannot take goes to the others by weight (water-filling, solved in closed form over the sources).

Schedule: slot i stands at the point i * golden ratio modulo 1, which falls into one source's share of the cumulative
targets; a slot's rank among its source's slots is the block of that source it takes. Blocks are stretches of equal
token number of the source's documents in hash order, repeated. Ranks and positions come from two-level prefix sums
(chunk totals first, then inside a chunk), so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.llm.common import WORD_PATTERN, as_text, heavy_join, stash

MAX_REPEAT = 3
#: Tokens of a block at most; small inputs use smaller ones, so that there are some MIN_SLOTS slots.
BLOCK = 1024
MIN_SLOTS = 50_000
#: Numerator over 2**32 of the golden ratio's fraction.
GOLDEN = 0x9E3779B9
CELLS = 4096
SLOT_CHUNK = 1 << 16
DOC_CHUNK_BITS = 12
SEED = 7


def weigh_sources(sizes: DataFrame, max_repeat: int = MAX_REPEAT, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """skey, source_size, n_docs, target, lo, hi per source: lo and hi are its share of the cumulative targets.

    Sources by code point, null last, get the weights in turn, repeating. The windows here see a row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    own = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    own = own.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    own = own.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    own = own.withColumn("level", left / F.sum("weight").over(onward))
    own = own.withColumn("level", F.max("level").over(everything))  # the level sought is the largest of the segments' levels
    own = own.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
    share = F.sum("target").over(everything)
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("hi", F.when(share > 0, upto / share).otherwise(F.lit(0.0)))
    return own.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0))).select("skey", "source_size", "n_docs", "target", "lo", "hi")


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """slot, skey, rank: the slots in order, each with its source and its rank there."""
    spark = sources.sparkSession
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 31)) * F.lit(GOLDEN) % (1 << 32) / F.lit(float(1 << 32))).alias("x"))
    slots = slots.withColumn("cell", F.floor(F.col("x") * CELLS))
    shares = sources.filter("hi > lo").select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    top = sources.agg(F.max("hi")).first()[0] or 0.0
    inside = (F.col("x") >= F.col("lo")) & ((F.col("x") < F.col("hi")) | (F.col("hi") >= F.lit(top)))
    placed = slots.join(shares, "cell").filter(inside).withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    counts = placed.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    prior = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("skey", "chunk", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    inner = Window.partitionBy("skey", "chunk").orderBy("slot")
    ranked = placed.withColumn("at", F.row_number().over(inner) - 1).join(counts, ["skey", "chunk"])
    return ranked.select("slot", "skey", (F.col("before") + F.col("at")).alias("rank"))


def lay_out(sizes: DataFrame) -> DataFrame:
    """The documents with ``begin``: the tokens of their source before them, in hash order."""
    h = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    d = sizes.withColumn("h", h).withColumn("chunk", F.shiftrightunsigned("h", 64 - DOC_CHUNK_BITS))
    sums = d.groupBy("skey", "chunk").agg(F.sum("size").alias("n"))
    prior = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "chunk", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    inner = Window.partitionBy("skey", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["skey", "chunk"])
    return d.withColumn("begin", F.col("before") + F.col("inside")).drop("h", "chunk", "before", "inside")


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, skey, size: words of the text (null: 0)."""
    source = F.col(source_col).cast("string")
    size = F.regexp_count(as_text(text_col), F.lit(WORD_PATTERN)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"), size.alias("size"))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame, int]:
    """Documents laid out with their source's figures, the schedule, and the tokens of a block."""
    sizes = stash(word_sizes(docs, id_col, text_col, source_col), "mix-sizes")
    sources = stash(weigh_sources(sizes, max_repeat), "mix-sources")
    total, n_docs = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    block = max(1, min(BLOCK, total // MIN_SLOTS))
    slots = schedule(sources, -(-total // block))
    placed = heavy_join(lay_out(sizes), sources.select("skey", "source_size", "target", "n_docs"), ["skey"], "n_docs", n_docs)
    return placed, slots, block


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), taken (words the mix takes, with repeats).

    Blocks cut documents where they end, so sources come within a few blocks of their targets. No document is taken
    over ``max_repeat`` times. Null or wordless texts have size 0 and are taken 0 times; a null source is a source of
    its own, the last; repeated rows count each; an empty table gives no rows; a very long text spans many blocks;
    other columns are not read. Reruns agree: the order is a hash of doc_id.
    """
    placed, slots, block = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, max_repeat=max_repeat)
    turns = placed.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    turns = turns.withColumn("start", F.col("turn") * F.col("source_size") + F.col("begin")).withColumn("stop", F.col("start") + F.col("size"))
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    here = F.least(F.col("stop"), (F.col("rank") + 1) * block) - F.greatest(F.col("start"), F.col("rank") * block)
    got = cut.join(slots.withColumnRenamed("slot", "taken_slot"), ["skey", "rank"], "left")
    got = got.withColumn("here", F.when(F.col("taken_slot").isNotNull(), here).otherwise(F.lit(0)))
    keys = ["doc_id", "source", "size", "source_size", "target"]
    some = got.groupBy(*keys, "skey", "begin").agg(F.sum("here").alias("taken")).select(*keys, F.col("taken").cast("long").alias("taken"))
    none = placed.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none)


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed rows themselves: each whole document as often as the schedule takes the block its middle falls in.

    Columns are those of ``docs``. Rows with equal id, source and size get equal numbers of copies; wordless rows go.
    """
    placed, slots, block = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, max_repeat=max_repeat)
    turns = placed.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    middle = F.col("turn") * F.col("source_size") + F.col("begin") + F.floor(F.col("size") / 2)
    got = turns.withColumn("rank", F.floor(middle / block)).join(slots, ["skey", "rank"])
    copies = got.groupBy("doc_id", "skey", "begin").agg(F.count("*").alias("copies"), F.first("size").alias("size"))
    copies = copies.groupBy(F.col("doc_id").alias("mix_id"), F.col("skey").alias("mix_key"), F.col("size").alias("mix_size")).agg(F.max("copies").alias("mix_copies"))
    named = docs.withColumn("mix_text_size", F.regexp_count(as_text(text_col), F.lit(WORD_PATTERN)).cast("long"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("mix_id")) & (key == F.col("mix_key")) & (F.col("mix_text_size") == F.col("mix_size"))
    joined = named.join(copies, on, "inner").withColumn("mix_turn", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return joined.select(*docs.columns)
