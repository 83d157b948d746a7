"""Operator 12: how far the sources of a language diverge in their use of words, and by which words.

Words are counted per (lang, source) group inside the tasks that read the texts. Each language keeps the terms of enough
documents, dealt into vocabulary chunks by hash, and each group's counts are packed into one vector per chunk. Pairs of
groups are worked out by two-dimensional tiling: groups are dealt into blocks, and every packed vector is copied to the
tasks of its block with each other block, a task for each stripe of chunks. A task walks its chunks one after the other,
spreads the vectors of both blocks over the terms that occur in them, and adds to the submatrix of its pairs. Terms that
none of a task's groups use have the same value throughout and are added as a product at the end.

Everything is in integers. A group's smoothed share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)), N being the
group's sum of counts and V the number of kept terms, and a divergence is floor((p - q) * (p - q) / q).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxoforge.llm.common import as_text, heavy_join, small_batches, stash, trim_worker

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Letters of ASCII and everything beyond it; in UTF-8 the latter are the bytes from 0x80.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Entries that a task counts before it hands them on.
HELD_TERMS = 400_000
#: Terms of a chunk, chunks of a stripe, groups of a block, about.
CHUNK_TERMS, STRIPE_CHUNKS, GROUP_BLOCK = 4096, 4, 8


def count_terms(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): partial counts, a few rows for each term at most from
    each task. Long texts are read whole."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, in_docs) in held.items():
                n = len(seen)
                if not n:
                    continue
                counts = (np.fromiter(x, np.int64, n) for x in (seen.values(), map(in_docs.__getitem__, seen)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(seen), pa.binary()).cast(pa.string()), *map(pa.array, counts)],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i) for i in range(3))):
                seen, in_docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                terms = TERM.findall(text.as_py().encode("utf-8").lower())
                size -= len(seen)
                seen.update(terms)
                in_docs.update(set(terms))
                size += len(seen)
                if size >= HELD_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()
        trim_worker()

    given = docs.select(as_text(text_col).alias("text"), as_text(lang_col).alias("lang"), as_text(source_col).alias("source"))
    return given.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """p of a count; its product with SCALE may pass a long, so it is a decimal there."""
    c, t, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    whole = F.call_function("div", (c + 1).cast("decimal(38,0)") * F.lit(SCALE), (t + v).cast("decimal(38,0)"))
    return (whole + 1).cast("long")


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """p of a matrix of counts, a row for each group; long division by thousands keeps it inside 64 bits."""
    by = (total + kept)[:, None]
    q, rest = np.divmod(counts + 1, by)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        q = q * 1000 + more
    return q + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def vocabulary(docs: DataFrame, min_docs: int, **cols: str) -> DataFrame:
    """lang, source, term, n, all_n: each group's counts of the terms that ``min_docs`` documents of its language hold,
    with the language's count. One shuffle, by language and term; a term has a row for each source at most."""
    of_term = Window.partitionBy("lang", "term")
    sums = count_terms(docs, **cols).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.withColumns({"in_docs": F.sum("docs").over(of_term), "all_n": F.sum("n").over(of_term)})
    return stash(sums.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "all_n"), "divergence-counts")


def tile_sums(packed: DataFrame) -> DataFrame:
    """lang, source, item, part (sum of divergences over the terms seen), seen (their number), of each pair and stripe."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names = [(b, s) for b, s in zip(table["block"].to_pylist(), table["source"].to_pylist())]
        groups = sorted(set(names))
        number = {g: i for i, g in enumerate(groups)}
        of = np.array([number[g] for g in names])
        total = np.zeros(len(groups), np.int64)
        total[of] = table["total"].to_numpy()
        kept = table["kept"][0].as_py()
        chunk = table["chunk"].to_numpy()
        low, high = key[1].as_py(), key[2].as_py()
        first = np.array([b == low for b, _ in groups])
        rows, cols = np.flatnonzero(first), np.flatnonzero(~first) if low != high else np.flatnonzero(first)
        sums, back, seen = np.zeros((len(rows), len(cols)), np.int64), np.zeros((len(rows), len(cols)), np.int64), 0
        at, counts = table["at"], table["counts"]
        for c in np.unique(chunk[chunk >= 0]):
            here = np.flatnonzero(chunk == c)
            places = [at[int(i)].values.to_numpy() for i in here]
            terms = np.unique(np.concatenate(places))
            dense = np.zeros((len(groups), len(terms)), np.int64)
            for i, p in zip(here, places):
                dense[of[i], np.searchsorted(terms, p)] = counts[int(i)].values.to_numpy()
            p = shares(dense, total, kept)
            seen += len(terms)
            for r, g in enumerate(rows):
                sums[r] += gap(p[g][None], p[cols]).sum(1)
                if low != high:
                    back[r] += gap(p[cols], p[g][None]).sum(1)
        pairs = [(groups[a][1], groups[b][1], int(sums[r, c])) for r, a in enumerate(rows) for c, b in enumerate(cols) if a != b]
        if low != high:
            pairs += [(groups[b][1], groups[a][1], int(back[r, c])) for r, a in enumerate(rows) for c, b in enumerate(cols)]
        n = len(pairs)
        source, item, part = ([x[i] for x in pairs] for i in range(3))
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(part, pa.int64()), pa.array([seen] * n, pa.int64())], ["lang", "source", "item", "part", "seen"])

    tiles = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return tiles.groupBy("lang", "low", "high", "stripe").applyInArrow(run, "lang string, source string, item string, part long, seen long")


def audit(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank: for each group, part ``pair`` holds all other sources of its language by their
    divergence, part ``term`` the ``top`` terms that the group uses more than its language does.

    Greater values first, ties by the item's bytes. Each row is a document, repeated rows too. Null texts, languages and
    sources are empty strings, and the empty language and source are like any other; texts without a term make a group
    all the same; a language with one source has no pairs; without kept terms all pairs are 0 and there are no terms; an
    empty table gives no rows; other columns are not read.
    """
    cols = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    counts = vocabulary(docs, min_docs, **cols)
    terms = stash(counts.select("lang", "term", "all_n").distinct(), "divergence-terms")
    langs = stash(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total")), "divergence-langs")
    groups = docs.groupBy(as_text(lang_col).alias("lang"), as_text(source_col).alias("source")).agg(F.count("*").alias("rows"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("weight"))
    heads = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    heads = heads.withColumn("sources", F.count("*").over(Window.partitionBy("lang"))).na.fill(0, ["total", "weight", "kept", "lang_total"])
    heads = heads.withColumn("blocks", F.ceil(F.col("sources") / GROUP_BLOCK).cast("int"))
    heads = heads.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    heads = stash(heads.select("lang", "source", "block", "blocks", "total", "kept", "lang_total", "weight"), "divergence-groups")

    # Each kept term's chunk and place in it, then each group's counts packed by chunk.
    n_terms = langs.agg(F.sum("kept")).first()[0] or 0
    places = heavy_join(terms, langs, ["lang"], "kept", n_terms).select("lang", "term", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / CHUNK_TERMS)).alias("chunk"))
    places = places.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    placed = counts.join(places, ["lang", "term"])
    vectors = placed.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("packed"))
    vectors = vectors.join(heads, ["lang", "source"])
    vectors = vectors.select("lang", "source", "block", "blocks", "total", "kept", "chunk", F.col("packed.at").alias("at"), F.col("packed.n").alias("counts"))
    vectors = vectors.withColumn("stripe", F.floor(F.col("chunk") / STRIPE_CHUNKS))
    # Each group is known in every stripe, whatever terms it has there.
    stripes = F.floor((F.greatest(F.lit(1), F.ceil(F.col("kept") / CHUNK_TERMS)) - 1) / STRIPE_CHUNKS)
    known = heads.select("lang", "source", "block", "blocks", "total", "kept", F.lit(-1).cast("long").alias("chunk"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("counts"), F.explode(F.sequence(F.lit(0).cast("long"), stripes)).alias("stripe"))
    sums = tile_sums(vectors.unionByName(known)).groupBy("lang", "source", "item").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    own = heads.select("lang", "source", "total", "kept")
    other = own.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    pairs = sums.join(own, ["lang", "source"]).join(other, ["lang", "item"])
    p, q = share(F.lit(0), "total", "kept"), share(F.lit(0), "item_total", "kept")
    rest = F.when(F.col("kept") > 0, (F.col("kept") - F.col("seen")) * F.call_function("div", (p - q) * (p - q), q)).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("part") + rest).alias("value"))

    p, q = share("n", "total", "kept"), share("all_n", "lang_total", "kept")
    used = heavy_join(counts, heads.filter("weight > 0"), ["lang", "source"], "weight", counts.count())
    terms = used.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", ranks).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", ranks).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
