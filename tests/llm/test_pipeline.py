from collections import Counter, defaultdict

import numpy as np
import xxhash

import corpus_pipeline as cp
from taxoforge.llm import quality
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_lines, brute_targets, texts_of


def test_pipeline_runs_and_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == cp.COLUMNS
        if name != "mixing":
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.count() > 0
    out = cp.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert out.count() >= docs.select("doc_id").distinct().count()


def test_stages_take_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, df, "/root/testdata/sf0.001").count() <= 3 * df.count()
        packed = cp.STAGES[-1][1](spark, df, "/root/testdata/sf0.001")
        assert packed.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()


def test_near_stage_keeps_one_of_a_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (1, text), (2, text), (4, "something else altogether stands here in this one")]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_stage(spark, df, "").collect()) == [1, 4]


SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r[c] for c in cp.COLUMNS) for r in df.collect())


def test_every_stage_against_brute_force(spark):
    """Each stage on what the one before kept: rows that stay, texts that change, copies and pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    index = quality.index_vectors()
    good = cp.quality_stage(spark, docs, SF).cache()
    assert rows(good) == Counter(tuple(r[c] for c in cp.COLUMNS) for r in docs.collect() if model.score([(r["text"] or "").encode()], index)[0] >= quality.CUT) and 0 < good.count() < docs.count()

    lines = cp.line_stage(spark, good, SF).cache()
    want = Counter((d, k) for d, _, _, k in brute_lines(texts_of(good)).elements())
    import hashlib

    assert Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in lines.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = cp.near_stage(spark, lines, SF).cache()
    held = [(r["doc_id"], brute_fingerprint(r["text"])) for r in lines.collect()]
    names = {c for c in brute_components(held)}
    by_id = {r["doc_id"]: tuple(r[c] for c in cp.COLUMNS) for r in lines.collect()}
    assert rows(near) == Counter(by_id[i] for i in names) and 0 < near.count() < lines.count()

    mixed = cp.mixing_stage(spark, near, SF).cache()
    copies, size = Counter(rows(mixed)), lambda t: len(t[1].encode().split())
    assert set(copies) <= set(rows(near)) and max(copies.values()) <= 3
    sizes = defaultdict(int)
    for t in rows(near):
        sizes[t[3]] += size(t)
    for source, target in brute_targets(sizes).items():
        taken = sum(n * size(t) for t, n in copies.items() if t[3] == source)
        biggest = max(size(t) for t in rows(near) if t[3] == source)
        assert abs(taken - target) <= 0.1 * target + 3 * biggest
    assert rows(cp.mixing_stage(spark, near.repartition(7), SF)) == copies

    from tokenizers import Tokenizer

    from taxoforge.llm.queries import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path())
    packed = cp.packing_stage(spark, mixed, SF).collect()
    want_tokens = sum(n * (len(tok.encode(t[1], add_special_tokens=False).ids) + 1) for t, n in copies.items())
    assert sum(r["length"] for r in packed) == want_tokens
    fill = defaultdict(list)
    for r in packed:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in fill.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
    count = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in df.collect())
    assert sum(r["length"] for r in cp.run(spark, SF).collect()) == sum(r["length"] for r in docs.collect())
    assert {k[0] for k in count(cp.run(spark, SF))} == {k[0] for k in count(docs)}


def test_near_stage_on_rows_that_share_an_id(spark):
    """Unlike texts under one id are documents of their own; of rows without an id one of each group stays."""
    a, b, c = ("one two three four five six seven eight nine ten", "something else altogether stands here in this one", "and a third text that is like none of the others at all")
    given = [(5, a, "en", "x", 1), (5, b, "en", "x", 1), (5, b, "de", "a", 1), (3, b, "en", "y", 2), (None, c, "en", "z", 3), (None, c, "en", "z", 3), (None, a, "fr", "z", 3), (7, None, "en", "q", 0), (8, "", "en", "q", 0)]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_stage(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "", r["source"]) for r in got) == sorted([("5", a, "x"), ("3", b, "y"), ("None", c, "z"), ("7", "", "q")])
    assert xxhash.xxh64_intdigest(b"") != 0
