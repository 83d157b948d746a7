"""Operators 11 to 13 against brute force."""

import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from taxoforge.llm import bpe, divergence, negatives
from taxoforge.llm.queries import op11_hard_negatives, tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


# ---- 11 hard negatives


def brute_negatives(rows, every=50, relabel=7):
    """rows: (vec_id, label, vector), usable ones; of equal ids the least."""
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = ((label + 1) % 10 if relabel and i % relabel == 0 else label, [int(np.floor(256.0 * e)) for e in v])
        own[i] = min(own.get(i, x), x)
    out = set()
    for a, (label, q) in own.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, w)), i, l == label) for i, (l, w) in own.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:5]:
            inside = [(n, i) for n, i, same in scores if not same and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out |= {(a, p, r, i, -s, -n) for r, (n, i) in enumerate(inside, 1)}
    return out


def negatives_of(df, **more):
    return [tuple(r) for r in negatives.hard_negatives(df, **more).collect()]


@pytest.mark.parametrize("tree_rows, leaf", [(40, 4), (2048, 64)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tree_rows, leaf):
    monkeypatch.setattr(negatives, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "TILE_TREES", 3)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 5)
    rnd = np.random.default_rng(7)
    rows = [(i, int(rnd.integers(0, 4)), rnd.normal(size=3).round(1).tolist()) for i in range(300)]  # coarse: many ties
    rows += [(i, int(rnd.integers(0, 10)), [0.5, -0.25, 1.0]) for i in range(300, 480)]  # one vector in over a third
    rows += [(500, 1, [0.0, 0.0, 0.0]), (550, 2, [-1.0, 3.0, 0.001])]
    got = negatives_of(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), relabel=7)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [0.5, 1.5]), (3, 2, [0.5, 1.5]), (3, 2, [0.5, 1.5]), (3, 1, [9.0, 9.0]), (50, 1, [1.0, 2.0])]
    odd = [(4, None, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (10, 2, [])]
    other = [(11, 2, [1.0, 1.0, 1.0]), (12, 2, [1e300, 1.0])]
    schema = "vec_id long, label int, embedding array<double>, tree string, low string, own string, cell string"
    df = spark.createDataFrame([(*r, *"abcd") for r in rows + odd + other], schema)
    got = negatives_of(df, relabel=None)
    assert set(got) == brute_negatives(rows, relabel=None) and got
    assert negatives_of(df.filter("vec_id is null")) == [] == negatives_of(df.limit(0)) == negatives_of(df.filter("vec_id = 1"))


def test_scores_beyond_double_precision_are_exact(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, i % 3, (rnd.integers(-(1 << 19), 1 << 19, 4) + rnd.integers(0, 256, 4) / 256).tolist()) for i in range(200)]
    got = negatives_of(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), every=10, relabel=None)
    assert max(r[4] for r in got) > 2**53 and set(got) == brute_negatives(rows, every=10, relabel=None)


def test_ball_trees_prune():
    rnd = np.random.default_rng(3)
    q = np.concatenate([rnd.normal(c, 3, (500, 8)).round() for c in rnd.normal(0, 200, (8, 8))])
    ids, labels = rnd.permutation(len(q)), np.zeros(len(q), np.int64)
    tree = negatives.BallTree.build(ids, labels, q.astype(np.int32))
    assert sorted(tree.ids) == list(range(len(q)))
    some = np.arange(0, len(q), 40)
    low = np.full((len(some), 1), negatives.LEAST)
    search = negatives.Search(ids[some], q[some], low, np.full_like(low, negatives.MOST), 5)
    search.run(tree, np.zeros(len(some)), True)
    full = q[some] @ q.T
    for i, a in enumerate(some):
        want = sorted((-s, j) for s, j in zip(full[i], ids) if j != ids[a])[:5]
        assert [(-s, j) for s, j in zip(search.score[i, 0], search.found[i, 0])] == want
    assert search.scored < 0.4 * len(some) * len(q)


def test_hard_negatives_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert {tuple(r) for r in op11_hard_negatives(spark, "/root/testdata/sf0.001").collect()} == brute_negatives(rows)


# ---- 12 divergence


def brute_audit(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        docs[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang, held in docs.items():
        kept = [t for t, n in held.items() if n >= min_docs]
        sources = [s for g, s in counts if g == lang]
        p = {}
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (c + 1) // (sum(whole.values()) + len(kept)) for t, c in whole.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s], "term": [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(sorted(found), 1) if part == "pair" or r <= top]
    return Counter(out)


def audited(df, **more):
    return Counter(tuple(r) for r in divergence.audit(df, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_against_brute_force(spark, monkeypatch, odd):
    for name, value in (("CHUNK_TERMS", 7), ("STRIPE_CHUNKS", 2), ("GROUP_BLOCK", 2), ("HELD_TERMS", 20)):
        monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in ("Ab", "é", "ß", "日本", "zz", "K") for b in "abcdefghij"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(40))) + "!1_", rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s1", "ü", "", None, "s9", "S5"])) for _ in range(150)]
    rows += [(" ".join(["ab"] * 3000), "en", "s0")] * 3 + [("", "xx", "only"), (None, None, None), ("123 ###", "xx", "second"), ("İstanbul \x7f K", "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert audited(df) == brute_audit(rows)
    assert audited(df, top=3, min_docs=1) == brute_audit(rows, 1, 3)
    assert audited(odd) == brute_audit([(r["text"], r["lang"], r["source"]) for r in odd.collect()])


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0
    few = [("one word", "en", "a"), ("other", "en", "b"), ("other", "fr", "b")]
    assert audited(spark.createDataFrame(few, "text string, lang string, source string")) == Counter([("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)])


def test_shares_do_not_overflow():
    counts, total = np.array([[10**14, 0, 7]]), np.array([3 * 10**14])
    assert divergence.shares(counts, total, 5).tolist() == [[1 + 10**9 * (c + 1) // (3 * 10**14 + 5) for c in (10**14, 0, 7)]]


# ---- 13 byte-level BPE


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_are_those_of_the_library(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CELLS", 4096)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3000)
    vocab = bpe.Vocabulary(RANKS)
    enc = bpe.Encoder(vocab, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    tokens = [t.decode("utf-8", "replace") for t in vocab.ranks]
    texts = ["", " ", "\n\n", "x" * 5000, "don't DON'T I'll", "<|endoftext|>", "\x00\x1c\u0085  a", "😀" * 300]
    for _ in range(150):
        texts.append("".join(rnd.choices("ab ", k=rnd.randrange(60))))
        texts.append("".join(rnd.choices(tokens, k=rnd.randrange(40))))
        texts.append("".join(chr(rnd.randrange(0x20, 0x2FFF)) for _ in range(rnd.randrange(50))))
        texts.append("".join(c for c in "".join(rnd.choices(tokens, k=rnd.randrange(150))) if c.isalpha()))
        texts.append("".join(rnd.choices("acgt", k=rnd.randrange(700))))
        texts.append(rnd.choice([" ", "\t", "a", "1", "=", "é"]) * rnd.randrange(600))
    for lo in range(0, len(texts), 50):
        for t, ids in zip(texts[lo : lo + 50], enc.encode(texts[lo : lo + 50])):
            assert ids.tolist() == reference.encode_ordinary(t)
            assert vocab.decode(ids) == t.encode()


def test_long_matches_merge_as_in_rounds():
    vocab, rnd = bpe.Vocabulary(RANKS), random.Random(2)
    for _ in range(60):
        row = vocab.byte_ids[np.frombuffer("".join(rnd.choices("abcehnrst", k=rnd.randrange(1, 200))).encode(), np.uint8)]
        rows = vocab.merge_rows(row[None].copy())
        assert vocab.merge_long(row).tolist() == rows[rows >= 0].tolist()


def test_pair_table_with_collisions():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 300, (2, 6000))
    pairs, first = np.unique(a * 1000 + b, return_index=True)
    table = bpe.PairTable(a[first], b[first], np.arange(len(first)))
    assert (table(a[first], b[first]) == np.arange(len(first))).all()
    miss = rnd.integers(0, 300, (2, 6000))
    assert ((table(*miss) == bpe.NONE) == ~np.isin(miss[0] * 1000 + miss[1], pairs)).all()
    assert (table(np.array([-1, 3]), np.array([3, -1])) == bpe.NONE).all()


def test_bpe_on_odd_tables(spark, odd, empty, reference):
    tokens = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], tuple(reference.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(tokens, RANKS).collect()) == want
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0 == bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count()
    lists = spark.createDataFrame([(1, None), (2, []), (None, [50])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["decoded"] if r["decoded"] is None else bytes(r["decoded"])) for r in bpe.decode(lists, RANKS).collect()} == {(1, None), (2, b""), (None, reference.decode_single_token_bytes(50))}
    for bad in ([60_000], [-1], [3, None]):
        with pytest.raises(Exception, match="vocabulary|null id"):
            bpe.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), RANKS).collect()
