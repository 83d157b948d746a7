import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from taxoforge.llm import chat, line_dedup, media, mixing, nearest, packing, passages, quality, simhash, suffixes
from taxoforge.llm.queries import op4_chat_formatting, tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- 1 quality


def test_quality_learns_and_scores_all(spark, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(big, labels)
    got = quality.score(big, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(empty, model).count() == 0
    none = quality.fit(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {1.0}
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns


def test_long_texts_are_pooled_in_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" + "  " * int(x % 3) for x in rnd.integers(0, 300, n)).encode() for n in (5, 4000, 300, 9000)] + [b"", b"x" * 5000 + b" y", b" \n "]
    vectors, index = rnd.normal(size=(quality.WORDS + quality.SHAPES, quality.DIM)).astype(np.float32), quality.index_vectors()
    whole = quality.pooled_texts(texts, vectors, index)
    monkeypatch.setattr(quality, "BATCH_BYTES", 700)
    monkeypatch.setattr(quality.pieces, "__defaults__", (700,))
    assert [b"".join(quality.pieces(t)) for t in texts] == texts and len(list(quality.pieces(texts[1]))) > 10
    assert np.abs(quality.pooled_texts(texts, vectors, index) - whole).max() < 1e-5


def test_equal_rows_get_equal_scores_in_batches_of_all_sizes():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(97, 4 * quality.DIM + 2)).astype(np.float32)
    w = [rnd.normal(size=s) for s in ((x.shape[1], quality.HIDDEN), (quality.HIDDEN,), (quality.HIDDEN,), ())]
    net = quality.Network(x.mean(0), x.std(0) + 1e-3, w)
    whole = net.score(x)
    for n in (1, 2, 3, 5, 8, 13, 40):
        assert all((net.score(x[lo : lo + n]) == whole[lo : lo + n]).all() for lo in range(0, len(x), n))
    assert len(set(net.score(np.repeat(x[:1], 61, axis=0)))) == 1
    assert net.score(x[:0]).shape == (0,)


def test_held_out_rule(spark):
    got = spark.range(200).select("id", quality.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# ---- 2 nearest


def brute_nearest(vectors, every, k):
    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors], dtype=np.float64)
    out = {}
    for i, q in zip(ids, v):
        if i % every == 0:
            d = np.sqrt(((v - q) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), d[j]) for j in order]
    return out


def test_nearest_recall_and_ties(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in e.collect()], 20, 10)
    got = defaultdict(list)
    for r in nearest.nearest(e, every=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q, g in got.items() for i, s in g)


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (100, [1.0, 0.0, 2.0]), (7, [1.0, 0.0, 2.0]), (3, [1.0, 0.0, 2.0]), (4, [0.0, 5.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (8, [float("nan"), 1.0, 1.0]), (9, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (200, [1.0]), (11, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, codes string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.nearest(df, k=3).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 7), (0, 3, 100), (100, 1, 0), (100, 2, 3), (100, 3, 7)]
    assert nearest.nearest(df.limit(0)).count() == 0


# ---- 3 line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    low = lambda d: -1 if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(low(d))
    out = Counter()
    for d, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == low(d)]
        out[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_line_dedup(docs, odd, empty):
    for df in (docs, odd):
        assert rows_of(line_dedup.dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute_lines(texts_of(df))
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.replace_lines(odd).columns == odd.columns


def test_line_dedup_is_reversible(spark):
    line = "the very same line that stands in many of these documents"
    df = spark.createDataFrame([(i, line) for i in range(6)], "doc_id long, text string")
    all_ = line_dedup.build_state(df)
    count = lambda s: {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(df, state=s).collect()}
    keys = lambda s: sum(int((np.frombuffer(r["filter"], np.uint16) > 0).sum()) for r in s.filters.collect())
    assert count(all_) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0} and keys(all_) == 1
    gone = line_dedup.delete_docs(all_, spark.createDataFrame([(5,), (4,)], "doc_id long"))
    assert set(count(gone).values()) == {0} and keys(gone) == 0
    back = line_dedup.insert_docs(gone, df.filter("doc_id = 4"))
    assert count(back) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0} and keys(back) == 1


def test_line_state_after_changes_equals_a_fresh_one(spark, docs, monkeypatch):
    parts = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3))).cache()
    cut = lambda *n: parts.filter(F.col("part").isin(*n)).drop("part")
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    state = line_dedup.build_state(cut(0, 1), min_docs=2)
    assert state.n_shards > 1
    state = line_dedup.delete_docs(line_dedup.insert_docs(state, cut(2, 1)), cut(0).select("doc_id"))
    fresh = line_dedup.build_state(cut(1, 2), min_docs=2)
    table = lambda df, *c: rows_of(df, *c)
    assert table(state.refs, "k1", "k2", "n_docs", "keep_doc") == table(fresh.refs, "k1", "k2", "n_docs", "keep_doc")
    assert table(state.postings, "k1", "k2", "doc_id", "th") == table(fresh.postings, "k1", "k2", "doc_id", "th")
    hot = state.refs.filter("n_docs >= 2")
    assert sum(int((np.frombuffer(r["filter"], np.uint16) > 0).sum()) for r in state.filters.collect()) == hot.count()
    few = line_dedup.probe(state).collect()
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 4)
    many = line_dedup.probe(state).collect()
    assert Counter(few) == Counter(many)
    assert line_dedup.probe(state).join(hot, ["k1", "k2"], "left_semi").count() == state.postings.join(hot, ["k1", "k2"], "left_semi").count() < state.postings.count()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    f = line_dedup.CuckooFilter(5000)
    f.insert(keys)
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    small = line_dedup.CuckooFilter(2)
    small.insert(keys[:200])
    assert small.contains(keys[:200]).all()


# ---- 4 chat


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    bits = ["</turn>", "<turn> ", "\\", "\n", "### ", "x", "é", "\\\\", "user", " ", "\x00", "𝄞"]
    for _ in range(300):
        turns = [("".join(rnd.choices(bits, k=rnd.randrange(6))), "".join(rnd.choices(bits, k=rnd.randrange(12)))) for _ in range(rnd.randrange(4))]
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns
    with pytest.raises(ValueError):
        chat.parse("<turn> user\nno end")


def test_chat_digests(spark):
    rows = [(1, 0, "user", "a", "z"), (1, 1, "assistant", "b</turn>", "z"), (1, 2, "user", None, "z"), (1, 3, "assistant", "c\\", "z"), (2, 0, "user", "only", "z"), (None, None, None, None, "z"), (3, 1, "assistant", "t", "z"), (3, 1, "assistant", "t", "z"), (3, 1, "assistant", "s", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    seg = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.read_back(seg).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb</turn>\nuser\n\nassistant\nc\\\n")
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"], got[1]["n_examples"]) == (4, 10, sha("b</turn>c\\"), 2)
    assert (got[2]["n_examples"], got[2]["loss_sha256"]) == (0, sha(""))
    assert got[None]["n_turns"] == 1 and got[3]["loss_sha256"] == sha("stt")
    ex = {(r["conv_id"], r["example"]): (r["context"], r["target"]) for r in chat.example_texts(seg).collect()}
    assert len(ex) == 5 and chat.unescape(ex[1, 1][1]) == "c\\"
    assert [t for _, t in chat.parse(ex[1, 1][0] + ex[1, 1][1] + "</turn>\n")] == ["a", "b</turn>", "", "c\\"]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_long_conversations(spark, monkeypatch):
    """A very long text, and context that is cut into several rows: the same digests and examples."""
    rnd = random.Random(8)
    rows = [(c, t, "assistant" if t % 3 == 2 else "user", "".join(rnd.choices("ab\\\n</turn>### ", k=rnd.randrange(200)))) for c in range(3) for t in range(31)]
    rows.append((1, 31, "user", "x</turn>" * 200_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.format_turns(df)
    one = rows_of(chat.read_back(whole), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")
    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert {r[2] for r in one if r[0] == 1} == {sha} and {r[1] for r in one} == {31, 32}
    assert chat.examples(whole).count() == 30 and whole.count() == 33


def test_chat_examples_are_written_whole(spark, monkeypatch):
    """Every reply is a row of its own with all that comes before it, in pieces of any size; the query reads these."""
    rnd = random.Random(4)
    rows = [(c if c else None, t, "assistant" if rnd.random() < 0.4 else "user", "".join(rnd.choices("ab\\\n</turn>### é", k=rnd.randrange(90)))) for c in range(8) for t in range(3 * c + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(df)
    want = {(r["conv_id"], r["example"]): (r["context"], r["target"]) for r in chat.example_texts(segments).collect()}
    digests = rows_of(chat.read_back(segments), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")
    for most in (0, 300, 1 << 20):
        written = chat.expand(segments, most=most)
        got = defaultdict(list)
        for r in written.collect():
            if r["example"] is not None:
                got[r["conv_id"], r["example"]].append(r)
        texts = {k: "".join(r["text"] for r in sorted(v, key=lambda r: r["piece"])) for k, v in got.items()}
        spans = {k: [(r["loss_start"], r["loss_end"]) for r in v if r["loss_start"] is not None] for k, v in got.items()}
        assert {k: (t[: spans[k][0][0]], t[spans[k][0][0] : spans[k][0][1]]) for k, t in texts.items()} == want
        assert all(len(v) == 1 and texts[k][v[0][1] :] == "</turn>\n" for k, v in spans.items())
        assert rows_of(chat.read_examples(written), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples") == digests
    with pytest.raises(Exception, match="contexts of conversation"):
        chat.read_examples(written.withColumn("text", F.expr("if(example > 0, replace(text, '<turn> user', '<turn> used'), text)"))).collect()
    seen = []
    monkeypatch.setattr(chat, "read_examples", lambda x, own=chat.read_examples: seen.append(x) or own(x))
    op4_chat_formatting(spark, DATA).collect()
    assert seen and seen[0].filter("example is not null").count() == seen[0].select("conv_id", "example").filter("example is not null").distinct().count() > 0


# ---- 5 media


def test_media(docs, odd, empty):
    for df in (docs, odd):
        want = Counter()
        for d, t in texts_of(df):
            raw = t.encode()
            pay = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            m = media.wave_header(len(pay)) + pay
            want[(d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.features(m)[5])] += 1
        got = media.media_table(df)
        assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == want
    assert media.media_table(empty).count() == 0


def test_texts_that_end_in_zeros_lose_no_document(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(9000))
    text += "x" * ((20 - len(text)) % 64)  # room for zeros in the last block
    rows = [(2, text + "\0"), (1, text), (3, text + " and a tail of its own"), (4, "other"), (None, text + "\0\0"), (1, text + "\0\0\0"), (5, "\0"), (6, None), (7, "")]
    for order in (rows, rows[::-1], rows[3:] + rows[:3], rows[1::2] + rows[::2]):
        got = rows_of(media.media_table(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)), "doc_id", "n_bytes", "payload_sha256")
        want = Counter()
        for d, t in rows:
            raw = (t or "").encode()
            want[(d, len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64 or (64 if not raw else 0))).hexdigest())] += 1
        assert got == want


def test_gear_cuts_follow_content():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(60_000))
    ends = media.gear_cuts(data)
    assert ends[-1] == len(data) and all(b - a <= media.MAX_CHUNK for a, b in zip([0, *ends], ends))
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"some bytes before" + data
    ends = media.gear_cuts(moved)
    assert len(chunks & {moved[a:b] for a, b in zip([0, *ends], ends)}) >= len(chunks) - 3


# ---- 6 passages


def test_passages(spark, odd, empty):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijk", k=7))
    own = lambda n: [word() for _ in range(n)]
    p = own(70)
    fuzzy = list(p)
    fuzzy[33] = "changed"
    short = own(40)
    rows = [own(60) + p + own(30), own(10) + p, own(90) + fuzzy + own(20), own(50) + short, short + own(80), own(300)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)] + [(9, " ".join(rows[5])), (5, " ".join(rows[5]))], "doc_id long, text string")
    got = passages.fuzzy_passages(df).collect()
    pairs = [r for r in got if r["kind"] == "passage"]
    assert {r["doc_id"] for r in pairs} | {r["ref_doc_id"] for r in pairs} == {0, 1, 2}
    place = {0: (60, 130), 1: (10, 80), 2: (90, 160)}
    for r in pairs:
        assert (r["start"], r["end"]) == place[r["doc_id"]] and (r["ref_start"], r["ref_end"]) == place[r["ref_doc_id"]]
        assert r["similarity"] >= 0.8
    assert [(r["doc_id"], r["ref_doc_id"]) for r in got if r["kind"] == "copy"] == [(9, 5)]
    assert passages.fuzzy_passages(odd).filter("kind = 'passage'").count() == 0
    assert passages.fuzzy_passages(empty).count() == 0


def test_passages_beside_a_smaller_partial_holder(spark):
    rnd = random.Random(11)
    own = lambda n: ["".join(rnd.choices("abcdefghijk", k=7)) for _ in range(n)]
    rows, want = [], set()
    for g in range(12):  # in each group two whole holders and six of 40 words of it in a row
        p = own(60)
        rows += [own(30) + p + own(30), own(20) + p + own(40)] + [own(15) + p[i : i + 40] + own(45) for i in (0, 10, 20) * 2]
        want.add((8 * g, 8 * g + 1))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {tuple(sorted((r["doc_id"], r["ref_doc_id"]))) for r in passages.fuzzy_passages(df).collect()}
    assert got == want


def test_passages_repeated_in_one_document(spark):
    rnd = random.Random(12)
    own = lambda n: ["".join(rnd.choices("abcdefghijk", k=7)) for _ in range(n)]
    p = own(70)
    rows = [own(20) + p + own(80) + p + own(10), own(200), ["ab"] * 60]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["end"], r["ref_doc_id"], r["ref_start"], r["ref_end"]) for r in passages.fuzzy_passages(df).collect()]
    assert got == [(0, 170, 240, 0, 20, 90)]


def test_chain_is_collinear():
    got = passages.chain([(0, 100), (10, 110), (20, 5), (22, 121), (90, 10)])
    assert got[0] == [(0, 100), (10, 110), (22, 121)]
    assert sorted(x for c in got for x in c) == [(0, 100), (10, 110), (20, 5), (22, 121), (90, 10)]


# ---- 7 mixing


def brute_targets(sizes, repeat=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(repeat * sizes[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        target = {s: repeat * sizes[s] if s in fixed else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > repeat * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        assert len(got) == df.count()
        sizes, taken, target = Counter(), Counter(), {}
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        want = brute_targets(sizes)
        for s, t in want.items():
            assert abs(target[s] - t) <= 1e-6 * max(1, t)
            assert abs(taken[s] - t) <= 0.02 * t + 40
        assert rows_of(mixing.mix(df.repartition(5)), "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)
    assert mixing.mix(empty).count() == 0
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and max(Counter(r["doc_id"] for r in out.collect()).values()) <= 3
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(empty).count() == 0


# ---- 8 simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    """Smallest id reachable, for (id, fingerprint) pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_simhash(docs, odd, empty):
    for df in (docs, odd):
        rows = [(d, brute_fingerprint(t)) for d, t in texts_of(df)]
        want = Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_components(rows)))
        assert rows_of(simhash.near_groups(df), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(empty).count() == 0


def test_ball_links_find_all_pairs(spark):
    rnd = random.Random(2)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for n in (1, 2, 3, 4, 3):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), n)))
        for lo, width in simhash.BLOCKS:
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(lo, lo + width), 3)))
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    from taxoforge.llm.components import components

    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.ball_links(nodes)).collect()}
    want = brute_components(list(enumerate(fps)))
    groups = defaultdict(set)
    for f, c in zip(signed, want):
        groups[c].add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path(spark):
    from taxoforge.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 303
    assert components(edges.limit(0)).count() == 0


# ---- 9 suffixes


def brute_repeats(rows, depth):
    seen = Counter()
    data = [(d, t.encode()) for d, t in rows]
    for _, b in data:
        seen.update(b[p : p + depth] for p in range(len(b) - depth + 1))
    out = Counter()
    for d, b in data:
        hit = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if seen[b[p : p + depth]] > 1:
                hit[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, h in zip(b, hit) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (not i or not hit[i - 1]))
        out[(d, len(b), sum(hit), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffixes(spark, docs, odd, empty):
    rnd = random.Random(1)
    base = [t for _, t in texts_of(docs.limit(60))]
    bits = [rnd.choice(base)[i : i + rnd.choice([380, 399, 400, 401, 410, 450, 500, 700])] for i in range(0, 60, 5)]
    made = base + ["ab" * 700, "x" * 1200, "é" * 450, "", base[3], base[3][5:]]
    made += [rnd.choice(base)[: rnd.randrange(300)] + rnd.choice(bits) + rnd.choice(bits) + rnd.choice(base)[: rnd.randrange(600)] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    for x in (df, odd):
        got = suffixes.cut_repeats(x)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(texts_of(x), 400)
    assert suffixes.cut_repeats(empty).count() == 0


def test_shuffled_lists_give_what_sent_ones_give(spark, docs, monkeypatch):
    """Ops 5, 6 and 9 with no room for broadcasts."""
    some = docs.limit(80).cache()
    kinds = (
        (suffixes, "SENT_BYTES", lambda: rows_of(suffixes.cut_repeats(some), "doc_id", "n_removed", "n_spans", "kept_sha256")),
        (media, "ORDERS_BYTES", lambda: rows_of(media.media_table(some), "doc_id", "payload_sha256", "media_sha256", "feature", "n_chunks")),
        (passages, "SENT_BYTES", lambda: rows_of(passages.fuzzy_passages(some), "kind", "doc_id", "start", "end", "ref_doc_id", "ref_start", "ref_end")),
    )
    for module, name, run in kinds:
        sent = run()
        with monkeypatch.context() as m:
            m.setattr(module, name, -1)
            assert run() == sent


def test_anchors_by_pieces(monkeypatch):
    rnd = random.Random(4)
    data = bytes(rnd.choice(b"abc") for _ in range(5000))
    whole = {(lo + i, lo + off) for lo, n, off, _, _ in suffixes.anchors(data) for i in range(n)}
    monkeypatch.setattr(suffixes, "PIECE_BITS", 10)
    assert {(lo + i, lo + off) for lo, n, off, _, _ in suffixes.anchors(data) for i in range(n)} == whole


# ---- 10 packing


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for df in (docs, odd):
        pieces = packing.pack(df, tokenizer_path(), with_ids=True).collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in pieces:
            by_seq[r["sequence_id"]].append(r)
            by_doc[r["doc_id"]].append(r)
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        padding = total = 0
        for rs in by_seq.values():
            at = 0
            for r in sorted(rs, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096
            padding += 0 if at & (at - 1) == 0 else 4096 - at
            total += at
        assert padding <= 0.01 * total
        want = defaultdict(list)
        for d, t in texts_of(df):
            want[d].append([*tok.encode(t, add_special_tokens=False).ids, 2])
        for d, lists in want.items():
            if len(lists) == 1:
                assert [i for r in sorted(by_doc[d], key=lambda r: r["start"]) for i in r["ids"]] == lists[0]
                assert all(r["doc_tokens"] == len(lists[0]) for r in by_doc[d])
            else:
                assert sum(r["length"] for r in by_doc[d]) == sum(map(len, lists))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_word_tokenizer_equals_whole_texts():
    tok = packing.word_tokenizer(tokenizer_path())
    odd = ["", "  ", "It's a'story l'été ÀÉ ﬁ é ́x \x85y\xa0z \x1cq Straße İx ΑΣ, ΑΣ. a.,b 12.5, 3., ... ,,, x!., don't.''s , 　 z", "́ ́a b́.", "<|endoftext|>, a<|startoftext|>b"]
    assert [list(x) for x in tok.encode(odd)] == [tok.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]


def test_tokenizers_of_another_kind(tmp_path):
    """A tokenizer that keeps case, and one that keeps white space, give the ids of whole texts too."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["the", "The", "quick", "fox", ".", ",", "a", "A", " the", " fox"]
    for cut, kind in ((pre_tokenizers.Whitespace(), (False, True)), (pre_tokenizers.Split(" ", "merged_with_next"), (False, False))):
        tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(["?", *words])}, unk_token="?"))
        tok.pre_tokenizer = cut
        tok.save(str(tmp_path / "t.json"))
        own = packing.WordTokenizer(str(tmp_path / "t.json"))
        assert (own.lower, own.by_word) == kind
        texts = ["The quick fox, the fox.", "a A  the", ""]
        assert [list(x) for x in own.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_cache_shrinks(docs, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    tok = packing.WordTokenizer(tokenizer_path())
    every = [t for _, t in texts_of(docs)]
    for lo in range(0, 60, 5):
        texts = every[lo : lo + 5]
        assert [list(x) for x in tok.encode(texts)] == [tok.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert tok.encode([]) == []
    tok.shrink(50)
    assert len(tok.index) <= 50


def test_pack_block_balances():
    pieces = packing.pack_block([5000, 3000, 100, 100, 92], 4096)
    by = defaultdict(int)
    for _, _, n, s, _ in pieces:
        by[s] += n
    assert sorted(by.values(), reverse=True) == [4096, 4096, 64, 32, 4]
