"""The training-data operators on small tables against plain versions, and their odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanepulse.llm import chat_format, embed_dedup, line_dedup, media, minhash, packing, quality, sentencepiece_codec, token_store, toxicity
from lanepulse.llm.common import Scratch, tokenizer_path
from lanepulse.llm.components import connected_components
from lanepulse.llm.fragments import encoder

DOC = "doc_id long, text string, formatted string"
WORDS = ["lane", "Road", "été", "straße", "1", "22", ",", ".", "!", "?", "\n", " ", "  ", "\t", "'s", "漢字", "😀", " ", "　", "<|endoftext|>", "á", "­"]


def texts(n, seed, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "a b"), (5, "word " * 40_000), (6, "x y z"), (6, "x y z"), (None, "x y z"), (7, " \n\t ")]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], DOC)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_fragments_equal_whole_encoding(file, kind):
    some = texts(3000, 1)
    tok = Tokenizer.from_file(tokenizer_path(file))
    want = [x.ids for x in tok.encode_batch(some, add_special_tokens=False)]
    got = encoder(tokenizer_path(file), kind).encode([t.encode() for t in some])
    assert [g.tolist() for g in got] == want


def test_chat_formatting(spark):
    said = ["", "\\", "<|", "<|end|>", "\\<|turn|>", "é漢\n", "\\### Assistant: </turn> ok", "x" * 50_000, None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)]
    rows += [(2, None, None, "a"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, tokenizer_path("byte_bpe_50k.json"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(said)]))
    learned = "".join(t or "" for t in said[1::2])
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(learned), sha(learned))
    assert got[2].n_turns == 3 and got[2].loss_sha256 == sha("bb") and got[None].loss_sha256 == sha("z")
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_token_store(spark, tmp_path):
    docs = odd_docs(spark).union(spark.createDataFrame([(10 + i, t, "") for i, t in enumerate(texts(200, 2))], DOC))
    path = str(tmp_path / "ids")
    token_store.write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    start = 0
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(token_store.store_report(spark, path).collect(), key=lambda r: r.start)
    for want, r in zip(order, got, strict=True):
        ids = tok.encode(want.text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.read_ids(spark, path, [12]).count() == 1
    token_store.write_ids(empty_docs(spark), str(tmp_path / "none"), tokenizer_path("byte_bpe_50k.json"))
    assert token_store.store_report(spark, str(tmp_path / "none")).count() == 0


def test_media_columns(spark, tmp_path):
    docs = odd_docs(spark)
    store = media.store_texts(docs, str(tmp_path / "media"))
    found = media.resolve(media.interleave(docs, "doc_id", media.document_html(F.col("text"))), media.media_features(store)).collect()
    assert len(found) == docs.count()
    by = {r.key: r for r in found}
    for d in docs.collect():
        raw = (d.text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[d.doc_id]
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.caption == f"{len(d.text or '')} characters"
    html = '<p>a<b>b</b></p><figure><img src="sha256:ff" alt="x"><figcaption>c &amp; d</figcaption></figure><script>no</script>tail<img src="u" alt="y">'
    assert media.parse_sequence(html) == [["text", "ab", None, None], ["media", None, "sha256:ff", "c & d"], ["text", "tail", None, None], ["media", None, "u", "y"]]
    assert media.parse_sequence(None) == []


def test_packing(spark):
    docs = odd_docs(spark).union(spark.createDataFrame([(100 + i, "lane road " * (i * 7 % 300), "") for i in range(300)], DOC))
    rows = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((d.doc_id or -1, len(tok.encode(d.text or "", add_special_tokens=False).ids) + 1) for d in docs.collect())
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    sequences = {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty_docs(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def brute_viterbi(model, text):
    pieces = {p: (s, i) for i, (p, s, k) in enumerate(model.pieces) if k == sentencepiece_codec.NORMAL}
    best = [(0.0, [])] + [None] * len(text)
    for e in range(1, len(text) + 1):
        options = [(best[s][0] + pieces[text[s:e]][0], best[s][1] + [pieces[text[s:e]][1]]) for s in range(max(0, e - 20), e) if text[s:e] in pieces]
        if text[e - 1 : e] not in pieces:
            options.append((best[e - 1][0] + model.lowest - 10, best[e - 1][1] + [model.bytes[b] for b in text[e - 1].encode()]))
        best[e] = max(options, key=lambda o: o[0])
    return best[-1][1]


def test_sentencepiece(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec.of(model)
    some = texts(400, 3, 12)
    got = [g.tolist() for g in codec.encode([t.encode() for t in some])]
    assert got == [brute_viterbi(codec.model, "▁" + t.replace(" ", "▁")) if t else [] for t in some]
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd_docs(spark), model), model).collect()
    assert all(r.decoded == r.text for r in rows) and len(rows) == 9


def brute_groups(ids, linked):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_minhash(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    rows = []
    for t in base:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(w), ""))
    rows += [(1000, None, ""), (1001, "", ""), (1002, " \t", ""), (1003, "A b", ""), (1004, "a B", ""), (1004, "a B", "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()

    s = {i: sets(t) for i, t, _ in rows}
    linked = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    root = brute_groups(list(s), linked)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s[i]), root[i], root[i] == i) for i in s}
    assert len(got) == len(rows)
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.2, base[:3], base[:3]]).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    rows += [(500, None), (501, [0.0] * 16), (502, [None] + [1.0] * 15), (503, [float("nan")] * 16), (504, [float("inf")] * 16), (505, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("links", F.lit(1))
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    u = near.astype(np.float64) / np.linalg.norm(near.astype(np.float64), axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = brute_groups(range(len(u)), np.argwhere(link).tolist())
    true, found = link.sum(), sum(got[i].n_links for i in range(len(u)))
    assert found <= true and found >= 0.9 * true
    if found == true:
        assert all(got[i].component_id == root[i] for i in range(len(u)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(500, 506))


def test_embeddings_of_several_lengths(spark):
    """Lengths are compared each by itself, minority ones too; doubles keep their precision."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 4))
    rows = [(i, x.tolist()) for i, x in enumerate(base)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [2.0, -1.0]), (103, [0.0, 0.0]), (104, None), (105, [float("nan"), 1.0])]
    # a hair below and above the threshold, which single precision does not tell apart
    for k, c in ((200, 0.9 - 1e-10), (201, 0.9 + 1e-10)):
        rows.append((k, [1e3 * c, 1e3 * float(np.sqrt(1 - c * c)), 0.0]))
    rows.append((202, [1.0, 0.0, 0.0]))
    got = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for i, x in rows:
        near = [j for j, y in rows if j != i and x and y and len(x) == len(y) and np.isfinite(x).all() and np.isfinite(y).all() and np.linalg.norm(x) * np.linalg.norm(y) > 0 and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
        assert got[i].n_links == len(near)
    assert got[101].component_id == 100 and not got[101].kept and got[200].n_links == 1 and got[202].n_links == 1


def test_embeddings_over_many_cells(spark):
    """Recall against brute force where the index has a grid of many cells."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3000, 16))
    x = np.concatenate([centre, centre + rng.normal(size=centre.shape) * rng.uniform(0.05, 0.5, (3000, 1)), rng.normal(size=(16_000, 16))]).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": [r.tolist() for r in x]}), "vec_id long, embedding array<float>")
    got = embed_dedup.near_vectors(rows).toPandas().set_index("vec_id").n_links
    u = embed_dedup.unit(x)
    want = np.concatenate([(u[lo : lo + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for lo in range(0, len(u), 1000)])
    assert embed_dedup.build(u[:20_000], len(u), 0.9, 0.99).first.shape[0] >= 10
    assert want.sum() > 2000 and (got.reindex(range(len(x))).to_numpy() <= want).all()
    assert got.sum() >= 0.95 * want.sum()


def test_line_dedup(spark):
    line = " ".join(f"word{i}" for i in range(60))
    near = line.replace("word7 ", "other ")
    docs = [(1, f"{line}\nunique words stand here alone\n***"), (2, f"{near}\nUnique, words stand here ALONE!\n***"), (3, line.upper()), (4, None), (5, ""), (6, "short"), (7, "short"), (None, "short\nkept because it is new")]
    out = line_dedup.dedup_lines(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, pos string"))
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got[1] == (docs[0][1], 0) and got[3] == ("", 1) and got[2][0].endswith("***")
    assert "ALONE" not in got[2][0] and got[4] == ("", 0) and got[5] == ("", 0)
    assert sorted([got[6][1], got[7][1], got[None][1]]) == [0, 1, 1]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_counts_every_row(spark):
    """Rows without an id and rows that repeat one are documents of their own."""
    long = " ".join(f"word{i}" for i in range(300))
    nulls = [f"{a} {w}\n{w} {b}\n{end}" for w, a, b, end in [("lane", "before any other of its kind comes", "seldom or never repeats its words", "a line that is found twice"), ("road", "mostly quiet at night under trees", "north of town bends twice and ends", "a line that is found twice"), ("ramp", "there is scarcely room for one more", "closed since last winter for works", "nothing else in the table ends so")]]
    rows = [(None, t) for t in nulls] + [(7, long)] * 10 + [(7, "another text of that id stays"), (8, "a row of its own id")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    of_null = sorted(r.text for r in out if r.doc_id is None)
    assert sum(r.n_removed for r in out if r.doc_id is None) == 1
    assert [t.split("\n")[:2] for t in of_null] == sorted(t.split("\n")[:2] for t in nulls)
    assert any(t == nulls[2] for t in of_null)
    assert sorted((r.text, r.n_removed) for r in out if r.doc_id == 7) == [("", 1)] * 9 + [(rows[-2][1], 0), (long, 0)]
    assert [(r.text, r.n_removed) for r in out if r.doc_id == 8] == [(rows[-1][1], 0)]


def test_simhash_votes(spark, tmp_path):
    rng = random.Random(8)
    norms = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) for n in (1, 2, 5, 127, 128, 500)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(norms)], "doc_id long, pos int, norm string")
    got = {r.doc_id: r for r in line_dedup.with_signature(df, Scratch(spark, "test")).collect()}
    hashes = df.select("doc_id", F.transform(F.array_distinct(F.split("norm", " ")), lambda w: F.xxhash64(w)).alias("h")).collect()
    for r in hashes:
        bits = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in r.h) > len(r.h))
        assert got[r.doc_id].s1 & (2**64 - 1) == bits


def test_simhash_votes_of_long_lines(spark):
    """Every word votes, also beyond 32,767 words; words in front move hardly a bit."""
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 200_000)}" for _ in range(70_000)]
    norms = [" ".join(w) for w in (long[:32_767], long[:40_000], long, [f"new{i}" for i in range(100)] + long)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(norms)], "doc_id long, pos int, norm string")
    got = {r.doc_id: r for r in line_dedup.with_signature(df, Scratch(spark, "test")).collect()}
    words = sorted({w for t in norms for w in t.split()})
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"))
    hashed = {r.w: (r.h, r.g) for r in hashed.withColumn("g", F.xxhash64("h")).collect()}
    for i, t in enumerate(norms):
        h, g = (np.array([hashed[w][k] for w in sorted(set(t.split()))]) for k in (0, 1))
        s1 = sum(1 << b for b in range(64) if 2 * ((h >> b) & 1).sum() > len(h))
        s2 = [b for b in range(64) if b % 8 < 4 and 2 * ((g >> b) & 1).sum() > len(g)]
        # the low halves of bytes 4 to 7 are folded into the upper ones of bytes 0 to 3
        assert got[i].s1 & (2**64 - 1) == s1 and got[i].s2 == sum(1 << (b if b < 32 else b - 28) for b in s2)
    assert ((got[2].s1 ^ got[3].s1) & (2**64 - 1)).bit_count() <= 10


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    nodes = {x for e in edges for x in e}
    root = brute_groups(sorted(nodes), edges)
    assert all(got.get(n, n) == root[n] for n in nodes)


@pytest.mark.parametrize(("fit", "score"), [("quality", quality), ("toxic", toxicity)])
def test_classifiers_held_out(spark, fit, score):
    """Learns on four fifths of the given labels, and tells the rest apart; odd texts get a score.

    Toxic texts are a tenth of the labelled ones, with words of their own in each of four
    languages: a few dozen of them (sf0.01) do not show these words, hence the larger table."""
    path = "/root/testdata/sf0.01" if score is quality else "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    labels = labels.select("doc_id", F.col(fit).alias("label"))
    train = labels.filter("doc_id % 5 <> 0")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9, None), (10**9 + 1, "")], "doc_id long, text string"))
    if score is quality:
        stats = quality.document_statistics(rows)
        out = quality.score(stats, quality.fit(stats, train))
    else:
        out = toxicity.score(rows, toxicity.fit(rows, train))
    got = out.join(labels.filter("doc_id % 5 = 0"), "doc_id").toPandas()
    a, b = got[got.label == 1].score, got[got.label == 0].score
    ranked = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])
    assert ranked >= (0.97 if score is quality else 0.8)
    assert out.filter("doc_id >= 1000000000 and score between 0 and 1").count() == 2
    none = score.fit(quality.document_statistics(rows) if score is quality else rows, train.limit(0))
    assert none.constant is not None


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "line dedup", "MinHash near-dedup", "packing"]
    out = corpus_pipeline.STAGES[2][1](spark, docs, data)
    assert out.columns == docs.columns and out.count() <= 60


def test_pipeline_near_dedup(spark, data):
    """One document of each group stays, by brute force on sets of five words at 0.8."""
    import corpus_pipeline

    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 9999)}"
    rows = []
    for k in range(40):
        base = [word() for _ in range(rng.randint(150, 250))]
        rows.append((1000 - k, base))
        # one passage of 18 to 25 % more, and scattered edits of single words
        rows.append((k, base + [word() for _ in range(int(len(base) * rng.uniform(0.18, 0.25)))]))
        edited = list(base)
        for i in rng.sample(range(len(base)), int(len(base) * rng.uniform(0.01, 0.03))):
            edited[i] = word()
        rows.append((k + 100, edited))
    rows = [(i, " ".join(t)) for i, t in rows]
    rows += [(None, "copies of a text without any id stay once"), (None, "copies of a text without any id stay once"), (None, rows[0][1]), (None, "a text of its own"), (None, None)]
    rows += [(2000, "this text comes twice with one id")] * 2 + [(2000, "the same id with another text stays")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.near_dedup_stage(spark, df, data)
    assert out.columns == df.columns

    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = [sets(t) for _, t in rows]
    linked = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    root = brute_groups(range(len(s)), linked)
    first = {}
    for i, (d, t) in enumerate(rows):
        key = (d is None, d or 0, t or "")
        first[root[i]] = min(first.get(root[i], key), key)
    assert len(linked) > 40 and len(first) < len(rows) - 40
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == sorted(first.values())
