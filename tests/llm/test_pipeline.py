"""The pipeline's stages against plain versions, over odd inputs and whole small tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from lanepulse.llm import embed_dedup, quality, queries, toxicity
from lanepulse.llm.common import fold_bucket, table, tokenizer_path


def held_back(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def plain_quality(spark, data):
    """{doc_id: score} of all documents by dense matrices and determinants, nothing cached."""
    stats = {r.doc_id: np.array(r.x) for r in quality.document_statistics(table(spark, data, "documents")).collect()}
    labels = {}
    for r in table(spark, data, "labels").collect():
        if r.doc_id is not None and r.quality is not None and not held_back(r.doc_id, 5, 0):
            labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    x = [np.array([stats[i] for i, y in labels.items() if y == c and i in stats]) for c in (0, 1)]
    own = [np.cov(v.T) for v in x]
    pooled = sum(o * (len(v) - 1) for o, v in zip(own, x, strict=True)) / (sum(map(len, x)) - 2)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    out = {}
    for i, s in stats.items():
        log = []
        for v, o in zip(x, own, strict=True):
            cov = 0.95 * (0.7 * o + 0.3 * pooled) + 0.05 * floor
            away = s - v.mean(axis=0)
            log.append(-0.5 * away @ np.linalg.inv(cov) @ away - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(v)))
        out[i] = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    return out


def test_quality_densities_and_stage(spark, data):
    want = plain_quality(spark, data)
    got = queries.op6_quality(spark, data).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 and r.held_out == held_back(r.doc_id, 5, 0) for r in got)
    docs = table(spark, data, "documents")
    kept = C.quality_stage(spark, docs, data)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in want.items() if s >= 0.3)


def test_toxicity_stage_keeps_what_the_score_says(spark, data):
    docs = table(spark, data, "documents")
    labels = table(spark, data, "labels").select("doc_id", F.col("toxic").alias("label")).filter(fold_bucket(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(docs, labels)
    # one text at a time, through the two compressors alone
    scores = {r.doc_id: float(toxicity.predict(model, toxicity.histograms(model, [(r.text or "").encode()]))[0]) for r in docs.collect()}
    kept = C.toxicity_stage(spark, docs, data)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s < 0.3)


def check_packed(pieces, texts, tokenizer):
    """Pieces against the library's own ids: each id once, sequences without gaps."""
    rows = {}
    for r in pieces:
        rows.setdefault(r.doc_id, []).append(r)
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(rows[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and list(r.ids) == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    return sum(r.length for r in pieces) / (4096 * len(sequences))


def test_packing_stage(spark, data):
    docs = table(spark, data, "documents")
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_packed(C.packing_stage(spark, docs, data).collect(), texts, tok) > 0.9
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 10_000, "c")], "doc_id long, text string, ids string")
    check_packed(C.packing_stage(spark, odd, data).collect(), {r.doc_id: r.text for r in odd.collect()}, tok)


ODD = "doc_id long, text string, _row string, n_removed string, n_lines string, component_id string, score string, label int, kept string"


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES[:-1]])
def test_stages_over_odd_tables(spark, data, name):
    """Names that stages use themselves, missing n_chars, nulls, empty texts, repeats, and no rows at all."""
    stage = dict(C.STAGES)[name]
    text = "a line of words that is long enough to stand by itself\nand another one which is different from it"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text + " ending"), (None, None), (4, "short"), (5, "x" * 70_000)]
    docs = spark.createDataFrame([(i, t, "r", "p", "q", "c", "s", 1, "k") for i, t in rows], ODD)
    out = stage(spark, docs, data)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) <= len(rows) and all(tuple(r)[2:] == ("r", "p", "q", "c", "s", 1, "k") for r in got)
    if name == "MinHash near-dedup":  # two equal texts, one of them kept; nulls and empty ones stay
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)] or len(got) == 7
    empty = stage(spark, docs.limit(0), data)
    assert empty.columns == docs.columns and empty.count() == 0


def test_line_dedup_stage_against_plain(spark, data):
    """Exact copies of lines: the first by document and place stays; a text that loses all its lines goes."""
    a, b, c, d = ("crossing lanes under heavy evening rain", "northbound traffic slowed beyond the second bridge", "detour signs were posted along every ramp", "quiet morning hours without any reported delay")
    texts = {3: f"{a}\n{b}", 1: f"{b}\n{c}", 2: a, 4: f"{c.upper()}\n{d}", 5: f"{d}\n***", 6: None}
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    seen, want = set(), {}
    for i, t in sorted(texts.items()):
        lines = (t or "").split("\n")
        left = [x for x in lines if x == "***" or not x or not (x.lower() in seen or seen.add(x.lower()))]
        if len(left) == len(lines) or "\n".join(left).strip():
            want[i] = "\n".join(left)
    got = C.line_dedup_stage(spark, docs, data).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_vectors_of_any_scale(spark):
    """Squares of tiny and huge doubles vanish or overflow; their directions are compared all the same."""
    rows = [(1, [1e-200] * 4), (2, [2e-200] * 4), (3, [1e200] * 4), (4, [5e-324, 0.0, 0.0, 0.0]), (5, [1e308, 1e-308, 0.0, 0.0]), (6, [0.0, 1.0, 0.0, 0.0]), (7, [-1e200, 1e200, -1e200, 1e200]), (8, [0.0] * 4)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (0, 7, True), 8: (0, 8, True)}
