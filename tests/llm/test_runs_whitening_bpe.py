"""Periodic runs, whitening and byte-level BPE against plain versions, and their odd cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lanepulse.llm import byte_bpe, periodic_runs, queries, whitening
from lanepulse.llm.common import tokenizer_path

DOC = "doc_id long, text string, runs string, ids string, decoded string"


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "one"), (5, "a b c " * 20_000), (6, "x y z"), (6, "x y z"), (None, "w " * 30), (7, " \n\t "), (8, "é\x85a b" * 40)]
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOC)


def plain_runs(w, least_words=24, least_periods=3):
    found = set()
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least_words, least_periods * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                found.add((i, n, q))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_against_plain_search():
    rng = random.Random(5)
    for _ in range(300):
        letters, w = rng.choice([1, 2, 3, 20]), []
        while len(w) < rng.randint(0, 160):
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
            w += (root * rng.randint(1, 9))[: rng.randint(3, 90)]
        w = [b"%d" % x for x in w]
        assert [tuple(r) for r in periodic_runs.text_runs(w).tolist()] == plain_runs(w)


def test_common_extension_crosses_blocks():
    rng = random.Random(6)
    w = ([rng.randint(1, 2) for _ in range(40)] * 4)[:150]
    tree = periodic_runs.SuffixTree(w)
    i, j = map(np.ravel, np.meshgrid(np.arange(151), np.arange(151)))
    i, j = i[i != j], j[i != j]
    plain = [next((k for k in range(151) if max(a, b) + k >= 150 or w[a + k] != w[b + k])) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert periodic_runs.CommonExtension(tree)(i, j).tolist() == plain


def contract_runs(doc_id, text):
    """What the query promises, word by word."""
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = (sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


def test_runs_query_against_contract(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter(F.length("text") < 12_000)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    want = {r.doc_id: contract_runs(r.doc_id, r.text) for r in docs.collect()}
    assert got == want and sum(r[0] > 0 for r in want.values()) > 5


def test_runs_odd_cases(spark):
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(odd_docs(spark)).collect()]
    assert (5, [(0, 60_000, 3)], "a b c") in got and (None, [(0, 30, 1)], "w") in got
    assert got.count((6, [], "x y z")) == 2 and (1, [], "") in got and (7, [], "") in got
    assert len(got) == 9 and next(g for g in got if g[0] == 8)[1] == [(0, 41, 1)] or len(next(g for g in got if g[0] == 8)[1]) == 1
    assert periodic_runs.find_runs(odd_docs(spark).limit(0)).count() == 0


def check_whitening(got, x, ids):
    """``got``: rows of the operator for these whole-number vectors."""
    n, d = x.shape
    s = x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(8, int((e > 1e-6 * max(e[0], 1)).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert set(by_id) == set(ids) and all(sorted(c) == list(range(1, k + 1)) for c in by_id.values())
    w = np.array([[by_id[i][c + 1].whitened for c in range(k)] for i in ids])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9 and max(r.identity_error for r in got) < 1e-9
    assert [by_id[i][1].deviation for i in ids] == [int(sum((n * a - b) ** 2 for a, b in zip(row, s.tolist(), strict=True))) for row in x.tolist()]
    for c in range(k):
        assert abs(by_id[ids[0]][c + 1].explained / (e[c] / e.sum()) - 1) < 1e-9
        axis = centred.T @ w[:, c] / n / np.sqrt(e[c])  # covariance of the data with a component is the axis, scaled
        assert np.abs(v @ axis - e[c] * axis).max() < 1e-8 * e[0]
        assert by_id[ids[0]][1].n == n


def test_whitening_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 100_000
    check_whitening(queries.op12_embedding_whitening(spark, data).collect(), x, [r.vec_id for r in rows])


def test_whitening_odd_cases(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    three = rng.normal(size=(40, 3)).tolist()
    square = [[1.0, 1.0], [1.0, -1.0], [-1.0, 1.0], [-1.0, -1.0]]  # an eigenvalue twice
    rows = [(i, v, "clash") for i, v in enumerate(three)] + [(100 + i, v, "clash") for i, v in enumerate(square)]
    rows += [(200, [2.0] * 5, ""), (201, [2.0] * 5, ""), (202, [], "")]  # no variance: no components
    rows += [(300, None, ""), (301, [1.0, None], ""), (302, [nan, 1.0], ""), (303, [1.0, inf], ""), (304, [1e300, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == set(range(40)) | {100, 101, 102, 103}
    check_whitening([r for r in got if r.vec_id < 40], np.floor(1024 * np.array(three)).astype(np.int64) + 100_000, list(range(40)))
    check_whitening([r for r in got if r.vec_id >= 100], np.floor(1024 * np.array(square)).astype(np.int64) + 100_000, [100, 101, 102, 103])
    big = [(i, [float(v) for v in row], "") for i, row in enumerate(rng.integers(-(2**37), 2**37, size=(6, 2)).tolist())]
    large = whitening.whiten(spark.createDataFrame(big, df.schema)).collect()
    assert len(large) == 12 and max(r.identity_error for r in large) < 1e-9 and all(r.deviation is None for r in large)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 200")).count() == 0


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(4)
    for d in (1, 2, 5, 7):
        a = rng.integers(-9, 10, size=(d, max(d - 1, 1)))
        m = (a @ a.T).tolist()
        poly = whitening.characteristic(spark, {d: m}).get(d)
        for x in range(-3, 4):  # the determinant by Leibniz' recursion
            b = [[(x if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)]
            det = lambda q: sum((-1) ** k * q[0][k] * det([r[:k] + r[k + 1 :] for r in q[1:]]) for k in range(len(q))) if q else 1
            assert sum(c * x**k for k, c in enumerate(poly)) == det(b)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks, public_tokenizers.PATTERN


def random_texts(ranks, n):
    rng, tokens = random.Random(8), list(ranks)
    out = []
    for k in range(n):
        if k % 3 == 0:
            points = [rng.choice([rng.randrange(32, 127), rng.randrange(0x100), rng.randrange(0x3000, 0xA000), rng.randrange(0x400, 0x600), rng.randrange(0x10000, 0x110000)]) for _ in range(rng.randrange(30))]
            out.append("".join(map(chr, points)))
        elif k % 3 == 1:
            out.append("".join(rng.choice("abcdefghij aeiou\n 1.'s") for _ in range(rng.randrange(60))))
        else:
            out.append(b"".join(rng.choice(tokens) for _ in range(rng.randrange(9))).decode("utf-8", "ignore"))
    return out


def test_byte_bpe_equals_library(spark, library):
    encoding, ranks, pattern = library
    texts = [*random_texts(ranks, 3000), "a" * 30_000, "Ѽ篑辽\U0001dfddiø"]
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == encoding.encode_ordinary(t), t
        assert bytes(got[i].decoded) == t.encode()


def test_transducer_on_any_bytes(library):
    encoding, ranks, _ = library
    rng = random.Random(9)
    run = byte_bpe.Transducer(ranks)
    for _ in range(800):
        data = bytes(rng.choice([rng.randrange(256), 32, 97, 0xE3, 0x81]) for _ in range(rng.randint(1, 24)))
        assert run(data) == byte_bpe.merged(data, ranks)


def test_utf8_stream():
    rng = random.Random(10)
    for _ in range(300):
        data = "".join(chr(rng.choice([65, 0xE9, 0x6F22, 0x1F600])) for _ in range(12)).encode()
        if rng.random() < 0.3:  # not UTF-8: handed on all the same
            data = bytes(rng.randrange(128, 256) for _ in range(12))
        stream, out, at = byte_bpe.Utf8Stream(), [], 0
        while at < len(data):
            step = rng.randint(1, 4)
            out.append(stream.feed(data[at : at + step]))
            at += step
            assert len(stream.rest) < 4
        assert b"".join([*out, stream.finish()]) == data
    stream = byte_bpe.Utf8Stream()
    assert [stream.feed(bytes([b])) for b in "a漢é".encode()] == [b"a", b"", b"", "漢".encode(), b"", "é".encode()]
    assert byte_bpe.Utf8Stream().feed(b"\xed\xa0") == b"\xed\xa0" and byte_bpe.Utf8Stream().feed(b"\xc0") == b"\xc0"


def test_byte_bpe_odd_cases(spark, library):
    encoding, _, pattern = library
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = odd_docs(spark)
    got = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path).collect()
    want = [(r.doc_id, encoding.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.ids, bytes(r.decoded))) for r in got)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.decoded) for r in byte_bpe.decode(none, path).orderBy("doc_id").collect()] == [(1, None), (2, b"")]
    assert byte_bpe.encode(docs.limit(0), path, pattern).count() == 0


def test_byte_bpe_query(spark, data, library):
    encoding, _, _ = library
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op13_byte_bpe(spark, data).collect()} == want
