"""Whitening of embeddings by principal components, from an exact characteristic polynomial.

1. Components become whole numbers, ``floor(scale * c) + offset``; their sums and products are added
   up exactly, by partition and then by Spark. The scatter matrix ``n * sum(x x') - S S'`` (``n`` squared times the
   covariance) is a matrix of whole numbers.
2. Its characteristic polynomial is computed modulo many primes, a prime a row of a Spark job: Hessenberg
   reduction, then the recurrence over leading minors. A bound on the coefficients from the
   trace says how many primes make Chinese remaindering exact.
3. All roots are real, so the sign changes of the polynomial's shifted coefficients count the roots
   above a point exactly (Descartes). Bisection isolates the greatest roots, repeated ones with their
   number, and whole-number arithmetic refines each to ``BITS`` bits.
4. Inverse iteration in ``DIGITS``-digit decimals on the matrix less the root gives the null space: unit vectors to
   more than double precision, orthonormal where a root repeats. The entry of greatest size is positive.
5. Rows are projected and scaled. The whitened rows' own covariance is measured over all of them.

What meets in the driver is one matrix for each vector length, and numbers per prime and coefficient:
nothing that grows with the rows. Work in the driver grows with the cube of the vector's length.

Defined results: vectors that are null, or hold a null or non-finite entry or one whose scaled value
is ``LARGEST`` or more in size, are dropped; vectors of each length are fitted apart; repeated rows count each and null ids
are kept; components with an eigenvalue of zero (known exactly) have no direction and no rows, so that equal
vectors, or a single one, have none; empty vectors have none; a deviation beyond a long is null; an empty table
gives no rows; further columns are ignored. ``identity_error`` is one value, the greatest of all lengths.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

LARGEST = 2.0**50
BITS, DIGITS = 256, 100
#: Whole numbers that a double holds, and that products of this size leave room for in a long.
EXACT, SAFE = 2**53, 2**62


def batch_groups(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length in a batch's list column."""
    column = batch.column(at)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets = column.offsets.to_numpy()
    lens = np.diff(offsets)
    for d in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): exact for a scale that is a power of two."""
    return np.floor(x * scale).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """The exact sum of the rows' outer products, as Python integers."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    top = max(int(np.abs(y).max(initial=0)), 1)
    if top * top >= EXACT:
        return out + y.T.astype(object).dot(y.astype(object)) if len(y) else out
    step = max(EXACT // (top * top) - 1, 1)
    for lo in range(0, len(y), step):
        part = y[lo : lo + step].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)  # every partial sum is a whole number below 2**53
    return out


def sums(vectors: DataFrame, scale: float) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length: number of vectors, sums, and sums of products of floor(scale * c)."""

    def run(batches):
        n: dict[int, int] = defaultdict(int)
        total: dict[int, np.ndarray] = {}
        outer: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in batch_groups(batch, 0):
                y = whole(x, scale)
                d = y.shape[1]
                n[d] += len(y)
                total[d] = total.get(d, 0) + y.astype(object).sum(axis=0)
                outer[d] = outer.get(d, 0) + products(y)
        for d in n:
            i, j = np.triu_indices(d)
            names = [(-2, 0), *((-1, k) for k in range(d)), *zip(i.tolist(), j.tolist(), strict=True)]
            values = [n[d], *total[d], *outer[d][i, j]]
            columns = [[d] * len(names), [a for a, _ in names], [b for _, b in names], [str(v) for v in values]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["d", "i", "j", "v"])

    parts = vectors.select("v").mapInArrow(run, "d int, i int, j int, v string")
    rows = parts.groupBy("d", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # one matrix a length
    out: dict[int, tuple] = {}
    for d in {r.d for r in rows}:
        n, total, outer = 0, [0] * d, [[0] * d for _ in range(d)]
        for r in rows:
            if r.d == d and r.i == -2:
                n = int(r.v)
            elif r.d == d and r.i == -1:
                total[r.j] = int(r.v)
            elif r.d == d:
                outer[r.i][r.j] = outer[r.j][r.i] = int(r.v)
        out[d] = n, total, outer
    return out


def is_prime(n: int) -> bool:
    """Miller and Rabin's test, exact below 2**31 with these bases."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The greatest primes below 2**31 whose product is over twice ``bound``."""
    out, product, n = [], 1, 2**31 - 1
    while product <= 2 * bound:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo ``p``, the lowest first, by Hessenberg reduction."""
    h, d = m.copy() % p, len(m)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:  # a similarity swaps columns along with rows
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[k - 1, :-1]
        weight, run = np.zeros(k, np.int64), 1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):  # the way up the subdiagonal
            run = run * int(h[i + 1, i]) % p
            if not run:
                break
            weight[i] = int(h[i, k - 1]) * run % p
        minors[k] = (row - (weight[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[d]


def remaindered(rows: list[tuple[int, list[int]]]) -> list[int]:
    """Whole numbers of either sign from their remainders by prime."""
    product = math.prod(p for p, _ in rows)
    weights = [(product // p) * pow(product // p, -1, p) for p, _ in rows]
    out = [sum(w * c[k] for w, (_, c) in zip(weights, rows, strict=True)) % product for k in range(len(rows[0][1]))]
    return [c - product if 2 * c > product else c for c in out]


def characteristic(spark: SparkSession, scatters: dict[int, list[list[int]]]) -> dict[int, list[int]]:
    """det(x - scatter) of each matrix (by its size), the lowest coefficient first."""
    jobs = []
    for d, m in scatters.items():
        # no coefficient is above those of d equal roots of the same sum
        mean = -(-sum(m[i][i] for i in range(d)) // d)
        jobs += [(d, p) for p in primes_for(max(math.comb(d, k) * mean**k for k in range(d + 1)))]
    if not jobs:
        return {}
    held = spark.sparkContext.broadcast({d: np.array(m, object) for d, m in scatters.items()})  # one matrix a length

    def run(batches):
        for batch in batches:
            for d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = polynomial_mod((held.value[d] % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([p]), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["d", "p", "c"])

    rows = spark.createDataFrame(jobs, "d int, p long").repartition(min(len(jobs), 16))
    found: dict[int, list] = defaultdict(list)
    for r in rows.mapInArrow(run, "d int, p long, c array<long>").collect():
        found[r.d].append((r.p, r.c))
    return {d: remaindered(rows) for d, rows in found.items()}


def above(poly: list[int], point: int) -> int:
    """How many roots of a polynomial with real roots only lie above a whole number: the sign
    changes of its coefficients once the point is moved to zero."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def primitive(c: list[int]) -> list[int]:
    while c and not c[-1]:
        c = c[:-1]
    g = math.gcd(*c) if c else 1
    return [x // g for x in c]


def quotient(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """A multiple of a / b, and what is left of it."""
    left, out = list(a), []
    while len(left) >= len(b):
        f, g = left[-1], b[-1]
        common = math.gcd(f, g) or 1
        f, g = f // common, g // common
        shift = len(left) - len(b)
        left = [x * g for x in left]
        out = [x * g for x in out] + [f]
        for k, x in enumerate(b):
            left[shift + k] -= f * x
        left.pop()
    return out[::-1], left


def coprime_mod(a: list[int], b: list[int], p: int) -> bool:
    """Whether two polynomials have no common factor modulo a prime (and so none at all)."""
    strip = lambda c: c[: np.flatnonzero(c)[-1] + 1] if c.any() else c[:0]
    a, b = (strip(np.array([x % p for x in c], np.int64)) for c in (a, b))
    while len(b) > 1:
        inverse = pow(int(b[-1]), -1, p)
        while len(a) >= len(b):
            a[len(a) - len(b) :] = (a[len(a) - len(b) :] - b * (int(a[-1]) * inverse % p)) % p
            a = strip(a)
        a, b = b, a
    return len(b) == 1


def simple_part(poly: list[int]) -> list[int]:
    """The polynomial with each root once."""
    slope = [k * c for k, c in enumerate(poly)][1:]
    if any(coprime_mod(poly, slope, p) for p in primes_for(2**90) if poly[-1] % p):
        return primitive(poly)
    a, b = primitive(poly), primitive(slope)
    while len(b) > 1:
        a, b = b, primitive(quotient(a, b)[1])
    if b:  # a constant: no root repeats
        return primitive(poly)
    return primitive(quotient(poly, a)[0])


def sign_at(poly: list[int], a: int, bits: int) -> int:
    """The sign at a / 2**bits."""
    value = 0
    for k, c in enumerate(reversed(poly)):
        value = value * a + (c << (bits * k))
    return (value > 0) - (value < 0)


def top_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """(a, bits, number) of the greatest positive roots, a / 2**bits, until ``wanted`` are counted."""
    poly = primitive(poly)
    while poly and not poly[0]:
        poly = poly[1:]
    if len(poly) < 2:
        return []
    simple = simple_part(poly)
    if simple[-1] < 0:
        simple = [-c for c in simple]
    sum_of_roots = -(-abs(poly[-2]) // abs(poly[-1]))
    out, counted, open_ = [], 0, [(0, sum_of_roots + 1, 0)]
    while open_ and counted < wanted:
        lo, hi, bits = open_.pop()
        scaled = lambda c, bits: [x << (bits * (len(c) - 1 - k)) for k, x in enumerate(c)]
        inside = above(scaled(simple, bits), lo) - above(scaled(simple, bits), hi)
        if inside == 1:
            number = above(scaled(poly, bits), lo) - above(scaled(poly, bits), hi)
            out.append((*refined(simple, lo, hi, bits), number))
            counted += number
        elif inside:
            if hi - lo < 2:
                lo, hi, bits = lo << 16, hi << 16, bits + 16
            mid = (lo + hi) // 2
            open_ += [(lo, mid, bits), (mid, hi, bits)]
    return out


def refined(poly: list[int], lo: int, hi: int, bits: int) -> tuple[int, int]:
    """The one simple root above ``lo`` and up to ``hi``, both over 2**bits, to ``BITS`` bits."""
    end = sign_at(poly, hi, bits)
    if not end:
        return hi, bits
    while hi.bit_length() < BITS or hi - lo > 1:
        if hi - lo < 2:
            lo, hi, bits = lo << 16, hi << 16, bits + 16
        mid = (lo + hi) // 2
        sign = sign_at(poly, mid, bits)
        if not sign:
            return mid, bits
        lo, hi = (mid, hi) if sign != end else (lo, mid)
    return hi, bits


def null_space(matrix: list[list[int]], root: tuple[int, int], number: int) -> list[np.ndarray]:
    """``number`` orthonormal vectors that the matrix less the root takes to (almost) nothing."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        shift = Decimal(root[0]) / Decimal(2 ** root[1])
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[range(d), range(d)] -= shift
        scale = max(abs(x) for x in a.reshape(-1)) or Decimal(1)
        tiny = scale * Decimal(10) ** (8 - DIGITS)
        order = list(range(d))
        for k in range(d):  # a = lower * upper, by the greatest pivot of each column
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solved(b: np.ndarray) -> np.ndarray:
            x = b[order]
            for k in range(d):
                x[k] -= a[k, :k].dot(x[:k]) if k else 0
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - (a[k, k + 1 :].dot(x[k + 1 :]) if k < d - 1 else 0)) / a[k, k]
            return x

        def unit(x: np.ndarray, apart: list[np.ndarray]) -> np.ndarray:
            x = x / max(abs(v) for v in x)
            for _ in range(2):
                for other in apart:
                    x = x - other * other.dot(x)
            return x / x.dot(x).sqrt()

        found: list[np.ndarray] = []
        for start in range(number):
            x = unit(np.array([Decimal(1) / (1 + (k * (2 * start + 1) + start) % (d + 7)) for k in range(d)], object), found)
            for _ in range(3):
                x = unit(solved(x), found)
            found.append(x)
        out = [np.array([float(v) for v in x]) for x in found]
    return [x if x[np.abs(x).argmax()] > 0 else -x for x in out]


@dataclass
class Whitener:
    """What is known of the vectors of one length: their number, sums of whole numbers, and by
    component unit vector, eigenvalue of the covariance and its share."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def prepared(rows: DataFrame, vec_id: str | Column, vector: str | Column, scale: float) -> DataFrame:
    """(vec_id, v: array of doubles) of the rows that count."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    v = rows.select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST / scale))
    return v.filter(F.col("v").isNotNull() & fits)


def fit(vectors: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> dict[int, Whitener]:
    """A whitener for each length of ``vectors`` (prepared)."""
    out, scatters, known = {}, {}, sums(vectors, scale)
    for d, (n, total, outer) in known.items():
        m = [[n * outer[i][j] - total[i] * total[j] for j in range(d)] for i in range(d)]  # a shift of all x does not change it
        if d and any(m[i][i] for i in range(d)):
            scatters[d] = m
    polys = characteristic(vectors.sparkSession, scatters)
    for d, (n, total, _) in known.items():
        axes, roots = [], []
        if d in polys:
            for a, bits, number in top_roots(polys[d], components):
                axes += null_space(scatters[d], (a, bits), number)
                roots += [(a, bits)] * number
        trace = sum(scatters[d][i][i] for i in range(d)) if d in scatters else 1
        over = lambda root, x: float(Decimal(root[0]) / (Decimal(x) * Decimal(2 ** root[1])))
        out[d] = Whitener(
            n, [t + n * offset for t in total], np.array(axes[:components]).reshape(len(axes[:components]), d),
            np.array([over(r, n * n) for r in roots[:components]]), np.array([over(r, trace) for r in roots[:components]]),
        )
    return out


def applied(model: Whitener, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
    """Deviations and whitened components of rows of whole numbers."""
    away = np.array(model.sums, object)
    top = model.n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(s) for s in model.sums), default=0)
    centred = model.n * x - away.astype(np.int64) if top < SAFE else model.n * x.astype(object) - away
    if top < SAFE and int(np.abs(centred).max(initial=0)) ** 2 * x.shape[1] < SAFE:
        deviation = (centred * centred).sum(axis=1).tolist()
    else:
        deviation = [v if v < 2**63 else None for v in (int(sum(c * c for c in map(int, row))) for row in centred)]
    return deviation, (centred / model.n).astype(np.float64) @ model.axes.T / np.sqrt(model.eigenvalues)


def identity_error(whitened: DataFrame, model: dict[int, Whitener]) -> float:
    """The greatest entry of (covariance of ``whitened`` less the identity), over all lengths."""

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for at, w in batch_groups(batch, 1):
                for d in set(batch.column(0).take(pa.array(at)).to_pylist()):
                    mine = w[batch.column(0).take(pa.array(at)).to_numpy() == d]
                    s, p = held.get(d, (0, 0))
                    held[d] = s + mine.sum(axis=0), p + mine.T @ mine
        for d, (s, p) in held.items():
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s.tolist()], kind), pa.array([p.reshape(-1).tolist()], kind)], names=["d", "s", "p"])

    parts = whitened.select("d", "whitened").mapInArrow(run, "d int, s array<double>, p array<double>")
    parts = parts.select("d", F.posexplode(F.concat("s", "p")).alias("k", "v")).groupBy("d", "k").agg(F.sum("v").alias("v"))
    found: dict[int, dict[int, float]] = defaultdict(dict)
    for r in parts.collect():  # components and their products, by length
        found[r.d][r.k] = r.v
    worst = 0.0
    for d, values in found.items():
        k, n = len(model[d].eigenvalues), model[d].n
        if k:
            flat = np.array([values[i] for i in range(k + k * k)])
            mean = flat[:k] / n
            worst = max(worst, float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()))
    return worst


def whiten(
    rows: DataFrame, vec_id: str | Column = "vec_id", vector: str | Column = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000
) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    scratch = Scratch(rows.sparkSession, "whitening")
    vectors = prepared(rows, vec_id, vector, scale)
    model = fit(vectors, components, scale, offset)
    held = rows.sparkSession.sparkContext.broadcast(model)  # ``components`` vectors for each length

    def run(batches):
        for batch in batches:
            for at, x in batch_groups(batch, 1):
                m = held.value[x.shape[1]]
                deviation, white = applied(m, whole(x, scale) + offset)
                ids, k = batch.column(0).take(pa.array(at)), len(m.eigenvalues)
                lists = lambda flat, k=k, n=len(at): pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(flat.reshape(-1)))
                data = [ids, pa.array([x.shape[1]] * len(at), pa.int32()), pa.array([m.n] * len(at), pa.int64()), pa.array(deviation, pa.int64()), lists(white), lists(np.tile(m.explained, len(at)))]
                yield pa.RecordBatch.from_arrays(data, names=["vec_id", "d", "n", "deviation", "whitened", "explained"])

    white = vectors.mapInArrow(run, "vec_id long, d int, n long, deviation long, whitened array<double>, explained array<double>")
    white = scratch.keep(white, "whitened")
    error = identity_error(white, model)
    flat = white.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "w"))
    return flat.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("w.whitened").alias("whitened"),
        F.col("w.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )
