"""op12: embedding whitening by the exact characteristic polynomial.

Entries become integers, so the scatter matrix is exact whatever the order of the rows.  From there on:

1. **Polynomial.**  The matrix is reduced modulo many primes to Hessenberg form (a similarity, so the
   polynomial stays), each residue polynomial follows from its recurrence, and Chinese remaindering gives
   the integer coefficients.  The primes are the rows of a Spark job.
2. **Roots.**  A symmetric matrix has only real roots, so Descartes' rule is exact: the roots above ``t`` are the
   sign variations of the polynomial shifted by ``t``.  Bisection over dyadic numbers isolates each of the largest roots,
   repeated ones too, to a stated number of bits.
3. **Components.**  Inverse iteration with that root in integers of a few hundred bits finds the null space
   of the shifted matrix; each vector is made orthogonal to the ones before, so repeated roots give a basis.

Spark sums the scatter (one row per matrix entry and task), runs the primes and projects the rows.  The driver holds
the matrix, the polynomial and the components, whose size depends on the dimension alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT_BITS = 100  # binary places of a root relative to its size
VECTOR_BITS = 320  # binary places of the inverse iteration
_CHUNK = 1 << 12  # rows multiplied at once

_PRIME_BITS = 31


# --- exact sums ------------------------------------------------------------------------------
def _rows_of(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, dim)


def integer_vectors(rows: DataFrame, vector_col: str, scale: int, dim: int, id_col: str | None = None) -> DataFrame:
    """``([id,] x)`` of the rows whose vector holds ``dim`` finite numbers; ``x`` = floor(scale * c) as longs.

    The components do not depend on a common offset of the entries, so none is added here.
    """
    own = [F.col(f"`{id_col}`").alias("id")] if id_col else []
    rows = rows.select(*own, F.col(f"`{vector_col}`").alias("c"))
    real = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))
    whole = F.col("c").isNotNull() & (F.size("c") == dim) & F.forall("c", lambda v: F.coalesce(real(v), F.lit(False)))
    x = F.transform("c", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return rows.where(whole).select(*(["id"] if id_col else []), x.alias("x"))


def _products(x: np.ndarray, whole: list[int]) -> list[int]:
    """Exact product of a block of rows with one vector of integers of any size."""
    if max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) >= 1 << 24:
        return (x.astype(object) @ np.array(whole, object)).tolist()
    total, at = [0] * len(x), 0
    while any(v not in (0, -1) for v in whole) or at == 0:  # 24 bits at a time, so that no sum leaves 63 bits
        part = x @ np.array([v & 0xFFFFFF for v in whole], np.int64)
        total = [t + (p << at) for t, p in zip(total, part.tolist())]
        whole, at = [v >> 24 for v in whole], at + 24
    rest = (x @ np.array(whole, np.int64)).tolist()
    return [t + (r << at) for t, r in zip(total, rest)]


def scatter_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums per dimension, sums of products) of ``x``; exact.

    Each task sends one row per matrix entry; blocks whose products could exceed 53 bits are multiplied as Python integers.
    """
    i_upper, j_upper = (a.tolist() for a in np.triu_indices(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            block = _rows_of(batch, 0, dim)
            for at in range(0, len(block), _CHUNK):
                x = block[at : at + _CHUNK]
                top = max(abs(int(x.min())), abs(int(x.max())))
                if top * top * len(x) < 1 << 53:
                    y = x.astype(np.float64)
                    products += (y.T @ y).astype(np.int64).astype(object)
                    sums += x.sum(0).astype(object)
                else:
                    y = x.astype(object)
                    products += y.T @ y
                    sums += y.sum(0)
                n += len(x)
        if not n:
            return
        values = [n, *sums, *products[i_upper, j_upper]]
        yield pa.record_batch(
            [
                pa.array([-1] + [-1] * dim + i_upper, pa.int32()),
                pa.array([-1] + list(range(dim)) + j_upper, pa.int32()),
                pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)),
            ],
            names=["i", "j", "v"],
        )

    found = vectors.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    n, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for r in found.collect():  # 1 + dim + dim * (dim + 1) / 2 rows
        v = int(r["v"])
        if r["j"] < 0:
            n = v
        elif r["i"] < 0:
            sums[r["j"]] = v
        else:
            products[r["i"]][r["j"]] = products[r["j"]][r["i"]] = v
    return n, sums, products


# --- characteristic polynomial ---------------------------------------------------------------
def primes_below(top: int, how_many: int) -> list[int]:
    """The largest ``how_many`` primes below ``top`` (Miller-Rabin with the bases that are exact for 32 bits)."""

    def prime(n: int) -> bool:
        if n % 2 == 0:
            return n == 2
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in (2, 7, 61):
            x = pow(a, d, n)
            if a % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
                return False
        return n > 1

    found, n = [], top
    while len(found) < how_many:
        n -= 1
        if prime(n):
            found.append(n)
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo a prime below 2**31, by Hessenberg reduction."""
    h = matrix % p
    n = len(h)
    for k in range(n - 2):
        below = np.nonzero(h[k + 1 :, k])[0]
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        # Row operations, and the inverse column operation that keeps the matrix similar.
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(n):
        # p[k+1] = (x - h[k,k]) p[k] - sum over i < k of h[i,k] * (product of the subdiagonal from i to k) * p[i]
        weights = np.zeros(k + 1, np.int64)
        product = 1
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * product % p
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - (weights[:, None] * polys[: k + 1] % p).sum(0)) % p
    return polys[n]


def _coefficient_bound(matrix: list[list[int]]) -> int:
    """A bound on the coefficients: eigenvalues that are not negative and add up to the trace have the largest products when equal."""
    n = len(matrix)
    mean = sum(matrix[i][i] for i in range(n)) // n + 1
    return max(comb(n, k) * mean**k for k in range(1, n + 1))


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients (constant first) of det(x - matrix) of a symmetric positive semidefinite integer matrix, exact.

    One Spark row per prime; their number follows from the bound on the coefficients.
    """
    n = len(matrix)
    bits = (2 * _coefficient_bound(matrix) + 1).bit_length()
    primes = primes_below(1 << _PRIME_BITS, bits // (_PRIME_BITS - 1) + 1)
    held = spark.sparkContext.broadcast(np.array(matrix, object))  # dim * dim numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            rows = [polynomial_modulo((held.value % p).astype(np.int64), p).tolist() for p in found]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["p", "c"])

    parts = min(len(primes), 2 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(parts)
    residues = {r["p"]: r["c"] for r in table.mapInArrow(run, "p bigint, c array<bigint>").collect()}  # primes x (dim + 1)
    held.unpersist()

    modulus, total = 1, [0] * (n + 1)
    for p in primes:
        inverse = pow(modulus % p, -1, p)
        total = [t + modulus * ((r - t) * inverse % p) for t, r in zip(total, residues[p])]
        modulus *= p
    return [t - modulus if 2 * t > modulus else t for t in total]


# --- roots -----------------------------------------------------------------------------------
def roots_above(polynomial: list[int], t: int, places: int) -> int:
    """How many roots (with multiplicity) of a polynomial with real roots only are above ``t / 2**places``."""
    n = len(polynomial) - 1
    # q(y) = 2**(places n) p(y / 2**places), shifted by t: all coefficients stay integers.
    q = [c << (places * (n - k)) for k, c in enumerate(polynomial)]
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            q[k] += t * q[k + 1]
    signs = [c > 0 for c in q if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign_at(polynomial: list[int], t: int, places: int) -> int:
    value, scale = 0, 0
    for c in reversed(polynomial):
        value = value * t + (c << scale)
        scale += places
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], how_many: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The ``how_many`` largest positive roots as ``(t, places)``, i.e. ``t / 2**places``, in falling order, repeated ones as often.

    ``t / 2**places`` is at most one unit above the root, which is at least ``2**bits`` units large.  Roots
    that are zero are left out.
    """
    n = len(polynomial) - 1
    zeros = next(k for k, c in enumerate(polynomial) if c)
    how_many = min(how_many, n - zeros)
    # The roots' sum is the trace, so none is larger; the product of the others bounds the least one from below.
    top = -polynomial[n - 1] + 1
    known: dict[tuple[int, int], int] = {}

    def above(t: int, places: int) -> int:
        while places and t % 2 == 0:
            t, places = t >> 1, places - 1
        if (t, places) not in known:
            known[t, places] = roots_above(polynomial, t, places)
        return known[t, places]

    out = []
    for k in range(1, how_many + 1):
        # Least t with fewer than k roots above it; first among whole numbers, then with more places.
        low, high, places = 0, top, 0  # above(low) >= k > above(high)
        single = False
        while high - low > 1 or high.bit_length() <= bits:
            if high - low == 1:
                low, high, places = low << 1, high << 1, places + 1
            middle = (low + high) >> 1
            if not single and above(low, places) - above(high, places) == 1:
                single, sign = True, _sign_at(polynomial, high, places)
                if sign == 0:
                    single = False
            # With a single root between, the sign tells the side; on the root itself counting does.
            side = _sign_at(polynomial, middle, places) if single else 0
            right = side == -sign if side else above(middle, places) >= k
            low, high = (middle, high) if right else (low, middle)
        out.append((high, places))
    return out


# --- components ------------------------------------------------------------------------------
def _solve(matrix: np.ndarray, root: tuple[int, int], right: np.ndarray, bits: int) -> np.ndarray:
    """One step of inverse iteration: (matrix - root) y = right, all with ``bits`` binary places, up to the scale of y."""
    n = len(matrix)
    t, places = root
    shift = (t << bits) >> places
    a = np.array([[int(v) << bits for v in row] for row in matrix], object)
    for i in range(n):
        a[i, i] -= shift
    b = right.copy()
    for k in range(n):
        pivot = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            b[[k, pivot]] = b[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1  # the null space itself: one unit keeps the direction
        for i in range(k + 1, n):
            if a[i, k]:
                factor = (a[i, k] << bits) // a[k, k]
                a[i, k + 1 :] -= (factor * a[k, k + 1 :]) >> bits
                b[i] -= (factor * b[k]) >> bits
    y = np.zeros(n, object)
    for k in range(n - 1, -1, -1):
        y[k] = ((b[k] - (int(np.dot(a[k, k + 1 :], y[k + 1 :])) >> bits if k + 1 < n else 0)) << bits) // a[k, k]
    return y


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    length = isqrt(int(np.dot(v, v)))
    return np.array([(int(x) << bits) // length for x in v], object)


def null_vectors(matrix: list[list[int]], roots: list[tuple[int, int]], bits: int = VECTOR_BITS) -> np.ndarray:
    """Unit vectors of the roots, one row each, as doubles; the largest entry is positive.

    Equal roots, and any that lie closer than their places tell, get an orthonormal basis of their common space.
    """
    m = np.array(matrix, object)
    n, done = len(matrix), []
    for k, root in enumerate(roots):
        # A start that no component is orthogonal to in practice; other ones for the next vectors of the same space.
        v = _unit(np.array([((i + 1) * (2 * k + 3) * 2654435761 % 65521) + 1 for i in range(n)], object), bits)
        for _ in range(2):
            v = _unit(_solve(m, root, v, bits), bits)
            for u in done:
                v = v - np.array([int(x) >> bits for x in u * int(np.dot(u, v) >> bits)], object)
            v = _unit(v, bits)
        done.append(v)
    out = np.array([[int(x) / (1 << bits) for x in v] for v in done]).reshape(-1, n)
    for v in out:
        v /= np.sqrt(v @ v)
        if v[np.argmax(np.abs(v))] < 0:
            v *= -1
    return out


# --- the operator ----------------------------------------------------------------------------
def _usual_dimension(rows: DataFrame, vector_col: str) -> int | None:
    size = F.size(F.col(f"`{vector_col}`"))
    sizes = rows.where(size > 0).groupBy(size.alias("d")).count()
    best = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return best["d"] if best else None


_OUT = "n bigint, deviation decimal(38,0), component int, whitened double, explained double"


def whiten(
    rows: DataFrame,
    components: int = 8,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int | None = None,
) -> DataFrame:
    """``(<id_col>, component, n, deviation, whitened, explained, identity_error)``, a row per remaining row and component.

    ``x`` = floor(scale * entry) in integers.  ``deviation`` is the sum over dimensions of (n x - S)**2, exact (it does not
    change if a constant is added to all x); ``whitened`` the centred x on the unit eigenvector over the root of its
    eigenvalue; ``explained`` the eigenvalue over the trace of the covariance; ``identity_error`` the largest
    absolute entry of the covariance of all rows' whitened values minus the identity, measured on those values.

    Rows go if their vector is null, empty, of another length than ``dim`` (default: the most frequent length, the longer of equals) or
    holds a null, NaN or infinite entry.  Entries must stay below 2**62 / scale.  Null and repeated ids keep their rows, copies count as
    often as they occur.  Components end with the rank of the covariance, so a direction without
    variance has none, and a table of no row, of one, or of equal rows gives no rows.
    """
    spark = rows.sparkSession
    dim = dim or _usual_dimension(rows, vector_col)
    empty = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if dim is None:
        return spark.createDataFrame([], empty)
    n, sums, products = scatter_sums(integer_vectors(rows, vector_col, scale, dim), dim)
    # n**2 times the covariance, centred: sum of (n x - S)(n x - S)' / n.
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return spark.createDataFrame([], empty)
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)
    vectors = null_vectors(matrix, roots)
    explained = [t / (trace << places) for t, places in roots]
    # sqrt(e) with e = root / n**2, from an integer square root.
    spread = np.array([isqrt((t << 2 * 64) >> places) / 2.0**64 / n for t, places in roots])
    held = spark.sparkContext.broadcast((n, sums, vectors, spread, explained))  # components x dim numbers

    def project(x: np.ndarray) -> np.ndarray:
        n, sums, vectors, spread, _ = held.value
        whole = np.array([s // n for s in sums], object)
        rest = np.array([s % n / n for s in sums])
        near = (x - whole.astype(np.int64)).astype(np.float64) - rest  # small numbers, so no digits are lost
        return near @ vectors.T / spread

    k = len(roots)

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = project(_rows_of(batch, 0, dim))
            total += w.T @ w
            first += w.sum(0)
        at = [(i, j) for i in range(k) for j in range(k)]
        yield pa.record_batch(
            [pa.array([i for i, _ in at] + list(range(k)), pa.int32()), pa.array([j for _, j in at] + [-1] * k, pa.int32()),
             pa.array([*total.ravel().tolist(), *first.tolist()])], names=["i", "j", "v"],
        )

    vectors_only = integer_vectors(rows, vector_col, scale, dim)
    found = vectors_only.mapInArrow(covariance, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    first = {r["i"]: r["v"] / n for r in found if r["j"] < 0}  # means, zero up to rounding: the values are centred already
    error = max(abs(r["v"] / n - first[r["i"]] * first[r["j"]] - (r["i"] == r["j"])) for r in found if r["j"] >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, _, _, explained = held.value
        squares = sum(s * s for s in sums)
        for batch in batches:
            x = _rows_of(batch, 1, dim)
            w = project(x)
            wide = x if max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) < 1 << 24 else x.astype(object)
            own = (wide * wide).sum(1).tolist()
            deviation = [Decimal(n * n * a - 2 * n * b + squares) for a, b in zip(own, _products(x, sums))]
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int64)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(w.ravel()),
                    pa.array(np.tile(np.array(explained), len(x))),
                ],
                names=["id", "n", "deviation", "component", "whitened", "explained"],
            )

    kept = integer_vectors(rows, vector_col, scale, dim, id_col)
    out = kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, {_OUT}")
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
