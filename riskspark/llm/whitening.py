"""Whitening of embeddings through the exact characteristic polynomial of their scatter.

Entries become integers, so n times the scatter, M = n * sum(x x') - S S', is an integer
matrix that tasks sum up exactly; the covariance is M / n^2.  Then:

* tasks reduce M to Hessenberg form modulo one prime each and return the characteristic
  polynomial there; enough primes for a proven bound on its coefficients put the exact
  polynomial together (Chinese remainders);
* all its roots are real, so the sign changes of the polynomial shifted to a count its
  roots above a.  Halving isolates the largest roots, exact signs narrow them down;
* tasks find the null space of M - root * I by inverse iteration with a hundred digits,
  one root (or one repeated root) each.

What the driver holds is M, a polynomial and its roots: it grows with the length of the
vectors, not with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_arrow

# FIXED VALUES: entries become floor(64 * c) + 1000000.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32

# Scaled entries beyond this size count as this size: they fit no long.
LARGEST = 1 << 62
LONG_MAX = (1 << 63) - 1

# Sums of many bits travel as limbs of 32 bits, the last one signed.
LIMBS, LIMB_BITS = 8, 32

# Binary places of a root behind the leading one of the trace, and digits of its vector.
ROOT_BITS, DIGITS, STEPS = 220, 100, 8

# Vectors a task turns into numbers at a time.
BATCH = 2048

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is whole: not null, no null or
    non-finite entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def integers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer entries less OFFSET, (rows, width); shorter vectors end in zeros."""
    lists = batch.column("vector")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = np.zeros((batch.num_rows, width))
    values[np.arange(width) < sizes[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            yield batch.slice(start, BATCH)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y without rounding, whatever the entries."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def scatter(rows: DataFrame, width: int) -> tuple[list[int], list[list[int]]]:
    """Sums and sums of products of the integer entries, exact."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for part in parts(batches):
            y = integers(part, width)
            sums += y.astype(object).sum(axis=0)
            products += exact_products(y)
        values = [*sums, *products[upper]]
        limbs = []
        for _ in range(LIMBS - 1):
            limbs.append([int(v) & ((1 << LIMB_BITS) - 1) for v in values])
            values = [int(v) >> LIMB_BITS for v in values]
        limbs.append([int(v) for v in values])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array(x, pa.int64()) for x in limbs)],
                                         names=["at", *(f"limb{i}" for i in range(LIMBS))])

    names = [f"limb{i}" for i in range(LIMBS)]
    partial = map_arrow(rows.select("vector"), run, "at int, " + ", ".join(f"{c} long" for c in names))
    total = [0] * (width + len(upper[0]))
    for row in partial.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).collect():
        total[row["at"]] = sum(row[c] << (LIMB_BITS * i) for i, c in enumerate(names))
    products = [[0] * width for _ in range(width)]
    for i, j, value in zip(*map(np.ndarray.tolist, upper), total[width:]):
        products[i][j] = products[j][i] = value
    return total[:width], products


def primes_below(limit: int, count: int) -> list[int]:
    """The largest ``count`` primes below ``limit`` (at most 2^31)."""
    def is_prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        # these bases decide every number below 3.2e9
        for base in (2, 3, 5, 7):
            x = pow(base, odd, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True

    found, n = [], limit - 1 if limit % 2 == 0 else limit - 2
    while len(found) < count:
        if is_prime(n):
            found.append(n)
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """det(x I - matrix) modulo p, constant term first."""
    h, d = matrix % p, len(matrix)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        h[[m, i]] = h[[i, m]]
        h[:, [m, i]] = h[:, [i, m]]
        factors = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * factors % p).sum(axis=1)) % p
    leading = [np.ones(1, dtype=np.int64)]
    for k in range(d):
        poly = np.zeros(k + 2, dtype=np.int64)
        poly[1:] = leading[k]
        poly[:-1] = (poly[:-1] - h[k, k] * leading[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            poly[:i + 1] = (poly[:i + 1] - below * int(h[i, k]) % p * leading[i]) % p
        leading.append(poly)
    return [int(c) for c in leading[d] % p]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(x I - matrix) of a symmetric integer matrix without negative eigenvalues,
    exact, constant term first."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # the coefficients' sizes add up to prod(1 + eigenvalue) <= (1 + trace / d)^d
    bound = (Fraction(trace, d) + 1) ** d
    primes = primes_below(1 << 31, math.ceil((math.log2(math.ceil(bound)) + 2) / 30.9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(matrix, dtype=object)
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_pydict({
                    "p": pa.array([p], pa.int64()),
                    "residues": pa.array([polynomial_modulo((exact % p).astype(np.int64), p)], pa.list_(pa.int64()))})

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 64))
    residues = {r.p: r.residues for r in map_arrow(dealt, run, "p long, residues array<long>").collect()}
    whole = math.prod(primes)
    weights = [whole // p * pow(whole // p, -1, p) for p in primes]
    found = (sum(w * residues[p][k] for p, w in zip(primes, weights)) % whole for k in range(d + 1))
    return [c - whole if c > whole // 2 else c for c in found]


def roots_above(polynomial: list[int], numerator: int, places: int) -> int:
    """Roots greater than numerator / 2^places of a polynomial whose roots are all real:
    the sign changes among its coefficients once shifted there."""
    d = len(polynomial) - 1
    shifted = [c << (places * (d - k)) for k, c in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += numerator * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def positive_at(polynomial: list[int], numerator: int, places: int) -> int:
    """The sign of the polynomial at numerator / 2^places."""
    value, d = 0, len(polynomial) - 1
    for k in range(d, -1, -1):
        value = value * numerator + (polynomial[k] << (places * (d - k)))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int) -> list[tuple[Fraction, int]]:
    """(root, how often) of the largest positive roots, falling, ``count`` with repeats,
    each to ROOT_BITS places behind the size of the sum of roots.  Roots that agree to all
    places count as one repeated root."""
    trace = -polynomial[-2]
    if trace <= 0:
        return []
    finest = ROOT_BITS - trace.bit_length()
    found: list[tuple[Fraction, int]] = []
    # (low, high] as multiples of 2^-places, roots above low, roots above high
    top = (1 << trace.bit_length()) + 1
    ranges = [(0, top, 0, roots_above(polynomial, 0, 0), 0)]
    while ranges and sum(m for _, m in found) < count:
        low, high, places, above_low, above_high = ranges.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if inside == 1 or places >= finest and high - low == 1:
            if inside == 1:
                low, high, places = narrowed(polynomial, low, high, places, finest)
            found.append((Fraction(2 * low + (high > low), 2) / (Fraction(2) ** places), inside))
            continue
        if high - low == 1:
            low, high, places = 2 * low, 2 * high, places + 1
        middle = (low + high) // 2
        above = roots_above(polynomial, middle, places)
        # the larger half is looked at first
        ranges += [(low, middle, places, above_low, above), (middle, high, places, above, above_high)]
    return found


def narrowed(polynomial: list[int], low: int, high: int, places: int, finest: int) -> tuple[int, int, int]:
    """The range (low, high] of a single root, halved by signs down to the last place."""
    at_high = positive_at(polynomial, high, places)
    if at_high == 0:
        return high, high, places
    while places < finest or high - low > 1:
        if high - low == 1:
            low, high, places = 2 * low, 2 * high, places + 1
        middle = (low + high) // 2
        sign = positive_at(polynomial, middle, places)
        if sign == 0:
            return middle, middle, places
        low, high = (low, middle) if sign == at_high else (middle, high)
    return low, high, places


def null_space(matrix: list[list[int]], root: Fraction, count: int) -> list[list[float]]:
    """``count`` orthogonal unit vectors of the eigenvalue ``root``, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        rows = [[Decimal(v) for v in row] for row in matrix]
        for i in range(d):
            rows[i][i] -= shift
        tiny = max(max(map(abs, row)) for row in rows).scaleb(10 - DIGITS) or Decimal(1)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best], order[k], order[best] = rows[best], rows[k], order[best], order[k]
            if abs(rows[k][k]) < tiny:
                rows[k][k] = tiny
            pivot, head = rows[k][k], rows[k][k + 1:]
            for row in rows[k + 1:]:
                if row[k]:
                    factor = row[k] = row[k] / pivot
                    row[k + 1:] = [a - factor * b for a, b in zip(row[k + 1:], head)]

        def solved(right: list[Decimal]) -> list[Decimal]:
            x = [right[i] for i in order]
            for i in range(d):
                x[i] -= sum(map(Decimal.__mul__, rows[i][:i], x[:i]), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum(map(Decimal.__mul__, rows[i][i + 1:], x[i + 1:]), Decimal(0))) / rows[i][i]
            return x

        found: list[list[Decimal]] = []

        def clean(x: list[Decimal]) -> list[Decimal]:
            for v in found:
                along = sum(map(Decimal.__mul__, x, v), Decimal(0))
                x = [a - along * b for a, b in zip(x, v)]
            length = sum((a * a for a in x), Decimal(0)).sqrt()
            first = max(x, key=abs)
            return [a / length.copy_sign(first) for a in x]

        for number in range(count):
            # any start that is not orthogonal to the space will do
            x = clean([Decimal(pow(7, 3 + i + number * d, 1_000_003)) for i in range(d)])
            for _ in range(STEPS):
                before, x = x, clean(solved(x))
                if max(abs(a - b) for a, b in zip(x, before)) < Decimal(10) ** -40:
                    break
            found.append(x)
        return [[float(a) for a in v] for v in found]


def components(spark: SparkSession, matrix: list[list[int]], count: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue, unit eigenvector) of the largest positive eigenvalues, falling."""
    groups = largest_roots(characteristic_polynomial(spark, matrix), count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("i").to_pylist():
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array([i], pa.int64()),
                    "vectors": pa.array([null_space(matrix, *groups[i])], pa.list_(pa.list_(pa.float64())))})

    if not groups:
        return []
    dealt = spark.createDataFrame([(i,) for i in range(len(groups))], "i long").repartition(len(groups), "i")
    found = {r.i: r.vectors for r in map_arrow(dealt, run, "i long, vectors array<array<double>>").collect()}
    return [(groups[i][0], v) for i in range(len(groups)) for v in found[i]][:count]


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for
    each whole vector and each of the ``count`` largest components.

    Vectors that are null or hold null or non-finite entries are left out; shorter
    vectors count as ending in entries of zero; null ids stay null; repeated rows count
    each; an empty table gives no rows.  Components without variance cannot be whitened
    and are left out, so equal vectors give no rows.  A deviation beyond the largest long
    is the largest long.  Other columns are not read, so their names cannot clash.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    sums, products = scatter(rows, width) if n and width else ([], [])
    matrix = [[n * q - a * b for q, b in zip(row, sums)] for row, a in zip(products, sums)]
    found = components(spark, matrix, count) if matrix else []
    if not found:
        return spark.createDataFrame([], RESULT)
    trace = sum(matrix[i][i] for i in range(width))
    explained = [float(root / trace) for root, _ in found]
    # the eigenvalue of the covariance is root / n^2, and n * x - S is n times the centred x
    project = np.array([v for _, v in found]).T / np.array([math.sqrt(root) for root, _ in found])
    k = len(found)

    def centred(part: pa.RecordBatch) -> np.ndarray:
        """n * x - S, exact."""
        y = integers(part, width)
        small = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums)) < LONG_MAX
        return y * n - np.array(sums, dtype=np.int64) if small else y.astype(object) * n - np.array(sums, dtype=object)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for part in parts(batches):
            w = centred(part).astype(np.float64) @ project
            total += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k + k * k), pa.int32()), "v": pa.array([*total, *square.ravel()], pa.float64())})

    gathered = np.zeros(k + k * k)
    for row in map_arrow(rows.select("vector"), gather, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        gathered[row["at"]] = row["v"]
    mean, square = gathered[:k] / n, gathered[k:].reshape(k, k) / n
    identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            c, m = centred(part), part.num_rows
            largest = int(np.abs(c).max(initial=0))
            wide = c if largest * largest * width < LONG_MAX else c.astype(object)
            deviation = np.array([min(int(v), LONG_MAX) for v in (wide * wide).sum(axis=1)], dtype=np.int64)
            w = c.astype(np.float64) @ project
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                 pa.array(np.repeat(deviation, k)), pa.array(w.ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows, run, RESULT)
