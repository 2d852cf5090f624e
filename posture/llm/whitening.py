"""Whitening of embeddings by Jacobi-Davidson.

Vectors become whole numbers x = floor(64 c) + 1,000,000. The fit list holds each different x
once; its covariance V (divisor n, centred before multiplying) is never formed. Spark forms
products V W with a few columns W: a task centres its rows, multiplies, and gives one row per
entry of the result; Spark sums them. What reaches the driver are D x b numbers, whatever the
number of rows.

Jacobi-Davidson on the driver's side of these products: Rayleigh-Ritz on the subspace held so
far gives Ritz pairs; those whose residual is down to double precision are locked; for the
others the correction equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q all Ritz vectors of the
block, is solved by a few steps of MINRES, all right-hand sides sharing one product a step;
the solutions, made orthogonal to the subspace, widen it. A subspace over ``SUBSPACE`` times
the wanted number is cut back to its best Ritz vectors. It ends when all residuals are down,
or when they do not get smaller any more in double precision.

x - S/n is taken as (x - m) - (S - n m)/n with the whole number m = floor(S/n): both parts are
small, so the shift by a million costs no digits.

Defined results: vectors that are NULL or hold NULL, infinite or NaN entries, or entries whose
whole number is 2^40 or more, take no part; shorter vectors are continued with c = 0; repeated
rows count once in the fit list and get a row each; components whose eigenvalue is no more
than rounding (a table of one vector, constant dimensions) are left out, as nothing can be
divided by them; equal eigenvalues have any orthonormal vectors of their space; the entry of
largest size of a component is positive; a deviation that does not fit into a long is NULL;
NULL ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, ship, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Entries from here on take no part.
LARGEST = 1 << 40
#: MINRES steps of a correction equation, and the subspace in multiples of the components.
INNER_STEPS = 3
SUBSPACE = 8
#: Residuals end at this multiple of the rounding unit times the largest eigenvalue.
ROUNDING = 32.0
#: Eigenvalues from here down, as a share of the largest, are no more than rounding.
SMALLEST = 1e-10
#: Turns without a smaller residual after which rounding is taken to be reached.
PATIENCE = 4
#: Rows that a task multiplies at a time.
ROWS = 4096

WHITENED_SCHEMA = (
    "vec_id bigint, component int, deviation bigint, whitened double, explained double"
)

Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(frame: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""

    def sound(c: Column) -> Column:
        # NaN is larger than all numbers in comparisons.
        fits = F.abs(F.lit(SCALE) * c.cast("double")) < F.lit(LARGEST)
        return F.coalesce(fits, F.lit(False))

    x = F.transform(column, lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(SHIFT))
    return frame.filter(F.col(column).isNotNull() & F.forall(column, sound)).select(
        F.col(key).cast("bigint").alias("vec_id"), x.alias("x")
    )


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            flat = part.column("x").flatten().to_numpy()
            yield part, flat.reshape(part.num_rows, dimensions)


class Centre:
    """n and S, and rows less S/n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.left = np.array([s % n for s in sums], dtype=np.int64)
        self.rest = self.left / n

    def less(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2."""
        near = x - self.base
        about = ((self.n * near.astype(float) - self.left) ** 2).sum(axis=1)
        small = about < 2.0**62
        near[~small] = 0
        sums: list[int | None] = ((self.n * near - self.left) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(~small).tolist():
            own = zip((x[i] - self.base).tolist(), self.left.tolist(), strict=True)
            total = sum((self.n * v - w) ** 2 for v, w in own)
            sums[i] = total if total < 1 << 63 else None
        return sums


class FitList:
    """The different vectors, their centre, and products that Spark sums over them."""

    def __init__(self, frame: DataFrame, dimensions: int):
        self.frame, self.dimensions = frame, dimensions

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, [0] * dimensions
            for _, x in _blocks(batches, dimensions):
                n += len(x)
                sums = [s + t for s, t in zip(sums, x.sum(axis=0).tolist(), strict=True)]
            values = pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict({"entry": pa.array(range(len(values))), "value": values})

        parts = frame.select("x").mapInArrow(add, "entry bigint, value decimal(38,0)")
        found = {
            r["entry"]: int(r["value"])
            for r in parts.groupBy("entry").agg(F.sum("value").alias("value")).collect()
        }
        self.n = found.get(0, 0)
        if self.n:
            self.centre = Centre(self.n, [found[1 + i] for i in range(dimensions)])

    def mean(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Mean over all rows of an array that ``part`` sums over a block of centred rows."""
        centre, dimensions = self.centre, self.dimensions

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for _, x in _blocks(batches, dimensions):
                total += part(centre.less(x))
            yield pa.RecordBatch.from_pydict(
                {"entry": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())}
            )

        entries = self.frame.select("x").mapInArrow(scan, "entry bigint, value double")
        found = entries.groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(int(np.prod(shape)))
        out[found["entry"].to_numpy()] = found["value"].to_numpy()
        return out.reshape(shape) / self.n

    def product(self, w: np.ndarray) -> np.ndarray:
        """V W, with one pass over the rows."""
        return self.mean(lambda c: c.T @ (c @ w), w.shape)


def corrections(
    product: Product, ritz: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int
) -> np.ndarray:
    """A few MINRES steps of (I - QQ')(V - theta I)(I - QQ') t = -r for all columns at once."""

    def aside(y: np.ndarray) -> np.ndarray:
        return y - ritz @ (ritz.T @ y)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    y = aside(-residual)
    before, last = np.zeros_like(y), y
    beta = np.linalg.norm(y, axis=0)
    old_beta, phi_bar = np.zeros_like(beta), beta.copy()
    cosine, sine = -np.ones_like(beta), np.zeros_like(beta)
    d_bar, epsilon = np.zeros_like(beta), np.zeros_like(beta)
    w, w_before, t = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
    for _ in range(steps):
        v = over(y, np.broadcast_to(beta, y.shape))
        y = aside(product(v) - theta * v)
        y = y - over(beta, old_beta) * before
        alpha = (v * y).sum(axis=0)
        y = aside(y - over(alpha, beta) * last)
        before, last = last, y
        old_beta, beta = beta, np.linalg.norm(y, axis=0)
        old_epsilon, delta = epsilon, cosine * d_bar + sine * alpha
        g_bar, epsilon = sine * d_bar - cosine * alpha, sine * beta
        d_bar = -cosine * beta
        gamma = np.hypot(g_bar, beta)
        cosine, sine = over(g_bar, gamma), over(beta, gamma)
        phi, phi_bar = cosine * phi_bar, sine * phi_bar
        turned = v - old_epsilon * w_before - delta * w
        w_before, w = w, over(turned, np.broadcast_to(gamma, turned.shape))
        t = t + phi * w
    return t


def _widening(basis: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add to the basis what ``t`` has beside it."""
    kept: list[np.ndarray] = []
    for column in t.T:
        length = np.linalg.norm(column)
        if not length > 0:
            continue
        column = column / length
        held = np.column_stack((basis, *kept))
        for _ in range(2):
            column = column - held @ (held.T @ column)
            rest = np.linalg.norm(column)
            if rest < 1e-8:
                break
            column = column / rest
        if rest >= 1e-8:
            kept.append(column)
    return np.column_stack(kept) if kept else np.zeros((len(basis), 0))


def jacobi_davidson(
    product: Product, dimensions: int, wanted: int, inner_steps: int = INNER_STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    k = min(wanted, dimensions)
    rng = np.random.default_rng(7)
    basis, image = np.zeros((dimensions, 0)), np.zeros((dimensions, 0))
    t = rng.standard_normal((dimensions, k))
    least, waited = np.inf, 0
    while True:
        new = _widening(basis, t)
        if not new.shape[1]:
            new = _widening(basis, rng.standard_normal((dimensions, 1)))
        basis = np.column_stack((basis, new))
        image = np.column_stack((image, product(new)))
        inside = basis.T @ image
        value, turn = np.linalg.eigh((inside + inside.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        theta, ritz = value[:k], basis @ turn[:, :k]
        residual = image @ turn[:, :k] - ritz * theta
        length = np.linalg.norm(residual, axis=0)
        open_ = length > ROUNDING * np.finfo(float).eps * max(theta[0], 0.0)
        waited = 0 if length.max() < least else waited + 1
        least = min(least, length.max())
        # A subspace of all dimensions cannot be widened: what is left is rounding.
        if not open_.any() or basis.shape[1] >= dimensions or waited >= PATIENCE:
            return theta, ritz / np.linalg.norm(ritz, axis=0)
        t = corrections(product, ritz, theta[open_], residual[:, open_], inner_steps)
        if basis.shape[1] + t.shape[1] > max(SUBSPACE * k, 2 * k + t.shape[1]):
            basis, image = basis @ turn[:, : 2 * k], image @ turn[:, : 2 * k]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The rows of ``op11``'s contract from (vec_id, x)."""
    ship(rows.sparkSession)
    rows = durable(rows)
    dimensions = max(1, rows.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0)
    missing = F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(dimensions) - F.size("x"))
    whole = rows.select("vec_id", F.concat("x", missing).alias("x"))
    fit = FitList(durable(whole.select("x").distinct()), dimensions)
    values, vectors, explained, error = np.zeros(0), np.zeros((dimensions, 0)), np.zeros(0), 0.0
    centre = None
    if fit.n:
        centre = fit.centre
        values, vectors = jacobi_davidson(fit.product, dimensions, components)
        trace = float(fit.mean(lambda c: (c**2).sum(keepdims=True).reshape(1), (1,))[0])
        kept = values > SMALLEST * max(values[0], 0.0)
        values, vectors = values[kept], vectors[:, kept]
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
        vectors = vectors * np.sign(largest)
        explained = values / trace if len(values) else values
    turn = vectors / np.sqrt(values)
    if len(values):
        k = len(values)
        white = fit.mean(lambda c: (c @ turn).T @ (c @ turn), (k, k))
        error = float(np.abs(white - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        for part, x in _blocks(batches, dimensions):
            if not k:
                continue
            row = pa.array(np.repeat(np.arange(len(x)), k))
            deviation = pa.array(centre.deviations(x), pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": part.column("vec_id").take(row),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "deviation": deviation.take(row),
                    "whitened": pa.array((centre.less(x) @ turn).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                }
            )

    return whole.mapInArrow(project, WHITENED_SCHEMA).select(
        "vec_id", "component", F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        "explained", F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_vectors(table(spark, sf_dir, "embeddings")))
