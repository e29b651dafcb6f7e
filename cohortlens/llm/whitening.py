"""Embedding whitening: leading eigenvectors of the covariance by a block Jacobi-Davidson method without the matrix.

The covariance is never formed. Its product with a few vectors is one pass over the distinct vectors: every task centres its
rows, multiplies them with the vectors and adds up what they carry back. The driver holds the search space (at most `most`
columns), its products and the sums of the tasks (at most `TASKS` blocks of the vectors' size). One round: Rayleigh-Ritz
in the search space; pairs whose residual, by a fresh product, is down to double precision (dimension times machine epsilon of
the largest eigenvalue) are locked; the correction equations of the others, projected off the locked and the present
vectors, are solved by a few steps of MINRES, all in step, so that a step is one pass; the corrections widen the space. It ends when
the wanted largest values are locked and no value of the rest can pass them.

Rows are integers, floor(256 * entry), so sums and deviations are exact.

Edge cases. A vector that is null or holds a null or non-finite entry is left out. Repeated vectors count once in the fit and
all get rows; null ids pass through. Shorter vectors, empty ones too, are filled with 0 to the longest. Entries beyond a long
are cut at its ends. A component without variance (one distinct vector, fewer vectors than components) has a null `whitened`, and a
null `explained` where nothing varies; components end with the dimension. A deviation beyond a long is null. Eigenvectors
of equal values may be any basis of their space. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ship_package, stored

TASKS = 1024
_EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


def integer_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add x, the integers of a usable vector; other rows go."""
    whole = f"forall({vector}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    return rows.where(F.col(vector).isNotNull()).where(F.coalesce(F.expr(whole), F.lit(False))).withColumn(
        "x", F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integers of the rows, filled with 0 to `dim`."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if len(flat) == len(sizes) * dim and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


@dataclass
class Spread:
    """The fit list with its exact sums: n vectors, sums and means per dimension, the trace of the covariance."""

    fit: DataFrame
    dim: int
    n: int
    sums: list[int]
    mean: np.ndarray
    trace: float = 0.0

    def total(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all vectors of `of` (centred rows of a batch), added up in the order of the tasks."""
        dim, mean = self.dim, self.mean

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = of(np.zeros((0, dim)))
            for batch in batches:
                out = out + of(matrix(batch.column("x"), dim) - mean)
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

        shape = of(np.zeros((0, dim))).shape
        out = np.zeros(shape)
        for row in self.fit.coalesce(TASKS).mapInArrow(part, "v array<double>").collect():
            out += np.array(row["v"]).reshape(shape)
        return out

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """Covariance times vectors, one pass."""
        return self.total(lambda x: x.T @ (x @ vectors)) / self.n


def spread_of(x: DataFrame) -> Spread | None:
    """Of the distinct vectors of `x`; they are written to the shared folder. None if there are none."""
    ship_package(x.sparkSession)
    fit = stored(x.select("x").distinct(), "vectors")
    n, dim = fit.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return None

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)  # halves of 32 bits: neither sum can run over
        for batch in batches:
            rows = matrix(batch.column("x"), dim)
            high += (rows >> 32).sum(0)
            low += (rows & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], ["high", "low"])

    sums = [0] * dim
    for row in fit.coalesce(TASKS).mapInArrow(part, "high array<long>, low array<long>").collect():
        sums = [s + (h << 32) + l for s, h, l in zip(sums, row["high"], row["low"])]
    out = Spread(fit, dim, n, sums, np.array([s / n for s in sums]))
    out.trace = float(out.total(lambda rows: (rows * rows).sum(0)).sum()) / n
    return out


def minres(product: Product, shifts: np.ndarray, off: np.ndarray, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of P(A - shift)P t = rhs for every column at once, P projecting off the columns of `off`.

    Lanczos with Givens rotations; columns that are solved stop changing. Every step is one product of all columns.
    """
    def project(v: np.ndarray) -> np.ndarray:
        v = v - off @ (off.T @ v)
        return v - off @ (off.T @ v)

    size = lambda v: np.sqrt((v * v).sum(0))
    safe = lambda v: np.where(v > 0, v, 1.0)
    v = project(rhs)
    beta = size(v)
    x, eta, start = np.zeros_like(rhs), beta.copy(), safe(beta)
    v, old = v / safe(beta), np.zeros_like(rhs)
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    c, c_old, s, s_old = (np.full(rhs.shape[1], a) for a in (1.0, 1.0, 0.0, 0.0))
    beta, alive = np.zeros_like(eta), eta > 0
    for _ in range(steps):
        if not alive.any():
            break
        z = project(product(v) - v * shifts)
        alpha = (v * z).sum(0)
        z = z - alpha * v - beta * old
        nxt = size(z)
        rho = np.hypot(c * alpha - c_old * s * beta, nxt)
        r0 = c * alpha - c_old * s * beta
        r2, r3 = s * alpha + c_old * c * beta, s_old * beta
        alive &= rho > 0
        w_new = (v - r3 * w_old - r2 * w) / safe(rho)
        c_old, s_old, c, s = c, s, r0 / safe(rho), nxt / safe(rho)
        x = x + np.where(alive, c * eta, 0.0) * w_new
        eta = -s * eta
        w_old, w, old = w, w_new, v
        alive &= (nxt > 1e-13 * np.abs(shifts).max()) & (np.abs(eta) > 1e-10 * start)
        v, beta = z / safe(nxt), nxt
    return x


def orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of `new` made orthonormal, off those of `against` too; columns that add nothing go."""
    kept: list[np.ndarray] = []
    for col in new.T:
        size = np.linalg.norm(col)
        if not size > 0:
            continue
        col = col / size
        for _ in range(3):
            for base in against:
                col = col - base @ (base.T @ col)
            for other in kept:
                col = col - other * (other @ col)
        if (size := np.linalg.norm(col)) > 1e-10:
            col = col / size
            for base in against:
                col = col - base @ (base.T @ col)
            kept.append(col / np.linalg.norm(col))
    return np.array(kept).T if kept else np.zeros((new.shape[0], 0))


def leading_pairs(product: Product, dim: int, wanted: int, inner: int = 5, guard: int = 2, most: int = 32, rounds: int = 200,
                  seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, their unit vectors (columns) and residual norms, largest value first."""
    wanted = min(wanted, dim)
    block = min(dim, wanted + guard)
    most = max(most, 2 * block)
    rnd = np.random.default_rng(seed)
    locked, values, residuals = np.zeros((dim, 0)), np.zeros(0), np.zeros(0)
    v = orthonormal(rnd.standard_normal((dim, block)))
    av = product(v)
    scale, floor, stuck = 0.0, np.inf, 0
    for _ in range(rounds):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        v, av = v @ y, av @ y
        scale = max(scale, float(np.abs(theta).max(initial=0.0)), float(np.abs(values).max(initial=0.0)))
        goal = dim * _EPS * scale
        rest = av - v * theta
        norms = np.linalg.norm(rest, axis=0)
        full = v.shape[1] + locked.shape[1] >= dim
        lead = min(block, v.shape[1])
        floor, stuck = (float(norms[0]), 0) if len(norms) and norms[0] < 0.5 * floor else (floor, stuck + 1)
        near = (norms[:lead] <= goal) | full | ((stuck >= 4) & (norms[:lead] <= 1e3 * goal))
        if near[:1].any():  # the first of the row: fresh products decide, in order, so that no larger value is passed over
            upto = int(np.argmin(near)) if not near.all() else lead
            av = np.hstack([product(v[:, :upto]), av[:, upto:]])
            norms[:upto] = np.linalg.norm(av[:, :upto] - v[:, :upto] * theta[:upto], axis=0)
            least = goal if not full and stuck < 4 else 1e3 * goal
            done = 0
            while done < upto and norms[done] <= least:
                done += 1
            if done:
                locked, values = np.hstack([locked, v[:, :done]]), np.append(values, theta[:done])
                residuals = np.append(residuals, norms[:done])
                v, av, theta, norms = v[:, done:], av[:, done:], theta[done:], norms[done:]
                floor, stuck = np.inf, 0
            rest = av - v * theta
        order = np.argsort(-values)
        if len(values) >= wanted and (not len(theta) or len(values) >= block + wanted or float((theta[:block] + norms[:block]).max()) < values[order[wanted - 1]] or full):
            break
        if not len(theta) and locked.shape[1] >= dim:
            break
        lead = min(block, v.shape[1])
        if v.shape[1] + lead > most:  # thick restart: the best half stays
            keep = max(lead, most // 2)
            v, av, theta, rest = v[:, :keep], av[:, :keep], theta[:keep], rest[:, :keep]
        t = minres(product, theta[:lead], np.hstack([locked, v[:, :lead]]), -rest[:, :lead], inner)
        t = orthonormal(t, locked, v)
        if not t.shape[1]:
            t = orthonormal(rnd.standard_normal((dim, min(lead, dim))), locked, v)
        if t.shape[1]:
            v, av = np.hstack([v, t]), np.hstack([av, product(t)])
        else:
            av = product(v)
    else:
        raise ArithmeticError("eigenvectors did not reach double precision")
    order = np.argsort(-values)[:wanted]
    return values[order], locked[:, order], residuals[order]


@dataclass
class Whitener:
    """Mean, leading eigenvectors and eigenvalues of the fit list, and how far its whitened covariance is from the identity."""

    spread: Spread
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    identity_error: float | None

    @property
    def scaled(self) -> np.ndarray:
        """Vectors over the roots of their values; not a number where nothing varies."""
        flat = self.values <= self.spread.dim * _EPS * max(float(self.values.max(initial=0.0)), 0.0)
        return self.vectors / np.sqrt(np.where(flat, np.nan, self.values))


def fit(x: DataFrame, components: int = 4) -> Whitener | None:
    """Of the distinct vectors of `x` (column x); None if there are none."""
    spread = spread_of(x)
    if spread is None:
        return None
    if spread.trace > 0:
        values, vectors, residuals = leading_pairs(spread.product, spread.dim, components)
    else:
        k = min(components, spread.dim)
        values, vectors, residuals = np.zeros(k), np.eye(spread.dim)[:, :k], np.zeros(k)
    out = Whitener(spread, values, vectors, residuals, None)
    scaled = out.scaled
    scaled = scaled[:, ~np.isnan(scaled).any(0)]
    if k := scaled.shape[1]:
        def moments(rows: np.ndarray) -> np.ndarray:
            y = rows @ scaled
            return np.vstack([y.T @ y, y.sum(0)])
        got = spread.total(moments) / spread.n
        out.identity_error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
    s = np.array(sums, dtype=float)
    most = np.abs(n * x.astype(float) - s).max(initial=0.0)
    if most < 2 ** 31 and x.shape[1] * most * most < 2 ** 62 and max(map(abs, sums), default=0) < 2 ** 62:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    out = [sum((n * a - b) ** 2 for a, b in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2 ** 63 else None for v in out]


def whiten(rows: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component."""
    x = integer_vectors(rows, vector).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(x, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    spread, scaled, error = model.spread, model.scaled, model.identity_error
    dim, n, sums, mean, k = spread.dim, spread.n, spread.sums, spread.mean, scaled.shape[1]
    share = [float(v) / spread.trace if spread.trace > 0 else None for v in model.values]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            own = matrix(batch.column("x"), dim)
            y = ((own - mean) @ scaled).ravel()
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(own, n, sums), pa.int64()).take(pa.array(at)), pa.array(y, mask=np.isnan(y)),
                pa.array(share * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(projected, schema)
