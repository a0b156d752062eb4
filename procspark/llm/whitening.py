"""Embedding whitening by a block Jacobi-Davidson iteration on distributed centred products.

The covariance is never formed: a pass over the vectors multiplies it with a narrow block. Correction equations,
projected off the locked and the current vectors, are solved for all open components at once by an inner MINRES, so that one of its
steps is one pass; a Rayleigh-Ritz step in the grown subspace follows, and components whose residual has come down
to double precision are locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Extra vectors in the start block; MINRES steps (passes) a round; rounds before giving up; subspace size in blocks.
GUARD, STEPS, ROUNDS, ROOM = 8, 4, 200, 4
#: Residuals, of the largest eigenvalue; share of it below which a component is no direction of the data.
RESIDUAL, RANK = 1e-13, 1e-10
#: Largest scaled entry; entries worked on at a time in a task.
LARGEST, CELLS = 2.0**52, 1 << 20
RESULT = ("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def readable(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that have a vector of finite entries only, and their lengths."""
    length = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    there = np.flatnonzero(length >= 0)
    bad = ~np.isfinite(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.concatenate([[0], np.cumsum(length[there])])
    there = there[np.diff(np.concatenate([[0], np.cumsum(bad)])[ends]) == 0]
    return there, length[there]


def scaled(col: pa.Array, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer entries as a matrix) of readable rows of one length, some at a time."""
    width = max(1, int(pc.list_value_length(col.take(pa.array(places[:1]))).to_pylist()[0])) if len(places) else 1
    step = max(1, CELLS // width)
    for i in range(0, len(places), step):
        at = places[i:i + step]
        x = np.floor(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1) * SCALE)
        if np.abs(x).max(initial=0) > LARGEST:
            raise ValueError("an entry is too large to be scaled")
        yield at, x.astype(np.int64) + SHIFT


@dataclass
class Centre:
    """Count, sums and ranges of the entries of all readable vectors, exact."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]

    def __post_init__(self):
        parts = [divmod(s, self.n) for s in self.sums] if self.n else []
        self._whole = np.array([w for w, _ in parts], np.int64)
        self._rest = np.array([r / self.n for _, r in parts], np.float64)
        self._far = sum(max(abs(self.n * a - s), abs(self.n * b - s)) ** 2 for s, a, b in zip(self.sums, self.low, self.high))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, to double precision however large the mean is."""
        return (x - self._whole) - self._rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over the dimensions of (n * x - S) ** 2 as decimals, exact."""
        if self._far < 2**62:
            d = x * self.n - np.array(self.sums, np.int64)
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        if self._far >= 10**38:
            raise OverflowError("deviations have more than 38 digits")
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return pa.array([Decimal(int(v)) for v in (d * d).sum(1)], pa.decimal128(38, 0))


def find_centre(rows: DataFrame) -> Centre:
    """rows: one column ``v``. Vectors of different lengths are an error."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list[np.ndarray]] = {}
        n = 0
        for batch in batches:
            places, length = readable(batch.column(0))
            n += len(places)
            for width in np.unique(length):
                for _, x in scaled(batch.column(0), places[length == width]):
                    new = [x.sum(0), x.min(0), x.max(0)]
                    old = acc.get(int(width))
                    acc[int(width)] = new if old is None else [old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2])]
        widths = np.array(sorted(acc), np.int64)
        if n:
            yield pa.RecordBatch.from_pydict({"cell": np.array([-1], np.int32), "total": [n], "low": widths[:1], "high": widths[-1:]})
        for s, low, high in acc.values():
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(s), dtype=np.int32), "total": s, "low": low, "high": high})

    found = rows.mapInArrow(part, "cell int, total long, low long, high long").groupBy("cell").agg(
        F.sum("total").alias("s"), F.min("low").alias("a"), F.max("high").alias("b")).toArrow().to_pylist()
    by = {r["cell"]: r for r in found}
    if not by:
        return Centre(0, [], [], [])
    head = by.pop(-1)
    if head["a"] != head["b"]:
        raise ValueError(f"vectors have {head['a']} to {head['b']} entries")
    cells = [by[j] for j in range(head["a"])]
    return Centre(head["s"], [r["s"] for r in cells], [r["a"] for r in cells], [r["b"] for r in cells])


def summed(rows: DataFrame, centre: Centre, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all centred rows of work's ``size`` numbers: a task adds its own up, then Spark adds the tasks up by cell."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for batch in batches:
            for _, x in scaled(batch.column(0), readable(batch.column(0))[0]):
                acc += work(centre.centred(x))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(size, dtype=np.int32), "value": acc})

    got = rows.mapInArrow(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("s")).toArrow()
    out = np.zeros(size)
    out[got["cell"].to_numpy()] = got["s"].to_numpy()
    return out


def covariance_times(rows: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """The function b -> V b, one pass over the rows each time."""

    def times(b: np.ndarray) -> np.ndarray:
        got = summed(rows, centre, lambda y: (y.T @ (y @ b)).ravel(), b.size)
        return got.reshape(b.shape) / centre.n

    return times


def orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """A basis of what t adds to the orthonormal columns of ``against``."""
    for _ in range(2):
        t = t - against @ (against.T @ t)
        norm = np.linalg.norm(t, axis=0)
        t = t[:, norm > 0] / norm[norm > 0]
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    u = u[:, s > 1e-8 * s.max(initial=0)][:, :max(0, len(t) - against.shape[1])]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """For each column of ``right`` the vector of least residual in its Krylov space of ``steps`` vectors, in lockstep.

    times(block) multiplies column j with the symmetric operator of column j.
    """
    d, k = right.shape
    beta = np.linalg.norm(right, axis=0)
    basis, tri = [right / np.where(beta > 0, beta, 1)], np.zeros((k, steps + 1, steps))
    for i in range(steps):
        w = times(basis[i])
        for j in range(max(0, i - 1), i + 1):
            c = (basis[j] * w).sum(0)
            tri[:, j, i] += c
            w = w - basis[j] * c
        c = (basis[i] * w).sum(0)  # once more, against rounding
        tri[:, i, i] += c
        w = w - basis[i] * c
        norm = np.linalg.norm(w, axis=0)
        tri[:, i + 1, i] = norm
        basis.append(np.divide(w, norm, out=np.zeros_like(w), where=norm > 1e-14 * np.abs(tri).max((1, 2))))
    out = np.zeros((d, k))
    for j in range(k):
        goal = np.zeros(steps + 1)
        goal[0] = beta[j]
        y = np.linalg.lstsq(tri[j], goal, rcond=1e-14)[0]
        out[:, j] = sum(y[i] * basis[i][:, j] for i in range(steps))
    return out


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], d: int, want: int, steps: int = STEPS,
                    residual: float = RESIDUAL, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator of size d."""
    want = min(want, d)
    q, locked = np.zeros((d, 0)), []
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, want + GUARD))))[0]
    w = times(v)
    best, slow, scale = np.inf, 0, 0.0
    for _ in range(ROUNDS):
        h = v.T @ w
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = v @ y, w @ y
        scale = max(scale, abs(theta[0]) if len(theta) else 0.0)
        open_ = want - len(locked)
        r = au[:, :open_] - u[:, :open_] * theta[:open_]
        r = r - q @ (q.T @ r)
        size = np.linalg.norm(r, axis=0)
        worst = size.max(initial=0)
        best, slow = (worst, 0) if worst < best / 2 else (best, slow + 1)
        full = len(locked) + v.shape[1] >= d  # nothing is left to search: what remains is rounding
        good = size <= residual * scale
        if full or (slow > 4 and worst <= 1e3 * residual * scale):
            good[:] = True
        n = int(np.argmin(good)) if not good.all() else len(good)  # the leading ones, so none is passed over
        q, locked = np.hstack([q, u[:, :n]]), locked + list(theta[:n])
        if len(locked) == want:
            q = np.linalg.qr(q)[0]
            order = np.argsort(locked)[::-1]
            return np.array(locked)[order], q[:, order] * np.where(q[np.abs(q).argmax(0), np.arange(want)] < 0, -1, 1)[order]
        v, w, left = u[:, n:], au[:, n:], open_ - n
        hold = np.hstack([q, v[:, :left]])  # corrections stay off the locked and the current vectors
        todo = np.flatnonzero(~good[n:])
        shift = theta[n:][todo]

        def projected(b: np.ndarray) -> np.ndarray:
            b = b - hold @ (hold.T @ b)
            b = times(b) - b * shift
            return b - hold @ (hold.T @ b)

        t = minres(projected, -r[:, n:][:, todo], min(steps, max(1, d - hold.shape[1])))
        if v.shape[1] + len(todo) > max(ROOM * want, left + GUARD + len(todo)):
            v, w = v[:, :left + GUARD], w[:, :left + GUARD]
        t = orthonormal(t, np.hstack([q, v]))
        if not t.shape[1]:
            t = orthonormal(np.random.default_rng(seed + len(locked)).normal(size=(d, 1)), np.hstack([q, v]))
        v, w = np.hstack([v, t]), np.hstack([w, times(t)])
    raise RuntimeError(f"residuals are still {best / max(scale, 1e-300):.1e} of the largest eigenvalue")


@dataclass
class Whitening:
    """Centre, eigenvalues (falling), unit eigenvectors as columns, the covariance's trace, and the identity's error."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y @ self.vectors) / np.sqrt(self.values)


def fit_whitening(df: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fit on all vectors of df that have finite entries only.

    Directions with less than ``RANK`` of the largest variance cannot be whitened and are left out, so a table
    without two different vectors, or an empty one, has no component. Vectors of different lengths are an error.
    """
    rows = df.select(F.col(vec).alias("v"))
    centre = find_centre(rows)
    d = len(centre.sums)
    none = Whitening(centre, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    if not d or centre.low == centre.high:
        return none
    trace = float(summed(rows, centre, lambda y: np.array([(y * y).sum()]), 1)[0]) / centre.n
    values, vectors = jacobi_davidson(covariance_times(rows, centre), d, components)
    keep = values > RANK * values[0]
    fit = Whitening(centre, values[keep], vectors[:, keep], trace, 0.0)
    k = int(keep.sum())

    def moments(y: np.ndarray) -> np.ndarray:
        z = fit.project(y)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    got = summed(rows, centre, moments, k + k * k) / centre.n
    fit.error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return fit


def whiten(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS,
           fit: Whitening | None = None) -> DataFrame:
    """(id, RESULT) for each vector with finite entries only and each component of ``fit``, fitted on df if not given.

    Rows without such a vector are left out, null ids and repeated rows stay, other columns of df are not returned.
    """
    fit = fit_whitening(df, vec, components) if fit is None else fit
    k = len(fit.values)
    explained = fit.values / fit.trace if k else fit.values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in scaled(batch.column(1), readable(batch.column(1))[0]) if k else ():
                each = pa.array(np.repeat(np.arange(len(at)), k))
                m = len(each)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(m, fit.centre.n, np.int64)), fit.centre.deviations(x).take(each),
                    pa.array(fit.project(fit.centre.centred(x)).ravel()), pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(m, fit.error))], names)

    names = [id_col, *[c.split()[0] for c in RESULT.split(", ")]]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, vec).mapInArrow(work, f"`{id_col}` {kind}, {RESULT}")
