"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers, floor(scale * c) + shift, and are stored once. The covariance V is never formed: a pass over the vectors
gives V Q for a block Q of directions, as sums of Yᵀ(Y Q) over centred rows Y (x minus the exact quotient S / n, in whole numbers as far as
they go). The block has ``GUARD`` directions more than are wanted.

1. Rayleigh-Ritz: the eigenvectors of Qᵀ V Q turn Q towards eigenvectors of V; the residuals |V q - e q| say how far they are from it.
2. A Chebyshev polynomial of V, by its three-term recurrence (a pass for each degree), keeps the spectrum from its lower end to the block's
   least Ritz value small and magnifies what lies above; its degree follows from the residuals. QR makes the block orthonormal again.
3. A single direction goes through the same passes as a Lanczos process of its own. It gives the spectrum's lower end, and a certificate:
   each of its Ritz values that surely lies above the last wanted eigenvalue must be one that the block has found.
4. It ends when the residuals are as small as double precision allows and the certificate holds. A block that doesn't get there in
   ``ROUNDS`` is doubled; a block of all dimensions is exact after one pass.

The driver holds blocks of (dimensions x directions) numbers only; sums of passes are aggregated by Spark.

Cases: rows whose vector is null or holds a null or non-finite entry are dropped. Vectors shorter than the longest count as padded with
c = 0. Directions along which the vectors don't vary (an eigenvalue below 1e-12 of the largest) are no components, so one vector alone, equal
vectors and an empty table give no rows. Null and repeated ids are rows like any others. Equal eigenvalues have any orthonormal pair. Entries
whose whole numbers leave 63 bits raise; a deviation that does is null in ``deviation`` and spelt out in ``deviation_digits``. Columns other than
``vec_id`` and ``embedding`` are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.session import stored

#: Directions of the block beyond the wanted ones.
GUARD = 24
#: Filter rounds of a block before it is doubled, and the largest degree of a filter.
ROUNDS, DEGREE = 12, 24
#: Residuals, as a share of the largest eigenvalue, that count as zero.
EXACT = 1e-14
#: Rows that a task centres at once.
ROWS = 8192


@dataclass
class Whitening:
    """``basis`` has a unit eigenvector in each column, ``values`` the eigenvalues; a row x becomes (x - sums / n) @ basis / sqrt(values)."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0
    residuals: list[float] = field(default_factory=list)


def whole_vectors(table: DataFrame, scale: float, shift: int) -> DataFrame:
    """vec_id, x ARRAY<BIGINT> of the rows that take part."""
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("e").isNotNull() & ~bad)
    big = F.exists("e", lambda c: F.abs(c * scale) >= 2.0**62)
    x = F.transform("e", lambda c: F.floor(c * scale) + F.lit(shift))
    return rows.select("vec_id", F.when(big, F.raise_error(F.lit("an entry leaves 63 bits"))).otherwise(x).alias("x"))


def _matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    values, off = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()], column.offsets.to_numpy()
    size = np.diff(off)
    if (size == width).all():
        return values.reshape(-1, width)
    out = np.full((len(size), width), fill, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(off[:-1] - off[0], size)] = values
    return out


class _Fit:
    def __init__(self, vectors: DataFrame, fill: int):
        self.vectors, self.fill = vectors, fill
        shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
        self.n, self.d, self.passes = shape.n, shape.d or 0, 0
        self.sums = self._sums() if self.n and self.d else []
        self.mean = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def _sums(self) -> list[int]:
        """Exact sums of each dimension, from their upper and lower halves."""
        d, fill = self.d, self.fill

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
            for b in batches:
                x = _matrix(b.column("x"), d, fill)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low)], names=["at", "high", "low"])

        got = self.vectors.select("x").mapInArrow(run, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        return [(r.high << 32) + r.low for r in sorted(got.collect(), key=lambda r: r.at)]

    def centred(self) -> Callable[[pa.Array], Iterator[np.ndarray]]:
        """A function for tasks: blocks of centred rows of a column of vectors."""
        d, fill, mean, part = self.d, self.fill, self.mean, self.rest / self.n

        def blocks(column: pa.Array) -> Iterator[np.ndarray]:
            for lo in range(0, len(column), ROWS):
                yield (_matrix(column.slice(lo, ROWS), d, fill) - mean).astype(np.float64) - part

        return blocks

    def summed(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``of`` (``size`` numbers for a block of centred rows) over all rows: a pass."""
        blocks = self.centred()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                for y in blocks(b.column("x")):
                    total += of(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "v"])

        self.passes += 1
        got = self.vectors.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got.column("at").to_numpy()] = got.column("v").to_numpy()
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q."""
        return self.summed(lambda y: (y.T @ (y @ q)).ravel(), q.size).reshape(q.shape) / self.n


class _Lanczos:
    """A Lanczos process that gets its products from outside, with full reorthogonalisation."""

    def __init__(self, start: np.ndarray):
        self.basis = [start / np.linalg.norm(start)]
        self.alpha: list[float] = []
        self.beta: list[float] = []

    @property
    def next(self) -> np.ndarray:
        return self.basis[-1]

    @property
    def ended(self) -> bool:
        return len(self.alpha) == len(self.basis)

    def step(self, product: np.ndarray) -> None:
        if self.ended:
            return
        self.alpha.append(float(self.basis[-1] @ product))
        q, r = np.array(self.basis), product.copy()
        for _ in range(2):
            r -= q.T @ (q @ r)
        size = float(np.linalg.norm(r))
        self.beta.append(size)
        if len(self.basis) < len(r) and size > 1e-13 * max(map(abs, self.alpha)):
            self.basis.append(r / size)

    def ritz(self) -> tuple[np.ndarray, np.ndarray]:
        """Its Ritz values, ascending, and the distance within which each has an eigenvalue."""
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return values, np.abs(vectors[-1]) * self.beta[-1]


def _chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block after a polynomial that stays small on [low, high] and is scaled to 1 at ``top``; ``vq`` is V q."""
    half, middle = (high - low) / 2, (high + low) / 2
    first = s = half / (top - middle)
    before, now = q, (vq - middle * q) * (s / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - s)
        before, now, s = now, (times(now) - middle * now) * (2 * then / half) - (s * then) * before, then
    return now


def fit(vectors: DataFrame, components: int, fill: int) -> tuple[Whitening, _Fit]:
    f = _Fit(vectors, fill)
    if not f.n or not f.d:
        return Whitening(f.n, f.sums, np.zeros((f.d, 0)), np.zeros(0), 0.0), f
    trace = float(f.summed(lambda y: np.array([np.einsum("ij,ij->", y, y)]), 1)[0]) / f.n
    if trace == 0:
        return Whitening(f.n, f.sums, np.zeros((f.d, 0)), np.zeros(0), 0.0, passes=f.passes), f
    rng = np.random.default_rng(12)
    wanted, size = min(components, f.d), min(components + GUARD, f.d)
    lanczos = _Lanczos(rng.normal(size=f.d))

    def times(q: np.ndarray) -> np.ndarray:
        out = f.times(np.column_stack([q, lanczos.next]))
        lanczos.step(out[:, -1])
        return out[:, :-1]

    q = np.linalg.qr(rng.normal(size=(f.d, size)))[0]
    best, rounds, worst = np.inf, 0, np.inf
    while True:
        vq = times(q)
        values, u = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        top = values[0]
        real = max(1, int((values[:wanted] > 1e-12 * top).sum()))
        left = np.linalg.norm(vq - q * values, axis=0)[:real] / top
        worst, rounds = float(left.max()), rounds + 1
        mu, within = lanczos.ritz()
        sure = mu - within > values[real - 1] * (1 + 1e-9)
        seen = all(np.abs(values[:real] - m).min() <= w + 1e-9 * top for m, w in zip(mu[sure], within[sure], strict=True))
        settled = worst <= EXACT or (worst < 1e-12 and worst > best / 2)  # rounding allows no more
        if q.shape[1] == f.d or (settled and seen):
            break
        best = min(best, worst)
        if rounds > ROUNDS:
            extra = min(f.d, 2 * q.shape[1]) - q.shape[1]
            q = np.linalg.qr(np.column_stack([q, rng.normal(size=(f.d, extra))]))[0]
            best, rounds = np.inf, 0
            continue
        high = max(values[-1], 1e-9 * top)
        low = min(max(0.0, float(mu[0] - 2 * within[0])), 0.9 * high)
        reach = np.arccosh(max(1 + 1e-9, (2 * values[real - 1] - high - low) / (high - low)))
        degree = int(np.clip(np.ceil(np.log(10 * worst / EXACT) / reach), 4, DEGREE)) if rounds > 1 else 6
        q = np.linalg.qr(_chebyshev(times, q, vq, degree, low, high, top * (1 + 1e-12)))[0]
    real = int((values[:wanted] > 1e-12 * top).sum())
    basis, values = q[:, :real], values[:real]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(real)])
    w = Whitening(f.n, f.sums, basis, values, trace, residuals=left.tolist())
    turned = basis / np.sqrt(values)

    def moments(y: np.ndarray) -> np.ndarray:
        z = y @ turned
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = f.summed(moments, real + real * real) / f.n
    w.identity_error = float(np.abs(got[real:].reshape(real, real) - np.outer(got[:real], got[:real]) - np.eye(real)).max())
    w.passes = f.passes
    return w, f


def _deviations(x: np.ndarray, n: int, mean: np.ndarray, rest: np.ndarray) -> list[int]:
    """Sums over dimensions of (n x - S)**2, exact."""
    off = x - mean
    most = (float(np.abs(off).max(initial=0)) + 1) * n
    if most * most * max(1, x.shape[1]) < 2.0**62:
        a = off * n - rest
        return np.einsum("ij,ij->i", a, a).tolist()
    a = off.astype(object) * n - rest.astype(object)
    return (a * a).sum(axis=1).tolist()


def whiten(table: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    vectors, _ = stored(whole_vectors(table, scale, shift), "vectors")
    w, f = fit(vectors, components, shift)
    spark, k = table.sparkSession, len(w.values)
    if not k:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")
    d, n, mean, rest, turned, blocks = f.d, f.n, f.mean, f.rest, w.basis / np.sqrt(w.values), f.centred()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, y in zip(range(0, b.num_rows, ROWS), blocks(b.column("x")), strict=True):
                part = b.slice(lo, ROWS)
                deviation = _deviations(_matrix(part.column("x"), d, shift), n, mean, rest)
                fits = [v if v < 1 << 63 else None for v in deviation]
                digits = [str(v) if u is None else None for u, v in zip(fits, deviation, strict=True)]
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array((y @ turned).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(fits, pa.int64()), z, pa.array(digits, pa.string())], names=["vec_id", "deviation", "z", "deviation_digits"])

    rows = vectors.mapInArrow(run, "vec_id long, deviation long, z array<double>, deviation_digits string")
    rows = rows.select("vec_id", "deviation", "deviation_digits", F.posexplode("z").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(w.identity_error).alias("identity_error"),
        "deviation_digits",
    )
