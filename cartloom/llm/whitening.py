"""Embedding whitening by incremental eigendecomposition.

Each partition keeps the mean of its vectors and the eigenvalues and axes of their scatter
matrix. A vector moves them by a centred rank-one update: in the present axes the new scatter
is a diagonal plus one product, whose eigenvalues are the roots of a secular equation.
Directions the update does not touch, and all but one axis of equal eigenvalues, are deflated
first; the axes follow from the roots by Loewner's formula, so they stay orthogonal however
close the roots are. The spectra of partitions are joined level by level, a bounded number at a
time, by successive rank-one updates too: one for each axis of the other side and one for the
distance of the means. Last, all vectors are projected on these axes and their covariance there
is summed up and diagonalised (Rayleigh-Ritz): this removes what rounding left in millions of
updates. The driver holds matrices of the dimension, never vectors.

Vectors are integers ``floor(1024 * c) + 100000``, so sums are exact whatever the order of rows.

Definitions: a vector that is missing or has a missing, infinite or not-a-number entry, or one
that a long cannot hold after scaling, is left out. Vectors must have one length: those of
another than the most frequent (of equally frequent ones the greatest) are left out too, as are
vectors without entries. Repeated rows and equal or missing ids are rows of their own, and
count as often as they occur. Components whose variance is under ``LEAST_SHARE`` of the whole
cannot be scaled to one and are not returned: constant vectors, or a single one, give no
rows, as does an empty table. Of equal eigenvalues any axes are eigenvectors; every run on the
same files gives the same. ``deviation`` is missing where a long cannot hold it. Only the id and
the vector are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import pin_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LEAST_SHARE = 1e-10
#: So many partial results are joined in one task.
FAN_IN = 8
EPS = np.finfo(float).eps
STATE_SCHEMA = "part long, n long, sums binary, state binary"
OUT_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``poles[j] - root[i]`` for the roots of ``1 + sum(weights / (poles - x))``.

    Poles ascend and differ, weights are positive; root *i* lies between pole *i* and the next.
    Roots are sought as distances from the nearer pole, so the differences are exact to rounding.
    Steps of a rational model of both neighbours are taken inside a bracket that always shrinks.
    """
    k = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    gap = upper - poles
    at = np.arange(k)
    with np.errstate(all="ignore"):
        middle = 1 + (weights / (poles - (poles + gap / 2)[:, None])).sum(axis=1)
        right = (middle < 0) & (at < k - 1)
        origin = at + right
        base = poles - poles[origin][:, None]
        far = upper - poles[origin]
        low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
        high[-1] = gap[-1]
        x = (low + high) / 2
        left_side = np.tri(k, dtype=bool)
        for _ in range(120):
            delta = base - x[:, None]
            term = weights / delta
            f = 1 + term.sum(axis=1)
            done = (np.abs(f) <= k * EPS * (1 + np.abs(term).sum(axis=1))) | (high - low <= EPS * np.abs(x))
            if done.all():
                break
            low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
            slope = term / delta
            left, whole = (slope * left_side).sum(axis=1), slope.sum(axis=1)
            near, next_ = delta[at, at], far - x
            a = (near + next_) * f - near * next_ * whole
            b = near * next_ * f
            c = f - near * left - next_ * (whole - left)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            tried = x + step
            inside = (tried > low) & (tried < high)
            x = np.where(done, x, np.where(inside, tried, (low + high) / 2))
    return base - x[:, None]


def rank_one(axes: np.ndarray, spectrum: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes and eigenvalues (ascending) of ``axes diag(spectrum) axes' + vector vector'``."""
    z = axes.T @ vector
    rho = float(z @ z)
    if not rho > 0:
        return axes, spectrum
    z = z / np.sqrt(rho)
    tolerance = 8 * EPS * max(float(spectrum[-1]), rho)
    axes = axes.copy()
    # deflation, first: of equal eigenvalues one axis takes the whole share of the vector
    steps = np.flatnonzero(np.diff(spectrum) > tolerance) + 1
    bounds = [0, *steps.tolist(), len(spectrum)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1:
            share = z[a:b].copy()
            size = np.copysign(np.sqrt(share @ share), share[-1])
            mirror = share.copy()
            mirror[-1] += size
            if mirror @ mirror > 0:
                axes[:, a:b] -= np.outer(axes[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
                z[a:b] = 0
                z[b - 1] = -size
    # second: what the vector does not touch stays
    live = np.flatnonzero(rho * np.abs(z) > tolerance)
    spectrum = spectrum.copy()
    if len(live) == 1:
        spectrum[live] += rho * z[live] ** 2
    elif len(live):
        poles, share = spectrum[live], z[live]
        k = len(live)
        delta = secular_roots(poles, rho * share**2)
        # Loewner: the vector whose update has exactly these roots
        lower = np.tri(k, k, -1, dtype=bool)
        shifted = np.append(poles[1:], 0.0)
        # of pole i (column) and root j (row): the pole that root j is paired with
        paired = np.where(lower.T, poles[:, None], shifted[:, None]) - poles
        paired[-1] = 1.0
        share = np.copysign(np.sqrt(np.abs(np.prod(-delta / paired, axis=0))), share)
        turn = (share / delta).T
        turn /= np.sqrt((turn * turn).sum(axis=0))
        axes[:, live] = axes[:, live] @ turn
        origin = np.argmin(np.abs(delta), axis=1)
        spectrum[live] = poles[origin] - delta[np.arange(k), origin]
    order = np.argsort(spectrum, kind="stable")
    return axes[:, order], spectrum[order]


@dataclass
class Spectrum:
    """Number, mean and scatter of some vectors, the scatter as axes and eigenvalues."""

    n: int
    mean: np.ndarray
    spectrum: np.ndarray
    axes: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray) -> None:
        away = vector - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.axes, self.spectrum = rank_one(self.axes, self.spectrum, away * np.sqrt((self.n - 1) / self.n))

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, axis in zip(other.spectrum.tolist(), other.axes.T, strict=True):
            if value > 0:
                self.axes, self.spectrum = rank_one(self.axes, self.spectrum, axis * np.sqrt(value))
        self.axes, self.spectrum = rank_one(self.axes, self.spectrum, away * np.sqrt(self.n * other.n / n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def packed(self) -> bytes:
        return np.concatenate((self.mean, self.spectrum, self.axes.ravel())).tobytes()

    @staticmethod
    def unpacked(n: int, raw: bytes, size: int) -> Spectrum:
        x = np.frombuffer(raw)
        return Spectrum(n, x[:size], x[size : 2 * size], x[2 * size :].reshape(size, size))


def scaled(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id`` and the integer vector ``x`` of the rows that are whole, and the length of the vectors."""
    entries = F.col(vector).cast("array<double>")
    chosen = rows.select(F.col(vec_id).cast("long").alias("vec_id"), entries.alias("x")).filter(
        F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52)), F.lit(False))
    )
    found = chosen.groupBy(F.size("x").alias("length")).count().filter("length > 0")
    first = found.orderBy(F.desc("count"), F.desc("length")).first()
    size = first.length if first else 0
    whole = chosen.filter(F.size("x") == size) if size else chosen.limit(0)
    return whole.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")), size


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, size)


def _state(n: int, sums: np.ndarray, state: bytes) -> pa.RecordBatch:
    """The partial result of a partition."""
    part = TaskContext.get().partitionId()
    return pa.record_batch(
        [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary()), pa.array([state], pa.binary())],
        ["part", "n", "sums", "state"],
    )


def in_levels(states: DataFrame, join: Callable[[pd.DataFrame], tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes] | None:
    """Join partial results, ``FAN_IN`` neighbours in a task at a time, until one is left."""

    def level(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *join(group.sort_values("part")))], columns=["part", "n", "sums", "state"])

    states = pin_table(states)
    parts = states.agg(F.max("part")).first()[0]
    while parts:
        parts //= FAN_IN
        states = states.groupBy(F.expr(f"part div {FAN_IN}").alias("part")).applyInPandas(level, STATE_SCHEMA)
    last = states.collect()
    return (last[0].n, bytes(last[0].sums), bytes(last[0].state)) if last else None


def local_spectra(vectors: DataFrame, size: int) -> DataFrame:
    """One row per partition: number, exact sums, and spectrum of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = Spectrum.empty(size), np.zeros(size, np.int64)
        for batch in batches:
            x = _matrix(batch, size)
            sums += x.sum(axis=0)
            for vector in x.astype(float):
                found.add(vector)
        if found.n:
            yield _state(found.n, sums, found.packed())

    return vectors.select("x").mapInArrow(run, STATE_SCHEMA)


def joined_spectrum(states: DataFrame, size: int) -> tuple[Spectrum, np.ndarray] | None:
    """The spectrum of all partitions and the exact sums."""

    def join(group: pd.DataFrame) -> tuple[int, bytes, bytes]:
        whole, sums = Spectrum.empty(size), np.zeros(size, np.int64)
        for n, part_sums, raw in zip(group["n"], group["sums"], group["state"], strict=True):
            whole.join(Spectrum.unpacked(int(n), raw, size))
            sums += np.frombuffer(part_sums, np.int64)
        return whole.n, sums.tobytes(), whole.packed()

    found = in_levels(states, join)
    if found is None:
        return None
    return Spectrum.unpacked(found[0], found[2], size), np.frombuffer(found[1], np.int64)


def summed_products(vectors: DataFrame, size: int, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``y`` and of ``y y'`` over all vectors, ``y`` being the centred vector in the axes of ``turn``."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            y = (_matrix(batch, size) - centre) @ turn
            total += y.sum(axis=0)
            product += y.T @ y
            n += len(y)
        if n:
            yield _state(n, np.zeros(0, np.int64), np.concatenate((total, product.ravel())).tobytes())

    def join(group: pd.DataFrame) -> tuple[int, bytes, bytes]:
        return int(group["n"].sum()), b"", np.sum([np.frombuffer(raw) for raw in group["state"]], axis=0).tobytes()

    _, _, raw = in_levels(vectors.select("x").mapInArrow(run, STATE_SCHEMA), join)
    x = np.frombuffer(raw)
    return x[:k], x[k:].reshape(k, k)


@dataclass
class Whitening:
    """A fitted whitening: ``axes`` (columns) and ``variances`` of the components, the greatest first."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def fit(vectors: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all vectors; ``None`` if there are none."""
    found = joined_spectrum(local_spectra(vectors, size), size) if size else None
    if found is None:
        return None
    (near, sums), n = found, found[0].n
    centre = sums / n
    start, _ = np.linalg.qr(near.axes[:, ::-1])
    total, product = summed_products(vectors, size, centre, start)
    variances, turn = np.linalg.eigh(product / n - np.outer(total / n, total / n))
    variances, turn = variances[::-1], turn[:, ::-1]
    trace = float(variances.sum())
    kept = int((variances[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    axes, variances = (start @ turn)[:, :kept], variances[:kept]
    axes = axes / np.sqrt((axes * axes).sum(axis=0))
    error = 0.0
    if kept:
        total, product = summed_products(vectors, size, centre, axes / np.sqrt(variances))
        error = float(np.abs(product / n - np.outer(total / n, total / n) - np.eye(kept)).max())
    return Whitening(n, sums, axes, variances, trace, error)


def whiten(vectors: DataFrame, size: int, model: Whitening | None) -> DataFrame:
    """One row per vector and component."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT_SCHEMA)
    n, sums, k = model.n, model.sums, len(model.variances)
    centre, turn, explained = sums / n, model.axes / np.sqrt(model.variances), model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, size)
            rows = len(x)
            rough = (np.square(n * x.astype(float) - sums)).sum(axis=1)
            fits = rough < 9.2e18
            deviation = np.where(fits, np.square(n * np.where(fits[:, None], x, 0) - sums * fits[:, None]).sum(axis=1), 0)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)), pa.array(((x - centre) @ turn).ravel()),
                pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, OUT_SCHEMA)


def whitened(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Fit on all rows and whiten them."""
    vectors, size = scaled(rows, vec_id, vector)
    return whiten(vectors, size, fit(vectors, size, components))
