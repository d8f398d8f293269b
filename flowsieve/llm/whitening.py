"""Whitening of embeddings by an incremental eigendecomposition.

Every partition of the distinct vectors keeps a spectrum and changes it row by row (``spectra.py``). The partitions' spectra are
merged sixteen at a time, each merge being rank-one updates too, until one is left. A last distributed pass projects the centred
vectors on its eigenvectors and diagonalises that projection (Rayleigh-Ritz), which takes away what rounding has left.

Only matrices of dims x dims leave a task or reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.spectra import EPS, Spectrum
from flowsieve.session import written

#: The grid: a component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS, FAN_IN, BLOCK = 16, 16, 1024
#: Components beyond this are refused, for their sums would leave 64 bits.
MOST = 1 << 40


def on_grid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, y``: the grid values less SHIFT of each vector without null or non-finite entries."""
    v = F.col(vec_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))

    def cell(c: Column) -> Column:
        scaled = c.cast("double") * float(SCALE)
        return F.when(F.abs(scaled) < float(MOST), F.floor(scaled)).otherwise(F.raise_error(F.lit("a component is too large for the grid")).cast("bigint"))

    kept = vectors.where(v.isNotNull()).where(~odd).where(F.size(v) > 0)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, cell).alias("y"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; all have one length, which the caller has checked."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


PARTIAL = "part bigint, n bigint, total array<bigint>, mean array<double>, d array<double>, basis array<double>"


def _row(part: int, total: list[int], s: Spectrum) -> pa.RecordBatch:
    if max(map(abs, total)) >= 1 << 63:
        raise OverflowError("sums of the grid values leave 64 bits")
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int64()), "n": pa.array([s.rows], pa.int64()), "total": pa.array([total], pa.list_(pa.int64())),
        "mean": [s.mean.tolist()], "d": [s.d.tolist()], "basis": [s.basis.ravel().tolist()]})


def partition_spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: the exact sum of its vectors and the spectrum of their centred scatter."""
    spectrum, total = None, []
    for batch in batches:
        y = _matrix(batch.column(0))
        if not len(y):
            continue
        if spectrum is None:
            spectrum, total = Spectrum(y.shape[1]), [0] * y.shape[1]
        for k in range(0, len(y), BLOCK):
            total = [a + int(b) for a, b in zip(total, y[k:k + BLOCK].sum(0))]
        for row in y.astype(float):
            spectrum.add(row)
    if spectrum is not None:
        yield _row(TaskContext.get().partitionId(), total, spectrum)


def merged_spectra(rows: pa.Table) -> pa.Table:
    """At most FAN_IN spectra in one."""
    out, total = None, []
    for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
        one = Spectrum(len(r["d"]))
        one.rows, one.mean, one.d, one.basis = r["n"], np.array(r["mean"]), np.array(r["d"]), np.array(r["basis"]).reshape(len(r["d"]), -1)
        if out is None:
            out, total = one, r["total"]
        else:
            out.merge(one)
            total = [a + b for a, b in zip(total, r["total"])]
    return pa.Table.from_batches([_row(r["part"] // FAN_IN, total, out)])


def spectrum_of(fit: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """Rows, exact sums and eigenvectors of all vectors of ``fit``; none without rows."""
    parts = written(fit.select("y").mapInArrow(partition_spectra, PARTIAL), "spectra")
    while (last := parts.agg(F.max("part").alias("m")).first()["m"]) is not None and last > 0:
        parts = written(parts.groupBy(F.expr(f"part div {FAN_IN}").alias("_group")).applyInArrow(merged_spectra, PARTIAL), "spectra")
    r = parts.first()
    return None if r is None else (r["n"], list(r["total"]), np.array(r["basis"]).reshape(len(r["d"]), -1))


def _summed(fit: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``make`` over blocks of rows of ``fit``: added by task, then over tasks by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _matrix(batch.column(0)) if batch.num_rows else ()
            for k in range(0, len(y), BLOCK):
                block = make(y[k:k + BLOCK]).astype(np.longdouble)
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.astype(float).tolist()]})
    parts = fit.select("y").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("k", "v"))
    found = parts.groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    return np.array([r["v"] for r in found])


class Whitener:
    """The fitted map: exact sums, unit eigenvectors by falling eigenvalue, and their share of the variance."""

    def __init__(self, n: int, total: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.total = n, total
        self.floor = np.array([t // n for t in total])
        self.rest = np.array([t % n / n for t in total])
        self.vectors, self.values, self.explained, self.identity_error = vectors, values, values / trace if trace else values, 0.0

    def centred(self, y: np.ndarray) -> np.ndarray:
        """Whole numbers are taken off first, so nothing is lost."""
        return (y - self.floor).astype(float) - self.rest

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.vectors / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int]:
        """Sum of squares of n * x - S, in whole numbers."""
        far = max(int(abs(y).max()), 1) * self.n + max(map(abs, self.total))
        if y.shape[1] * far * far < 1 << 63:
            away = y * self.n - np.array(self.total)
            return (away * away).sum(1).tolist()
        found = [sum((int(v) * self.n - t) ** 2 for v, t in zip(row, self.total)) for row in y]
        if max(found) >= 1 << 63:
            raise OverflowError("a deviation leaves 64 bits")
        return found


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on the distinct vectors ``y`` of ``fit``. Directions without variance (below dims * eps of the largest) are left out."""
    found = spectrum_of(fit)
    if found is None:
        return None
    n, total, basis = found
    dims = len(total)
    start = Whitener(n, total, basis, np.ones(dims), 0.0)

    def projected(y: np.ndarray) -> np.ndarray:
        g = start.centred(y) @ basis
        return (g.T @ g).ravel()

    ritz = _summed(fit, projected).reshape(dims, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    some = (values > dims * EPS * max(values[0], 0)) & (np.arange(dims) < components)
    whitener = Whitener(n, total, vectors[:, some], values[some], float(np.trace(ritz)))
    k = int(some.sum())
    if k:
        def moments(y: np.ndarray) -> np.ndarray:
            w = whitener(y)
            return np.append((w.T @ w).ravel(), w.sum(0))
        sums = _summed(fit, moments) / n
        mean = sums[k * k:]
        whitener.identity_error = float(np.abs(sums[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return whitener


OUT = "vec_id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null, empty or hold null or non-finite entries are dropped; those left must have one length and components
    below 2 ** 40 / 64, or an error says so. Equal vectors count once in the fit, however many rows hold them, and all get
    rows. Components without variance have no whitened values and are left out: with one distinct vector, or none, the
    result is empty. Ids may be null or repeat. Equal eigenvalues give any orthonormal directions of their space. Other columns are ignored.
    """
    grid = on_grid(vectors, id_col, vec_col)
    fit = written(grid.groupBy("y").agg(F.lit(1).alias("_one")).select("y"), "whitening_fit")
    lengths = fit.agg(F.min(F.size("y")).alias("lo"), F.max(F.size("y")).alias("hi")).first()
    if lengths["lo"] != lengths["hi"]:
        raise ValueError(f"vectors have from {lengths['lo']} to {lengths['hi']} components")
    schema = OUT.format(id=dict(grid.dtypes)["vec_id"])
    whitener = fit_whitener(fit, components)
    if whitener is None or not len(whitener.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(whitener.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK)):
                y = _matrix(part.column(1))
                rows = len(y)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    "n": pa.array(np.full(rows * k, whitener.n)), "deviation": pa.array(np.repeat(np.array(whitener.deviations(y)), k)),
                    "whitened": pa.array(whitener(y).ravel()), "explained": pa.array(np.tile(whitener.explained, rows)),
                    "identity_error": pa.array(np.full(rows * k, whitener.identity_error))})
    return grid.mapInArrow(run, schema)
