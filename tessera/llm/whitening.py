"""Whitening of embeddings with shifted CholeskyQR.

An entry c becomes the integer x = floor(64 c) + 1000000.  The fit list holds each distinct vector of
such integers once.  Its rows, centred first, form a tall matrix X that is never in one place: each
pass adds up the Gram matrix Q'Q of X R1^-1 R2^-1 ..., rows being taken through the triangular solves
as they are read.  The first Gram matrix gets a shift before its Cholesky factor is taken, so that the
factor exists however ill-conditioned X is; later passes orthogonalise what is left, without a shift
where they can.  The product R of the factors has X'X = R'GR with the last Gram matrix G (the identity,
but where X lacks rank), so the singular values and right vectors of sqrt(G) R are those of X, to
full precision, which the eigenvectors of a single Gram matrix are not.

Scale: a pass reads the fit list once, in batches; a task sends one row for each row of its d x d
matrix, these are summed by row number, and the driver sees d x d numbers.  Distinct vectors are found
with partial aggregation, so a vector that a third of all rows share is one row per task.  The fit
list is written to the shared folder and read by four to six passes.

Defined results: rows with a null vector, an empty one, or null, non-finite or unrepresentable entries
(64 c outside 62 bits) are dropped, and so are vectors of another length than most have (of equally
frequent lengths the larger counts).  Components whose singular value is under ``RANK`` of the largest do
not exist: one distinct vector has none, and gives no rows.  Of a component's signs the one with a
positive largest entry is taken.  A deviation beyond a long is null.  Repeated and null ids each have
their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Share of the largest singular value below which a direction is none; most Gram passes.
RANK, PASSES = 1e-12, 6
#: Entries that are multiplied at a time.
CHUNK = 1 << 20


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null where the vector is dropped."""
    scaled = lambda c: c.cast("double") * SCALE
    fits = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(scaled(c)) < 2.0**62), F.lit(False))
    return F.when((F.size(vector) > 0) & F.forall(vector, fits), F.transform(vector, lambda c: F.floor(scaled(c)) + OFFSET))


def usable(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows that remain, with their ``x``, and its length."""
    rows = rows.withColumn("x", integers(F.col(vector_col))).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("size")).count()
    most = lengths.agg(F.max(F.struct("count", "size")).alias("m")).first().m
    size = most.size if most else 0
    return rows.where(F.size("x") == size), size


@dataclass
class Centre:
    """Exact sums of the fit list, and the mean as whole numbers and what is left of it."""

    n: int
    sums: list[int]

    def __post_init__(self):
        whole = [s // self.n for s in self.sums]
        self.whole = np.array(whole, np.int64)
        self.rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, whole, strict=True)])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions of each row, exact."""
        left = np.array([s - self.n * int(w) for s, w in zip(self.sums, self.whole, strict=True)], object)
        apart = x - self.whole
        most = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * apart - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * apart.astype(object) - left) ** 2).sum(axis=1).tolist()
        return [int(v) if v < 1 << 63 else None for v in exact]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows R1^-1 R2^-1 ... of upper triangular factors, by forward substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[1]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _matrices(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    step = max(1, CHUNK // size)
    for low in range(0, len(x), step):
        yield x[low : low + step]


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows and sums of the task, as dimension -1 and 0, 1, ..."""
    n, sums = 0, [0] * size
    for batch in batches:
        for x in _matrices(batch.column(0), size):
            low = int(np.abs(x).max()) * len(x) < 1 << 62
            sums = [a + int(b) for a, b in zip(sums, (x if low else x.astype(object)).sum(axis=0), strict=True)]
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["i", "v"])


def _gram(batches: Iterator[pa.RecordBatch], size: int, rows_of) -> Iterator[pa.RecordBatch]:
    """Rows of the task's part of a Gram matrix; ``rows_of`` makes the matrix rows."""
    total = None
    for batch in batches:
        for x in _matrices(batch.column(0), size):
            q = rows_of(x)
            total = q.T @ q + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = row.values.to_numpy()
            total[i] = total[i] + values if i in total else values
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([*total.values()], pa.list_(pa.float64()))], ["i", "row"])


def gram(fit: DataFrame, size: int, rows_of) -> np.ndarray:
    """Sum of r'r over the matrix rows r that ``rows_of`` makes of the fit list."""
    parts = fit.mapInArrow(partial(_gram, size=size, rows_of=rows_of), "i int, row array<double>")
    rows = parts.repartition("i").mapInArrow(_added, "i int, row array<double>").collect()  # d rows of d numbers
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def _orthogonal(x: np.ndarray, centre: Centre, factors: list[np.ndarray]) -> np.ndarray:
    return solved(centre.apply(x), factors)


def _whitened(x: np.ndarray, centre: Centre, weights: np.ndarray) -> np.ndarray:
    return centre.apply(x) @ weights


def _with_one(x: np.ndarray, centre: Centre, weights: np.ndarray) -> np.ndarray:
    return np.hstack([_whitened(x, centre, weights), np.ones((len(x), 1))])


def shifted_cholesky_qr(fit: DataFrame, centre: Centre, size: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """The product R of the factors and the last Gram matrix: X'X = R'GR."""
    eps, factors, product = np.finfo(float).eps, [], np.eye(size)
    for number in range(passes):
        g = gram(fit, size, partial(_orthogonal, centre=centre, factors=factors))
        values = np.linalg.eigvalsh(g)
        clear = np.all((np.abs(values - 1) < 1e-9) | (np.abs(values) < 1e-6))
        if not values[-1] > 0 or number >= 2 and clear:
            break
        shift = 11 * (centre.n * size + size * (size + 1)) * eps * values[-1]
        if number and values[0] > 1e-6 * values[-1]:
            shift = 0.0
        r = np.linalg.cholesky(g + shift * np.eye(size)).T
        factors, product = [*factors, r], r @ product
    return product, g


@dataclass
class Whitening:
    """What whitens a vector: centre, weights (directions over roots of eigenvalues) and figures."""

    size: int
    centre: Centre | None
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return (self.directions / np.sqrt(self.eigenvalues)[:, None]).T


def fit_whitening(rows: DataFrame, size: int, components: int = COMPONENTS, passes: int = PASSES) -> Whitening:
    """``rows`` hold ``x``, all of one size."""
    none = Whitening(size, None, np.zeros((0, size)), np.zeros(0), np.zeros(0), 0.0)
    if not size:
        return none
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    sums = fit.mapInArrow(partial(_sums, size=size), "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    known = {r.i: int(r.v) for r in sums.collect()}  # one for each dimension
    centre = Centre(known[-1], [known[i] for i in range(size)])
    product, g = shifted_cholesky_qr(fit, centre, size, passes)
    values, vectors = np.linalg.eigh(g)
    root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ product
    _, singular, right = np.linalg.svd(root)
    count = int(np.sum(singular[:components] > RANK * singular[0])) if singular[0] > 0 else 0
    if not count:
        return none
    directions = right[:count]
    top = np.abs(directions).argmax(axis=1)
    directions = directions * np.sign(directions[np.arange(count), top])[:, None]
    spread = singular**2 / centre.n
    out = Whitening(size, centre, directions, spread[:count], spread[:count] / spread.sum(), 0.0)
    both = gram(fit, size, partial(_with_one, centre=centre, weights=out.weights)) / centre.n
    mean = both[-1, :-1]
    out.identity_error = float(np.abs(both[:-1, :-1] - np.outer(mean, mean) - np.eye(count)).max())
    return out


def _projected(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    count = len(model.eigenvalues)
    for batch in batches:
        low = 0
        for x in _matrices(batch.column(1), model.size):
            n, ids = len(x), batch.column(0).slice(low, len(x))
            each = np.repeat(np.arange(n), count)
            columns = {
                "id": ids.take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)), "n": pa.array(np.full(n * count, model.centre.n, np.int64)),
                "deviation": pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(each)), "whitened": pa.array(_whitened(x, model.centre, model.weights).ravel()),
                "explained": pa.array(np.tile(model.explained, n)), "identity_error": pa.array(np.full(n * count, model.identity_error)),
            }
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
            low += n


def whiten(vectors: DataFrame, id_col="vec_id", vector_col="embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each remaining
    row and component."""
    rows, size = usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector")
    model = fit_whitening(rows, size, components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.select("id", "x").mapInArrow(partial(_projected, model=model), schema)
