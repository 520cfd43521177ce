"""Whitening of embeddings by shifted CholeskyQR (operator 13).

The distinct vectors, on an integer grid, are the rows of a tall matrix Y after
the mean is taken off. Y = Q R is found without ever holding Q: a pass over the
rows sums the Gram matrix of the rows in their present basis (partial sums in
the tasks, added by a grouped sum), the driver factors that small matrix by
Cholesky, and the next pass sees each row after one more triangular solve. The
first factor is shifted by a multiple of the unit roundoff, so that it exists
for ill-conditioned rows; the passes that follow bring the basis to
orthogonality. The product of the factors is R; the singular value decomposition
of R gives the components and their standard deviations with the accuracy of a
QR decomposition, where an eigensolver on the covariance would lose half the
digits. Where the rows do not span all dimensions the basis stays short of
orthogonal; the square root of the last Gram matrix then stands before R.

What passes through the driver are d x d matrices and d sums, whatever the
number of rows. Mean and deviation are exact (integer sums).
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import stage

#: Steps of the grid per unit and what is added to each place; components returned.
GRID, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this size count as this large.
EDGE = float(2 ** 36)
#: Passes at most; distance from the identity at which the basis counts as orthonormal.
PASSES, NEAR = 6, 1e-10
#: Components whose deviation is below this part of the largest do not exist.
RANK = 1e-12


def grid_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor empty and holds
    finite entries only; x = floor(64 * entry) + 1000000 as longs."""
    e = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    place = lambda c: F.floor(F.least(F.greatest(c, F.lit(-EDGE)), F.lit(EDGE)) * GRID).cast("long") + SHIFT
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e"))
            .where(F.col("e").isNotNull() & (F.size("e") > 0)).where(F.forall("e", finite))
            .select("vec_id", F.transform("e", place).alias("x")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of all dimensions."""
    def part(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(0))]  # a batch's sums fit a long
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(d)], pa.int32()),
             pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], names=["j", "s"])

    got = (fit.mapInArrow(part, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect())
    sums = {r["j"]: int(r["s"]) for r in got}  # d + 1 rows
    return sums.get(-1, 0), [sums.get(j, 0) for j in range(d)]


class Centre:
    """Exact mean of the fit list; rows come out centred in double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S) ** 2, exactly."""
        near, rest = x - self.whole, np.array([s % self.n for s in self.sums], np.int64)
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2 ** 63:
            return ((near * self.n - rest) ** 2).sum(1).tolist()
        far = near.astype(object) * self.n - rest.astype(object)
        return (far * far).sum(1).tolist()


def gram(fit: DataFrame, d: int, centre: Centre, basis, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows ``basis(centred rows)`` and of their products."""
    def part(batches):
        total, product = np.zeros(wide), np.zeros((wide, wide))
        for b in batches:
            q = basis(centre.rows(_matrix(b.column(0), d)))
            total += q.sum(0)
            product += q.T @ q
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, wide), pa.int32()), pa.array([total.tolist(), *product.tolist()], pa.list_(pa.float64()))],
            names=["i", "g"])

    got = (fit.mapInArrow(part, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "g"))
           .groupBy("i", "j").agg(F.sum("g").alias("g")).collect())  # (wide + 1) x wide rows
    out = np.zeros((wide + 1, wide))
    for r in got:
        out[r["i"] + 1, r["j"]] = r["g"]
    return out[0], (out[1:] + out[1:].T) / 2


def factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted at first, and where it does not exist otherwise."""
    d = len(g)
    size = max(float(np.linalg.eigvalsh(g)[-1]), np.finfo(float).tiny)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size
    if not first:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def solved(factors):
    """Rows in the basis that the factors make: one triangular solve after the other."""
    def basis(y):
        q = y.T
        for r in factors:
            q = np.linalg.solve(r.T, q)
        return q.T
    return basis


def shifted_cholesky_qr(fit: DataFrame, d: int, centre: Centre) -> tuple[np.ndarray, float]:
    """R with R'R = Y'Y (the basis' own Gram matrix included), and the trace of Y'Y."""
    factors: list[np.ndarray] = []
    whole, trace = np.eye(d), 0.0
    for turn in range(PASSES + 1):
        _, g = gram(fit, d, centre, solved(list(factors)), d)
        if not turn:
            trace = float(np.trace(g))
            if trace == 0:
                return np.zeros((d, d)), 0.0
        if turn == PASSES or np.abs(g - np.eye(d)).max() < NEAR:
            break
        factors.append(factor(g, centre.n, not turn))
        whole = factors[-1] @ whole
    values, vectors = np.linalg.eigh(g)  # the identity, but for dimensions without rows
    return np.sqrt(np.clip(values, 0, None))[:, None] * (vectors.T @ whole), trace


class Whitening:
    """Components with a deviation, in falling order: ``directions`` (d x k) and
    their ``deviation`` (of the fit list, divisor n), with parts of the trace."""

    def __init__(self, centre: Centre, directions, deviation, explained):
        self.centre, self.directions, self.deviation, self.explained = centre, directions, deviation, explained
        self.error = 0.0

    def whiten(self, y: np.ndarray) -> np.ndarray:
        return y @ (self.directions / self.deviation)


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the stored distinct vectors (x); None without a vector."""
    n, sums = exact_sums(fit, d)
    if not n:
        return None
    centre = Centre(n, sums)
    r, trace = shifted_cholesky_qr(fit, d, centre)
    _, sigma, vectors = np.linalg.svd(r)
    keep = np.flatnonzero(sigma > RANK * sigma[0])[:components] if sigma[0] > 0 else np.zeros(0, int)
    directions = vectors[keep].T
    if len(keep):  # a sign that does not depend on the decomposition
        directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(len(keep))])
    out = Whitening(centre, directions, sigma[keep] / np.sqrt(n), sigma[keep] ** 2 / trace if trace else sigma[keep])
    if len(keep):
        total, product = gram(fit, d, centre, out.whiten, len(keep))
        cov = product / n - np.outer(total / n, total / n)
        out.error = float(np.abs(cov - np.eye(len(keep))).max())
    return out


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error, deviation_exact.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out, as are vectors of another length than most (ties: the longer);
    entries count as 2 ** 36 in size at most. The fit list is each distinct grid
    vector once; repeated rows and ids each get their rows. Components without
    variance do not exist: fewer than ``components`` where the vectors span
    less, none (an empty result) where all are equal or the table is empty. Of a
    component, the entry of the largest size is positive. ``deviation`` is null
    where it exceeds a long; ``deviation_exact`` holds it as a decimal.
    """
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_exact decimal(38,0)")
    grid = grid_vectors(rows, id_col, vector)
    lengths = grid.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = most["d"]
    grid = grid.where(F.size("x") == d)
    model = fit_whitening(stage(grid.select("x").distinct(), "fit"), d, components)
    if model is None or not model.directions.shape[1]:
        return rows.sparkSession.createDataFrame([], schema)

    def project(batches):
        k = model.directions.shape[1]
        for b in batches:
            x = _matrix(b.column(1), d)
            exact = model.centre.deviations(x)
            spread = lambda values, kind: pa.array(np.repeat(values, k), kind)
            which = np.repeat(np.arange(len(x)), k)
            long = pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())
            wide = pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(which), model.centre.n), pa.int64()), long.take(pa.array(which)),
                 pa.array(model.whiten(model.centre.rows(x)).ravel()), pa.array(np.tile(model.explained, len(x))),
                 pa.array(np.full(len(which), model.error)), wide.take(pa.array(which))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
                       "deviation_exact"])

    return grid.mapInArrow(project, schema)
