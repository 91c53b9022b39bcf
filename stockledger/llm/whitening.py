"""Operator 12: embedding whitening by shifted CholeskyQR.

1. ``integer_vectors``: usable rows with every entry as ``floor(scale * c)``; rows whose vector is null or
   holds null or non-finite entries go.  Stored once; nothing reads the embeddings again.
2. ``fit_list``: each distinct vector once (partial aggregation drops copies before the shuffle).
3. ``totals``: number, length and exact sums of the fit list.
4. ``triangular_factor``: CholeskyQR passes.  Each pass sends the factors found so far to all tasks, which
   centre their rows, solve them against these triangles one after the other and return the Gram matrix
   of the result; its Cholesky factor (shifted while the Gram matrix is far from the identity, so it
   exists for dependent dimensions too) is the next triangle.  R is the product of all triangles: the
   centred rows are Q R with orthonormal Q, which is never stored.  It stops when Q is orthonormal on
   the directions that the rows span.
5. ``fit``: singular values and right vectors of R are scales and directions of the components.  One more
   pass measures the covariance of the whitened rows, whose distance from the identity is reported.
6. ``whiten``: every usable row projected, in Arrow batches.

Gram matrices are added up in two levels (``_added``): the driver receives at most ``FAN_IN`` matrices of
dimensions x dimensions, whatever the number of rows.  A task holds one batch of rows.

Cases: shorter vectors count as followed by zeros; directions without variance (at most RANK of the
total) give no component, so a fit list of one vector, or an empty one, gives no rows; repeated rows each
give their rows but count once in the fit; ids may be null or repeat; entries beyond 64 bits are
taken as the nearest 64-bit integer; equal eigenvalues come in any order.  Only the id and vector
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockledger.llm.common import read, stored

SCALE = 256
COMPONENTS = 4
PASSES = 12            # at most; three are usual
ORTHONORMAL = 1e-11    # largest entry of Q'Q minus the identity (or minus a projection) at the end
RANK = 1e-12           # share of the total variance below which a direction counts as constant
FAN_IN = 32            # partial sums that reach the driver
_UNIT = np.finfo(float).eps / 2


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): rows with a finite vector, entries as ``floor(scale * entry)`` in 64 bits."""
    c = F.col(vector_col).cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    long = lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-2.0**63)), F.lit(2.0**63 - 1024))).cast("bigint")
    usable = vectors.where(c.isNotNull() & finite)
    return stored(usable.select(F.col(id_col).alias("id"), F.transform(c, long).alias("x")), "vectors")


def fit_list(each: DataFrame) -> DataFrame:
    """(x): every distinct vector once, shorter ones followed by zeros."""
    length = each.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).scalar()
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), length - F.size("x")))
    return stored(each.select(padded.alias("x")).distinct(), "fit-list")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The batch's vectors as an int64 matrix; shorter ones are followed by zeros."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _added(fits: DataFrame, part: Callable[[Iterator[np.ndarray]], list[np.ndarray]], dims: int) -> list[np.ndarray]:
    """Elementwise sums of the arrays that ``part`` makes of each task's batches, in a fixed order.

    Every task sends one row; ``FAN_IN`` tasks add those up; the driver adds the rest.
    """
    def arrays(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        for row in b.column("sums").to_pylist():
            yield [np.array(v, dtype=float) for v in row]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(part(matrix(b.column("x"), dims) for b in batches if b.num_rows))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for one in arrays(b):
                total = one if total is None else [x + y for x, y in zip(total, one)]
        if total is not None:
            yield packed(total)

    def packed(out: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([[a.ravel().tolist() for a in out]], pa.list_(pa.list_(pa.float64())))], ["sums"])

    kind = "sums array<array<double>>"
    rows = fits.mapInArrow(first, kind).repartition(FAN_IN).mapInArrow(second, kind).collect()
    total = [[np.array(v, dtype=float) for v in r.sums] for r in rows]
    return [np.sum(np.stack(x), axis=0) for x in zip(*total)]


def totals(fits: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    sums = fits.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.d: int(r.s) for r in sums}
    return fits.count(), [by[d] for d in range(len(by))]


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangle ``r``, by substitution."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _centred_gram(mean: np.ndarray, factors: list[np.ndarray]) -> Callable[[Iterator[np.ndarray]], list[np.ndarray]]:
    dims = len(mean)

    def part(batches: Iterator[np.ndarray]) -> list[np.ndarray]:
        gram = np.zeros((dims, dims))
        for x in batches:
            q = x - mean
            for r in factors:
                q = solve(q, r)
            gram += q.T @ q
        return [gram]

    return part


def triangular_factor(fits: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(R, squared norm, passes): R'R is the Gram matrix of the centred rows.  R is None if all rows are equal."""
    dims = len(mean)
    factors: list[np.ndarray] = []
    norm = 0.0
    for _ in range(PASSES):
        gram = _added(fits, _centred_gram(mean, factors), dims)[0].reshape(dims, dims)
        gram = (gram + gram.T) / 2
        if not factors:
            norm = float(np.trace(gram))
            if norm == 0:
                return np.zeros((dims, dims)), 0.0, 1
        elif np.abs(gram - np.eye(dims)).max() <= ORTHONORMAL or np.abs(gram @ gram - gram).max() <= ORTHONORMAL:
            break
        size = float(np.trace(gram))
        near = np.abs(gram - np.eye(dims)).max() < 0.5
        # the shift of shifted CholeskyQR: above the rounding error of the Gram matrix
        shift = 0.0 if near else 11 * (n * dims + dims * (dims + 1)) * _UNIT * size
        factors.append(np.linalg.cholesky(gram + min(shift, size / dims * 1e-3) * np.eye(dims)).T)
    else:
        raise RuntimeError("CholeskyQR did not settle")
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    return r, norm, len(factors)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``projection`` columns are components divided by their standard deviation."""
    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    projection: np.ndarray      # dims x components
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def _covariance(mean: np.ndarray, projection: np.ndarray) -> Callable[[Iterator[np.ndarray]], list[np.ndarray]]:
    def part(batches: Iterator[np.ndarray]) -> list[np.ndarray]:
        k = projection.shape[1]
        out = [np.zeros(k), np.zeros((k, k))]
        for x in batches:
            w = (x - mean) @ projection
            out[0] += w.sum(axis=0)
            out[1] += w.T @ w
        return out

    return part


def fit(fits: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None if it is empty or does not vary."""
    n, sums = totals(fits)
    if not sums:
        return None
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    r, norm, passes = triangular_factor(fits, n, mean)
    if norm == 0:
        return None
    _, scales, rows = np.linalg.svd(r)
    eigen = scales ** 2 / n
    keep = min(components, int((eigen > RANK * norm / n).sum()))
    projection = rows[:keep].T / np.sqrt(eigen[:keep])
    # centred before multiplying: first the mean of the whitened rows, then their products around it
    moved = _added(fits, _covariance(mean, projection), dims)[0] / n
    cov = _added(fits, _covariance(mean + _back(moved, rows[:keep], eigen[:keep]), projection), dims)[1].reshape(keep, keep) / n
    return Whitening(n, tuple(sums), mean, projection, eigen[:keep], eigen[:keep] / (norm / n), float(np.abs(cov - np.eye(keep)).max()), passes)


def _back(whitened: np.ndarray, directions: np.ndarray, eigen: np.ndarray) -> np.ndarray:
    """The point whose whitened form is ``whitened``."""
    return (whitened * np.sqrt(eigen)) @ directions


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Exact sum over the dimensions of (n * x - S)^2 for every row."""
    widest = n * int(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in sums) + 1
    if len(sums) * widest * widest < 2 ** 62:
        y = n * x - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def whiten(each: DataFrame, model: Whitening | None) -> DataFrame:
    """(id, component, deviation, whitened): one row per vector and component; deviation as an exact decimal."""
    kind = f"id {each.schema['id'].dataType.simpleString()}, component int, deviation decimal(38,0), whitened double"
    if model is None:
        return each.sparkSession.createDataFrame([], kind)
    held = each.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = m.projection.shape[1]
        with localcontext(prec=80):
            for b in batches:
                x = matrix(b.column("x"), len(m.sums))
                w = (x - m.mean) @ m.projection
                exact = pa.array([Decimal(v) for v in deviations(x, m.n, m.sums)], pa.decimal128(38, 0))
                row = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     exact.take(pa.array(row)), pa.array(w.ravel())], ["id", "component", "deviation", "whitened"])

    return each.mapInArrow(run, kind)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of every usable embedding, whitened over the distinct vectors."""
    each = integer_vectors(read(spark, sf_dir, "embeddings"))
    model = fit(fit_list(each))
    share = F.array(*[F.lit(float(v)) for v in model.explained]) if model else F.array(F.lit(0.0))
    return whiten(each, model).select(
        F.col("id").alias("vec_id"), "component", F.lit(model.n if model else 0).cast("bigint").alias("n"),
        F.col("deviation").cast("bigint").alias("deviation"), "whitened",
        F.element_at(share, F.col("component")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"))
