"""Whitening of embeddings by Jacobi-Davidson.

The covariance is never formed. Vectors are centred exactly and stored as blocks of rows; a product
of the covariance with a few directions is one job over the blocks, whose tasks return a partial
product each. A search space of directions is kept in the driver, of the size of a few vectors:

1. Rayleigh-Ritz in the space gives the best pairs; those with a residual of double precision are
   locked, the largest first.
2. The others' correction equations, projected off all Ritz vectors in use, are solved by MINRES;
   the equations go side by side, so a step of all of them is one job.
3. The corrections enlarge the space, which is cut back to its best directions when it is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import stored, table

COMPONENTS = 8
#: Vectors of a stored block, at most; a block has about BLOCK_BYTES.
BLOCK_BYTES = 1 << 20
#: Fixed-point form of an entry: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this are held at it.
LIMIT = float(1 << 30)
#: Residual of a pair over the largest eigenvalue: 2^-44 is 256 units in the last place.
TOLERANCE = 2.0**-44
#: Residual that a pair must have when the iteration cannot lower it any more.
ACCEPTED = 2.0**-36
#: Steps of MINRES in a correction, directions of the space at most, and rounds.
INNER, SPACE, ROUNDS = 5, 48, 200
#: Directions beyond those asked for that are improved with them, for close eigenvalues.
EXTRA = 4
#: Eigenvalues below this part of the trace are those of directions without spread.
FLAT = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def vectors(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """The fixed-point vectors of a batch, one a row."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(np.clip(values, -LIMIT, LIMIT) * SCALE).astype(np.int64) + SHIFT
    return x.reshape(len(batch), width)


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows with a vector of finite entries."""
    entries = F.forall(
        column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )
    return rows.where(F.col(column).isNotNull() & entries)


def totals(rows: DataFrame, column: str, width: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(width, np.int64), 0
        for batch in batches:
            sums += vectors(batch, column, width).sum(axis=0)
            n += len(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(sums), pa.array(np.full(width, n))],
            ["dim", "total", "n"],
        )

    found = (
        rows.select(column).mapInArrow(run, "dim long, total long, n long")
        .groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .orderBy("dim").collect()
    )
    return (found[0]["n"] if found else 0), np.array([r["total"] for r in found], np.int64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as machine integers where they fit, else as Python's."""
    bound = n * (int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0)) // max(n, 1) + 1)
    if bound * bound * x.shape[1] < 2**63:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def centred_blocks(rows: DataFrame, column: str, n: int, sums: np.ndarray) -> DataFrame:
    """rows (number of vectors), vectors: centred vectors as bytes of doubles, stored."""
    width = len(sums)
    most = max(1, BLOCK_BYTES // (8 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), most):
                part = batch.slice(first, most)
                y = deviations(vectors(part, column, width), n, sums).astype(np.float64) / n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([y.tobytes()], pa.binary())],
                    ["rows", "vectors"],
                )

    return stored(rows.select(column).mapInArrow(run, "rows int, vectors binary"))


def summed(
    blocks: DataFrame, width: int, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]
) -> np.ndarray:
    """Sum over all blocks of a small matrix that a block gives. Tasks add up their own, and rows of
    the matrix are added up by Spark."""
    lines, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in batch.column("vectors"):
                total += of_block(np.frombuffer(block.as_buffer(), np.float64).reshape(-1, width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(lines)), *(pa.array(c) for c in total.T)],
            ["line", *(f"c{i}" for i in range(columns))],
        )

    fields = "line long, " + ", ".join(f"c{i} double" for i in range(columns))
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(columns)]
    found = blocks.select("vectors").mapInArrow(run, fields).groupBy("line").agg(*sums).collect()
    out = np.zeros(shape)
    for row in found:
        out[row["line"]] = row[1:]
    return out


def covariance_product(blocks: DataFrame, n: int, width: int) -> Product:
    """U -> V U, the vectors centred before they are multiplied; one job."""

    def product(u: np.ndarray) -> np.ndarray:
        return summed(blocks, width, lambda y: y.T @ (y @ u), (width, u.shape[1])) / n

    return product


def orthonormal(new: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit directions of ``new`` off ``space`` and off each other; dependent ones are left out."""
    out = space
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            v = v / left
            v = v - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, space.shape[1] :]


def corrections(
    product: Product, theta: np.ndarray, off: np.ndarray, residual: np.ndarray, steps: int
) -> np.ndarray:
    """MINRES for (1 - QQ') (V - theta) (1 - QQ') t = -r, an equation for each column, all of them a
    step at a time."""

    def project(v: np.ndarray) -> np.ndarray:
        v = v - off @ (off.T @ v)
        return v - off @ (off.T @ v)

    v = project(-residual)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    safe = np.where(live, beta, 1.0)
    v, before = v / safe, np.zeros_like(v)
    eta, gamma, gamma_old = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sigma, sigma_old = np.zeros_like(beta), np.zeros_like(beta)
    w, w_old, t = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    beta = np.where(live, beta, 0.0)
    lead = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        a = project(product(v) - theta * v)
        alpha = (v * a).sum(axis=0)
        after = a - alpha * v - lead * before
        lead_new = np.linalg.norm(after, axis=0)
        # Two Givens rotations of the tridiagonal column, then a new one.
        delta = gamma * alpha - gamma_old * sigma * lead
        rho = np.sqrt(delta**2 + lead_new**2)
        live = live & (rho > 0)
        rho_safe = np.where(rho > 0, rho, 1.0)
        rho2 = sigma * alpha + gamma_old * gamma * lead
        rho3 = sigma_old * lead
        gamma_new, sigma_new = delta / rho_safe, lead_new / rho_safe
        w_new = (v - rho3 * w_old - rho2 * w) / rho_safe
        t = t + np.where(live, gamma_new * eta, 0.0) * w_new
        eta = -sigma_new * eta
        live = live & (lead_new > 1e-14 * np.abs(theta).max(initial=1e-300))
        before, v = v, after / np.where(lead_new > 0, lead_new, 1.0)
        w_old, w = w, w_new
        gamma_old, gamma, sigma_old, sigma = gamma, gamma_new, sigma, sigma_new
        lead = lead_new
    return project(t)


def largest_pairs(product: Product, width: int, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric product and unit vectors of them."""
    count = min(wanted + EXTRA, width)
    space = orthonormal(np.random.default_rng(seed).standard_normal((width, count)), np.zeros((width, 0)))
    image = product(space)
    best, idle = np.inf, 0
    for _ in range(ROUNDS):
        small = space.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        ritz, ritz_image = space @ inner[:, :count], image @ inner[:, :count]
        residual = ritz_image - ritz * values[:count]
        errors = np.linalg.norm(residual, axis=0)
        scale = max(values[0], np.finfo(float).tiny)
        worst = errors[:wanted].max() / scale
        # A full space has nothing to add; rounding keeps some residuals above the tolerance.
        idle = 0 if worst < 0.5 * best else idle + 1
        best = min(best, worst)
        if worst <= TOLERANCE or space.shape[1] == width or (idle >= 4 and worst <= ACCEPTED):
            break
        locked = 0
        while locked < wanted and errors[locked] <= TOLERANCE * scale:
            locked += 1
        open_ = np.array([i for i in range(locked, count) if errors[i] > TOLERANCE * scale])
        found = corrections(product, values[open_], ritz, residual[:, open_], INNER)
        if space.shape[1] + len(open_) > max(SPACE, 3 * count):
            keep = 2 * count
            space, image = space @ inner[:, :keep], image @ inner[:, :keep]
        new = orthonormal(np.column_stack([found, residual[:, open_]]), space)[:, : width - space.shape[1]]
        if not new.shape[1]:
            break
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    if worst > ACCEPTED:
        raise ArithmeticError(f"Residual {worst:.1e} of the largest eigenvalue.")
    return values[:wanted], ritz[:, :wanted]


def whiten(
    rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each usable
    vector and each of the ``components`` directions with the largest spread.

    Vectors are null, or hold a null or non-finite entry: left out. Vectors of another length than
    the commonest (the longer of equally common ones) are left out as well. Entries beyond ``LIMIT``
    are held at it. ``deviation`` is null where it exceeds a long. Directions without spread are not
    components, so equal vectors, a single one, an empty table give no rows. Null and repeated ids
    and repeated vectors are rows like others. Other columns are ignored.
    """
    found = usable(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), "vector")
    lengths = found.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    schema = (
        f"vec_id {rows.schema[vec_id].dataType.simpleString()}, component int, n long, "
        "deviation long, whitened double, explained double, identity_error double"
    )
    spark = rows.sparkSession
    if first is None or not first["width"]:
        return spark.createDataFrame([], schema)
    width = first["width"]
    kept = found.where(F.size("vector") == width)
    n, sums = totals(kept, "vector", width)
    blocks = centred_blocks(kept, "vector", n, sums)
    trace = summed(blocks, width, lambda y: np.array([[np.square(y).sum()]]), (1, 1))[0, 0] / n
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, directions = largest_pairs(
        covariance_product(blocks, n, width), width, min(components, width)
    )
    spread = values > FLAT * trace
    values, directions = values[spread], directions[:, spread]
    k = len(values)
    onto = directions / np.sqrt(values)

    def moments(y: np.ndarray) -> np.ndarray:
        w = y @ onto
        return np.column_stack([w.T @ w, w.sum(axis=0)])

    found_moments = summed(blocks, width, moments, (k, k + 1)) / n
    mean = found_moments[:, k]
    error = float(np.abs(found_moments[:, :k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = deviations(vectors(batch, "vector", width), n, sums)
            squares = (d * d).sum(axis=1)
            exact = [int(s) if int(s) < 2**63 else None for s in squares.tolist()]
            w = (d.astype(np.float64) / n) @ onto
            many = len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * k, n)),
                    pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(w.ravel()), pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
