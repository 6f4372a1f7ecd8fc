"""Embedding whitening: principal components by matrix-free block iteration, and rows projected on them at unit variance.

No task ever holds a covariance matrix. A pass over the fit list multiplies it into one block of a few columns, as Xᵀ(XQ) on
centred rows; tasks add up what they have, a second level adds up tasks, and the driver sees one array of dimensions x block. There
QR puts the new block into an orthonormal basis, Rayleigh-Ritz on the whole basis gives candidates, and the residuals ‖Vq - θq‖ of all
k candidates have to be small before they count. The blocks of earlier passes stay in the basis up to a bound, beyond which it starts
again from its best candidates: plain subspace iteration needs hundreds of passes where eigenvalues lie close together, the growing
basis at most one for each block of dimensions.

Entries become whole numbers, floor(256 * c). The fit list is each distinct vector once, so copies don't weigh. Defined results:
vectors that are null or hold null or non-finite entries are left out; shorter vectors count as having zeros at the end; rows of
equal vectors all get results, and null ids stay null; other columns are ignored by the report and kept by ``whitened``; components
whose eigenvalue is 0 up to rounding don't exist, so an empty table, or one with a single distinct vector, has no result rows. A
deviation beyond 64 bits is null. Eigenvalues that are equal share a plane, in which any basis is right.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, staged

LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: x becomes (x - sums / n) · components / sqrt(values), for x = floor(scale * c)."""

    scale: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dimensions x k, columns of length 1
    values: np.ndarray  # their eigenvalues, falling
    trace: float
    residuals: np.ndarray  # ‖Vq - θq‖ of each
    passes: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vectors: DataFrame, dims: int, scale: int, out: str = "__x") -> DataFrame:
    """The usable rows of vectors with ``out``: array<long> of dims entries."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    filled = F.when(F.size(x) < dims, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x)))).otherwise(x)
    return vectors.where(usable()).withColumn(out, filled)


def usable():
    """Whether a row has a vector without null and non-finite entries."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col("embedding").isNotNull() & ~odd


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _added_up(fit: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all rows of what ``of`` makes of a matrix of rows, an array of ``size`` doubles: by task, by a root of the tasks, then here."""

    def first(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    def again(batches):
        total, some = np.zeros(size), False
        for batch in batches:
            total += _matrix(batch, "v", size).sum(axis=0)
            some = True
        if some:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    parts = max(1, isqrt(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tasks = fit.select("x").mapInArrow(first, "v array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
    sums = tasks.repartition(parts, "part").select("v").mapInArrow(again, "v array<double>")
    # all at once: an iterator runs a job for each partition, and the arrays are few
    return np.sum([r["v"] for r in sums.collect()], axis=0)


def _exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension, exact whatever their size."""

    def run(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch, "x", dims)
            if len(x):
                low, high = int(x.min()), int(x.max())
                wide = max(-low, high) * len(x) >= LONG
                n, total = n + len(x), [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims + 1), pa.int32()), "s": pa.array(map(Decimal, [n, *total]), pa.decimal128(38, 0))})

    got = {r["i"]: int(r["s"]) for r in fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return got.get(0, 0), [got.get(i + 1, 0) for i in range(dims)]


def fit(vectors: DataFrame, k: int = 4, scale: int = 256, block: int = 16, basis: int = 512, tolerance: float = 1e-13, most_passes: int = 1000) -> Whitening | None:
    """The k first components of the distinct usable vectors; None if there are none.

    tolerance: residuals that certify a component, as a share of the largest eigenvalue. A basis as large as the space certifies too: there
    is nothing outside of it. Raises ArithmeticError if most_passes don't do.
    """
    dims = vectors.where(usable()).agg(F.max(F.size("embedding")).alias("d")).first()["d"] or 0
    if not dims:
        return None
    listed = staged(whole_numbers(vectors, dims, scale, "x").select("x").distinct(), "embedding-fit")
    n, sums = _exact_sums(listed, dims)
    mean = np.array([s / n for s in sums])
    basis = max(basis, 2 * k + block)

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q and the trace of V, by one pass."""
        wide = q.shape[1]

        def of(batch):
            x = _matrix(batch, "x", dims) - mean
            return np.append((x.T @ (x @ q)).ravel(), np.einsum("ij,ij->", x, x))

        got = _added_up(listed, dims * wide + 1, of) / n
        return got[:-1].reshape(dims, wide), float(got[-1])

    q = np.linalg.qr(np.random.default_rng(0).standard_normal((dims, min(block, dims))))[0]
    held, image = np.empty((dims, 0)), np.empty((dims, 0))
    for passes in range(1, most_passes + 1):
        z, trace = times(q)
        held, image = np.hstack([held, q]), np.hstack([image, z])
        values, turn = np.linalg.eigh((held.T @ image + image.T @ held) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        ritz, moved = held @ turn, image @ turn
        left = moved - ritz * values
        error = np.linalg.norm(left, axis=0)
        wanted = int((values[:k] > dims * np.finfo(float).eps * max(values[0], 0)).sum())
        if held.shape[1] >= dims or (error[:k] <= tolerance * values[0]).all():
            unit = ritz[:, :wanted] / np.linalg.norm(ritz[:, :wanted], axis=0)
            return Whitening(scale, n, tuple(sums), unit, values[:wanted], trace, error[:wanted], passes)
        if held.shape[1] + block > basis:  # starts again from the best candidates, whose images are known
            held, image = ritz[:, : k + block], moved[:, : k + block]
        # the next block: residuals, largest eigenvalues first, less what the basis has
        q = left[:, : min(block, dims - held.shape[1])]
        for _ in range(2):
            q = np.linalg.qr(q - held @ (held.T @ q))[0]
    raise ArithmeticError(f"components not certified after {most_passes} passes: residuals {error[:k]}")


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """rows x components: whitened coordinates of whole-number rows."""
    return (x - model.mean) @ (model.components / np.sqrt(model.values))


def whitened(vectors: DataFrame, model: Whitening, out: str = "whitened") -> DataFrame:
    """The usable rows of vectors with their whitened coordinates as ``out``, array<double>."""
    dims = model.dims

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__x")
            w = projected(_matrix(batch, "__x", dims), model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            names = [n for n in batch.schema.names if n != "__x"]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [lists], [*names, out])

    return whole_numbers(vectors, dims, model.scale).mapInArrow(run, f"{ddl(vectors.schema)}, `{out}` array<double>")


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the fit list's whitened covariance less the identity, measured by a pass of its own."""
    k, dims = len(model.values), model.dims
    listed = whole_numbers(vectors, dims, model.scale, "x").select("x").distinct()

    def of(batch):
        w = projected(_matrix(batch, "x", dims), model)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    got = _added_up(listed, k * k + k, of) / model.n
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Of each row, the sum over dimensions of (n x - sum)², exact; None beyond 64 bits."""
    n, sums = model.n, model.sums
    most = n * max(-int(x.min()), int(x.max())) + max(map(abs, sums))
    if most * most * model.dims < LONG:
        v = x * n - np.array(sums)
        return np.einsum("ij,ij->i", v, v).tolist()
    v = x.astype(object) * n - np.array(sums, object)
    return [d if (d := int(row)) < LONG else None for row in (v * v).sum(axis=1)]


REPORT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening_report(vectors: DataFrame, k: int = 4) -> DataFrame:
    """A row for each usable row of vectors and component: see the columns of REPORT."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(vectors, k)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], REPORT)
    found, dims = len(model.values), model.dims
    explained, error = model.values / model.trace, identity_error(vectors, model)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if rows:
                x = _matrix(batch, "__x", dims)
                each = np.repeat(np.arange(rows), found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)),
                        pa.array(np.full(len(each), model.n)),
                        pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                        pa.array(projected(x, model).ravel()),
                        pa.array(np.tile(explained, rows)),
                        pa.array(np.full(len(each), error)),
                    ],
                    [c.split()[0] for c in REPORT.split(", ")],
                )

    return whole_numbers(vectors, dims, model.scale).select("vec_id", "__x").mapInArrow(run, REPORT)
