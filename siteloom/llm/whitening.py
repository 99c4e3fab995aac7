"""Embedding whitening with distributed block matrices.

Entries become whole numbers, x = floor(64 c) + 1,000,000. The fit list holds each distinct x vector once; counts and sums
over it are exact. Its rows are centred, indexed and dealt into the blocks of a BlockMatrix A. The transpose times A is the scatter, a
matrix of dimension squared that alone comes to the driver; a local symmetric eigenproblem gives the components, and A times
the whitening matrix projects every row of the fit list, whose values its copies then share.

A product whose result is one block would gather all row blocks in one task; the shared dimension is therefore split in runs of
``RUN`` blocks that are multiplied apart and added. Copies of one vector, however many, are one row of the fit list; only the last
join sees them, as a skewed side that Spark splits.

Centring: with m = floor(S / n) and r = S - n m, x - S / n is (x - m) - r / n, whose first part is exact.

Defined cases: left out are null and empty vectors, vectors with a null, NaN or infinite entry or one of 2**46 and beyond (whose x
no double holds exactly), and vectors of another length than the most frequent (ties: the longest). A component without variance
(an eigenvalue within rounding of zero: equal vectors, fewer vectors than dimensions) is null when whitened and does not
count for the identity error, which is null if no component is left; ``explained`` is null if nothing varies. Rows of one id, and null ids, stay
rows of their own. ``deviation`` is null beyond 38 digits. The entry of a component that is largest in size is positive. Other columns,
whatever their names, are ignored. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE, SHIFT = 64, 1_000_000
#: Entries from which on a scaled one is no exact double.
LIMIT = float(1 << 46)
#: Numbers of one block, and row blocks multiplied in one task.
BLOCK, RUN = 1 << 17, 8
#: Digits of the widest decimal.
DIGITS = 38

EMPTY = "id {id}, n long, deviation decimal(38,0), whitened array<double>"


@dataclass
class Model:
    """What the fit list gave: its rows, sums, eigenvalues, unit components (columns), trace and identity error."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    active: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    identity_error: float | None = None

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.eigenvalues]


def quantised(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Usable rows as id and x, all of one length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)))
    rows = materialise(rows.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x")), "quantised")
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    return rows.where(F.size("x") == (top.d if top else 0))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once, numbered from 0 without gaps: index, x."""
    stored = materialise(rows.select("x").distinct().withColumn("place", F.monotonically_increasing_id()), "fit")
    part = F.shiftright("place", 33)
    parts = stored.groupBy(part.alias("part")).agg(F.min("place").alias("lo"), F.count("*").alias("here"))
    # As many rows as there were tasks.
    before = F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("part", (before - F.col("lo")).alias("shift"))
    return stored.withColumn("part", part).join(shift, "part").select((F.col("place") + F.col("shift")).alias("index"), "x")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension; a task gives one row per dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), d)
                n += len(x)
                # High and low halves apart: neither sum can overflow.
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
                total = [t + (h << 26) + w for t, h, w in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(DIGITS, 0))],
            names=["pos", "n", "total"])

    got = fit.select("x").mapInArrow(run, "pos int, n long, total decimal(38,0)").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    by = {r.pos: r for r in got}
    return (by[0].n, [int(by[j].total) for j in range(d)]) if by else (0, [])


def centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Per row of the fit list: index, x, y (x less the mean) and deviation (sum of (n x - S)^2, exact)."""
    d = len(sums)
    mean, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]

    def run(batches):
        share, whole = np.array([r / n for r in rest]), np.array(rest, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _matrix(batch.column("x"), d) - mean
            # Plain longs while no square nor sum can overflow, else Python's whole numbers.
            most = n * (int(np.abs(off).max()) + 1)
            wide = off.astype(object) * n - whole if most * most * d >= 1 << 63 else off * n - np.array(rest, np.int64)
            deviation = (wide * wide).sum(axis=1)
            y = (off - share).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("index"), batch.column("x"), pa.FixedSizeListArray.from_arrays(pa.array(y), d).cast(pa.list_(pa.float64())),
                pa.array([Decimal(int(v)) if v < 10 ** DIGITS else None for v in deviation], pa.decimal128(DIGITS, 0))], names=["index", "x", "y", "deviation"])

    return fit.mapInArrow(run, "index long, x array<long>, y array<double>, deviation decimal(38,0)")


def blocks_of(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """``rows(index, y)`` dealt into blocks of about ``BLOCK`` numbers."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("y").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(max(1, BLOCK // d), d)


def gram(a: BlockMatrix) -> np.ndarray:
    """Transpose of ``a`` times ``a``, by runs of row blocks."""
    row_blocks = -(-a.numRows() // a.rowsPerBlock)
    # Python's multiply lacks the JVM method's number of runs in which the shared dimension is split.
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, max(1, -(-row_blocks // RUN)))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def project(a: BlockMatrix, matrix: np.ndarray, spark: SparkSession) -> DataFrame:
    """Rows of ``a`` times ``matrix``: index, z."""
    d, k = matrix.shape
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, matrix.ravel(order="F").tolist()))], 1), d, k)
    per = a.rowsPerBlock

    def rows(block):
        (i, _), m = block
        return ((i * per + r, z) for r, z in enumerate(m.toArray().tolist()))

    return spark.createDataFrame(a.multiply(right).blocks.flatMap(rows), "index long, z array<double>")


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Model]:
    """Per usable row: id, n, deviation, whitened (by component); and the model."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector)
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], EMPTY.format(id=dict(rows.dtypes)["id"])), Model()
    d = len(first.x)
    fit = fit_list(rows)
    n, sums = sums_of(fit, d)
    fit = materialise(centred(fit, n, sums), "centred")
    a = blocks_of(fit, n, d)
    covariance = gram(a) / n
    value, unit = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-value, kind="stable")[:min(components, d)]
    value, unit = np.maximum(value[order], 0.0), unit[:, order]
    unit = unit * np.where(unit[np.abs(unit).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    active = value > d * np.finfo(float).eps * value[0]
    scale = np.divide(1.0, np.sqrt(value), out=np.zeros_like(value), where=active)
    found = materialise(project(a, unit * scale, spark), "projected")

    # The covariance of what came out, centred once more, against the identity.
    k = len(order)
    means = np.array(found.agg(*(F.avg(F.col("z")[j]) for j in range(k))).first(), float)
    z = found.select("index", F.zip_with("z", F.lit(means.tolist()), lambda v, m: v - m).alias("y"))
    error = np.abs(gram(blocks_of(z, n, k)) / n - np.eye(k))[np.ix_(active, active)]
    model = Model(n, sums, value, unit, trace, active, float(error.max()) if active.any() else None)

    keep = F.array(*(F.col("z")[j] if on else F.lit(None).cast("double") for j, on in enumerate(active.tolist())))
    of = fit.select("index", "x", "deviation").join(found.select("index", keep.alias("whitened")), "index").drop("index")
    return rows.join(of, "x").select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened"), model
