"""Embedding whitening: an exact-to-rounding covariance and the projection on its first components.

The centred vectors n * x - S are whole numbers. Each block of rows is split into slices of so few bits that the matrix products of two
slices are exact in doubles (an error-free transformation); the exact products of a block are added to a double-double sum, high and low
part, with TwoSum. The parts of all tasks are merged the same way, row by row of the matrix. The eigenvectors come from a reduction to
tridiagonal form and divide and conquer (LAPACK's syevd, as numpy.linalg.eigh calls it) of one small matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, frugal_group, stage_table, table

#: Rows of a block: with slices of (53 - log2(ROWS)) // 2 bits, products of slices summed over a block stay exact.
ROWS = 1024
_BITS = (53 - (ROWS - 1).bit_length()) // 2
#: Tasks' parts of a matrix are merged in so many groups first.
MERGE = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and its rounding error, exactly (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, x: np.ndarray, y: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double (high, low) plus (x, y)."""
    s, e = two_sum(high, x)
    t, f = two_sum(low, np.broadcast_to(y, np.shape(low)) + 0.0)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def outer_sums(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of the rows of d (int64), as a double-double matrix."""
    size = d.shape[1]
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for at in range(0, len(d), ROWS):
        block = d[at : at + ROWS]
        sign, rest = np.sign(block), np.abs(block)
        most = int(rest.max(initial=0)).bit_length()
        slices = [((rest >> k) & ((1 << _BITS) - 1)) * sign for k in range(0, max(most, 1), _BITS)]
        slices = [s.astype(np.float64) for s in slices]
        for i in range(len(slices) - 1, -1, -1):
            for j in range(len(slices) - 1, -1, -1):  # exact: integers below 2 ** 53; the power of two only shifts
                high, low = add(high, low, np.ldexp(slices[i].T @ slices[j], _BITS * (i + j)))
    return high, low


@dataclass
class Whitening:
    """Of vectors of one length: their distinct number, sums, first components (columns), eigenvalues, their shares, and the check."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as int64; refuses what leaves 64 bits."""
        most = max(int(np.abs(x).max(initial=0)), 1) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        if most >= 1 << 62:
            raise OverflowError("n * x - S leaves 64 bits")
        return x * self.n - self.sums.astype(np.int64)

    def project(self, d: np.ndarray) -> np.ndarray:
        """Whitened coordinates of centred rows; NaN where a component has no variance."""
        root = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (d.astype(np.float64) / self.n) @ self.components / root


def _vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of each length that occurs in a list column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[int(size)] = (rows, flat[(starts[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size))
    return out


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): x = floor(256 * c) of each component; rows whose vector is null, holds a null or non-finite component, or one
    whose x does not fit 64 bits, are left out."""
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 55)))
    whole = F.transform("v", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(ok).select("vec_id", whole.alias("x"))


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and exact sums of each length."""

    def add_up(batches):
        import pyarrow as pa

        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for size, (rows, x) in _vectors(batch.column(0)).items():
                n, s = total.get(size, (0, np.zeros(size, object)))
                low = (x & 0xFFFFFFFF).sum(0).astype(object)
                total[size] = n + len(rows), s + low + ((x >> 32).sum(0).astype(object) << 32)
        for size, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([str(v) for v in s], pa.string())], ["size", "i", "n", "s"])

    parts = fit.select("x").mapInArrow(frugal(add_up), "size int, i int, n long, s string")
    whole = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in whole.orderBy("size", "i").collect():  # a row for each dimension
        n, s = out.setdefault(r["size"], (r["n"], np.zeros(r["size"], object)))
        s[r["i"]] = int(r["s"])
    return out


def _merged(parts: DataFrame) -> DataFrame:
    """Double-double sums of (size, i, part, high, low) rows: first in MERGE groups, then of these."""

    def merge(key, rows):
        import pyarrow as pa

        high = low = None
        for h, l in zip(rows["high"].combine_chunks(), rows["low"].combine_chunks()):
            h, l = h.values.to_numpy(), l.values.to_numpy()
            high, low = (h, l) if high is None else add(high, low, h, l)
        return pa.table({"size": [key[0].as_py()], "i": [key[1].as_py()], "part": [key[2].as_py()], "high": [high], "low": [low]}, schema=_PART())

    out = parts
    for part in (F.col("part") % MERGE, F.lit(0)):
        out = out.withColumn("part", part.cast("int")).groupBy("size", "i", "part").applyInArrow(frugal_group(merge), "size int, i int, part int, high array<double>, low array<double>")
    return out


def _PART():
    import pyarrow as pa

    return pa.schema([("size", pa.int32()), ("i", pa.int32()), ("part", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])


def _covariances(fit: DataFrame, rows_of) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Double-double sums of outer products over all tasks; rows_of(x by length) gives each batch's sums, keyed by length."""

    def accumulate(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, (_, x) in _vectors(batch.column(0)).items():
                for h, l in rows_of(size, x):
                    held[size] = add(*held[size], h, l) if size in held else (h, l)
        part = TaskContext.get().partitionId()
        for size, (h, l) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([size] * len(h), range(len(h)), [part] * len(h), list(h), list(l)), _PART().types)], schema=_PART())

    parts = fit.select("x").mapInArrow(frugal(accumulate), "size int, i int, part int, high array<double>, low array<double>")
    out: dict[int, list] = {}
    for r in _merged(parts).orderBy("size", "i").collect():  # a row for each row of the matrix
        out.setdefault(r["size"], []).append((r["high"], r["low"]))
    return {size: (np.array([h for h, _ in rows]), np.array([l for _, l in rows])) for size, rows in out.items()}


def fit_whitening(fit: DataFrame, k: int = 4) -> dict[int, Whitening]:
    """The model of each length of x in `fit`, whose rows count once each; k components at most.

    A component whose eigenvalue is not above the rounding of the matrix has no variance: eigenvalue and share are 0."""
    spark = fit.sparkSession
    models = {size: Whitening(n, s, np.zeros((size, 0)), np.zeros(0), np.zeros(0)) for size, (n, s) in _sums(fit).items() if size}
    if not models:
        return models
    shared = spark.sparkContext.broadcast(models)  # a few rows of a vector's length
    sums = _covariances(fit, lambda size, x: [outer_sums(shared.value[size].centred(x))] if size else [])
    for size, m in models.items():
        high, low = sums[size]
        v = (high / m.n + low / m.n) / float(m.n) / float(m.n)
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        trace = float(np.trace(v))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        m.values = np.where(values > size * np.finfo(float).eps * max(trace, 0.0), values, 0.0)
        m.components = vectors
        m.explained = m.values / trace if trace > 0 else np.zeros(len(values))
    _check(fit, models)
    return models


def _check(fit: DataFrame, models: dict[int, Whitening]) -> None:
    """Set identity_error: the covariance of the whitened rows of `fit`, centred on their own means."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def live(size):
        m = shared.value[size]
        return m, np.flatnonzero(m.values > 0)

    def ones(size, x):
        if size:
            m, at = live(size)
            high, low = np.zeros((len(at), 1)), np.zeros((len(at), 1))
            w = m.project(m.centred(x))[:, at]
            for start in range(0, len(w), ROWS):
                high, low = add(high, low, w[start : start + ROWS].sum(0)[:, None])
            yield high, low

    means = {size: (h + l)[:, 0] / models[size].n for size, (h, l) in _covariances(fit, ones).items()}

    def products(size, x):
        if size:
            m, at = live(size)
            w = m.project(m.centred(x))[:, at] - means.get(size, 0.0)
            high, low = np.zeros((len(at), len(at))), np.zeros((len(at), len(at)))
            for start in range(0, len(w), ROWS):
                high, low = add(high, low, w[start : start + ROWS].T @ w[start : start + ROWS])
            yield high, low

    for size, (h, l) in _covariances(fit, products).items():
        models[size].identity_error = float(np.abs((h + l) / models[size].n - np.eye(len(h))).max())


def whiten(vectors: DataFrame, k: int = 4, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each remaining row on each of the first k components.

    x = floor(256 * c); the fit list holds each distinct x vector once, so copies do not weigh. Vectors of different lengths are tables of
    their own. Rows whose vector is null, empty, or holds a null or non-finite component, or one whose x does not fit 64 bits, are left
    out; null ids and repeated rows stay; an empty table gives no rows. A component without variance (fewer distinct vectors than
    dimensions, one vector only) has whitened null and explained 0; identity_error is over the others, null if there are none. Where
    n * x - S or a deviation leaves 64 bits, the run ends with an OverflowError. Equal eigenvalues leave their components' order open.
    """
    whole = whole_vectors(vectors, id_col, vector_col)
    fit = stage_table(whole.select("x").distinct())
    models = fit_whitening(fit, k)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    kind = whole.schema["vec_id"].dataType.simpleString()

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            for size, (rows, x) in _vectors(batch.column(1)).items():
                if not size:
                    continue
                m = shared.value[size]
                d = m.centred(x)
                if float((d.astype(np.float64) ** 2).sum(1).max()) >= 2.0**62:
                    raise OverflowError("a deviation leaves 64 bits")
                w = m.project(d)
                count = w.shape[1]
                repeat = lambda a: np.repeat(a, count)
                tile = lambda a: np.tile(a, len(rows))
                error = pa.array([m.identity_error] * (len(rows) * count), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(repeat(rows))),
                        pa.array(tile(np.arange(1, count + 1)), pa.int32()),
                        pa.array(np.full(len(rows) * count, m.n), pa.int64()),
                        pa.array(repeat((d * d).sum(1)), pa.int64()),
                        pa.array(w.ravel(), pa.float64(), from_pandas=True),
                        pa.array(tile(m.explained), pa.float64()),
                        error,
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = whole.mapInArrow(frugal(project), f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("vec_id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
