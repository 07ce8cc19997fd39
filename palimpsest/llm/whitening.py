"""Whitening of embeddings from an exact integer scatter matrix.

Entries are scaled to integers. Over the fit list, each distinct vector once, a shift is subtracted, and the sums and
cross-products of what is left are accumulated in integers of any size: each task adds up its rows, rows of the partial matrices
then meet by row number and are added. With n vectors, n·XᵀX − SSᵀ is so formed exactly, whatever the order of the
rows, and only then converted to floating point and decomposed by eigh. Nothing is lost to rounding however far the data lie from
zero, and a lost task gives the same numbers.

At scale: the fit list is one shuffle by vector (repeated ones meet map-side), written once. A task holds one
matrix of dimension squared, and as many cross its shuffle as there are tasks. What is decomposed, in a task, is that matrix alone,
and what comes to the driver and goes to all tasks is COMPONENTS vectors: both are bounded by the dimension, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import base

COMPONENTS = 4
SCALE = 256
#: Rows that a task takes at once.
BATCH = 4096


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.coalesce(F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def scaled(embedding: Column) -> Column:
    """The integers that a vector stands for."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column of longs as rows of ``dims`` longs; shorter lists are filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - at] = flat
    return out


def less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, in Python's integers where 64 bits might not do."""
    small = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), *(abs(int(s)) for s in shift)) < 1 << 61
    return x - shift.astype(np.int64) if small else x.astype(object) - shift.astype(object)


def cross(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of an integer matrix, exact, as arrays of Python's integers."""
    most = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    if most * most * len(y) < 1 << 53:  # every partial sum is an integer that a double holds
        d = y.astype(np.float64)
        return y.sum(0).astype(object), (d.T @ d).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.sum(0), o.T @ o


def _pack(ints) -> bytes:
    """Integers of any size, as decimal digits: Spark has no type for them."""
    return " ".join(map(str, ints)).encode()


def _unpack(data: bytes) -> np.ndarray:
    out = np.empty(data.count(b" ") + 1, object)
    out[:] = [int(v) for v in data.split(b" ")]
    return out


def _partial(dims: int, shift: np.ndarray):
    """Of a task's vectors: (i, n, row) with row i of the cross-products; the sums are row ``dims``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, s, c = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                ds, dc = cross(less(matrix(part.column(0), dims), shift))
                n, s, c = n + part.num_rows, s + ds, c + dc
        if n:
            rows = [*c, s]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([n] * (dims + 1), pa.int64()), pa.array([_pack(r) for r in rows], pa.binary())], ["i", "n", "row"])

    return run


def _added(batches: Iterator) -> Iterator:
    """The sum of the rows of each number."""
    import pyarrow as pa

    n: dict[int, int] = {}
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, m, r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            n[i] = n.get(i, 0) + m
            rows[i] = rows[i] + _unpack(r) if i in rows else _unpack(r)
    yield pa.RecordBatch.from_arrays([pa.array([*rows], pa.int32()), pa.array([n[i] for i in rows], pa.int64()), pa.array([_pack(r) for r in rows.values()], pa.binary())], ["i", "n", "row"])


def decompose(n: int, sums: np.ndarray, products: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors (rows) and shares of the trace of the covariance with divisor n, by falling
    eigenvalue. ``sums`` and ``products`` are exact, whatever shift was subtracted. Where an eigenvalue is nothing but
    rounding (under the largest times the dimension times the spacing of doubles) it is 0."""
    scatter = n * products - np.outer(sums, sums)  # exact; n * n times the covariance
    scale = max(1, *(abs(int(v)) for v in np.diag(scatter)))
    e, u = np.linalg.eigh((scatter / scale).astype(np.float64))  # the quotient of two integers is rounded once
    e, u = e[::-1], u.T[::-1]
    e = np.where(e > max(e[0], 0) * len(e) * np.finfo(np.float64).eps, e, 0.0)
    unit = scale / (n * n)
    trace = float(sum(int(v) for v in np.diag(scatter)) / scale)
    return e[:most] * unit, u[:most], e[:most] / trace if trace else np.full(len(e[:most]), np.nan)


def _decomposed(dims: int, shift: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows, n = {}, 0
        for batch in batches:
            for i, m, r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows[i], n = _unpack(r), m
        if rows:
            e, u, share = decompose(n, rows[dims], np.array([rows[i] for i in range(dims)], object))
            total = _pack(rows[dims] + n * shift.astype(object))
            cols = [pa.array(range(1, len(e) + 1), pa.int32()), pa.array([n] * len(e), pa.int64()), pa.array([total] * len(e), pa.binary()), pa.array(e), pa.array(share), pa.array(list(u), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["component", "n", "sums", "eigenvalue", "explained", "vector"])

    return run


def fit(vectors: DataFrame) -> dict | None:
    """What whitens: n, sums, eigenvalues, vectors, explained; from ``vectors`` (x, each distinct array of longs once), None if there are none.
    Bounded by the dimension: it is COMPONENTS vectors and the sums."""
    first = vectors.agg(F.max(F.size("x")).alias("dims"), F.min("x").alias("x")).first()
    if not first.dims or first.dims < 1:
        return None
    dims, shift = first.dims, np.zeros(first.dims, np.int64)
    shift[: len(first.x)] = first.x
    rows = vectors.mapInArrow(base.tidied(_partial(dims, shift)), "i int, n long, row binary").repartition("i").mapInArrow(base.tidied(_added), "i int, n long, row binary")
    kind = "component int, n long, sums binary, eigenvalue double, explained double, vector array<double>"
    found = sorted(rows.repartition(1).mapInArrow(base.tidied(_decomposed(dims, shift)), kind).collect())
    return {
        "n": found[0].n,
        "sums": _unpack(bytes(found[0].sums)),
        "eigenvalues": np.array([r.eigenvalue for r in found]),
        "explained": np.array([r.explained for r in found]),
        "vectors": np.array([r.vector for r in found]),
    }


def project(x: np.ndarray, model: dict) -> tuple[list[int], np.ndarray]:
    """Of each row of an integer matrix the sum of (n*x - S)**2, exact, and its whitened components (nan where the eigenvalue is 0)."""
    n, sums = model["n"], model["sums"]
    room = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(abs(int(s)) for s in sums)
    off = x * n - sums.astype(np.int64) if room < 1 << 62 else x.astype(object) * n - sums
    square = off if room * room * x.shape[1] < 1 << 62 else off.astype(object)
    with np.errstate(divide="ignore", invalid="ignore"):
        white = (off / n).astype(np.float64) @ model["vectors"].T / np.where(model["eigenvalues"] > 0, np.sqrt(model["eigenvalues"]), np.nan)
    return [int(v) for v in (square * square).sum(1)], white


def _whitened(model: dict):
    dims, k = model["vectors"].shape[1], len(model["eigenvalues"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                away, white = project(matrix(part.column(1), dims), model)
                away = [a if a < 1 << 63 else None for a in away]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k), pa.int32()), pa.array(white.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(away, pa.int64()), lists], ["vec_id", "deviation", "white"])

    return run


def identity_error(white: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of ``white`` (array<double>, k of them) minus the identity, measured: means
    first, then centred products."""
    at = lambda i: F.col("white")[i]
    if not k:
        return None
    means = white.agg(*[F.avg(at(i)).alias(f"m{i}") for i in range(k)]).first()
    if any(m is None for m in means):
        return None
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = white.agg(*[F.avg((at(i) - means[i]) * (at(j) - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row of ``vectors`` that has a usable vector and each of
    its first COMPONENTS components (all, if the dimension is lower).

    Rows whose vector is null or holds null or non-finite entries are dropped; further columns are ignored. A null or repeated
    vec_id is a row like others. A vector shorter than the longest is filled up with zeros; if all are empty the result is.
    An entry beyond 64 bits after scaling is the nearest long. Where an eigenvalue is 0 (one distinct vector, or fewer than
    components) whitened is null, as is identity_error, and explained is 0 (null if the trace is 0). A deviation beyond 64
    bits is null. An empty table gives an empty result. The fit list is written to the shared folder while the result is made.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.where(usable(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), scaled(F.col(embedding)).alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x"))))
    fitted = base.save(rows.select("x").distinct(), "fit")
    model = fit(fitted)
    out = f"vec_id {kind}, deviation long, white array<double>"
    if model is None:
        base.drop(fitted)
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(fitted.select(F.lit(None).cast(kind).alias("vec_id"), "x").mapInArrow(base.tidied(_whitened(model)), out), len(model["eigenvalues"]))
    base.drop(fitted)
    share = F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in model["explained"]])
    return (
        rows.mapInArrow(base.tidied(_whitened(model)), out)
        .select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
        .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(base.table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE: dict[str, str] = {}
