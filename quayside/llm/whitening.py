"""Whitening of embeddings by eigenvectors in mixed precision.

Entries become whole numbers first, so sums, products about a whole centre and
their totals over all tasks are exact: the covariance does not depend on how the
rows are dealt.  A task adds its rows' products up by matrix multiplication and
returns one small matrix, whose entries Spark sums by position.

The eigenvectors of that matrix, which is as wide as the vectors, are found on
the driver: a float32 decomposition, then Ogita and Aishima's iteration, which
corrects all vectors at once by matrix multiplications in extended precision and
converges quadratically.  Where eigenvalues lie closer together than the
correction can tell apart, the vectors of that cluster are separated by a small
decomposition of the matrix seen from their own span, about the cluster's mean.

Defined results: rows whose vector is null, empty, holds a null, NaN or infinite
entry, or has another length than most vectors (the longer one of a tie), are
dropped and do not count; repeated rows and rows with a null id are rows of their
own; entries beyond 2**40 stand at that value; a deviation beyond the range of
long is null; components without variance (e at most 1e-13 of the trace) have
whitened 0 and are left out of identity_error; without rows the result is empty;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries are held to this size, far beyond any embedding's.
BOUND = 2.0**40
#: Share of the trace up to which an eigenvalue counts as none.
FLAT = 1e-13
ROUNDS = 30


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): finite vectors of the table's usual length as doubles."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.size(v).alias("d")
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"), sound).where(finite & (F.size(v) > 0))
    usual = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()  # one row for each length
    return rows.where(F.col("d") == (usual["d"] if usual else 0)).select("vec_id", "v")


def _table(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as whole numbers, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.clip(np.floor(SCALE * flat), -BOUND, BOUND).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, of_batch, width: int) -> list[int]:
    """Totals of an array of whole numbers that each task adds up over its batches; Spark sums them by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_table(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([[str(x) for x in total]], pa.list_(pa.string()))], names=["totals"])

    parts = rows.mapInArrow(run, "totals array<string>").select(F.posexplode("totals").alias("at", "part"))
    sums = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = [0] * width
    for r in sums.collect():  # as many rows as the vectors' width, or its square
        out[r["at"]] = int(r["total"])
    return out


def moments(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Count and sums of the whole-number vectors, and their covariance, in extended precision."""

    def counts(x: np.ndarray) -> np.ndarray:
        return np.array([len(x), *[int(s) for s in x.sum(axis=0)]], dtype=object)

    n, *sums = _summed(rows, counts, d + 1)
    centre = np.array([round(s / n) for s in sums], dtype=np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        y, total = x - centre, np.zeros(d * d, dtype=object)
        exact = int(np.abs(y).max()) ** 2  # a product of floats is exact below 2**53
        step = max(1, int(2**52 // max(1, exact))) if exact < 2**52 else 0
        for i in range(0, len(y), step or len(y)):
            part = y[i : i + step] if step else y.astype(object)
            total += (part.T.astype(float) @ part.astype(float)).astype(np.int64).ravel().astype(object) if step else (part.T @ part).ravel()
        return total

    about = _summed(rows, products, d * d)
    off = np.array([np.longdouble(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])  # mean less centre, under one
    return n, sums, np.array([np.longdouble(p) / n for p in about]).reshape(d, d) - np.outer(off, off)


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Runs of several eigenvalues, in falling order, each within ``apart`` of the next."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction of approximate eigenvectors ``x`` of the symmetric ``a``: (vectors, eigenvalues, size of the correction by vector)."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    gap = values[None, :] - values[:, None]
    off = s - np.diag(np.diag(s))
    # Twice the error that the eigenvalues of s may have: closer ones cannot be told apart.
    apart = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    near = np.abs(gap) <= apart
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    x = x + x @ e
    for c in clusters(values, apart):
        v = x[:, c]
        mean = values[c].mean()
        inner = v.T @ (a @ v) - mean * (v.T @ v)
        size = np.abs(inner).max()
        if size > 0:
            _, turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))
            x[:, c] = v @ turn[:, ::-1].astype(x.dtype)
    return x, values, np.abs(e).max()


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) by falling value, to double precision, of a symmetric matrix."""
    a = a.astype(np.longdouble)
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    scaled = a / size
    _, start = np.linalg.eigh(scaled.astype(np.float32))
    x, last = start.astype(np.longdouble), np.inf
    for _ in range(ROUNDS):
        x, values, moved = refined(scaled, x)
        if moved < 1e-17 or (moved < 1e-12 and moved >= last):
            break
        last = moved
    for _ in range(3):  # vectors of a cluster are only as good as its gaps, but at right angles
        x = x + x @ (np.eye(len(a), dtype=x.dtype) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, scaled @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


_ROW = "array<struct<component:int,whitened:double,explained:double>>"


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each sound vector and component."""
    rows = whole(vectors, id_col, vector_col)
    id_type = vectors.schema[id_col].dataType.simpleString()
    out = f"vec_id {id_type}, n bigint, deviation bigint, parts {_ROW}, identity_error double"
    first = rows.select(F.size("v").alias("d")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], out).select("vec_id", F.inline("parts"), "n", "deviation", "identity_error").select(*ORDER)
    d = first["d"]
    n, sums, cov = moments(rows, d)
    values, vectors_ = eigen(cov)
    kept = min(components, d)
    trace = float(np.trace(cov))
    solid = values[:kept] > FLAT * trace
    turn = np.where(solid, vectors_[:, :kept] / np.sqrt(np.where(solid, values[:kept], 1.0)), 0.0)
    explained = values[:kept] / trace if trace else np.zeros(kept)
    centre = np.array([round(s / n) for s in sums], dtype=np.int64)
    off = np.array([float(np.longdouble(s - n * int(c)) / n) for s, c in zip(sums, centre, strict=True)])
    about = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    small = n * (2 * BOUND + SHIFT) < 2**62

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - off) @ turn

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - centre
        widest = n * int(np.abs(y).max(initial=0)) + max(abs(b) for b in about)
        if small and widest * widest * d < 2**63:
            return ((n * y - np.array(about, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(v) - b) ** 2 for v, b in zip(row, about, strict=True)) for row in y]
        return [v if v < 2**63 else None for v in exact]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, square = 0, np.zeros(kept), np.zeros((kept, kept))
        for batch in batches:
            if batch.num_rows:
                w = whitened(_table(batch.column(1)))
                count, total, square = count + len(w), total + w.sum(axis=0), square + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[float(count), *total, *square.ravel()]], pa.list_(pa.float64()))], names=["totals"])

    parts = rows.mapInArrow(spread, "totals array<double>").select(F.posexplode("totals").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("total"))
    sums_of = dict(parts.collect())  # as many rows as components, squared
    mean = np.array([sums_of[1 + i] for i in range(kept)]) / n
    seen = np.array([sums_of[1 + kept + i] for i in range(kept * kept)]).reshape(kept, kept) / n - np.outer(mean, mean)
    error = float(np.abs(seen - np.eye(kept))[np.ix_(solid, solid)].max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _table(batch.column(1))
            m = len(x)
            items = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(whitened(x).ravel()), pa.array(np.tile(explained, m))], names=["component", "whitened", "explained"])
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, m * kept + 1, kept, dtype=np.int32)), items)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n] * m, pa.int64()), pa.array(deviations(x), pa.int64()), listed, pa.array([error] * m, pa.float64())], names=["vec_id", "n", "deviation", "parts", "identity_error"])

    return rows.mapInArrow(run, out).select("vec_id", F.inline("parts"), "n", "deviation", "identity_error").select(*ORDER)


ORDER = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
