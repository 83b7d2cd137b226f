"""Tensors from arrays, tables and ranges, and their Parquet form."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.frame import DenseFrame, SparseFrame, StretchedFrame, coord_names, dense, fill, grid


def _rows(spark: SparkSession, columns: list, names: list[str]) -> DataFrame:
    rows = list(zip(*[np.asarray(c, np.int64).tolist() for c in columns[:-1]], np.asarray(columns[-1], np.float64).tolist(), strict=True))
    return spark.createDataFrame(rows, ", ".join([*(f"{n} long" for n in names), "val double"]))


def _compressed(spark: SparkSession, indptr, indices, data, shape, fmt: str, check: bool) -> SparseFrame:
    indptr, indices = np.asarray(indptr, np.int64), np.asarray(indices, np.int64)
    major = shape[0] if fmt == "csr" else shape[1]
    if len(indptr) != major + 1 or len(indices) != len(data) or (len(indptr) and (indptr[0] != 0 or indptr[-1] != len(indices))):
        raise ValueError("pointers, indices and data do not fit each other")
    if check and (np.diff(indptr) < 0).any():
        raise ValueError("pointers must not fall")
    outer = np.repeat(np.arange(major), np.diff(indptr))
    if check and ((indices < 0) | (indices >= shape[fmt == "csr"])).any():
        raise ValueError("an index is out of bounds")
    if check and ((np.diff(outer) == 0) & (np.diff(indices) <= 0)).any():
        raise ValueError("indices must rise within a row or column")
    rows, cols = (outer, indices) if fmt == "csr" else (indices, outer)
    return SparseFrame(_rows(spark, [rows, cols, data], ["row", "col"]), shape, fmt, coalesced=check)


def from_csr(spark: SparkSession, indptr, indices, data, shape, check: bool = True) -> SparseFrame:
    return _compressed(spark, indptr, indices, data, shape, "csr", check)


def from_csc(spark: SparkSession, indptr, indices, data, shape, check: bool = True) -> SparseFrame:
    return _compressed(spark, indptr, indices, data, shape, "csc", check)


def from_coo(spark: SparkSession, row, col, data, shape, check: bool = True) -> SparseFrame:
    if not len(row) == len(col) == len(data):
        raise ValueError("row, col and data must be equally long")
    out = SparseFrame(_rows(spark, [row, col, data], ["row", "col"]), shape, "coo")
    return out.validate() if check else out


def from_coond(spark: SparkSession, shape, indices, data, check: bool = True) -> SparseFrame:
    """indices: one row for each entry, or all of them flat."""
    at = np.asarray(indices, np.int64)
    if at.ndim == 1:
        if not len(shape) or len(at) % len(shape):
            raise ValueError("the number of indices must be a multiple of the dimensions")
        at = at.reshape(-1, len(shape))
    if at.shape != (len(data), len(shape)):
        raise ValueError("indices and data do not fit each other")
    out = SparseFrame(_rows(spark, [*at.T, data], coord_names(len(shape), "coond")), shape, "coond")
    return out.validate() if check else out


def _no_other(dtype, device) -> None:
    if dtype is not None and np.dtype(dtype) != np.float64:
        raise NotImplementedError("values are float64")
    if device not in (None, "cpu"):
        raise ValueError("the only device is cpu")


def zeros(spark: SparkSession, shape, dtype=None, device=None) -> SparseFrame:
    """An empty matrix (csr), or an empty tensor of any other number of dimensions."""
    _no_other(dtype, device)
    shape = (int(shape),) if isinstance(shape, int) else tuple(shape)
    fmt = "csr" if len(shape) == 2 else "coond"
    return SparseFrame(_rows(spark, [[] for _ in range(len(shape) + 1)], coord_names(len(shape), fmt)), shape, fmt, coalesced=True)


def eye(spark: SparkSession, n_rows: int, n_cols: int | None = None, k: int = 0, dtype=None, device=None) -> SparseFrame:
    _no_other(dtype, device)
    n_cols = n_rows if n_cols is None else n_cols
    low, high = max(0, -k), min(n_rows, n_cols - k)
    cells = spark.range(low, max(low, high)).select(F.col("id").alias("row"), (F.col("id") + k).alias("col"), F.lit(1.0).alias("val"))
    return SparseFrame(cells, (n_rows, n_cols), "csr", coalesced=True)


def diag(spark: SparkSession, values) -> SparseFrame:
    """A square matrix with these values on its diagonal: a list on the driver, or a dense vector."""
    if isinstance(values, DenseFrame):
        cells, n = values.df.select(F.col("i0").alias("row"), F.col("i0").alias("col"), "val"), values.shape[0]
    else:
        n = len(values)
        cells = _rows(spark, [range(n), range(n), values], ["row", "col"])
    return SparseFrame(cells, (n, n), "csr", coalesced=True)


def full(spark: SparkSession, shape, value: float) -> DenseFrame:
    shape = (int(shape),) if isinstance(shape, int) else tuple(shape)
    return DenseFrame(grid(spark, shape, coord_names(len(shape))).withColumn("val", F.lit(float(value))), shape)


def ones(spark: SparkSession, shape) -> DenseFrame:
    return full(spark, shape, 1.0)


def arange(spark: SparkSession, start, stop=None, step=1) -> DenseFrame:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return DenseFrame(spark.range(n).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("val")), (n,))


def linspace(spark: SparkSession, start, stop, num: int) -> DenseFrame:
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    value = F.when((F.col("id") == num - 1) & F.lit(num > 1), F.lit(float(stop))).otherwise(F.lit(float(start)) + F.col("id") * F.lit(step))
    return DenseFrame(spark.range(num).select(F.col("id").alias("i0"), value.alias("val")), (num,))


def meshgrid(*vectors: DenseFrame, indexing: str = "xy") -> list[DenseFrame]:
    """A tensor for each vector that holds its value along its own axis, and carries the others without making the cells."""
    order = list(range(len(vectors)))
    if indexing == "xy" and len(order) > 1:
        order[:2] = [1, 0]
    shape = tuple(vectors[k].shape[0] for k in order)
    names, out = coord_names(len(shape)), []
    for k, v in enumerate(vectors):
        own = order.index(k)
        base = v.df.select(*[F.col("i0").alias(c) if x == own else F.lit(0).cast("long").alias(c) for x, c in enumerate(names)], "val")
        out.append(StretchedFrame(DenseFrame(base, tuple(n if x == own else 1 for x, n in enumerate(shape))), shape))
    return out


def write_parquet(tensor: SparseFrame, path: str) -> None:
    """The cells as Parquet, and shape and format as one line of text beside them."""
    tensor.df.write.parquet(f"{path}/cells")
    about = json.dumps({"shape": tensor.shape, "fmt": tensor.fmt, "coalesced": tensor.coalesced})
    tensor.spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")


def read_parquet(spark: SparkSession, path: str) -> SparseFrame:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return SparseFrame(spark.read.parquet(f"{path}/cells"), tuple(about["shape"]), about["fmt"], about["coalesced"])


__all__ = [
    "arange", "dense", "diag", "eye", "fill", "from_coo", "from_coond", "from_csc", "from_csr", "full", "linspace",
    "meshgrid", "ones", "read_parquet", "write_parquet", "zeros",
]
