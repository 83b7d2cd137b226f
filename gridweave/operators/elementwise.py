"""Cell by cell: scalars, pairs, broadcasting, comparisons and functions of one value."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.frame import BROADCAST_CELLS, DenseFrame, FilledFrame, SparseFrame, StretchedFrame, beside, coord_names, dealt, fill
from gridweave.functions import expr

ZERO_DIVISION = {"divide": "division by zero", "floor_divide": "division by zero", "remainder": "integer modulo by zero"}


def scalar(name: str, a: SparseFrame, alpha: float) -> SparseFrame:
    """multiply, divide, floor_divide, remainder or pow of each stored value by a number; no cell comes or goes."""
    alpha = float(alpha)
    if alpha == 0.0 and name in ZERO_DIVISION:
        raise ZeroDivisionError(ZERO_DIVISION[name])
    if name == "divide":
        return a.map_values(lambda v: v * F.lit(1.0 / alpha))
    return a.map_values(lambda v: expr.BINARY[name](v, F.lit(alpha)))


def _like(a: SparseFrame, b: SparseFrame) -> None:
    if not isinstance(a, SparseFrame) or not isinstance(b, SparseFrame) or a.fmt != b.fmt:
        raise NotImplementedError("both tensors must be sparse and of one format")
    if a.shape != b.shape:
        raise ValueError(f"shapes differ: {a.shape} and {b.shape}")


def _sum(a: SparseFrame, b: SparseFrame, factor: float) -> SparseFrame:
    both = a.df.unionByName(b.df.withColumn("val", F.col("val") * factor) if factor != 1.0 else b.df)
    return a.like(both.groupBy(*a.coords).agg(F.sum("val").alias("val")).where("val != 0"), coalesced=True)


def pairwise(name: str, a: SparseFrame, b: SparseFrame) -> SparseFrame:
    """add and subtract over the cells stored on either side; the others over those stored on both.

    Repeated cells are added up first. Zero results are dropped. divide, floor_divide and remainder skip zero
    divisors, and these and pow keep finite results alone.
    """
    if name == "multiply" and a.fmt == getattr(b, "fmt", None) == "coond" and a.shape != b.shape:
        return hadamard_broadcast(a, b)
    _like(a, b)
    if name in ("add", "subtract"):
        return _sum(a, b, 1.0 if name == "add" else -1.0)
    right = b.coalesce().df.withColumnRenamed("val", "other")
    if name in ZERO_DIVISION:
        right = right.where("other != 0")
    both = a.coalesce().df.join(right, a.coords).select(*a.coords, expr.BINARY[name](F.col("val"), F.col("other")).alias("val"))
    kept = both.where("val != 0")
    return a.like(kept if name == "multiply" else kept.where(expr.is_finite(F.col("val"))), coalesced=True)


def union_support(name: str, a: SparseFrame, b: SparseFrame) -> SparseFrame:
    """maximum or minimum over the cells stored on either side, 0.0 where one is missing; zeros are dropped."""
    _like(a, b)
    right = b.coalesce().df.withColumnRenamed("val", "other")
    both = a.coalesce().df.join(right, a.coords, "full")
    value = expr.BINARY[name](F.coalesce("val", F.lit(0.0)), F.coalesce("other", F.lit(0.0)))
    return a.like(both.select(*a.coords, value.alias("val")).where("val != 0"), coalesced=True)


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    n = max(len(a), len(b))
    a, b = (1,) * (n - len(a)) + a, (1,) * (n - len(b)) + b
    if any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
        raise ValueError(f"shapes do not broadcast: {a} and {b}")
    return tuple(y if x == 1 else x for x, y in zip(a, b, strict=True))


def hadamard_broadcast(a: SparseFrame, b: SparseFrame) -> SparseFrame:
    """Products of cells that meet when dimensions of one are stretched; products of zero stay stored.

    The tensors are joined on the dimensions that neither stretches.
    """
    if not isinstance(b, SparseFrame) or b.fmt != "coond" or a.fmt != "coond":
        raise TypeError("both tensors must be coond")
    shape = broadcast_shape(a.shape, b.shape)
    n = len(shape)
    left, right, keys, out = a.coalesce().df.withColumnRenamed("val", "u"), b.coalesce().df.withColumnRenamed("val", "w"), [], []
    left = left.select(*[F.col(c).alias(f"a{k + n - a.ndim}") for k, c in enumerate(a.coords)], "u")
    right = right.select(*[F.col(c).alias(f"b{k + n - b.ndim}") for k, c in enumerate(b.coords)], "w")
    for k in range(n):
        da = a.shape[k - (n - a.ndim)] if k >= n - a.ndim else None
        db = b.shape[k - (n - b.ndim)] if k >= n - b.ndim else None
        if da == db:
            keys.append(F.col(f"a{k}") == F.col(f"b{k}"))
        out.append(F.col(f"b{k}" if da in (None, 1) and db is not None else f"a{k}").alias(f"i{k}"))
    both = left.join(right, keys) if keys else left.crossJoin(right)  # an outer product has as many cells
    cells = both.select(*out, (F.col("u") * F.col("w")).alias("val"))
    return SparseFrame(cells.groupBy(*coord_names(n, "coond")).agg(F.sum("val").alias("val")), shape, "coond", coalesced=True)


def compare(name: str, a, b) -> DenseFrame:
    """equal, not_equal, less, less_equal, greater or greater_equal of all cells, as booleans; of sparse tensors, of the stored cells and zero."""
    return binary(name, *(x.filled() if isinstance(x, SparseFrame) else x for x in (a, b)))


def unary(name: str, a):
    """A function of each value. Of a sparse tensor it is sparse if it keeps zero, else a tensor with another value for missing cells.

    Tests (isnan and the like) of a sparse tensor are booleans with a value for missing cells.
    """
    fn, keeps_zero = expr.UNARY[name]
    if isinstance(a, SparseFrame):
        if keeps_zero and name not in expr.TESTS:
            return a.map_values(fn)
        a = a.filled()
    if isinstance(a, FilledFrame):
        spark = a.stored.sparkSession
        return FilledFrame(a.stored.select(*a.coords, fn(F.col("val")).alias("val")), a.shape, _value(spark, fn(F.lit(a.value))))
    if isinstance(a, StretchedFrame):
        return StretchedFrame(unary(name, a.base), a.shape)
    return DenseFrame(a.df.select(*a.coords, fn(F.col("val")).alias("val")), a.shape)


def _value(spark, value) -> float | bool:
    """A constant expression's value."""
    return spark.range(1).select(value.alias("v")).first()[0]


def _real(x: DenseFrame, shape: tuple[int, ...]) -> tuple[DenseFrame, list[int]]:
    """(the cells that x holds, with as many axes as shape; the axes along which they differ)."""
    base = x.base if isinstance(x, StretchedFrame) else x
    lead = len(shape) - base.ndim
    return base, [k + lead for k, n in enumerate(base.shape) if n != 1]


def aligned(*tensors) -> tuple[DataFrame, tuple[int, ...], tuple[int, ...]]:
    """(rows, real, shape): coordinates and v0, v1 and so on for each cell of the shape that dense tensors broadcast to.

    real is that shape with ones for axes along which all tensors are stretched; rows have their cells once.

    The tensor with the most real axes comes first, and each other one is joined on the axes that are real on both sides; small ones are
    sent to all tasks. So no cell is repeated before it is needed. Tensors that share no axis give an outer product, which
    has as many cells and is dealt out by its size. Of filled tensors the stored cells are joined, if some other tensor has all cells.
    """
    shape: tuple[int, ...] = ()
    for t in tensors:
        shape = broadcast_shape(shape, t.shape)
    names, n = coord_names(len(shape)), len(shape)
    if 0 in shape:
        empty = tensors[0].df.select("val").limit(0)
        return empty.select(*[F.lit(0).cast("long").alias(c) for c in names], *[F.col("val").alias(f"v{k}") for k in range(len(tensors))]), shape, shape
    order = sorted(range(len(tensors)), key=lambda k: (-len(_real(tensors[k], shape)[1]), isinstance(tensors[k], FilledFrame), -tensors[k].size))
    out, known = None, []
    for k in order:
        own, axes = _real(tensors[k], shape)
        lead = n - own.ndim
        lazy = isinstance(own, FilledFrame) and out is not None and set(axes) <= set(known)
        columns = [F.col(own.coords[x - lead]).alias(names[x]) for x in axes]
        df = (own.stored if lazy else own.df).select(*columns, F.col("val").alias(f"v{k}"))
        if out is None:
            out, known = df, axes
            continue
        shared = [names[x] for x in axes if x in known]
        rows = math.prod(shape[x] for x in known)
        if not shared:  # an outer product, or one cell beside all
            out = beside(out, rows, df, own.size)
        elif own.size <= BROADCAST_CELLS:
            out = dealt(out, rows, math.prod(shape[x] for x in axes if x not in known)).join(F.broadcast(df), shared, "left" if lazy else "inner")
        else:
            out = out.join(df, shared, "left" if lazy else "inner")
        if lazy:
            out = out.withColumn(f"v{k}", F.coalesce(f"v{k}", F.lit(own.value)))
        known = known + [x for x in axes if x not in known]
    rows = out.select(*[F.col(c) if x in known else F.lit(0).cast("long").alias(c) for x, c in enumerate(names)], *[f"v{k}" for k in range(len(tensors))])
    return rows, tuple(m if x in known else 1 for x, m in enumerate(shape)), shape


def _of_rows(tensors: list, operands: list, fn) -> DenseFrame:
    """fn of the operands, tensors among them brought together."""
    rows, real, shape = aligned(*tensors)
    at = iter(range(len(tensors)))
    values = [F.col(f"v{next(at)}") if isinstance(x, DenseFrame) else F.lit(x) for x in operands]
    out = DenseFrame(rows.select(*coord_names(len(shape)), fn(*values).alias("val")), real)
    return out if real == shape else StretchedFrame(out, shape)


def combined(fn, *operands) -> DenseFrame:
    """fn of the cells of dense tensors, stretched to one shape, and of numbers.

    Filled tensors of one shape stay filled: their stored cells are brought together, and fn is taken once of the values of the others.
    """
    operands = [x.filled() if isinstance(x, SparseFrame) else x for x in operands]
    tensors = [x for x in operands if isinstance(x, DenseFrame)]
    if all(isinstance(t, FilledFrame) and t.shape == tensors[0].shape for t in tensors):
        return _combined_filled(fn, operands, tensors)
    return _of_rows(tensors, operands, fn)


def _combined_filled(fn, operands: list, tensors: list[FilledFrame]) -> FilledFrame:
    first, spark = tensors[0], tensors[0].stored.sparkSession
    out = first.stored.withColumnRenamed("val", "v0")
    for k, t in enumerate(tensors[1:], 1):
        out = out.join(t.stored.withColumnRenamed("val", f"v{k}"), first.coords, "full")
    at, values, rest = 0, [], []
    for x in operands:
        own = F.lit(x.value if isinstance(x, FilledFrame) else x)
        rest.append(own)
        values.append(F.coalesce(f"v{at}", own) if isinstance(x, FilledFrame) else own)
        at += isinstance(x, FilledFrame)
    return FilledFrame(out.select(*first.coords, fn(*values).alias("val")), first.shape, _value(spark, fn(*rest)))


def binary(name: str, a, b) -> DenseFrame:
    """A function of the cells of dense tensors, stretched to one shape, or of a dense tensor and a number."""
    return combined(expr.BINARY[name], *(x if isinstance(x, DenseFrame) else float(x) for x in (a, b)))


def nextafter(a, toward) -> DenseFrame:
    """The next double from each cell towards another tensor's, or towards a number."""
    @F.pandas_udf("double")
    def step(v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(v, w))

    operands = [x if isinstance(x, DenseFrame) else float(x) for x in (a, toward)]
    return _of_rows([x for x in operands if isinstance(x, DenseFrame)], operands, step)


def sign(a: SparseFrame) -> SparseFrame:
    """-1, 0 or 1 for each stored value; NaN stays."""
    return a.map_values(expr.sign)


def filled(a: SparseFrame) -> DenseFrame:
    return fill(a.coalesce().df, a.coords, a.shape, a.spark)
