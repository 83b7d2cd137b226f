"""Shapes, axes, formats, parts and stored zeros: mostly projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridweave.frame import DenseFrame, SparseFrame, StretchedFrame, coord_names, fill


def _named(a, columns: list[Column], shape) -> SparseFrame | DenseFrame:
    """The same values at other coordinates."""
    if isinstance(a, DenseFrame):
        names = coord_names(len(shape))
        return DenseFrame(a.df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], "val"), shape)
    fmt = a.fmt if len(shape) == 2 else "coond"
    names = coord_names(len(shape), fmt)
    return SparseFrame(a.df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], "val"), shape, fmt, a.coalesced)


def _cols(a) -> list[Column]:
    return [F.col(c) for c in a.coords]


# ---- stored zeros

def prune(a: SparseFrame, eps: float) -> SparseFrame:
    """Drops values of at most eps, and NaN; a negative eps drops nothing."""
    return a if eps < 0 else a.like(a.df.where((F.abs("val") > eps) & ~F.isnan("val")))


def eliminate_zeros(a: SparseFrame) -> SparseFrame:
    """Drops stored zeros. NaN goes with them, but in csr and csc stays if no zero is stored."""
    if a.fmt not in ("csr", "csc"):
        return prune(a, 0.0)
    any_zero = F.broadcast(a.df.agg(F.coalesce(F.max(F.col("val") == 0.0), F.lit(False)).alias("_any")))
    return a.like(a.df.crossJoin(any_zero).where((F.col("val") != 0.0) & ~(F.col("_any") & F.isnan("val"))).drop("_any"))  # one row beside all


# ---- parts and types

def getitem(a: SparseFrame, key):
    """A[i, j] as a number, A[i, :] and A[:, j] as dense vectors."""
    if a.ndim != 2 or not isinstance(key, tuple) or len(key) != 2:
        raise NotImplementedError("only A[i, j], A[i, :] and A[:, j] are supported")
    i, j = key
    is_int = [isinstance(k, int) and not isinstance(k, bool) for k in key]
    everything = [isinstance(k, slice) and k == slice(None) for k in key]
    if all(is_int):
        if not (0 <= i < a.shape[0] and 0 <= j < a.shape[1]):
            raise IndexError(f"no cell {key} in {a.shape}")
        return a.df.where((F.col("row") == i) & (F.col("col") == j)).agg(F.coalesce(F.sum("val"), F.lit(0.0))).first()[0]
    for k in (0, 1):
        if is_int[k] and everything[1 - k]:
            own = a.df.where(F.col(a.coords[k]) == key[k]).groupBy(a.coords[1 - k]).agg(F.sum("val").alias("val"))
            return fill(own, [a.coords[1 - k]], (a.shape[1 - k],), a.spark)
    raise NotImplementedError("only A[i, j], A[i, :] and A[:, j] are supported")


def astype(a: SparseFrame, dtype) -> SparseFrame:
    """A copy; float64 is the only type of values of a sparse tensor. Dense ones also take int64 and bool, which cut and test values."""
    import numpy as np

    if isinstance(a, DenseFrame):
        kinds = {np.dtype(np.float64): "double", np.dtype(np.int64): "long", np.dtype(bool): "boolean"}
        if np.dtype(dtype) not in kinds:
            raise NotImplementedError(f"no values of {dtype}")
        return DenseFrame(a.df.withColumn("val", F.col("val").cast(kinds[np.dtype(dtype)])), a.shape)
    if a.fmt != "csr" or np.dtype(dtype) != np.float64:
        raise NotImplementedError("values are float64, and only csr has astype")
    return a.like(a.df)


def take(a, indices: list[int], axis: int):
    """The given places along an axis, in the given order."""
    k = axis % a.ndim
    picked = a.df.sparkSession.createDataFrame([(int(i) % a.shape[k], n) for n, i in enumerate(indices)], "_at long, _to long")
    own = a.df.join(picked, F.col(a.coords[k]) == F.col("_at"))
    shape = tuple(len(indices) if i == k else n for i, n in enumerate(a.shape))
    out = own.select(*[F.col("_to").alias(c) if i == k else F.col(c) for i, c in enumerate(a.coords)], "val")
    return DenseFrame(out, shape) if isinstance(a, DenseFrame) else a.like(out, shape=shape)


def take_along_axis(a: DenseFrame, indices: DenseFrame, axis: int) -> DenseFrame:
    """For each cell of indices, the value at that place along the axis."""
    k = axis % a.ndim
    own = a.df.select(*[F.col(c).alias("_at" if i == k else c) for i, c in enumerate(a.coords)], "val")
    where = indices.df.select(*indices.coords, F.pmod(F.col("val").cast("long"), F.lit(a.shape[k])).alias("_at"))
    keys = ["_at", *[c for i, c in enumerate(a.coords) if i != k]]
    return DenseFrame(where.join(own, keys).select(*indices.coords, "val"), indices.shape)


def _triangle(a, inside):
    """The cells for which inside(last axis less the one before) holds; the others of a dense tensor are zero."""
    if a.ndim < 2:
        raise ValueError("a triangle needs two axes")
    kept = inside(F.col(a.coords[-1]) - F.col(a.coords[-2]))
    if isinstance(a, SparseFrame):
        return a.like(a.df.where(kept))
    return DenseFrame(a.df.withColumn("val", F.when(kept, F.col("val")).otherwise(F.lit(0.0))), a.shape)


def tril(a, k: int = 0):
    """The lower triangle of a matrix, or of each matrix of a stack."""
    return _triangle(a, lambda apart: apart <= k)


def triu(a, k: int = 0):
    """The upper triangle of a matrix, or of each matrix of a stack."""
    return _triangle(a, lambda apart: apart >= k)


# ---- formats

def _format(a: SparseFrame, fmt: str) -> SparseFrame:
    if a.ndim != 2 or a.fmt == "coond":
        raise NotImplementedError("only matrices change their format")
    return a.coalesce().like(a.coalesce().df, fmt=fmt, coalesced=True) if fmt != "coo" else a.like(a.df, fmt="coo")


def to_csr(a: SparseFrame) -> SparseFrame:
    """Repeated cells are added up; zero sums stay stored."""
    return _format(a, "csr")


def to_csc(a: SparseFrame) -> SparseFrame:
    return _format(a, "csc")


def to_coo(a: SparseFrame) -> SparseFrame:
    return _format(a, "coo")


def row_pointers(a: SparseFrame):
    """(line, ptr): the stored cells before each row (csr) or column (csc), and the total at the end.

    Counts are one row a line, so the running total works on them alone.
    """
    at, n = (a.coords[0], a.shape[0]) if a.fmt == "csr" else (a.coords[1], a.shape[1])
    counts = a.df.groupBy((F.col(at) + 1).alias("line")).agg(F.count("*").alias("n"))
    every = a.spark.range(n + 1).select(F.col("id").alias("line")).join(counts, "line", "left")
    block = 65_536
    every = every.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("block", F.floor(F.col("line") / block))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.groupBy("block").agg(F.sum("n").alias("own")).select("block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    local = every.select("block", "line", F.sum("n").over(inside).alias("ptr"))
    return local.join(carried, "block").select("line", (F.col("ptr") + F.col("carry")).alias("ptr"))


# ---- axes

def permute_axes(a, perm):
    """Axes in another order."""
    perm = [int(p) for p in perm]
    if sorted(perm) != list(range(a.ndim)):
        raise ValueError(f"not an order of {a.ndim} axes: {perm}")
    return _named(a, [F.col(a.coords[p]) for p in perm], tuple(a.shape[p] for p in perm))


def moveaxis(a, source: int, destination: int):
    order = [k for k in range(a.ndim) if k != source % a.ndim]
    order.insert(destination % a.ndim, source % a.ndim)
    return permute_axes(a, order)


def squeeze(a, axis=None):
    drop = [k for k, n in enumerate(a.shape) if n == 1] if axis is None else [k % a.ndim for k in ((axis,) if isinstance(axis, int) else axis)]
    if any(a.shape[k] != 1 for k in drop):
        raise ValueError("only axes of length one can go")
    keep = [k for k in range(a.ndim) if k not in drop]
    return _named(a, [F.col(a.coords[k]) for k in keep], tuple(a.shape[k] for k in keep))


def expand_dims(a, axis: int):
    cols, shape = _cols(a), list(a.shape)
    at = axis % (a.ndim + 1)
    cols.insert(at, F.lit(0).cast("long"))
    shape.insert(at, 1)
    return _named(a, cols, tuple(shape))


def linear_key(columns: list[Column], shape) -> Column:
    """The place of a cell in row-major order; an error beyond 64 bits."""
    key = F.lit(0).cast("long")
    for c, n in zip(columns, shape, strict=True):
        key = key * F.lit(int(n)).cast("long") + c
    return key


def reshape(a, new_shape):
    """Row-major: the same order of cells in another shape; one length may be -1, and follows from the others."""
    new_shape = tuple(int(n) for n in ((new_shape,) if isinstance(new_shape, int) else new_shape))
    if new_shape.count(-1) == 1:
        known = -math.prod(new_shape)
        if not known or math.prod(a.shape) % known:
            raise ValueError(f"{a.shape} does not reshape to {new_shape}")
        new_shape = tuple(math.prod(a.shape) // known if n == -1 else n for n in new_shape)
    if math.prod(new_shape) != math.prod(a.shape):
        raise ValueError(f"{a.shape} does not reshape to {new_shape}")
    keyed = a.df.select(linear_key(_cols(a), a.shape).alias("_key"), "val")
    strides = [math.prod(new_shape[k + 1 :]) for k in range(len(new_shape))]
    cols = [F.expr(f"(_key div {max(1, s)}L) % {max(1, n)}L") for s, n in zip(strides, new_shape, strict=True)]
    if isinstance(a, DenseFrame):
        return DenseFrame(keyed.select(*[c.alias(n) for c, n in zip(cols, coord_names(len(new_shape)), strict=True)], "val"), new_shape)
    names = coord_names(len(new_shape), "coond")
    return SparseFrame(keyed.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], "val"), new_shape, "coond", a.coalesced)


def _unfold(a: SparseFrame, row_axes, fmt: str) -> SparseFrame:
    rows = [int(k) % a.ndim for k in row_axes]
    cols = [k for k in range(a.ndim) if k not in rows]
    parts = [linear_key([F.col(a.coords[k]) for k in own], [a.shape[k] for k in own]) for own in (rows, cols)]
    shape = tuple(math.prod(a.shape[k] for k in own) for own in (rows, cols))
    cells = a.df.select(parts[0].alias("row"), parts[1].alias("col"), "val")
    return SparseFrame(cells, shape, fmt, a.coalesced).coalesce()


def mode_unfold_to_csr(a: SparseFrame, axis: int) -> SparseFrame:
    """A matrix with one axis for rows and the others, in order, for columns; repeats are added up."""
    return _unfold(a, [axis], "csr")


def mode_unfold_to_csc(a: SparseFrame, axis: int) -> SparseFrame:
    return _unfold(a, [axis], "csc")


def axes_unfold_to_csr(a: SparseFrame, row_axes) -> SparseFrame:
    return _unfold(a, row_axes, "csr")


def axes_unfold_to_csc(a: SparseFrame, row_axes) -> SparseFrame:
    return _unfold(a, row_axes, "csc")


# ---- joining, stretching and moving

def concat(tensors: list, axis: int | None = 0):
    """Tensors one after another along an axis; without one, of the vectors of all their cells in row-major order."""
    if axis is None:
        tensors, axis = [reshape(t, (-1,)) if math.prod(t.shape) else reshape(t, (0,)) for t in tensors], 0
    k, first, out, at = axis % tensors[0].ndim, tensors[0], None, 0
    for t in tensors:
        if t.shape[:k] + t.shape[k + 1 :] != first.shape[:k] + first.shape[k + 1 :]:
            raise ValueError("shapes differ beyond the axis")
        own = t.df.withColumn(t.coords[k], F.col(t.coords[k]) + at)
        out, at = own if out is None else out.unionByName(own), at + t.shape[k]
    shape = tuple(at if i == k else n for i, n in enumerate(first.shape))
    return DenseFrame(out, shape) if isinstance(first, DenseFrame) else first.like(out, shape=shape, coalesced=all(t.coalesced for t in tensors))


def stack(tensors: list, axis: int = 0):
    return concat([expand_dims(t, axis) for t in tensors], axis % (tensors[0].ndim + 1))


def unstack(a, axis: int = 0) -> list:
    k = axis % a.ndim
    keep = [i for i in range(a.ndim) if i != k]
    part = lambda j: DenseFrame(a.df.where(F.col(a.coords[k]) == j), a.shape) if isinstance(a, DenseFrame) else a.like(a.df.where(F.col(a.coords[k]) == j))
    return [_named(part(j), [F.col(a.coords[i]) for i in keep], tuple(a.shape[i] for i in keep)) for j in range(a.shape[k])]


def broadcast_to(a, shape):
    """Axes of length one repeated, and axes put in front; a dense tensor carries them without making the cells."""
    shape = tuple(shape)
    lead = len(shape) - a.ndim
    if lead < 0 or any(n not in (1, m) for n, m in zip(a.shape, shape[lead:], strict=True)):
        raise ValueError(f"{a.shape} does not stretch to {shape}")
    cols = [F.lit(0).cast("long")] * lead + _cols(a)
    if isinstance(a, DenseFrame):
        base = a.base if isinstance(a, StretchedFrame) else a
        return StretchedFrame(_named(base, [F.lit(0).cast("long")] * lead + _cols(base), (1,) * lead + base.shape), shape)
    stretched = [k for k, n in enumerate(shape) if k < lead or a.shape[k - lead] == 1 != n]
    wide = _named(a, cols, shape)
    df = wide.df
    for k in stretched:
        df = df.withColumn(wide.coords[k], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[k] - 1).cast("long")))) if shape[k] else df.limit(0)
    return wide.like(df, shape=shape)


def broadcast_arrays(*tensors) -> list:
    from gridweave.operators.elementwise import broadcast_shape

    shape = ()
    for t in tensors:
        shape = broadcast_shape(shape, t.shape)
    return [broadcast_to(t, shape) for t in tensors]


def _moved(a, changed: dict[int, Column]):
    return _named(a, [changed.get(k, c) for k, c in enumerate(_cols(a))], a.shape)


def flip(a, axis=None):
    axes = range(a.ndim) if axis is None else [k % a.ndim for k in ((axis,) if isinstance(axis, int) else axis)]
    return _moved(a, {k: F.lit(a.shape[k] - 1).cast("long") - F.col(a.coords[k]) for k in axes})


def roll(a, shift, axis=None):
    """Cells moved along an axis, or along several by a shift each, round the end; without an axis in row-major order."""
    if isinstance(axis, (tuple, list)):
        for by, k in zip(shift if isinstance(shift, (tuple, list)) else [shift] * len(axis), axis, strict=True):
            a = roll(a, by, k)
        return a
    if axis is None:
        flat = roll(reshape(a, (math.prod(a.shape),)), shift, 0)
        return reshape(flat, a.shape)
    k = axis % a.ndim
    return _moved(a, {k: F.pmod(F.col(a.coords[k]) + shift, F.lit(a.shape[k]).cast("long"))})


def _copied(a, k: int, times: int, place):
    """Each cell `times` over, moved along the axis."""
    shape = tuple(n * times if i == k else n for i, n in enumerate(a.shape))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))
    df = a.df.withColumn("_n", copies).withColumn(a.coords[k], place(F.col(a.coords[k]), F.col("_n"))).drop("_n")
    return DenseFrame(df, shape) if isinstance(a, DenseFrame) else a.like(df, shape=shape)


def repeat(a, repeats: int, axis: int | None = None):
    """Each cell `repeats` times along an axis; without one, of the vector of all cells in row-major order."""
    if axis is None:
        a, axis = reshape(a, (math.prod(a.shape),)), 0
    return _copied(a, axis % a.ndim, repeats, lambda i, n: i * repeats + n)


def tile(a, reps):
    """The tensor side by side so often along each axis; with more numbers than axes, axes are put in front."""
    reps = (reps,) if isinstance(reps, int) else tuple(reps)
    while len(reps) > a.ndim:
        a = expand_dims(a, 0)
    reps = (1,) * (a.ndim - len(reps)) + reps
    for k, times in enumerate(reps):
        own = a.shape[k]
        a = _copied(a, k, times, lambda i, n, own=own: n * own + i)
    return a

