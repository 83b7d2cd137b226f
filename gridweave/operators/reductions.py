"""Reductions over axes, with missing cells counted as zeros, and running sums, products and differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridweave.frame import DenseFrame, FilledFrame, SparseFrame, coord_names, fill, grid, normal_axes
from gridweave.functions.expr import binomials, power


def _partials(name: str) -> dict[str, Column]:
    """What each reduction gathers from the stored cells of a group."""
    v = F.col("val")
    if name in ("sum", "mean"):
        return {"s": F.sum(v)}
    if name in ("var", "std"):
        return {"n": F.count("*"), "s": F.avg(v), "q": F.var_pop(v)}
    if name in ("min", "max"):
        return {"n": F.count("*"), "m": getattr(F, name)(F.when(~F.isnan(v), v)), "x": F.max(F.isnan(v))}
    if name == "prod":
        return {"n": F.count("*"), "p": F.product(v)}
    if name in ("all", "any"):
        return {"n": F.sum((v != 0.0).cast("long"))}
    return {"n": F.count("*")}


def _result(name: str, cells: int, correction: float) -> Column:
    """The reduction of a group of so many cells, from what was gathered; nulls stand for no stored cell."""
    n, zero = F.coalesce("n", F.lit(0)) if name not in ("sum", "mean") else None, F.lit(0.0)
    s = F.coalesce("s", zero) if n is None else None
    if name == "sum":
        return s
    if name == "mean":
        return s * F.lit(1.0 / cells) if cells else zero
    if name in ("var", "std"):
        if cells - correction <= 0:
            return zero
        mean, apart = F.coalesce("s", zero), F.coalesce("q", zero)  # of the stored cells; missing ones pull the mean towards zero
        var = n * (apart + mean * mean * (F.lit(float(cells)) - n) / F.lit(float(cells))) / F.lit(float(cells - correction))
        var = F.greatest(zero, var)
        return F.sqrt(var) if name == "std" else var
    if name in ("min", "max"):
        own = F.coalesce("m", zero)
        pick = F.least if name == "min" else F.greatest
        return F.when(n < cells, pick(own, zero)).otherwise(own) if cells else zero
    if name == "prod":
        return F.when(n < cells, zero).otherwise(F.coalesce("p", F.lit(1.0)))
    if name == "all":
        return n >= cells
    if name == "any":
        return n > 0
    return n


def reduce(name: str, a: SparseFrame, axis=None, keepdims: bool = False, correction: float = 0.0, nan: bool = False):
    """A reduction of a sparse tensor over an axis, axes or all of it.

    Of a matrix it is a DenseFrame, with a cell for every row or column; over an axis of a coond tensor it is
    a coond tensor of the groups that have stored cells. sum, mean, all and any read repeated cells as their
    sum; the others take stored entries as they are. min and max skip NaN, or with nan give it wherever there is one;
    all and any take it as true.
    """
    axes = normal_axes(axis, a.ndim)
    kept = [k for k in range(a.ndim) if k not in axes]
    cells = math.prod(a.shape[k] for k in axes)
    source = a.coalesce().df if name in ("all", "any") and a.fmt == "coo" else a.df
    names, shape = [a.coords[k] for k in kept], tuple(a.shape[k] for k in kept)
    partial = source.groupBy(*names).agg(*[c.alias(k) for k, c in _partials(name).items()])
    value = _result(name, cells, correction)
    if nan and name in ("min", "max"):
        value = F.when(F.col("x"), F.lit(math.nan)).otherwise(value)
    if a.fmt == "coond" and kept:
        own = partial.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(names)], value.alias("val"))
        out = SparseFrame(own, shape, "coond", coalesced=True)
        return _kept_sparse(out, a.ndim, axes) if keepdims else out
    reduced = partial.select(*names, value.alias("val"))
    if not kept:
        done = DenseFrame(reduced, ())
    else:
        done = fill(reduced, names, shape, a.spark, _default(name, cells))
    return _kept_dense(done, a.ndim, axes, kept) if keepdims else done


def reduce_filled(name: str, a: FilledFrame, axis=None, keepdims: bool = False) -> DenseFrame:
    """sum, mean, prod, min, max, all or any over all cells of a filled tensor, from its stored cells and how many there are.

    NaN is what min and max of a line with NaN are; all and any take it as true.
    """
    axes = normal_axes(axis, a.ndim)
    kept = [k for k in range(a.ndim) if k not in axes]
    cells, names, shape = math.prod(a.shape[k] for k in axes), [a.coords[k] for k in kept], tuple(a.shape[k] for k in kept)
    v, other = F.col("val").cast("double"), F.lit(float(a.value))
    sums = {
        "n": F.count("*"), "s": F.sum(v), "p": F.product(v), "t": F.sum((v != 0).cast("long")), "x": F.max(F.isnan(v)),
        "lo": F.min(F.when(~F.isnan(v), v)), "hi": F.max(F.when(~F.isnan(v), v)),
    }

    def value(n: Column, s: Column, p: Column, t: Column, x: Column, lo: Column, hi: Column) -> Column:
        rest = F.lit(cells) - n
        true = t + (rest if a.value else F.lit(0))
        if name in ("sum", "mean"):
            total = s + F.when(rest > 0, rest * other).otherwise(0.0)
            return total if name == "sum" else total / F.lit(float(cells)) if cells else F.lit(0.0)
        if name == "prod":
            return p * F.when(rest > 0, power(other, rest.cast("double"))).otherwise(1.0)
        if name in ("all", "any"):
            return true >= cells if name == "all" else true > 0
        own, pick = (lo, F.least) if name == "min" else (hi, F.greatest)
        return F.when(x | ((rest > 0) & F.isnan(other)), math.nan).when(rest > 0, F.coalesce(pick(own, other), other)).otherwise(own)

    none = [F.lit(0), F.lit(0.0), F.lit(1.0), F.lit(0), F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("double")]
    gathered = a.stored.groupBy(*names).agg(*[c.alias(k) for k, c in sums.items()])
    own = value(*[F.coalesce(F.col(k), first) for k, first in zip(sums, none, strict=True)])
    reduced = gathered.select(*names, own.alias("val"))
    done = DenseFrame(reduced, ()) if not kept else fill(reduced, names, shape, a.stored.sparkSession, value(*none))
    return _kept_dense(done, a.ndim, axes, kept) if keepdims else done


def _default(name: str, cells: int) -> Column:
    """The reduction of a group without stored cells."""
    if name == "all":
        return F.lit(cells == 0)
    if name == "any":
        return F.lit(False)
    if name == "count_nonzero":
        return F.lit(0).cast("long")
    return F.lit(1.0 if name == "prod" and cells == 0 else 0.0)


def _kept_dense(done: DenseFrame, ndim: int, axes: tuple[int, ...], kept: list[int]) -> DenseFrame:
    names = coord_names(ndim)
    at = {k: F.col(done.coords[i]) for i, k in enumerate(kept)}
    shape = tuple(1 if k in axes else done.shape[kept.index(k)] for k in range(ndim))
    return DenseFrame(done.df.select(*[at.get(k, F.lit(0).cast("long")).alias(c) for k, c in enumerate(names)], "val"), shape)


def _kept_sparse(out: SparseFrame, ndim: int, axes: tuple[int, ...]) -> SparseFrame:
    kept = [k for k in range(ndim) if k not in axes]
    cols = [F.lit(0).cast("long").alias(f"i{k}") if k in axes else F.col(f"i{kept.index(k)}").alias(f"i{k}") for k in range(ndim)]
    return SparseFrame(out.df.select(*cols, "val"), tuple(1 if k in axes else out.shape[kept.index(k)] for k in range(ndim)), "coond", coalesced=True)


def sum(a: SparseFrame, axis=None, keepdims: bool = False):  # noqa: A001
    return reduce("sum", a, axis, keepdims)


def mean(a: SparseFrame, axis=None, keepdims: bool = False):
    return reduce("mean", a, axis, keepdims)


def reduce_sum_axes(a: SparseFrame, axes) -> SparseFrame:
    return reduce("sum", a, axes)


def reduce_mean_axes(a: SparseFrame, axes) -> SparseFrame:
    return reduce("mean", a, axes)


#: Cells of a line that one window runs over; longer lines are cut, and what comes before a cut is carried over.
CHUNK = 65_536


def _running(df, lines: list[str], at: str, length: int, **totals):
    """df with running totals along each line, by name: (column, running aggregate, how two of them combine, what none is)."""
    chunked = length > CHUNK
    own = df.withColumn("_chunk", F.floor(F.col(at) / CHUNK)) if chunked else df
    keys = [*lines, "_chunk"] if chunked else lines
    window = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = own.select("*", *[fn(c).over(window).alias(k) for k, (c, fn, _, _) in totals.items()])
    if not chunked:
        return local
    before = Window.partitionBy(*lines).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = own.groupBy(*keys).agg(*[fn(c).alias("_w_" + k) for k, (c, fn, _, _) in totals.items()])
    carried = whole.select(*keys, *[F.coalesce(fn("_w_" + k).over(before), F.lit(none)).alias("_b_" + k) for k, (_, fn, _, none) in totals.items()])
    both = local.join(carried, keys)
    for k, (_, _, combine, _) in totals.items():
        both = both.withColumn(k, combine(F.col(k), F.col("_b_" + k)))
    return both


def _axis_of(a, axis) -> int:
    if axis is None:
        if a.ndim == 1:
            return 0
        raise NotImplementedError("a running sum or product needs an axis")
    return normal_axes(axis, a.ndim)[0]


def _plain_names(a) -> tuple:
    """(cells, each once, with the names of a dense tensor's coordinates; these names)."""
    names = coord_names(a.ndim)
    df = a.coalesce().df if isinstance(a, SparseFrame) else a.df
    return df.select(*[F.col(c).alias(n) for c, n in zip(a.coords, names, strict=True)], "val"), names


def cumulative_sum(a, axis=None) -> DenseFrame:
    """Running sums along an axis, for every cell.

    The stored cells of a line are summed up in order, with one of zero at its start and at each chunk's; every sum then
    stands for the cells up to the next stored one. Lines are all that is counted out, no grid of cells is joined.
    """
    k = _axis_of(a, axis)
    cells, names = _plain_names(a)
    lines, at, length = [c for i, c in enumerate(names) if i != k], names[k], a.shape[k]
    if not isinstance(a, SparseFrame):
        out = _running(cells, lines, at, length, total=("val", F.sum, lambda x, y: x + y, 0.0))
        return DenseFrame(out.select(*names, F.col("total").alias("val")), a.shape)
    starts = grid(a.spark, tuple(n for i, n in enumerate(a.shape) if i != k), lines) if lines else a.spark.range(1).select()
    first = F.sequence(*[F.lit(x).cast("long") for x in (0, max(0, length - 1), CHUNK)])
    starts = starts.select(*lines, F.explode(first).alias(at), F.lit(0.0).alias("val"))
    starts = starts if length else starts.limit(0)
    both = cells.unionByName(starts).groupBy(*names).agg(F.sum("val").alias("val"))
    out = _running(both, lines, at, length, total=("val", F.sum, lambda x, y: x + y, 0.0))
    chunk = F.floor(F.col(at) / CHUNK)
    following = F.lead(at).over(Window.partitionBy(*lines, chunk).orderBy(at))
    last = F.coalesce(following - 1, F.least((chunk + 1) * CHUNK, F.lit(length)) - 1)
    spread = out.withColumn("_last", last).withColumn("_at", F.explode(F.sequence(F.col(at), F.col("_last"))))
    return DenseFrame(spread.select(*[F.col("_at").alias(c) if i == k else F.col(c) for i, c in enumerate(names)], F.col("total").alias("val")), a.shape)


def cumulative_prod(a, axis=None) -> DenseFrame:
    """Running products along an axis, for every cell: 0.0 from the first missing cell on.

    Only the stored cells before that have another value, so of a sparse tensor these alone are held.
    """
    k = _axis_of(a, axis)
    cells, names = _plain_names(a)
    lines, at = [c for i, c in enumerate(names) if i != k], names[k]
    out = _running(cells, lines, at, a.shape[k], total=("val", F.product, lambda x, y: x * y, 1.0), held=(F.lit(1), F.sum, lambda x, y: x + y, 0))
    if not isinstance(a, SparseFrame):
        return DenseFrame(out.select(*names, F.col("total").alias("val")), a.shape)
    return FilledFrame(out.where(F.col("held") == F.col(at) + 1).select(*names, F.col("total").alias("val")), a.shape, 0.0)


def diff(a, n: int = 1, axis: int = -1) -> SparseFrame:
    """The n-th difference along an axis of a matrix or of a tensor of any number of axes; zeros are dropped.

    Each stored cell adds to at most n + 1 cells of the result, with signed binomials for weights.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return a
    (k,) = normal_axes(axis, a.ndim)
    shape = tuple(max(0, d - n) if i == k else d for i, d in enumerate(a.shape))
    at, others = a.coords[k], [c for i, c in enumerate(a.coords) if i != k]
    weights = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.lit(float(w)).alias("w")) for j, w in enumerate(binomials(n))]))
    spread = a.coalesce().df.select(*others, at, "val", weights.alias("x")).select(*others, (F.col(at) - F.col("x.j")).alias(at), (F.col("val") * F.col("x.w")).alias("val"))
    inside = spread.where((F.col(at) >= 0) & (F.col(at) < shape[k]))
    return a.like(inside.groupBy(*a.coords).agg(F.sum("val").alias("val")).where("val != 0"), shape=shape, coalesced=True)
