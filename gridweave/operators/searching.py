"""Searching, sorting and sets.

Sorting along an axis is a window on each line of the tensor; long lines, and vectors, are ranked by ranges.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.frame import DenseFrame, SparseFrame, normal_axes
from gridweave.operators import elementwise, reductions
from gridweave.plans.ranges import running_total


def count_nonzero(a: SparseFrame, axis=None, keepdims: bool = False):
    """Stored cells, stored zeros included."""
    if a.fmt == "coond" and axis is not None and len(normal_axes(axis, a.ndim)) < a.ndim:
        raise NotImplementedError("count_nonzero of a coond tensor has no axis")
    return reductions.reduce("count_nonzero", a, axis, keepdims)


def nonzero(a):
    """The coordinates of all cells that are not zero."""
    own = a.coalesce() if isinstance(a, SparseFrame) else a
    return own.df.where("val != 0").select(*a.coords)


def arg_extreme(name: str, a: DenseFrame, axis: int, keepdims: bool = False) -> DenseFrame:
    """argmax or argmin along an axis: the first place of the largest or smallest value, or of the first NaN."""
    k = axis % a.ndim
    rest = [c for i, c in enumerate(a.coords) if i != k]
    best = F.max(F.struct("val", (-F.col(a.coords[k])).alias("at"))) if name == "argmax" else F.min(F.struct(~F.isnan("val"), "val", F.col(a.coords[k]).alias("at")))
    place = F.abs(F.col("best.at"))
    shape = tuple(n for i, n in enumerate(a.shape) if i != k)
    names = ["row", "col"] if len(shape) == 2 else [f"i{i}" for i in range(len(shape))]
    out = a.df.groupBy(*rest).agg(best.alias("best"))
    done = DenseFrame(out.select(*[F.col(c).alias(n) for c, n in zip(rest, names, strict=True)], place.alias("val")), shape)
    if not keepdims:
        return done
    from gridweave.operators.manipulation import expand_dims

    return expand_dims(done, k)


def where(cond, x, y) -> DenseFrame:
    """x where cond is true, else y: tensors that broadcast to one shape, or numbers. A sparse tensor is true where it is not zero."""
    return elementwise.combined(lambda c, u, v: F.when(c.cast("boolean"), u).otherwise(v), *(k if isinstance(k, (DenseFrame, SparseFrame)) else float(k) for k in (cond, x, y)))


def searchsorted(x: DenseFrame, v: DenseFrame, side: str = "left") -> DenseFrame:
    """For each value of v, how many values of the sorted vector x are smaller (left) or not larger (right).

    Both are counted in one order: values of x rank before equal values of v on the right, after them on the left.
    """
    first, second = (0, 1) if side == "right" else (1, 0)
    both = x.df.select(F.lit(first).alias("rank"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("i0"), "val")
    both = both.unionByName(v.df.select(F.lit(second).alias("rank"), F.lit(0).alias("one"), "i0", "val"))
    counted = running_total(both, ["val", "rank", "i0"], F.col("one"), "n").where("one = 0")
    return DenseFrame(counted.select("i0", F.col("n").alias("val")), v.shape)


def unique_values(a: DenseFrame):
    """(val): each value once, in no order; all NaNs are one value here."""
    return a.df.select("val").distinct()


def unique_counts(a: DenseFrame):
    """(val, count)."""
    return a.df.groupBy("val").agg(F.count("*").alias("count"))


def unique_inverse(a: DenseFrame):
    """(coordinates, val, inverse): the rank of each cell's value among the different values."""
    ranks = running_total(unique_values(a), ["val"], F.lit(1).cast("long"), "n").select("val", (F.col("n") - 1).alias("inverse"))
    return a.df.join(ranks, "val").select(*a.coords, "val", "inverse")


def unique_all(a: DenseFrame):
    """(val, count, index): also the first place of each value in row-major order."""
    from gridweave.operators.manipulation import linear_key

    key = linear_key([F.col(c) for c in a.coords], a.shape)
    return a.df.groupBy("val").agg(F.count("*").alias("count"), F.min(key).alias("index"))


#: Cells of a line from which lines are ranked by ranges of all cells, so that one is dealt to many tasks.
LONG_LINE = 1_000_000


def _ranked(a: DenseFrame, axis: int, descending: bool):
    """(axis, cells with _to, the place that each takes in its line): equal values keep their order, NaN counts as largest.

    All lines are equally long, so in an order by line and value the place in a line is the rank among all cells less whole lines.
    """
    k = axis % a.ndim
    lines = [c for i, c in enumerate(a.coords) if i != k]
    own = a.df.withColumn("_nan", F.isnan("val") if not descending else ~F.isnan("val")).withColumn("_by", F.when(F.isnan("val"), 0.0).otherwise(-F.col("val") if descending else F.col("val")))
    if lines and a.shape[k] <= LONG_LINE:
        line = Window.partitionBy(*lines).orderBy("_nan", "_by", a.coords[k])
        return k, own.withColumn("_to", (F.row_number().over(line) - 1).cast("long"))
    ranked = running_total(own, [*lines, "_nan", "_by", a.coords[k]], F.lit(1).cast("long"), "_to")
    return k, ranked.withColumn("_to", (F.col("_to") - 1) % max(1, a.shape[k]))


def sort(a: DenseFrame, axis: int = -1, descending: bool = False) -> DenseFrame:
    """Each line along the axis in ascending order, NaN last, or in descending order, NaN first."""
    k, ranked = _ranked(a, axis, descending)
    return DenseFrame(ranked.select(*[F.col("_to").alias(c) if i == k else F.col(c) for i, c in enumerate(a.coords)], "val"), a.shape)


def argsort(a: DenseFrame, axis: int = -1, descending: bool = False) -> DenseFrame:
    """The places of each line's values in ascending or descending order; equal values keep their order."""
    k, ranked = _ranked(a, axis, descending)
    at = F.col(a.coords[k]).alias("val")
    return DenseFrame(ranked.select(*[F.col("_to").alias(c) if i == k else F.col(c) for i, c in enumerate(a.coords)], at), a.shape)
